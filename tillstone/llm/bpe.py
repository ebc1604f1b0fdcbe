"""BPE encoding and decoding with a contiguous rank array per word.

A word is a string with the part boundaries and the merge rank of each two neighbouring
parts in two plain lists. The least rank is found by scanning the list, the boundary
between its two parts goes, and the ranks beside it are looked up anew. Words are short, so
a scan beats a queue; a word of over ``SHORT`` symbols takes a queue with the same result.

White space ends a word in this family of vocabularies, so texts are cut at ASCII white
space first and each distinct piece is encoded once per worker while it is cached.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillstone.llm import common

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SHORT = 256
_NEVER = 1 << 60


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (given as text).

    The library normalises and splits words as the file says; merging is done here.
    """

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        model = parsed["model"]
        if parsed.get("decoder") is not None:
            raise ValueError("only vocabularies without a decoder are supported")
        library = Tokenizer.from_str(spec)
        self._normal, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        self.special = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, at in [*self.ids.items(), *self.special.items()]:
            self.tokens[at] = token
        self._pieces: dict[str, list[int]] = {}
        self._plain = [x for x, _ in self._split(self._normal("ABCxyz"))] == ["abcxyz"]
        self.cache = common.WordCache(lambda words: [self.word(w.decode("utf-8", "replace")) for w in words])

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece of a word."""
        whole = piece + self.suffix
        bounds = [*range(len(piece)), len(whole)]
        if len(piece) > SHORT:
            bounds = self._merge_long(whole, bounds)
        else:
            rank = self.rank.get
            parts = [whole[a:b] for a, b in zip(bounds, bounds[1:])]
            ranks = [rank(pair, _NEVER) for pair in zip(parts, parts[1:])]
            while ranks and (least := min(ranks)) < _NEVER:
                i = ranks.index(least)
                del bounds[i + 1], ranks[i]
                middle = whole[bounds[i]:bounds[i + 1]]
                if i < len(ranks):
                    ranks[i] = rank((middle, whole[bounds[i + 1]:bounds[i + 2]]), _NEVER)
                if i:
                    ranks[i - 1] = rank((whole[bounds[i - 1]:bounds[i]], middle), _NEVER)
        return [self.ids[x] for a, b in zip(bounds, bounds[1:]) if (x := whole[a:b]) in self.ids]

    def _merge_long(self, whole: str, bounds: list[int]) -> list[int]:
        """The boundaries left in a long piece: the same merges from a queue of (rank, place)."""
        after = {a: b for a, b in zip(bounds, bounds[1:])}
        before = {b: a for a, b in after.items()}
        end = bounds[-1]

        def pair(at: int) -> int:
            middle = after.get(at, end)
            return self.rank.get((whole[at:middle], whole[middle:after[middle]]), _NEVER) if middle < end else _NEVER

        queue = [(r, at) for at in bounds[:-1] if (r := pair(at)) < _NEVER]
        heapq.heapify(queue)
        while queue:
            r, at = heapq.heappop(queue)
            if at not in after or pair(at) != r:
                continue
            middle = after[at]
            after[at] = after.pop(middle)
            before[after[at]] = at
            before.pop(middle)
            for place in (at, before.get(at, end)):
                if place < end and (r := pair(place)) < _NEVER:
                    heapq.heappush(queue, (r, place))
        return [*sorted(after), end]

    def word(self, word: str) -> list[int]:
        """Ids of text without ASCII white space."""
        if self._marks is not None and any(x in word for x in self.special):
            return [i for part in self._marks.split(word) if part
                    for i in ([self.special[part]] if part in self.special else self.word(part))]
        out: list[int] = []
        # ASCII letters are one piece, the same in bytes, unless a file says otherwise.
        plain = self._plain and word.isascii() and word.isalpha()
        for piece, _ in [(word.lower(), None)] if plain else self._split(self._normal(word)):
            if (ids := self._pieces.get(piece)) is None:
                if len(self._pieces) > 200_000:
                    self._pieces.clear()
                ids = self._pieces[piece] = self.merge(piece)
            out += ids
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        split = [x.split() for x in texts]
        values, sizes = self.cache.values([w for words in split for w in words])
        return values, common.per_text(sizes, [len(words) for words in split])

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by a space; unknown ids are left out."""
        known = len(self.tokens)
        return " ".join([self.tokens[i] for i in ids if 0 <= i < known])


def codec(path: str, spec: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return common.only(("codec", path), lambda: Codec(spec))


def _shipped(df: DataFrame, path: str):
    """The vocabulary as a broadcast: its size does not depend on the data."""
    with open(path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(df: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row: the ids of the whole text; null and empty texts have none.

    One row out per row in, repeated and null ids included; further columns are left behind.
    """
    spec = _shipped(df, path)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        flat, sizes = codec(path, spec.value).encode(common.texts_of(batch))
        return {"id": batch.column("id"), "ids": common.nested(flat.astype(np.int32), sizes, pa.int32())}

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_batches(rows, work, "id long, ids array<int>")


def decode(df: DataFrame, path: str = VOCABULARY, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row: the text of its ids; null and empty lists give empty text."""
    spec = _shipped(df, path)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        own = codec(path, spec.value)
        return {"id": batch.column("id"), "text": [own.decode(x or []) for x in batch.column("ids").to_pylist()]}

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return common.map_batches(rows, work, "id long, text string", column="ids")


def round_trip(df: DataFrame, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of each text and the text decoded from those ids.

    Both in one pass, since a worker that has the ids at hand need not send them twice.
    """
    spec = _shipped(df, path)

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        own = codec(path, spec.value)
        flat, sizes = own.encode(common.texts_of(batch))
        ids, start, decoded = flat.tolist(), 0, []
        for size in sizes.tolist():
            decoded.append(own.decode(ids[start:start + size]))
            start += size
        return {"id": batch.column("id"), "ids": common.nested(flat.astype(np.int32), sizes, pa.int32()), "decoded": decoded}

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_batches(rows, work, "id long, ids array<int>, decoded string", limit=1 << 20)


def digests(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of documents, from ``round_trip``."""
    return round_trip(df, path).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
