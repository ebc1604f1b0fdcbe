"""Token-id files: Simple-8b words in blocks, written in id order and read back.

A 64-bit word holds a selector in its top four bits and as many values as fit at the
selector's width below. Selector 0 is an escape: its low bits number a value of the block
that needs over 60 bits and is kept whole in the block's escape list. Every ``GROUP``
values a new word begins, and the block lists the word each group begins at, so groups
decode alone and all words of one selector decode as one array operation.

Files are Parquet tables of blocks: Spark's committer then keeps a shard whole when an
executor is lost and its task runs again. A block holds whole documents.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tillstone.llm import common

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
GROUP = 4096
BLOCK_IDS = 1 << 19
#: Values per word and bits per value of selectors 1 to 15.
MODES = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNTS = np.array([1, *(c for c, _ in MODES)], np.int64)
_HEAD = struct.Struct("<4sIIII")
_MAGIC = b"S8B1"


def _bits(values: np.ndarray) -> np.ndarray:
    """The width of each value."""
    if not len(values) or int(values.max()) < 1 << 53:  # exact as doubles, whose exponent is the width
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    out = np.zeros(len(values), np.uint8)
    most, width = int(values.max(initial=0)), 0
    while most >> width:
        out += values >= np.uint64(1 << width)
        width += 1
    return out


def _plan(bits: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the word that begins at each place ends, and its selector, a word taking all it can."""
    n = len(bits)
    place = np.arange(n, dtype=np.int32)
    end = np.minimum((place // group + 1) * group, n)
    selector = np.zeros(n, np.uint8)
    step = np.ones(n, np.int32)
    widest = int(bits.max(initial=0))
    windows = [bits]  # the widest of the next 1, 2, 4 ... values; 255 where there are fewer

    def both(most: np.ndarray, apart: int) -> np.ndarray:
        out = np.full(n, 255, np.uint8)
        if n > apart:
            np.maximum(most[:-apart], most[apart:], out=out[:-apart])
        return out

    for at in range(len(MODES), 0, -1):  # the most values per word come last and win
        count, width = MODES[at - 1]
        if width >= widest:
            if at > 1 and MODES[at - 2][1] >= widest:
                continue  # the next selector holds every value too, and more of them
            selector[:], step[:] = at, count
            continue
        power = count.bit_length() - 1
        while len(windows) <= power:
            windows.append(both(windows[-1], 1 << len(windows) - 1))
        more = count - (1 << power)
        fits = (both(windows[power], more) if more else windows[power]) <= width
        if not fits.any():
            break  # a run for a selector of more and narrower values would be one for this
        np.copyto(selector, np.uint8(at), where=fits)
        np.copyto(step, np.int32(count), where=fits)
    return np.minimum(place + step, end), selector


def _begins(after: np.ndarray, group: int) -> np.ndarray:
    """Where words begin, found in all groups at the same time: ``after`` tells where each place's word ends."""
    n = len(after)
    at = np.arange(0, n, group)
    ends = np.minimum(at + group, n)
    steps = []
    while (open_ := at < ends).any():
        steps.append(at)
        at = np.where(open_, after[np.minimum(at, n - 1)], ends)
    steps = np.stack(steps, axis=1) if steps else np.empty((0, 0), np.int64)
    return steps[steps < ends[:, None]]  # group after group


def pack(values: np.ndarray, group: int = GROUP) -> bytes:
    """A block of unsigned 64-bit values; none give a block without words."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    after, selectors = np.empty(n, np.int64), np.empty(n, np.uint8)
    for start in range(0, n, 16 * group):  # groups are independent; so many fit in the cache
        own = slice(start, start + 16 * group)
        stop, selectors[own] = _plan(_bits(values[own]), group)
        after[own] = stop + start
    first = _begins(after, group)
    chosen = selectors[first]
    end = np.minimum((first // group + 1) * group, n)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for mode, (count, width) in enumerate(MODES, 1):
        if width and len(own := np.flatnonzero(chosen == mode)):
            begin, stop, held = first[own], end[own], words[own]
            for k in range(count):
                value = values[np.minimum(begin + k, n - 1)]
                value[begin + k >= stop] = 0
                held |= value << np.uint64(k * width)
            words[own] = held
    own = np.flatnonzero(chosen == 0)
    words[own] = np.arange(len(own), dtype=np.uint64)
    escapes = values[first[own]]
    groups = np.searchsorted(first, np.arange(0, n, group)).astype("<u4")
    return b"".join((
        _HEAD.pack(_MAGIC, n, len(words), len(escapes), group), groups.tobytes(),
        escapes.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
    ))


def unpack(block: bytes, only_group: int | None = None) -> np.ndarray:
    """All values of a block, or those of one group."""
    magic, n, n_words, n_escapes, group = _HEAD.unpack_from(block)
    if magic != _MAGIC:
        raise ValueError("not a Simple-8b block")
    n_groups = -(-n // group)
    at = _HEAD.size
    begins = np.frombuffer(block, "<u4", n_groups, at).astype(np.int64)
    escapes = np.frombuffer(block, "<u8", n_escapes, at := at + 4 * n_groups)
    words = np.frombuffer(block, "<u8", n_words, at + 8 * n_escapes)
    lengths = np.minimum(group, n - np.arange(n_groups, dtype=np.int64) * group)
    if only_group is not None:
        stops = np.append(begins, n_words)
        words = words[stops[only_group]:stops[only_group + 1]]
        begins, lengths, n = np.zeros(1, np.int64), lengths[only_group:only_group + 1], int(lengths[only_group])
    selectors = (words >> np.uint64(60)).astype(np.int64)
    held = _COUNTS[selectors]
    if len(begins):  # the last word of a group may hold fewer than its selector says
        stops = np.append(begins[1:], len(words))
        sums = np.concatenate(([0], np.cumsum(held)))
        held[stops - 1] -= sums[stops] - sums[begins] - lengths
    start = np.cumsum(held) - held
    out = np.zeros(n, np.uint64)
    for mode, (count, width) in enumerate(MODES, 1):
        if width and len(own := np.flatnonzero(selectors == mode)):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            values = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
            inside = np.arange(count) < held[own][:, None]
            out[(start[own][:, None] + np.arange(count))[inside]] = values[inside]
    own = np.flatnonzero(selectors == 0)
    out[start[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out


_encoders: dict[str, common.WordCache] = {}


#: How a vocabulary file says that words are lower-cased and cut into letters, single digits and signs, in bytes.
_CUT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: ASCII but the apostrophe and letters of Latin-1: NFC leaves them, and letters, digits and signs are told apart at sight.
_PLAIN = re.compile("[!-&(-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_PIECES = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^0-9a-z\u00DF-\u00F6\u00F8-\u00FF]+")
#: Characters that stand for bytes without one of their own, of those that such letters have.
_BYTES = {**{128 + k: 290 + k for k in range(33)}, 173: 323}
#: Pieces whose ids a worker keeps.
KEPT_PIECES = 300_000


def _shown(piece: str) -> str:
    """A piece as the model takes it, a character for each byte."""
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)


def _letters_alone(own: Tokenizer) -> bool:
    """Whether a word of ASCII letters goes to the model as it is, but for lower case."""
    if own.normalizer is None or own.pre_tokenizer is None or any(x.content.isalpha() for x in own.get_added_tokens_decoder().values()):
        return False
    return [x for x, _ in own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str("ABCxyz"))] == ["abcxyz"]


def _encoder(path: str, spec: str) -> common.WordCache:
    """The library's ids of words; the vocabulary treats texts word by word."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = Tokenizer.from_str(spec)
        own.no_truncation()
        own.no_padding()
        plain, model, pieces = _letters_alone(own), own.model.tokenize, {}
        cut = plain and {k: json.loads(spec).get(k) for k in _CUT} == _CUT
        special = [x.content.lower() for x in own.get_added_tokens_decoder().values()]

        def pieces_of(word: bytes) -> list[str] | None:
            """The pieces that the file cuts a word into; None where the library has to tell."""
            if plain and word.isalpha():
                return [word.decode().lower()]
            if not cut or not _PLAIN.fullmatch(text := word.decode("utf-8", "replace")):
                return None
            text = text.lower()
            return None if any(x in text for x in special) else _PIECES.findall(text)

        def ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # The library's model takes the pieces of plain words at once, each once while it is kept.
            values, counts, others = [], [], []
            for w in words:
                before = len(values)
                if (found := pieces_of(w)) is None:
                    others.append(w)
                    counts.append(-1)
                    continue
                for piece in found:
                    if (got := pieces.get(piece)) is None:
                        if len(pieces) >= KEPT_PIECES:
                            pieces.clear()
                        got = pieces[piece] = tuple([t.id for t in model(_shown(piece))])
                    values += got
                counts.append(len(values) - before)
            other_ids, other_sizes = marked(others)
            sizes = np.array(counts, np.int64)
            own_words = sizes >= 0
            sizes[~own_words] = other_sizes
            starts = np.empty(len(words), np.int64)
            starts[own_words] = np.cumsum(sizes[own_words]) - sizes[own_words]
            starts[~own_words] = len(values) + np.cumsum(other_sizes) - other_sizes
            flat = np.concatenate((np.array(values, np.uint32), other_ids))
            return flat[common.spans(sizes, starts)], sizes

        def marked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # Many words in one call, a mark between them; a word that holds the mark goes alone.
            sizes, parts = np.empty(len(words), np.int64), [np.empty(0, np.uint32)]
            for at in range(0, len(words), 1000):
                some = words[at:at + 1000]
                text = b" \0 ".join(some)
                if text.count(b"\0") == len(some) - 1:
                    got = np.array(encode(text.decode("utf-8", "replace")), np.uint32)
                    bounds = np.flatnonzero(got == mark)
                    sizes[at:at + len(some)] = np.diff(bounds, prepend=-1, append=len(got)) - 1
                    parts.append(got[got != mark])
                else:
                    each = [encode(w.decode("utf-8", "replace")) for w in some]
                    sizes[at:at + len(some)] = [len(x) for x in each]
                    parts += [np.array(x, np.uint32) for x in each]
            return np.concatenate(parts), sizes

        def encode(text: str) -> list[int]:
            return own.encode_batch_fast([text], add_special_tokens=False)[0].ids

        (mark,) = encode("\0")
        _encoders[path] = common.WordCache(ids)
    return _encoders[path]


BLOCK_SCHEMA = "shard int, block int, start long, n_ids long, doc_ids array<long>, n_tokens array<long>, payload binary"


def write_token_file(
    df: DataFrame, folder: str, path: str = VOCABULARY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Encodes every text, appends ``end_id`` and writes blocks in ascending order of the id.

    Documents are range partitioned on the id, so shard k holds smaller ids than shard k + 1
    and no task sees more than its share. Null texts are empty; rows with equal ids stay
    in the order of their texts; a null id comes first.
    """
    with open(path, encoding="utf-8") as file:
        spec = df.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = _encoder(path, spec.value), TaskContext.get().partitionId()
        block = start = 0
        keys: list = []
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            values = np.concatenate(parts)
            lengths = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays([
                pa.array([x], type=f.type) for x, f in
                zip((shard, block, start, len(values), keys, lengths.tolist(), pack(values)), schema)
            ], schema=schema)

        for batch in batches:
            for piece in common.slices(batch, "text", BLOCK_IDS * 2):
                split = [x.split() for x in common.texts_of(piece)]
                flat, per_word = own.values([w for words in split for w in words])
                counts = common.per_text(per_word, [len(words) for words in split])
                ids = np.full(len(flat) + len(counts), end_id, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(counts)), counts)] = flat
                keys += piece.column("id").to_pylist()
                sizes.append(counts + 1)
                parts.append(ids)
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield row()
                    block, start, held, keys, sizes, parts = block + 1, start + held, 0, [], [], []
        if keys:
            yield row()

    rows = (df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .repartitionByRange("id").sortWithinPartitions("id", "text"))
    with common.shuffles_dropped(df.sparkSession):
        common.in_arrow(rows, run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_token_file(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a token file."""
    return _documents(spark, folder, "ids array<int>", _lists)


def token_digests(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its decoded ids."""
    return _documents(spark, folder, "ids_crc32 long", _crcs)


def _lists(values: np.ndarray, lengths: np.ndarray) -> object:
    return common.nested(values.astype(np.int32), lengths, pa.int32())


def _crcs(values: np.ndarray, lengths: np.ndarray) -> object:
    raw, ends = memoryview(values.astype("<u4").tobytes()), 4 * np.cumsum(lengths)
    return [zlib.crc32(raw[a:b]) for a, b in zip((ends - 4 * lengths).tolist(), ends.tolist())]


def _documents(spark, folder: str, extra: str, derive) -> DataFrame:
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(folder)
    # One row per shard: as many as there are write tasks.
    totals = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect()}
    before, total = {}, 0
    for shard in sorted(totals):
        before[shard], total = total, total + totals[shard]

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        keys, starts, counts, made = [], [], [], []
        for shard, start, ids, sizes, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "doc_ids", "n_tokens", "payload"))):
            lengths = np.array(sizes, np.int64)
            keys += ids
            counts += sizes
            starts.append(before[shard] + start + np.cumsum(lengths) - lengths)
            made.append(derive(unpack(payload), lengths))
        joined = pa.concat_arrays(made) if isinstance(made[0], pa.Array) else [x for part in made for x in part]
        return {"doc_id": keys, "start": np.concatenate(starts), "n_tokens": counts, extra.split()[0]: joined}

    rows = blocks.select("shard", "start", "doc_ids", "n_tokens", "payload")
    return common.map_batches(rows, work, f"doc_id long, start long, n_tokens long, {extra}", column="payload", limit=1 << 20)


def round_trip(df: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Writes the token file of documents into the shared folder and reads its digests."""
    folder = common.shared_path(df.sparkSession, "tokens")
    write_token_file(df, folder, path)
    return token_digests(df.sparkSession, folder)
