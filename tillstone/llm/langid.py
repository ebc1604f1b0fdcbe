"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent letter n-grams of a language's training texts,
most frequent first. A document's own list is compared to each profile: the out-of-place
distance adds, for each of its n-grams, how far its place is from its place in the profile,
or the profile's length where the profile lacks it. The nearest profile wins.

N-grams lie within words (runs of letters, lower-cased, with a mark before and after).
Nulls: a null text or one without letters is ``und`` with score 0, as is every text when
nothing could be learned; a null language is never learned from. Ties go to the language
first in order. Rows are predicted one by one, repeated ids included.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.llm import common

#: N-grams have up to three letters, so that one fits into 63 bits.
PROFILE = 400
UNDETERMINED = "und"
#: Below this score a text shares next to nothing with any profile.
MIN_SCORE = 0.1
#: Bytes of text at a time; its n-grams take some thirty times as many.
SLICE_BYTES = 1 << 20
#: Different n-grams of a language up to which a task holds its counts before it sends them on.
HELD = 300_000
_BITS, _MARK = 21, 0x5F
_RUNS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points runs are made of, and which of those are letters, of which a run needs one."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    runs, alpha = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    at = np.array(points)
    for found in _RUNS.finditer(every):
        runs[at[found.start():found.end()]] = True
    alpha[at] = np.fromiter(map(str.isalpha, every), bool, len(every))
    return runs, alpha


def packed(gram: str) -> int:
    """An n-gram as a number; numbers are in the order of the n-grams."""
    return sum(ord(c) << _BITS * (2 - i) for i, c in enumerate(gram))


def unpacked(number: int) -> str:
    points = (number >> 2 * _BITS, number >> _BITS & (1 << _BITS) - 1, number & (1 << _BITS) - 1)
    return "".join(chr(c) for c in points if c)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed n-grams of all texts, sorted within each text, and how many each text has.

    They are the letters of each run and, with a mark before and after it, its pairs and triples.
    """
    lowered = [x.decode("utf-8", "replace").lower() for x in texts]
    points = np.frombuffer("\n".join(lowered).encode("utf-32-le"), np.uint32)
    runs, alpha = _letters()
    inside = np.concatenate(([False], runs[points], [False]))
    start, end = (np.flatnonzero(x) for x in (inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]))
    known = np.concatenate(([0], np.cumsum(alpha[points])))
    some = known[end] > known[start]
    start, length = start[some], (end - start)[some]
    own = np.searchsorted(np.cumsum([len(x) + 1 for x in lowered]), start, "right")
    # Runs one after another, each between two marks.
    begin = np.cumsum(length + 2) - (length + 2)
    marked = np.full(int((length + 2).sum()) + 2, _MARK, np.int64)
    letters = common.spans(length, begin + 1)
    marked[letters] = points[common.spans(length, start)]
    pairs, triples = common.spans(length + 1, begin), common.spans(length, begin)
    first, second = marked << 2 * _BITS, marked << _BITS
    # Each text's letters, pairs and triples lie together.
    n_letters = np.bincount(own, length, len(texts)).astype(np.int64)
    n_pairs = n_letters + np.bincount(own, minlength=len(texts))
    sizes = 2 * n_letters + n_pairs
    at = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.int64)
    out[common.spans(n_letters, at)] = first[letters]
    out[common.spans(n_pairs, at + n_letters)] = first[pairs] | second[pairs + 1]
    out[common.spans(n_letters, at + n_letters + n_pairs)] = first[triples] | second[triples + 1] | marked[triples + 2]
    for a, b in zip(at.tolist(), (at + sizes).tolist()):
        out[a:b].sort()
    return out, sizes


def counted(keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, how often): the different n-grams of each text in order."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    return own[first], keys[first], np.diff(first, append=len(keys))


class Counts:
    """Counts of n-grams of one language, added up as they come."""

    def __init__(self) -> None:
        self.keys, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        keys, n = np.concatenate((self.keys, keys)), np.concatenate((self.n, n))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.keys, self.n = keys[first], np.add.reduceat(n[order], first) if len(first) else n


def profiles(df: DataFrame, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[str]]:
    """The ``size`` most frequent n-grams of each language, ties in the n-grams' order.

    Counted over all texts, added up per task and then by Spark; what comes to the
    driver is ``size`` n-grams per language.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counts] = {}

        def rows(lang: str) -> pa.RecordBatch:
            own = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(own.keys), pa.string()), pa.array(own.keys), pa.array(own.n)], ["lang", "gram", "n"])

        for batch in batches:
            for part in common.slices(batch, "text", SLICE_BYTES):
                own, keys, n = counted(*grams(common.texts_of(part)))
                langs, of = np.unique(part.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
                for k, lang in enumerate(langs.tolist()):
                    chosen = of[own] == k
                    held.setdefault(lang, Counts()).add(keys[chosen], n[chosen])
                    if len(held[lang].keys) > HELD:
                        yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    rows = df.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = common.in_arrow(rows, run, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
           .withColumn("place", F.row_number().over(order)).where(F.col("place") <= size))
    out: dict[str, list[str]] = {}
    for lang, gram, _, _ in sorted(top.collect(), key=lambda r: (r[0], r[3])):
        out.setdefault(lang, []).append(unpacked(gram))
    return out


class Ranker:
    """Distances of documents to profiles."""

    def __init__(self, learned: dict[str, list[str]], size: int = PROFILE) -> None:
        self.size, self.langs = size, sorted(learned)
        self._grams = np.unique(np.array([packed(g) for own in learned.values() for g in own], np.int64))
        # A place for each language and n-gram, the last column for n-grams of none.
        self._place = np.full((len(self.langs), len(self._grams) + 1), size, np.int64)
        for row, lang in zip(self._place, self.langs):
            row[np.searchsorted(self._grams, [packed(g) for g in learned[lang]])] = np.arange(len(learned[lang]))

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        keys, sizes = grams(texts)
        if not self.langs or not len(keys):
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        own, keys, n = counted(keys, sizes)
        order = np.argsort((own << 32) - n, kind="stable")  # within a text by count, then as they were
        begin = np.searchsorted(own, np.arange(len(texts)))
        place = np.arange(len(own)) - begin[own]
        first = order[place < self.size]
        own, keys, place = own[first], keys[first], place[place < self.size]
        at = np.minimum(np.searchsorted(self._grams, keys), max(len(self._grams) - 1, 0))
        at[self._grams[at] != keys] = len(self._grams)
        kept = np.bincount(own, minlength=len(texts))
        away = np.stack([np.bincount(own, np.abs(row[at] - place), len(texts)) for row in self._place])
        best = np.argmin(away, axis=0)
        nearest = away[best, np.arange(len(texts))]
        langs = [self.langs[k] if has else UNDETERMINED for k, has in zip(best.tolist(), (kept > 0).tolist())]
        return langs, np.where(kept > 0, 1.0 - nearest / (self.size * np.maximum(kept, 1)), 0.0).tolist()


def _ranker(learned: dict[str, list[str]], size: int) -> Ranker:
    return common.only(("ranker", learned, size), lambda: Ranker(learned, size))


def accepted(df: DataFrame, learned: dict[str, list[str]], size: int = PROFILE, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The rows in a learned language with at least ``min_score``, with all their columns."""
    shipped = df.sparkSession.sparkContext.broadcast(learned)

    def verdict(texts: list[bytes]) -> np.ndarray:
        langs, scores = _ranker(shipped.value, size).predict(texts)
        return np.array([x != UNDETERMINED and y >= min_score for x, y in zip(langs, scores)], bool)

    return common.keep_rows(df, verdict, text_col, SLICE_BYTES)


def predict(df: DataFrame, learned: dict[str, list[str]], size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; the score is 1 less the share of the largest distance."""
    shipped = df.sparkSession.sparkContext.broadcast(learned)  # ``size`` n-grams per language

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        langs, scores = _ranker(shipped.value, size).predict(common.texts_of(batch))
        return {"id": batch.column("id"), "lang_pred": langs, "score": scores}

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_batches(rows, work, "id long, lang_pred string, score double", limit=SLICE_BYTES)


def held_out(key: Column) -> Column:
    return common.fold(key, 3) == 1


def identified(df: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of documents, learned from those not held out."""
    learned = profiles(df.where(~held_out(F.col("doc_id"))))
    return predict(df, learned).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score")
