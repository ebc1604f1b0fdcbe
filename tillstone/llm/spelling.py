"""Spelling variant grouping by search schemes on a bidirectional FM-index.

Words one edit apart have a half in common: the edit lies in the left or in the right half of
the shorter one. So a word is searched twice: its left half is matched exactly, from the middle to the
delimiter before it, and the match is extended to the right across the other half with one
error; then the mirror image. An index holds the words between delimiters, read in both
directions; a match is an interval of suffix ranks in either, kept in step, so it can be
extended at both ends. Only letters that do follow in the index are tried as errors.

Every word is dealt to blocks by its halves, and as the longer one by the halves that a word one shorter
may share with it: three places. A block holds all words with its halves, so it answers its
searches whole. A half that more words share than a block takes is cut into several
blocks, each of which its searches visit. All searches of a block advance together.

A word's form is its commonest near word if that is ten times as common; following forms
leads to the root, found by doubling pointers.

Nulls: a null text has no words; a null id counts as empty text in the damage of words. Rows are
counted one by one, repeated ids included; equal rows are damaged alike. An empty table gives no rows.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common

#: Letters that a word is made of, and the least code points and occurrences of a word.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "A-Za-zÀ-ÿ", 7, 2
#: One in so many words, by a hash of document and word, loses a letter.
DAMAGED = 31
#: How many times commoner a form must be.
TIMES = 10
#: Places of words that one index holds, about.
BLOCK = 100_000
#: Searches that branch together.
TOGETHER = 1 << 14
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all texts after the damage."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"),
    ).select("id", F.translate("run", _UPPER, _SMALL).alias("run"))
    rows = runs.withColumn("hash", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    cut = (F.col("hash") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), cut), F.substring("run", cut + 2, F.length("run")))
    word = F.when(F.col("hash") % DAMAGED == 0, shorter).otherwise(F.col("run"))
    return (rows.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))


class Ranks:
    """Suffix ranks of a circular text: where a string's interval goes when a letter is put before it."""

    def __init__(self, text: np.ndarray, letters: int) -> None:
        self.order = _suffixes(text, letters)
        last = text[self.order - 1]
        n = len(text)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=letters))))[:letters]
        words = n // 64 + 1
        self.same = _bits([last == c for c in range(letters)], words)
        self.less = _bits([last < c for c in range(letters)], words)

    @staticmethod
    def count(table: tuple[np.ndarray, np.ndarray], letter: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marked places of each letter's bit row before ``at``."""
        bits, before = table
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return before[letter, word] + np.bitwise_count(bits[letter, word] & mask)


def _bits(rows: list[np.ndarray], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits by row in words of 64, and how many are set before each word."""
    bits = np.zeros((len(rows), words * 8), np.uint8)
    for own, row in zip(bits, rows):
        packed = np.packbits(row, bitorder="little")
        own[:len(packed)] = packed
    bits = bits.view(np.uint64)
    set_ = np.bitwise_count(bits).astype(np.int64)
    return bits, np.cumsum(set_, axis=1) - set_


def _suffixes(text: np.ndarray, letters: int) -> np.ndarray:
    """Starts of the rotations of ``text`` in order, by doubling the length compared.

    Words differ, so rotations do once more than two words are compared.
    """
    n, width = len(text), max(1, 62 // max(1, int(letters).bit_length()))
    width = min(width, n)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = key * letters + np.roll(text, -i)
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if n == 1 or rank[order[-1]] == n - 1:
            return order
        key = rank * n + np.roll(rank, -width)
        width *= 2


class Index:
    """Distinct words between delimiters (letter 0), ready for searches from either side."""

    def __init__(self, words: list[str]) -> None:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.alphabet = np.unique(flat)
        self.letters = len(self.alphabet) + 1
        self.flat, self.sizes = np.searchsorted(self.alphabet, flat).astype(np.int64) + 1, sizes
        self.starts = np.cumsum(sizes) - sizes
        text = np.zeros(len(flat) + len(words), np.int64)
        text[np.arange(len(flat)) + 1 + np.repeat(np.arange(len(words)), sizes)] = self.flat
        self.owner = np.repeat(np.arange(len(words)), sizes + 1)
        self.ranks = (Ranks(text, self.letters), Ranks(text[::-1].copy(), self.letters))

    def grown(self, end: int, own: np.ndarray, other: np.ndarray, size: np.ndarray, letter: np.ndarray):
        """The intervals after putting ``letter`` before (end 0) or after (end 1) the strings.

        ``own`` begins the interval in the ranks of that end, ``other`` in those of the other end.
        """
        ranks = self.ranks[end]
        low = ranks.count(ranks.same, letter, own)
        wider = ranks.count(ranks.same, letter, own + size) - low
        smaller = ranks.count(ranks.less, letter, own + size) - ranks.count(ranks.less, letter, own)
        return ranks.begin[letter] + low, other + smaller, wider

    def near(self, queries: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): words of the index that take one replacement in, or one more letter than, a query.

        End 1: the left half is exact and the match is extended after it. End 0: the mirror image.
        """
        found = [self._near(queries[i:i + TOGETHER], end) for i in range(0, len(queries), TOGETHER)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 2

    def _near(self, queries: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        size, start = self.sizes[queries], self.starts[queries]
        half = size // 2 if end else size - size // 2

        def letter(q: np.ndarray, at: np.ndarray) -> np.ndarray:
            """The letters at a place counted from the exact half's outer side; a delimiter beyond the last."""
            place = np.where(end == 1, start[q] + at, start[q] + size[q] - 1 - at)
            return np.where(at < size[q], self.flat[np.clip(place, 0, len(self.flat) - 1)], 0)

        # The exact half, from the middle outwards, and the delimiter: the intervals of both ends.
        q = np.arange(len(queries))
        outer, inner = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        width = np.full(len(q), len(self.owner))
        for k in range(int(half.max(initial=0)) + 1):
            go = np.flatnonzero(half >= k)
            of = np.where(half[go] == k, 0, letter(go, half[go] - 1 - k))
            outer[go], inner[go], width[go] = self.grown(1 - end, outer[go], inner[go], width[go], of)
        at, hits = half.copy(), []
        whole = np.flatnonzero(width > 0)
        while len(whole):
            hits.append(self._errors(whole, at[whole], inner[whole], outer[whole], width[whole], letter, size, end))
            whole = whole[at[whole] < size[whole]]
            inner[whole], outer[whole], width[whole] = self.grown(end, inner[whole], outer[whole], width[whole], letter(whole, at[whole]))
            at[whole] += 1
            whole = whole[width[whole] > 0]
        asked, words = (np.concatenate(x) for x in zip(*hits)) if hits else (np.empty(0, np.int64),) * 2
        return queries[asked], words

    def _errors(self, q, at, inner, outer, width, letter, size, end):
        """Matches that go on with one error at this place and then exactly to the delimiter."""
        other = np.arange(1, self.letters)
        which, own = np.repeat(np.arange(len(q)), len(other)), np.tile(other, len(q))
        differs = own != letter(q, at)[which]
        which, own = which[differs], own[differs]
        i, o, w = self.grown(end, inner[which], outer[which], width[which], own)
        alive = w > 0
        which, i, o, w = which[alive], i[alive], o[alive], w[alive]
        swapped = at[which] < size[q[which]]  # in place of the letter there, or before it
        q_, at_ = np.concatenate((q[which][swapped], q[which])), np.concatenate((at[which][swapped] + 1, at[which]))
        i, o, w = (np.concatenate((x[swapped], x)) for x in (i, o, w))
        asked, words = [], []
        while len(q_):
            ended = at_ == size[q_]
            i, o, w = self.grown(end, i, o, w, letter(q_, at_))
            done = ended & (w > 0)
            forward = o if end else i  # begins the interval in the text as it is read
            asked.append(q_[done])
            words.append(self.owner[self.ranks[0].order[forward[done]]])
            on = ~ended & (w > 0)
            q_, at_, i, o, w = q_[on], at_[on] + 1, i[on], o[on], w[on]
        return (np.concatenate(asked), np.concatenate(words)) if asked else (np.empty(0, np.int64),) * 2


def places(words: DataFrame) -> DataFrame:
    """(side, half, word, n, asks): where each word is held, and where it is searched for."""
    size = F.length("word")
    half, less = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    right, less_right = size - half, size - 1 - less

    def place(side: int, length, asks: bool):
        part = F.substring("word", F.lit(1), length) if side else F.substring("word", size - length + 1, length)
        return F.struct(F.lit(side).alias("side"), part.alias("half"), F.lit(asks).alias("asks"))

    even = F.array(place(1, half, True), place(1, less, False), place(0, right, True))
    odd = F.array(place(1, half, True), place(0, right, True), place(0, less_right, False))
    return words.select("word", "n", F.explode(F.when(size % 2 == 0, even).otherwise(odd)).alias("p")).select("p.*", "word", "n")


def blocked(held: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``block``; a half with more than ``block`` words has several, and its searches visit each."""
    sizes = held.groupBy("side", "half").agg(F.count(F.lit(1)).alias("words"))
    large = sizes.where(F.col("words") > block).select("side", "half", F.ceil(F.col("words") / block).cast("int").alias("parts"))
    blocks = 1 + 2 * held.count() // block
    rows = held.join(large, ["side", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    visited = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    rows = rows.withColumn("own", own).withColumn("part", F.explode(visited))
    return rows.select(
        F.pmod(F.xxhash64("side", "half", "part"), F.lit(blocks)).alias("block"), "side", "word", "n", "asks",
        (F.col("own") == F.col("part")).alias("held"))


def _searched(table: pa.Table) -> pa.Table:
    """Pairs of near words of one block, the lesser first, repeats left in."""
    rows = zip(*(table.column(c).to_pylist() for c in ("side", "word", "n", "asks", "held")))
    number: dict[str, int] = {}
    counts, queries, holds = [], ([], []), set()
    for side, word, n, asks, held in rows:
        if (k := number.setdefault(word, len(number))) == len(counts):
            counts.append(n)
        if asks:
            queries[side].append(k)
        if held:
            holds.add(k)
    words, pairs = list(number), []
    index = Index(words)
    for end in (0, 1):
        pairs += [(a, b) for a, b in zip(*(x.tolist() for x in index.near(np.array(queries[end], np.int64), end))) if b in holds]
    pairs = [(a, b) if words[a] < words[b] else (b, a) for a, b in set(pairs)]
    return pa.table([
        pa.array([words[a] for a, _ in pairs], pa.string()), pa.array([counts[a] for a, _ in pairs], pa.int64()),
        pa.array([words[b] for _, b in pairs], pa.string()), pa.array([counts[b] for _, b in pairs], pa.int64()),
    ], names=["word", "n", "near", "near_n"])


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, once, the lesser first."""
    common.importable(words.sparkSession)
    rows = blocked(places(words), block)
    found = rows.groupBy("block").applyInArrow(_searched, "word string, n long, near string, near_n long")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow from each word with a form.

    Each round doubles the steps a pointer spans; a form is ten times as common as its word, so
    chains are short.
    """
    now = common.stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = common.stored(now.join(onward, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def grouped(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    words = common.stored(vocabulary(docs), "words")
    pairs = common.stored(near_words(words, block), "near-words")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    commoner = -F.col("best.less") >= TIMES * F.col("n")
    facts = common.stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(commoner, F.col("best.near")).alias("form"), F.when(commoner, -F.col("best.less")).alias("form_n")), "spellings")
    return facts.join(roots(facts.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
