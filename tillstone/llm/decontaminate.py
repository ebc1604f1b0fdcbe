"""Benchmark decontamination: edit distance by CGK embedding and bit-sampling LSH.

The CGK walk reads a sequence of words with a pointer: at each step it writes down the word
under the pointer and moves on by a random bit that depends on the step and the word. Few
edits between two sequences then mean few differing places between their walks. A hash table
samples ``BITS`` steps of the walk; windows of documents whose samples equal an item's are
candidates, and ``TABLES`` tables with walks and samples of their own reach the recall wanted.

Every word of a document begins a window. Walks of an item begin at its first word and at
every later one that leaves ``REACH`` words, so an edit near the beginning spoils only some
of them. Samples are hashed one after another, and a window whose hash so far no item has
is not walked any further. A walk never leaves an item that it begins at the first word of, so exact
copies are always found.

Items of under ``WALKED`` words are too short for samples to survive their edits. They are allowed
so few edits that, cut into one part more, one part stands in any match as it is: their parts
are looked up word for word, which misses nothing.

A candidate is decided by the exact edit distance, in words, of the item to the part of the
document around it that is nearest: at most ``MAX_EDITS_PCT`` per cent of the item's words.

Words are letters, digits and non-ASCII characters, lower-cased (A-Z). Nulls: a null text has
no words; an item without words or with a null id is never found. Repeated rows are each
searched; of repeated items each is found. An empty table of documents or items gives no rows.
"""

from __future__ import annotations

from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common
from tillstone.llm.licences import words_of

TABLES = 6
BITS = 4
STEPS = 13
REACH = 5
#: Items from this length are walked; it is no less than STEPS.
WALKED = 15
MAX_EDITS_PCT = 20
#: Bytes of items searched for in one pass; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20
#: Words of the parts around candidates that are looked at together.
PART_WORDS = 1 << 19


class Table:
    """Sampled words of walks, hashed: the sorted hashes after each sample, and whose the last ones are."""

    def __init__(self, steps: list[int], bits: np.ndarray | None) -> None:
        self.steps, self.bits = steps, bits  # without bits each step moves on

    def walk(self, words: np.ndarray, starts: np.ndarray):
        """The word at each sample for the windows at ``starts`` that are still wanted.

        A generator: it gives the words at a sample and is sent which windows to go on with.
        """
        last = len(words) - 1
        pointer = starts.copy()
        for step in range(self.steps[-1] + 1):
            seen = words[np.minimum(pointer, last)]
            seen[pointer > last] = 0
            if step in self.steps:
                keep = yield seen
                pointer, seen = pointer[keep], seen[keep]
            pointer = pointer + (1 if self.bits is None else self.bits[step][seen])

    def fill(self, items: list[np.ndarray], starts: dict[int, np.ndarray], side: int) -> Table:
        """Takes in the windows of items at the places given for each."""
        self.begins = np.zeros(side, bool)  # words of the first sample
        keys, owners, offsets = [], [], []
        for k, own in starts.items():
            walk, keep = self.walk(items[k], own), np.ones(len(own), bool)
            inside, hashes = keep.copy(), []  # samples beyond the item's end are no use
            for i in range(len(self.steps)):
                seen = next(walk) if i == 0 else walk.send(keep)
                inside &= seen > 0
                hashes.append(_hash(hashes[-1] if hashes else None, seen))
                if i == 0:
                    self.begins[seen] = True
            keys.append(np.stack(hashes)[:, inside])
            owners.append(np.full(int(inside.sum()), k))
            offsets.append(own[inside])
        self.begins[0] = False
        key = np.concatenate(keys, axis=1)
        order = np.argsort(key[-1], kind="stable")
        self.prefixes = [np.unique(row) for row in key]
        self.keys, self.owners, self.offsets = key[-1][order], np.concatenate(owners)[order], np.concatenate(offsets)[order]
        return self

    def hits(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(place of the item's first word, item) in two rows, of windows at ``begin`` with all samples alike."""
        at, walk, key = begin, self.walk(words, begin), None
        for i, prefix in enumerate(self.prefixes):
            if i == 0:
                seen = next(walk)
                keep = self.begins[seen]
                key = _hash(None, seen[keep])
            else:
                seen = walk.send(keep)
                key = _hash(key, seen)
                keep = (seen > 0) & _in(key, prefix)
                key = key[keep]
            at = at[keep]
            if not len(at):
                break
        low, high = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        hit = common.spans(high - low, low)
        return np.stack((np.repeat(at, high - low) - self.offsets[hit], self.owners[hit]))


def _hash(before: np.ndarray | None, seen: np.ndarray) -> np.ndarray:
    """64 bits that stand for the words sampled so far."""
    with np.errstate(over="ignore"):
        return common.mixed((0 if before is None else before * np.uint64(0x9E3779B97F4A7C15)) + seen.astype(np.uint64))


class Tables:
    """Walks of all items, ready to search texts. What is held grows with the words of the items."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        self.ids, self.words = [], []
        number: dict[bytes, int] = {}
        for key, text in sorted(items):
            if words := words_of(text):
                self.ids.append(key)
                self.words.append(np.array([number.setdefault(w, len(number) + 1) for w in words], np.int32))
        self.number = number
        self.side = len(number) + 1
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.most = self.lengths * MAX_EDITS_PCT // 100
        # Each item's words in order and how often it has them, all items one after another.
        flat = np.concatenate(self.words).astype(np.int64) if self.words else np.empty(0, np.int64)
        self.held, self.counts = np.unique(np.repeat(np.arange(len(self.words)), self.lengths) * self.side + flat, return_counts=True)
        # The same as marks at hashed places, some sixteen to an entry: quicker to ask, and seldom wrong.
        self.shift = np.uint64(60 - max(len(self.held), 1).bit_length())
        self.marks = np.zeros(1 << (64 - int(self.shift)), bool)
        self.marks[self._place(self.held)] = True
        random = np.random.default_rng(20)
        bits = random.integers(0, 2, (TABLES, STEPS, self.side), dtype=np.int8)
        bits[:, :, 0] = 1  # a word of no item
        steps = [sorted([0, *(random.choice(np.arange(1, STEPS), BITS - 1, replace=False)).tolist()]) if t % 2 == 0
                 else sorted(random.choice(np.arange(STEPS), BITS, replace=False).tolist()) for t in range(TABLES)]
        walked = {k: np.arange(n - REACH + 1) for k, n in enumerate(self.lengths.tolist()) if n >= WALKED}
        self.tables = [Table(own, b).fill(self.words, walked, self.side) for own, b in zip(steps, bits)] if walked else []
        parts: dict[int, dict[int, list[int]]] = {}
        for k, (n, most) in enumerate(zip(self.lengths.tolist(), self.most.tolist())):
            if n < WALKED:
                cuts = [n * i // (most + 1) for i in range(most + 2)]
                for a, b in zip(cuts, cuts[1:]):
                    parts.setdefault(b - a, {}).setdefault(k, []).append(a)
        self.tables += [Table(list(range(size)), None).fill(self.words, {k: np.array(a) for k, a in own.items()}, self.side) for size, own in parts.items()]

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the item's first word, item) wherever a table has a window's sample."""
        begin = np.flatnonzero(words)
        if not len(begin) or not self.tables:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        place, item = np.concatenate([t.hits(words, begin) for t in self.tables], axis=1)
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (item[1:] != item[:-1])
        return place[new], item[new]

    def _place(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def _likely(self, chosen: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Those of the chosen candidates whose part of the text has enough of the item's words."""
        item_, low_, width = item[chosen], low[chosen], high[chosen] - low[chosen]
        least = self.lengths[item_] - self.most[item_]
        marked = self.marks[self._place(np.repeat(item_, width) * self.side + words[common.spans(width, low_)])]
        some = common.per_text(marked.astype(np.int64), width) >= least
        # The same by how often each word stands there, which is dearer to count.
        chosen, least = chosen[some], least[some]
        return chosen[self._shared(item[chosen], low[chosen], high[chosen], words) >= least]

    def _shared(self, item: np.ndarray, low: np.ndarray, high: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How many words of each part are the item's, a word as often as the item has it at most."""
        width = high - low
        key = np.repeat(item, width) * self.side + words[common.spans(width, low)]
        at = np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)
        has = self.held[at] == key
        entry, times = np.unique(np.repeat(np.arange(len(item)), width)[has] * len(self.held) + at[has], return_counts=True)
        counted = np.minimum(times, self.counts[entry % len(self.held)])
        return np.bincount(entry // len(self.held), counted, minlength=len(item))

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first word, last word) of the nearest part for each item found."""
        split = [words_of(x) for x in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.number.get, chain.from_iterable(split), repeat(0)), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        gap = STEPS + 1  # words of no item between texts, so that no walk runs from one into the next
        spread = np.zeros(len(words) + gap * len(texts), np.int32)
        spread[np.arange(len(words)) + gap * np.repeat(np.arange(len(texts)), sizes)] = words
        begins = ends - sizes + gap * np.arange(len(texts))
        place, item = self.candidates(spread)
        if not len(place):
            return []
        # The text that the item's middle lies in, and enough words of it on both sides.
        most = self.most[item]
        owner = np.clip(np.searchsorted(begins, place + self.lengths[item] // 2, "right") - 1, 0, None)
        low = np.maximum(place - 2 * most, begins[owner])
        high = np.maximum(low, np.minimum(place + self.lengths[item] + 2 * most, begins[owner] + sizes[owner]))
        # Words of the part that are the item's: fewer than its length less the edits cannot do.
        width = high - low
        enough = np.concatenate([
            self._likely(k, item, low, high, spread) for k in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(width) // PART_WORDS)) + 1)])
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for own, k, a, b, p in zip(*(x[enough].tolist() for x in (owner, item, low, high, place))):
            if done.get((own, k), -1) >= p or out.get((own, k), (1,))[0] == 0:
                continue  # the part around the last place has this one in its middle, or no nearer is possible
            edits, first, last = nearest(self.words[k], spread[a:b])
            done[own, k] = p + int(self.most[k]) // 2
            if edits <= self.most[k] and edits < out.get((own, k), (edits + 1,))[0]:
                out[own, k] = (edits, a + first - int(begins[own]), a + last - int(begins[own]))
        return sorted((own, k, *rest) for (own, k), rest in out.items())


def _in(key: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(key), bool)
    at = np.searchsorted(ordered, key)
    at[at == len(ordered)] = 0
    return ordered[at] == key


def nearest(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, last) of the stretch of ``part`` with the least edit distance to ``item``.

    Rows of the usual table, free to begin and end anywhere in ``part``; insertions along a row
    are a running minimum. Of equal ones the first to end is taken.
    """
    n = len(part)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    along = np.arange(n + 1)
    for word in item.tolist():
        swap = cost[:-1] + (part != word)
        drop = cost + 1
        best = drop.copy()
        begin = start.copy()
        better = swap < best[1:]
        best[1:][better] = swap[better]
        begin[1:][better] = start[:-1][better]
        # best[j] = min over i <= j of best[i] + j - i, carrying where that began
        level = best - along
        packed = np.minimum.accumulate(level * (2 * n + 4) + begin)
        start = packed % (2 * n + 4)
        cost = packed // (2 * n + 4) + along
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end - 1


def _tables(items: list[tuple[int, bytes]]) -> Tables:
    """The tables of these items, once per worker process; the list is held so that its identity stays its own."""
    return common.only(("items", id(items)), lambda: (items, Tables(items)))[1]


def _passes(benchmark: DataFrame, id_col: str, text_col: str):
    """The items as broadcasts of ``PASS_BYTES`` each at most, about."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = -(-total // PASS_BYTES)
    context = benchmark.sparkSession.sparkContext
    for k in range(count):
        own = items if count == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k)
        yield context.broadcast([(r[0], r[1].encode()) for r in own.collect()])


def found(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, n_edits, first_word, last_word) for every document and item it holds."""
    schema = "id long, item_id long, n_edits long, first_word long, last_word long"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = df.sparkSession.createDataFrame([], schema)
    for items in _passes(benchmark, item_col, item_text_col):
        def work(batch: pa.RecordBatch, items=items) -> dict[str, object]:
            own = _tables(items.value)
            hits = own.search(common.texts_of(batch))
            keys = batch.column("id").to_pylist()
            return {
                "id": [keys[i] for i, *_ in hits], "item_id": [own.ids[k] for _, k, *_ in hits],
                "n_edits": [x[2] for x in hits], "first_word": [x[3] for x in hits], "last_word": [x[4] for x in hits],
            }

        out = out.unionByName(common.map_batches(rows, work, schema))
    return out


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    for items in _passes(benchmark, "item_id", "text"):
        def verdict(texts: list[bytes], items=items) -> np.ndarray:
            kept = np.ones(len(texts), bool)
            kept[[i for i, *_ in _tables(items.value).search(texts)]] = False
            return kept

        df = common.keep_rows(df, verdict, text_col)
    return df


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_edits, first_word, last_word) of documents."""
    return found(documents, benchmark).withColumnRenamed("id", "doc_id")
