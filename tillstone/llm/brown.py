"""Language-model scoring with Brown class-based bigrams.

The most frequent words are put into classes by exchange: a word moves to the class that
raises the likelihood of the class bigrams most, over and over. Every other word that occurs
more than once then goes to the class which the classes beside its places make likeliest, from
an aggregate over the corpus. Words that occur once make one further class, which unseen words
share, and the end of a text another. A text's probability is the product of class
transitions, counted over all words and smoothed towards the class's own frequency, and of the
words' emissions from their classes.

``vocabulary`` bounds the words that start the classes, not those that have one. Counts and
classes of the ``HEAD`` most frequent words travel with the tasks; those of the words
beyond are looked up by a join.

Nulls: a null text is empty and is the end token alone. A null id counts as the text ''
when the training rows are chosen. Repeated rows are scored, and learned from, one by one.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common

#: Words clustered by exchange; the classes of all others follow from these.
VOCABULARY = 1000
#: Classes are single bytes in the paths, so 250 at most.
CLASSES = 48
#: From so many occurrences on a word has a class.
REPEATED = 2
SWEEPS = 6
HEAD = 100_000
#: Bytes of words that travel with the tasks; a word over 64 bytes is always looked up.
HEAD_WORD_BYTES = 64
SMOOTHING = 8.0
_FLUSH = 250_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) over all texts; the empty word stands for the ends of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in common.slices(batch, "text", common.SLICE_BYTES):
                for text in common.texts_of(part):
                    counts.update(words_of(text))
                counts[b""] += part.num_rows
                if len(counts) > _FLUSH:
                    yield rows()
                    counts.clear()
        if counts:
            yield rows()

    rows = df.select(F.col(text_col).cast("string").alias("text"))
    return common.in_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(df: DataFrame, vocabulary: list[bytes], text_col: str = "text") -> np.ndarray:
    """Bigrams between vocabulary words, the end of a text (0) and any other word (1).

    A square table whose side does not depend on the corpus.
    """
    shipped, side = df.sparkSession.sparkContext.broadcast(vocabulary), len(vocabulary) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(zip(shipped.value, range(2, side)))
        table = np.zeros(side * side, np.int64)
        for batch in batches:
            for part in common.slices(batch, "text", common.SLICE_BYTES):
                numbers = np.concatenate([_numbered(known, words_of(x)) for x in common.texts_of(part)])
                before = np.concatenate(([0], numbers[:-1]))  # a text begins after an end
                table += np.bincount(before * side + numbers, minlength=side * side)
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(table[some], pa.int64())], ["pair", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text"))
    summed = common.in_arrow(rows, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(side * side, np.float64)
    table[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    return table.reshape(side, side)


def _numbered(known: dict, words: list[bytes]) -> np.ndarray:
    out = np.zeros(len(words) + 1, np.int64)
    out[:-1] = np.fromiter(map(known.get, words, repeat(1)), np.int64, len(words))
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each word number: 0 and 1 keep classes of their own, words move among the rest.

    Words start dealt out by frequency. The objective is the class bigram likelihood,
    sum n(a,b) log n(a,b) - sum n(a) log n(a) over left and over right classes; a sweep gives
    each word its best class in turn, ties to the lowest, until none moves.
    """
    size = len(pairs)
    total = min(classes, max(size - 2, 0)) + 2
    member = np.array([i if i < 2 else 2 + (i - 2) % max(total - 2, 1) for i in range(size)], np.int64)
    one = np.zeros((size, total))
    one[np.arange(size), member] = 1
    right, left = pairs @ one, pairs.T @ one  # n(w, class), n(class, w)
    table = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in range(2, size):
            old, self_n = member[w], pairs[w, w]
            to, fro = right[w].copy(), left[w].copy()
            to[old] -= self_n
            fro[old] -= self_n
            table[old] -= to
            table[:, old] -= fro
            table[old, old] -= self_n
            rows, columns = table.sum(1), table.sum(0)
            out_n, in_n = to.sum() + self_n, fro.sum() + self_n
            own = np.arange(total)
            gain = (_xlogx(table + to) - _xlogx(table)).sum(1) + (_xlogx(table.T + fro) - _xlogx(table.T)).sum(1)
            # The diagonal cell takes both sides and the word after itself at once.
            cell = table[own, own]
            gain += _xlogx(cell + to + fro + self_n) - _xlogx(cell + to) - _xlogx(cell + fro) + _xlogx(cell)
            gain -= _xlogx(rows + out_n) - _xlogx(rows) + _xlogx(columns + in_n) - _xlogx(columns)
            gain[:2] = -np.inf
            new = int(np.argmax(np.round(gain, 6)))
            table[new] += to
            table[:, new] += fro
            table[new, new] += self_n
            if new != old:
                moved += 1
                member[w] = new
                for matrix, counts in ((right, pairs[:, w]), (left, pairs[w])):
                    matrix[:, old] -= counts
                    matrix[:, new] += counts
        if not moved:
            break
    return member


def context_counts(df: DataFrame, known: dict[bytes, int], total: int, text_col: str = "text") -> DataFrame:
    """(word, contexts, times) of the words not in ``known``: the classes beside their places.

    A class before the word counts under its number and one after it under ``total`` plus that. A
    word has a row for each task or flush, whose parts are summed by ``assigned``.
    """
    shipped, width = df.sparkSession.sparkContext.broadcast(known), 2 * total
    kinds = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of = {**shipped.value, b"": 0}
        words, keys, times, held = common.Interned(), [], [], 0

        def rows() -> pa.RecordBatch:
            key, n = _summed(keys, times)
            word, context = key // width, key % width
            lengths = np.bincount(word, minlength=len(words))
            made = pa.RecordBatch.from_arrays([
                pa.array(list(words), pa.binary()).cast(pa.string()),
                common.nested(context, lengths, pa.int32()).cast(kinds[0]), common.nested(n, lengths, pa.int64()).cast(kinds[1]),
            ], ["word", "contexts", "times"])
            words.clear(), words.new.clear(), keys.clear(), times.clear()
            return made

        for batch in batches:
            for part in common.slices(batch, "text", common.SLICE_BYTES):
                flat = [b""]
                for text in common.texts_of(part):
                    flat += words_of(text)
                    flat.append(b"")
                classes = np.fromiter(map(class_of.get, flat, repeat(1)), np.int64, len(flat))
                at = np.flatnonzero(classes == 1)
                own = words.numbers([flat[i] for i in at.tolist()]) * width
                key, n = np.unique(np.concatenate((own + classes[at - 1], own + total + classes[at + 1])), return_counts=True)
                keys.append(key)
                times.append(n)
                held += len(key)
                if held > 8 * _FLUSH:
                    key, n = _summed(keys, times)
                    keys[:], times[:], held = [key], [n], len(key)
                if len(words) > _FLUSH or held > 6 * _FLUSH:
                    yield rows()
                    held = 0
        if words:
            yield rows()

    rows = df.select(F.col(text_col).cast("string").alias("text"))
    return common.in_arrow(rows, run, "word string, contexts array<int>, times array<long>")


def _summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[begin], np.add.reduceat(n, begin)


def assigned(contexts: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, n, class) of the words in ``contexts``, given the class bigrams of the clustered words.

    A word goes to the class in which the classes beside its places are likeliest, ties to the
    lowest. A word met once stays in the class of rare words: it stands for those never met.
    """
    total = len(table)
    before, after = table.sum(0) + 1, table.sum(1) + 1
    to = np.log((table + SMOOTHING * before / before.sum()) / (table.sum(1, keepdims=True) + SMOOTHING))
    fro = np.log((table + SMOOTHING * (after / after.sum())[:, None]) / (table.sum(0) + SMOOTHING))
    weights = np.concatenate((fro, to.T))  # (class before or after, class of the word)
    weights[:, :2] = -np.inf

    def rows(words: list[str], counts: np.ndarray) -> pa.RecordBatch:
        n = counts[:, :total].sum(1)
        member = np.ones(len(words), np.int64)
        if total > 2 and len(words):
            member = np.where(n >= REPEATED, np.argmax(np.round(counts @ weights[:, 2:], 6), 1) + 2, 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(n.astype(np.int64)), pa.array(member, pa.int32())], ["word", "n", "class"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, np.zeros((1, 2 * total))
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                words = part.column("word").to_pylist()
                new = np.fromiter((x != y for x, y in zip(words, [last, *words])), bool, len(words))
                group = np.cumsum(new)  # 0: the word carried over
                lists = part.column("contexts")
                cell = np.repeat(group, lists.value_lengths().to_numpy(zero_copy_only=False)) * 2 * total + lists.flatten().to_numpy()
                counts = np.bincount(cell, part.column("times").flatten().to_numpy(), (group[-1] + 1) * 2 * total).reshape(-1, 2 * total)
                counts[:1] += carried
                own = [last, *(words[i] for i in np.flatnonzero(new).tolist())]
                skip = int(last is None)
                yield rows(own[skip:-1], counts[skip:-1])
                last, carried = own[-1], counts[-1:].copy()
        if last is not None:
            yield rows([last], carried)

    return common.in_arrow(contexts.repartition("word").sortWithinPartitions("word"), run, "word string, n long, class int")


class Model:
    """The words that travel with the tasks, and (word, n, class) of all others as a table."""

    def __init__(self, df: DataFrame, counts: DataFrame, vocabulary: int, classes: int) -> None:
        total = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
        self.tokens, self.types = total[0] or 0, total[1]
        ends = counts.where(F.col("word") == "").first()
        self.end = float(np.log10((ends["n"] if ends else 0) + 1))
        short = F.octet_length("word") <= HEAD_WORD_BYTES
        words = counts.where((F.col("word") != "") & short)
        # A histogram of log counts says from which count on at most HEAD words are left.
        band = F.floor(32 * F.log2("n"))
        bands = words.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("k")).collect()
        least, held = 1 << 30, 0
        for at, k in sorted(bands, reverse=True):
            if held + k > HEAD:
                break
            least, held = at, held + k
        head = words.where(band >= least).select("word", "n").toArrow()
        head = head.sort_by([("n", "descending"), ("word", "ascending")])
        self.head = [x.encode() for x in head.column("word").to_pylist()]
        self.head_n = head.column("n").to_numpy().astype(np.float64)
        frequent = self.head[:vocabulary]
        pairs = pair_counts(df, frequent)
        member = exchange(pairs, classes)
        self.classes = int(member.max(initial=1)) + 1
        one = np.zeros((len(pairs), self.classes))
        one[np.arange(len(pairs)), member] = 1
        class_of = dict(zip(frequent, member[2:].tolist()))
        self.others = common.stored(
            assigned(context_counts(df, class_of, self.classes), one.T @ pairs @ one), "classes")
        near = self.others.where(short & (band >= least)).select("word", "class").toArrow()
        class_of.update(zip((x.encode() for x in near.column("word").to_pylist()), near.column("class").to_pylist()))
        self.member = np.array([class_of[x] for x in self.head], np.int64)
        self.once = self.others.where(F.col("class") == 1).count()
        self.base = float(np.log10(self.tokens + self.types + 1))

    def shipped(self) -> dict[str, object]:
        return {"id": uuid.uuid4().hex, "head": self.head, "n": self.head_n, "member": self.member,
                "tokens": self.tokens, "end": self.end, "base": self.base}


PATHS = (
    "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, "
    "path binary, tail array<string>, tail_at array<int>"
)
_FULL = "id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, path binary"
_LATER = 255


def paths(df: DataFrame, model: Model, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The class of every word of every row, one byte each, with what sums over its words.

    ``emission`` is the log10 of the words' counts, of rare words' counts plus one. A word beyond the
    head has its class from a join by word.
    """
    shipped = df.sparkSession.sparkContext.broadcast(model.shipped())

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        own = shipped.value
        known, logs, emit, member = _tables(own)
        split = [words_of(x) for x in common.texts_of(batch)]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = list(chain.from_iterable(split))
        places = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))  # -1: beyond the head
        row = np.repeat(np.arange(len(split)), sizes)
        path = np.zeros(len(words) + len(split), np.uint8)  # an end after the words of each row
        path[np.arange(len(words)) + row] = member[places]
        later = np.flatnonzero(places < 0)
        beyond, waiting = np.bincount(row[later], minlength=len(split)), iter([words[i] for i in later.tolist()])
        tails, at = [], []
        for n in beyond.tolist():
            tail = common.Interned()
            at.append(tail.numbers(list(islice(waiting, n))))
            tails.append([x.decode("utf-8", "replace") for x in tail])
        n_tokens = sizes + 1
        return {
            "id": batch.column("id"), "held_out": batch.column("held_out"), "n_tokens": n_tokens,
            "n_known": sizes - beyond + (own["tokens"] > 0),
            "base_score": np.bincount(row, logs[places], len(split)) + own["end"] - n_tokens * own["base"],
            "emission": np.bincount(row, emit[places], len(split)),
            "path": _binaries(path, n_tokens), "tail": tails, "tail_at": at, "row": np.zeros(len(split), np.int64),
        }

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words beyond the head, all rows of a batch at a time."""
        for batch in batches:
            rows, sizes = np.arange(batch.num_rows), batch.column("n_tokens").to_numpy()
            path = np.frombuffer(b"".join(batch.column("path").to_pylist()), np.uint8).copy()
            tails = batch.column("n_tail").to_numpy()
            begin = np.cumsum(tails) - tails
            n, member = np.zeros(int(tails.sum())), np.ones(int(tails.sum()), np.int64)
            found = batch.column("found")
            own = np.repeat(rows, _list_sizes(found))
            k, own_n, own_class = (x.to_numpy() for x in found.flatten().flatten())
            at = begin[own] + k
            n[at], member[at] = own_n, own_class
            places = batch.column("tail_at")
            own = np.repeat(rows, _list_sizes(places))
            at = begin[own] + places.flatten().to_numpy()
            path[path == _LATER] = member[at]

            def summed(values: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                return np.bincount(own, values, len(rows))

            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("id", "held_out", "n_tokens")),
                pa.array(batch.column("n_known").to_numpy() + summed(n[at] > 0).astype(np.int64)),
                pa.array(batch.column("base_score").to_numpy() + summed(np.log10(n[at] + 1))),
                pa.array(batch.column("emission").to_numpy() + summed(np.log10(n[at] + (member[at] == 1)))),
                _binaries(path, sizes),
            ], [x.split()[0] for x in _FULL.split(", ")])

    rows = df.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    begun = common.stored(common.map_batches(rows, work, PATHS).withColumn("row", F.monotonically_increasing_id()), "paths")
    words = begun.select("row", F.posexplode("tail").alias("k", "word"))
    found = words.join(model.others, "word").groupBy("row").agg(F.collect_list(F.struct("k", "n", "class")).alias("found"))
    narrow = begun.withColumn("n_tail", F.size("tail").cast("long")).drop("tail")
    return common.stored(common.in_arrow(narrow.join(found, "row", "left"), fill, _FULL), "paths")


def _binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive runs of bytes as an Arrow array."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _list_sizes(lists: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def class_pairs(walked: DataFrame, classes: int) -> np.ndarray:
    """How often a class follows another in the rows that are not held out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(classes * classes, np.int64)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                after = np.frombuffer(path, np.uint8).astype(np.int64)
                table += np.bincount(np.concatenate(([0], after[:-1])) * classes + after, minlength=len(table))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(table[some], pa.int64())], ["pair", "n"])

    learned = walked.where(~F.col("held_out")).select("path")
    summed = common.in_arrow(learned, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(classes * classes, np.float64)
    table[summed.column("pair").to_numpy()] = summed.column("n").to_numpy()
    return table.reshape(classes, classes)


def score(df: DataFrame, held_out: Column, vocabulary: int = VOCABULARY, classes: int = CLASSES,
          id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """(id, held_out, n_tokens, n_known, base_score, score) of every row of ``df`` and the training tokens.

    ``base_score`` is the add-one unigram model's log10 probability, ``score`` the class
    model's, both learned from the rows that are not ``held_out``.
    """
    train = df.where(~held_out).select(F.col(text_col).alias("text"))
    counts = common.stored(word_counts(train), "words")
    model = Model(train, counts, vocabulary, classes)
    walked = paths(df, model, held_out, id_col, text_col)
    table = class_pairs(walked, model.classes)
    ends = table.sum(0)
    share = (ends + 1) / (ends.sum() + len(table))
    step = np.log10((table + SMOOTHING * share) / (table.sum(1, keepdims=True) + SMOOTHING))
    # Emissions divide by the class total; a rare word is add-one among such words and one unseen kind.
    below = np.log10(np.maximum(ends, 1))
    below[:2] = 0, np.log10(ends[1] + model.once + 1)
    step -= below  # of the class stepped to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for emission, path in zip(batch.column("emission").to_pylist(), batch.column("path").to_pylist()):
                after = np.frombuffer(path, np.uint8)
                scores.append(emission + float(step[np.concatenate(([0], after[:-1])), after].sum()))
            names = ["id", "held_out", "n_tokens", "n_known", "base_score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores, pa.float64())], [*names, "score"])

    schema = _FULL.replace("emission double, path binary", "score double")
    return common.in_arrow(walked, run, schema), model.tokens


def _tables(own: dict) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """The head's numbers and, by number, log counts, emissions and classes; the last entry stands for words beyond it."""
    return common.only(("classes", own["id"]), lambda: (
        dict(zip(own["head"], range(len(own["head"])))), np.append(np.log10(own["n"] + 1), 0),
        np.append(np.log10(own["n"] + (own["member"] == 1)), 0), np.append(own["member"], _LATER).astype(np.uint8)))


def scored(df: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of documents."""
    out, tokens = score(df, common.fold(F.col("doc_id"), 7) == 2)
    return out.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
