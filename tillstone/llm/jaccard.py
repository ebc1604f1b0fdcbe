"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document's set is its distinct five-word shingles; two link at a Jaccard similarity of 75
hundredths or more, which bounds how many shingles of sets of given sizes may differ. Every
shingle is a partition of the domain. Sets fall into size bands so that linked sets lie in equal
or neighbouring bands; a set makes signatures for its own band, where it meets sets of that
band and the one below, and for the next one, where it meets larger sets only. For each, let d be
the most shingles of its own that a linked set there may lack. Of its shingles the first
d + q, in an order common to all sets, are taken and all subsets of q of them are signatures (q is 2
in bands of short sets, where few subsets arise, else 1). The q shared shingles that come first
are within the first d + q of either set: linked sets share a signature.

Shingles counted in over ``COMMON`` sets come last in the order, so that they make
signatures only for sets that have little else. All are counted by Spark; equal sets of one slice of
documents count once, those of several slices again. Counts and signatures leave a task packed, a row
for each bucket that has some, so that rows are as few as the blocks of the shuffle that follows. Which come late is held in cells, a byte for every eight shingles of the corpus between 2^20 and 2^26 cells; where
two fall on a cell the other comes late too. It affects the order alone, not results.

Sets of the documents with a signature in common are compared exactly. In a group that shares
one, all members meet a hub first. What the links so far have joined need not meet again; where a group is
still in several components, its members meet further hubs, more in each turn, as long as a turn joins many.
All pairs of a group in different components are compared after that. Of either only those are whose marks
(bits for odd counts of classes of shingles) do not differ too much to link. So no link is lost and
a large group of copies costs little more than its size, also where its first hub is none of them.

Equal sets are one node throughout. Shingles are 64-bit hashes of their words.

Nulls: a null text has no shingles and links with nothing; a row with a null id links with
nothing either and has a null component. Rows that repeat are each given. An empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
#: A shingle of more sets than this comes late in the order.
COMMON = 32
#: Least and most bits of a shingle that say its cell.
SKETCH_BITS, MOST_SKETCH_BITS = 20, 26
_FILTER_BITS = 24
#: Cells of the smallest sets.
CELLS = 128
SHORT_BITS = 40
#: Bytes of shingles or signatures that a task holds before it hands them out by buckets, and shingles of a bucket that is counted at once.
HELD_BYTES, BUCKET_SHINGLES = 16 << 20, 1 << 20
#: Longs whose bits tell which of so many classes hold an odd number of a set's shingles.
MARKS = [f"mark{k}" for k in range(16)]
#: Hubs of a group in each further turn; a turn that links fewer than one in ``WORTH`` of its members is the last.
HUBS, WORTH = (1, 4, 16), 100
#: Bands with sets of PAIRS_FROM to PAIRS_TO shingles take subsets of two partitions.
PAIRS_FROM, PAIRS_TO = 5, 34
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SHORT_MASK = (1 << SHORT_BITS) - 1
_PAIRS_OF = [np.array(list(combinations(range(n), 2)), np.int64).reshape(-1, 2).T for n in range(PAIRS_TO + 1)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and the sets' sizes."""
    split = [x.translate(_LOWER).split() for x in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    hashes = common.only("word hashes", _Hashes)
    hashed = np.fromiter(map(hashes.__getitem__, (w for own in split for w in own)), np.uint64, int(sizes.sum()))
    counts = np.where(sizes == 0, 0, np.maximum(sizes - words + 1, 1))
    starts = np.cumsum(sizes) - sizes
    first = common.spans(counts, starts)
    short = np.repeat(sizes < words, counts)
    rolled = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[np.minimum(first + k, max(len(hashed) - 1, 0))]
        for row in np.flatnonzero(short).tolist():  # a text of fewer words is one shingle, its length mixed in
            own = int(np.searchsorted(starts, first[row], "right")) - 1
            value = np.uint64(sizes[own])
            for w in hashed[starts[own]:starts[own] + sizes[own]]:
                value = value * np.uint64(0xD6E8FEB86659FD93) + w
            rolled[row] = value
    rolled = common.mixed(rolled)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        rolled[a:b].sort()
    owner = np.repeat(np.arange(len(texts)), counts)
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    return rolled[new], np.bincount(owner[new], minlength=len(texts))


def node_of(own: np.ndarray) -> int:
    """A number for a set, 63 bits."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) >> 1


def cells_of(own: np.ndarray) -> bytes:
    """Counts of a set's elements by their low bits, a cell for every four to eight elements."""
    count = max(CELLS, min(1 << (len(own) // 4 - 1).bit_length(), 1 << 16)) if len(own) > 4 * CELLS else CELLS
    return np.minimum(np.bincount((own & np.uint64(count - 1)).astype(np.int64), minlength=count), 255).astype(np.uint8).tobytes()


def marks_of(own: np.ndarray) -> np.ndarray:
    """A bit for each class of elements, by bits that ``cells_of`` does not look at: whether the set has an odd number of them."""
    odd = np.bincount((own >> np.uint64(32)).astype(np.int64) & (64 * len(MARKS) - 1), minlength=64 * len(MARKS)) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def _near_marks() -> Column:
    """Whether the marks of two sets, ``_a`` and ``_b``, leave them near enough to link: bits that differ are differing elements, one each at least."""
    apart, total = sum(F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS), F.col("n_a") + F.col("n_b")
    return (NUMERATOR + DENOMINATOR) * (total - apart) >= 2 * NUMERATOR * total


def linked(shared: int, a: int, b: int) -> bool:
    return DENOMINATOR * shared >= NUMERATOR * (a + b - shared)


def largest_partner(size: int | np.ndarray) -> int | np.ndarray:
    return size * DENOMINATOR // NUMERATOR


def largest_distance(size: int | np.ndarray, partner: int | np.ndarray) -> int | np.ndarray:
    """How many elements linked sets of these sizes may differ in."""
    total = size + partner
    return total - 2 * -(-NUMERATOR * total // (NUMERATOR + DENOMINATOR))


def most_lacking(size: int | np.ndarray, partner: int | np.ndarray) -> int | np.ndarray:
    """How many elements of a set linked sets of ``partner`` elements or more may lack."""
    return size + -NUMERATOR * (size + partner) // (NUMERATOR + DENOMINATOR)


def bands(largest: int) -> list[tuple[int, int]]:
    """Size bands up to ``largest``: linked sets lie in one band or in neighbours."""
    out, low = [], 1
    while low <= largest:
        out.append((low, largest_partner(low)))
        low = out[-1][1] + 1
    return out


_BANDS = bands(1 << 40)
_LOWS, _HIGHS = np.array(_BANDS, np.int64).T


def common_class(levels: np.ndarray | None, hashed: np.ndarray) -> np.ndarray:
    """0 for most shingles, more for each doubling of how many sets have one of the cell's."""
    if levels is None:
        return np.zeros(len(hashed), np.uint8)
    return levels[(hashed >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]


def signatures(flat: np.ndarray, sizes: np.ndarray, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signature, place of its set) for the sets given one after another."""
    band_of = np.maximum(np.searchsorted(_LOWS, sizes, "right") - 1, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((common.mixed(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), common_class(levels, flat), owner))
    inner = common.mixed(flat[order])
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found_sigs, found_owners = [], []
    for up in (0, 1):
        instance = band_of + up
        low, high = _LOWS[instance], _HIGHS[instance]
        least = low if up else -(-sizes * NUMERATOR // DENOMINATOR)
        pairs = (low >= PAIRS_FROM) & (high <= PAIRS_TO)
        take = most_lacking(sizes, least) + np.where(pairs, 2, 1)
        if up:
            take[largest_partner(sizes) < low] = 0
        kept = rank < take[owner]
        part_owner, content = owner[kept], inner[kept]
        content = common.mixed(content ^ common.mixed((instance[part_owner] + 1).astype(np.uint64)))
        ones = ~pairs[part_owner]
        found_sigs.append(content[ones])
        found_owners.append(part_owner[ones])
        two = np.flatnonzero(~ones)
        if len(two):
            edges = np.flatnonzero(np.diff(part_owner[two])) + 1
            for own in np.split(two, edges):
                left, right = _PAIRS_OF[len(own)]
                with np.errstate(over="ignore"):
                    found_sigs.append(common.mixed(content[own[left]] + content[own[right]] * np.uint64(3)))
                found_owners.append(np.full(len(left), part_owner[own[0]]))
    return np.concatenate(found_sigs), np.concatenate(found_owners)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _measured(rows: DataFrame) -> DataFrame:
    """(id, n, node, cells) of every row, and its marks.

    ``cells`` counts the shingles of a set by classes: the sum of the lesser counts of two sets
    is the most they can share. Marks say less in less space, and Spark compares them in a join.
    """
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        flat, sizes = shingle_sets(common.texts_of(batch))
        own = np.split(flat, np.cumsum(sizes)[:-1])
        marks = np.stack([marks_of(x) for x in own], axis=1)
        return {
            "id": batch.column("id"), "n": pa.array(sizes, pa.int64()),
            "node": [node_of(x) if len(x) else None for x in own], "cells": [cells_of(x) if len(x) else None for x in own],
            **{m: pa.array(x) for m, x in zip(MARKS, marks)},
        }

    return common.map_batches(rows, work, "id long, n long, node long, cells binary, " + ", ".join(f"{m} long" for m in MARKS))


def _distinct(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal sets and empty ones left out: elements, sizes and numbers of the others."""
    ends = np.cumsum(sizes)
    nodes: dict[int, int] = {}
    for i, (s, b) in enumerate(zip(sizes.tolist(), ends.tolist())):
        if s:
            nodes.setdefault(node_of(flat[b - s:b]), i)
    chosen = np.fromiter(nodes.values(), np.int64, len(nodes))
    return flat[common.spans(sizes[chosen], ends[chosen] - sizes[chosen])], sizes[chosen], np.fromiter(nodes, np.int64, len(nodes))


def levels_of(values: np.ndarray, times: np.ndarray, bits: int) -> np.ndarray:
    """Classes of the cells, told by the first ``bits`` of the 32-bit values: 1 and more where one is met over ``COMMON`` times."""
    out = np.zeros(1 << bits, np.uint8)
    if len(values):
        order = np.argsort(values, kind="stable")
        values = values[order]
        begin = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        total = np.add.reduceat(times[order], begin)
        often = total > COMMON
        np.maximum.at(out, (values[begin[often]] >> np.uint32(32 - bits)).astype(np.int64), (1 + np.log2(total[often] / COMMON)).astype(np.uint8))
    return out


def _gathered(
    rows: DataFrame, work: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], packed: Callable[..., dict[str, list]], schema: pa.Schema,
) -> DataFrame:
    """``packed`` of what ``work`` makes of slices of rows with an id, joined while a task holds less than ``HELD_BYTES``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            arrays = [np.concatenate(x) for x in zip(*held)]
            held.clear()
            made = packed(*arrays)
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in schema], schema=schema)

        for batch in batches:
            for part in common.slices(batch, "text", common.SLICE_BYTES):
                made = work(part)
                if len(made[0]):
                    held.append(made)
                    size += sum(x.nbytes for x in made)
                if size >= HELD_BYTES:
                    yield out()
                    size = 0
        if held:
            yield out()

    kinds = {pa.int32(): "int", pa.binary(): "binary"}
    return common.in_arrow(rows.where(F.col("id").isNotNull()), run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _counted(rows: DataFrame, top: int) -> DataFrame:
    """(bucket, once, again): the shingles of a bucket that a task has once, and others with their counts.

    A shingle goes to the bucket of its first ``top`` bits, its next 32 bits stand for it there.
    """
    def work(batch: pa.RecordBatch) -> tuple[np.ndarray]:
        return _distinct(*shingle_sets(common.texts_of(batch)))[:1]

    def packed(flat: np.ndarray) -> dict[str, list]:
        values, times = np.unique(flat, return_counts=True)
        edges = np.searchsorted(values >> np.uint64(64 - top), np.arange((1 << top) + 1, dtype=np.uint64)).tolist()
        short, once = (values >> np.uint64(32 - top)).astype("<u4"), times == 1
        some = [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        return {
            "bucket": [k for k, _ in some], "once": [short[x][once[x]].tobytes() for _, x in some],
            "again": [short[x][~once[x]].tobytes() + times[x][~once[x]].astype("<u4").tobytes() for _, x in some],
        }

    return _gathered(rows, work, packed, pa.schema([("bucket", pa.int32()), ("once", pa.binary()), ("again", pa.binary())]))


def common_levels(rows: DataFrame, shingles: int, buckets: int) -> np.ndarray:
    """The class of every cell, from counts of all shingles (equal sets of a slice count once).

    A task sends a shingle with its count, so that one which all documents have makes no large bucket. What
    reaches the driver and the workers is one byte for eight shingles, 64 MB at most; where over an eighth
    of the cells would be late, only more common shingles are.
    """
    top = min(max((max(buckets, shingles // BUCKET_SHINGLES) - 1).bit_length(), 1), 16)
    bits = min(max((shingles // 8).bit_length(), SKETCH_BITS), MOST_SKETCH_BITS)

    def add(key: tuple, table: pa.Table) -> pa.Table:
        once = np.frombuffer(b"".join(table.column("once").to_pylist()), "<u4")
        again = [np.frombuffer(x, "<u4").reshape(2, -1) for x in table.column("again").to_pylist()]
        values, times = np.concatenate(again, axis=1)
        made = levels_of(np.concatenate((once, values)), np.concatenate((np.ones(len(once), np.int64), times.astype(np.int64))), bits - top)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([made.tobytes()], pa.binary())})

    out = np.zeros((1 << top, 1 << (bits - top)), np.uint8)
    with common.shuffles_dropped(rows.sparkSession):
        for bucket, made in _counted(rows, top).groupBy("bucket").applyInArrow(add, "bucket int, levels binary").collect():
            out[bucket] = np.frombuffer(made, np.uint8)
    while np.count_nonzero(out) > out.size // 8:
        out -= out > 0
    return out.ravel()


def _packed_signatures(rows: DataFrame, levels: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, packed): signatures of a bucket with their sets, packed for many documents of a task.

    A signature is kept in 32 bits beside its bucket and a set in 40: what meets by chance is
    told apart when sets are compared.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(levels)

    def work(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        flat, sizes, nodes = _distinct(*shingle_sets(common.texts_of(batch)))
        sigs, owners = signatures(flat, sizes, shipped.value)
        return sigs, (nodes & _SHORT_MASK).astype(np.uint64)[owners]

    def packed(sigs: np.ndarray, short: np.ndarray) -> dict[str, list]:
        bucket = (sigs >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, sigs, short = bucket[order], sigs[order].astype("<u4"), short[order].astype("<u8")
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        stops = np.append(begin[1:], len(bucket))
        return {
            "bucket": bucket[begin].astype(np.int32),
            "packed": [sigs[a:b].tobytes() + np.ascontiguousarray(short[a:b].view(np.uint8).reshape(-1, 8)[:, :SHORT_BITS // 8].T).tobytes() for a, b in zip(begin, stops)],
        }

    return _gathered(rows, work, packed, pa.schema([("bucket", pa.int32()), ("packed", pa.binary())]))


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    width = SHORT_BITS // 8
    n = len(packed) // (4 + width)
    short = np.zeros((n, 8), np.uint8)
    short[:, :width] = np.frombuffer(packed, np.uint8, n * width, 4 * n).reshape(width, n).T
    return np.frombuffer(packed, "<u4", n), short.view("<u8").ravel()


_GROUP_SCHEMA = "gid long, size long, hub long, members array<long>"
_MEMBERS = 512
_PAIRS = 256


def _groups(packed: DataFrame, buckets: int) -> DataFrame:
    """(gid, size, hub, members): the sets that share a signature, in rows of 512 members.

    Equal groups of a task are given once. The hub is the member whose number, scrambled in one of
    three ways, is least.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, shorts = [], []
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                sig, short = _unpacked(blob)
                keys.append(sig.astype(np.uint64) | np.uint64(bucket << 32))
                shorts.append(short)
        if not keys:
            return
        key, short = np.concatenate(keys), np.concatenate(shorts).astype(np.uint64)
        keys.clear()
        shorts.clear()
        order = np.argsort(key, kind="stable")
        key, short = key[order], short[order]
        again = key[1:] == key[:-1]
        shared = np.zeros(len(key), bool)
        shared[1:] |= again
        shared[:-1] |= again
        key, short = key[shared], short[shared]
        order = np.lexsort((short, key))
        key, short = key[order], short[order]
        distinct = np.ones(len(key), bool)
        distinct[1:] = (key[1:] != key[:-1]) | (short[1:] != short[:-1])
        key, short = key[distinct], short[distinct]
        if not len(key):
            return
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        with np.errstate(over="ignore"):
            same = np.add.reduceat(common.mixed(short + np.uint64(1)), begin)
        many = np.flatnonzero(size > 1)
        _, first = np.unique(same[many], return_index=True)
        out: dict[str, list] = {"gid": [], "size": [], "hub": [], "members": []}

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([
                *(pa.array(out[c], pa.int64()) for c in ("gid", "size", "hub")), pa.array(out["members"], pa.list_(pa.int64()))], list(out))
            for values in out.values():
                values.clear()
            return made

        for g in many[first].tolist():
            own = short[begin[g]:begin[g] + size[g]]
            hub = int(own[np.argmin(common.mixed(own ^ common.mixed(np.uint64([int(same[g]) % 3 + 1]))))])
            rest = own[own != hub].astype(np.int64)
            for at in range(0, len(rest), _MEMBERS):
                out["gid"].append(int(same[g] >> np.uint64(1)))
                out["size"].append(int(size[g]))
                out["hub"].append(hub)
                out["members"].append(rest[at:at + _MEMBERS])
            if len(out["gid"]) > 2000:
                yield rows()
        if out["gid"]:
            yield rows()

    return common.in_arrow(packed.repartitionById(buckets, "bucket"), run, _GROUP_SCHEMA)


def most_shared(x: bytes, y: bytes) -> int | None:
    """At most how many elements two sets with these cell counts share; None if that is not known.

    The longer list is folded to the shorter one's cells, which are the low bits of its own.
    """
    if b"\xff" in x or b"\xff" in y:  # counts beyond 255 are not held
        return None
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(u) != len(v):
        u, v = (u, v) if len(u) < len(v) else (v, u)
        v = v.reshape(-1, len(u)).sum(axis=0, dtype=np.int64)
    return int(np.minimum(u, v).sum(dtype=np.int64))


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) node pairs, of (left, right) pairs of short numbers, that sizes and cells allow to link."""
    a = nodes.select(F.col("short").alias("left"), F.col("node").alias("a"), F.col("n").alias("n_a"))
    b = nodes.select(F.col("short").alias("right"), F.col("node").alias("b"), F.col("n").alias("n_b"))
    close = (DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b")) & (F.col("a") != F.col("b"))
    near = pairs.join(a, "left").join(b, "right").where(close).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n_a") + F.col("n_b")).alias("total")).distinct()
    met = (near.join(nodes.select(F.col("node").alias("a"), F.col("cells").alias("cells_a")), "a")
           .join(nodes.select(F.col("node").alias("b"), F.col("cells").alias("cells_b")), "b")
           .select("a", "b", "total", "cells_a", "cells_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for total, x, y in zip(*(batch.column(c).to_pylist() for c in ("total", "cells_a", "cells_b"))):
                shared = most_shared(x, y)
                keep.append(shared is None or DENOMINATOR * shared >= NUMERATOR * (total - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return common.in_arrow(met, run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose sets link; ``sets`` has (node, shingles).

    Pairs around one node go to one place, ``_PAIRS`` of them at most about, and every set goes
    there once, however many of the pairs it is in.
    """
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    around = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("key"))
    keyed = (pairs.join(around.toDF("a", "key_a"), "a").join(around.toDF("b", "key_b"), "b")
             .select("a", "b", F.least("key_a", "key_b").alias("key")))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / _PAIRS).alias("chunks"))
    keyed = common.stored(
        keyed.join(sizes, "key").select("key", F.pmod(F.xxhash64("a", "b"), "chunks").alias("chunk"), "a", "b"), "keyed")
    needed = keyed.select("key", "chunk", F.col("a").alias("node")).union(keyed.select("key", "chunk", "b")).distinct()
    none = F.lit(None)
    rows = needed.join(sets, "node").select(
        "key", "chunk", F.col("node").alias("a"), none.cast("long").alias("b"), "shingles",
    ).union(keyed.select("key", "chunk", "a", "b", none.cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, {}
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for key, chunk, a, b, shingles in zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "a", "b", "shingles"))):
                if (key, chunk) != place:
                    place, held = (key, chunk), {}
                if b is None:
                    held[a] = np.frombuffer(shingles, "<u8")
                else:
                    own, other = held[a], held[b]
                    joined = np.sort(np.concatenate((own, other)), kind="stable")
                    if linked(int(np.count_nonzero(joined[1:] == joined[:-1])), len(own), len(other)):
                        found[0].append(a)
                        found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])

    dealt = rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", F.col("b").asc_nulls_first())
    return common.in_arrow(dealt, run, "a long, b long")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits of the places that the ids of ``ids`` hash to: 2^24 bits, whatever the number of ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS))
    words = (ids.select(F.shiftright(place, 5).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {1 << _FILTER_BITS}) % 32 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (_FILTER_BITS - 5), "<u4")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little")


def _sets(rows: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted``, made again from one text of each.

    A bitmap of fixed size tells which documents to take, so that texts are not shuffled; a few
    others that fall on the same bits come along and meet no pair.
    """
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("first_id").alias("id"))
    bits = rows.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(ids)))

    def work(batch: pa.RecordBatch) -> dict[str, object] | None:
        place = batch.column("place").to_numpy(zero_copy_only=False)
        asked = (bits.value[place >> 3] >> (7 - (place & 7))) & 1
        batch = batch.filter(pa.array(asked.astype(bool)))
        flat, sizes = shingle_sets(common.texts_of(batch))
        made = {node_of(x): x.astype("<u8").tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1]) if len(x)}
        return {"node": list(made), "shingles": list(made.values())} if made else None

    place = F.pmod(F.xxhash64("id"), F.lit(1 << _FILTER_BITS)).alias("place")
    return common.map_batches(rows.where(F.col("id").isNotNull()).select("text", place), work, "node long, shingles binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of its component for every node in ``links`` (a, b).

    Each round a node takes the least label around it and then its label's label, until none
    changes; every round is a written table.
    """
    both = common.stored(links.union(links.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = common.stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        low = labels.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = common.stored(low.join(up, "label", "left").select(
            "node", F.least("label", F.coalesce("top", "label")).alias("label"), "was"), "labels")
        labels = new.select("node", "label")
        if new.where(F.col("was") != F.col("label")).isEmpty():
            return labels


def _apart(member: DataFrame) -> DataFrame:
    """The members of groups that are in several components."""
    open_ = member.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("gid")
    return member.join(open_, "gid", "left_semi")


def _near_pairs(one: DataFrame, two: DataFrame, apart: Column) -> DataFrame:
    """(left, right) of members of one group whose sizes and marks let them link, where ``apart`` holds of their labels."""
    one = one.select("gid", F.col("short").alias("left"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), *[F.col(m).alias(f"{m}_a") for m in MARKS])
    two = two.select("gid", F.col("short").alias("right"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), *[F.col(m).alias(f"{m}_b") for m in MARKS])
    close = DENOMINATOR * F.least("n_a", "n_b") >= NUMERATOR * F.greatest("n_a", "n_b")
    return one.join(two, "gid").where(apart & close & _near_marks()).select("left", "right").distinct()


def _hub_pairs(member: DataFrame, turn: int, hubs: int) -> DataFrame:
    """Pairs of up to ``hubs`` members of every group with its members in other components.

    A hub is the member nearest to a number drawn from the group, the turn and its place among the hubs.
    """
    points = [F.xxhash64("gid", F.lit(turn), F.lit(k)).bitwiseAND(F.lit(_SHORT_MASK)) for k in range(hubs)]
    least = member.groupBy("gid").agg(*[F.min(F.col("short").bitwiseXOR(x)).alias(f"least{k}") for k, x in enumerate(points)])
    chosen = least.select("gid", F.explode(F.array_distinct(F.array(*[F.col(f"least{k}").bitwiseXOR(x) for k, x in enumerate(points)]))).alias("short"))
    return _near_pairs(member.join(chosen, ["gid", "short"], "left_semi"), member, F.col("label_a") != F.col("label_b"))


def links(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, nodes, links): the measured rows, the distinct sets, and linked pairs of nodes.

    The links join all that linked documents join; of a group of copies they need not be all pairs.
    """
    rows = _rows(df, id_col, text_col)
    spark = df.sparkSession
    docs = common.stored(_measured(rows), "measured")
    nodes = common.stored(
        docs.where(F.col("id").isNotNull() & F.col("node").isNotNull()).groupBy("node")
        .agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("cells").alias("cells"), *[F.first(m).alias(m) for m in MARKS])
        .withColumn("short", F.col("node").bitwiseAND(F.lit(_SHORT_MASK))), "nodes")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = common_levels(rows, docs.agg(F.sum("n")).first()[0] or 0, buckets)
    groups = common.stored(_groups(_packed_signatures(rows, levels, buckets), buckets), "groups")

    first = common.stored(_plausible(
        groups.select(F.col("hub").alias("left"), F.explode("members").alias("right")).distinct(), nodes), "pairs")
    wanted = common.stored(_ends(first), "wanted")
    sets = common.stored(_sets(rows, wanted, nodes), "sets")
    found = common.stored(_verified(first, sets), "links")

    def compared(pairs: DataFrame) -> int:
        """Adds the links among pairs of short numbers that were not compared yet; how many there are."""
        nonlocal done, wanted, sets, found
        more = common.stored(_plausible(pairs, nodes).join(done, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            return 0
        new = common.stored(_ends(more).join(wanted, "node", "left_anti"), "wanted")
        if not new.isEmpty():
            wanted, sets = wanted.union(new), sets.union(common.stored(_sets(rows, new, nodes), "sets"))
        more_links = common.stored(_verified(more, sets), "links")
        done, found = done.union(more), found.union(more_links)
        return more_links.count()

    # What is left: members of one group in different components, not compared yet.
    named = nodes.join(components(found), "node", "left").select("short", "n", *MARKS, F.coalesce("label", "node").alias("label"))
    large, done = groups.where(F.col("size") > 2), first
    member = common.stored(_apart(
        large.select("gid", F.explode("members").alias("short"))
        .union(large.select("gid", F.col("hub").alias("short"))).distinct().join(named, "short")), "members")
    for turn, hubs in enumerate(HUBS):
        linked_now = compared(_hub_pairs(member, turn, hubs))
        if linked_now:  # a label is a node of its component, so its own label is the new one
            top = components(found).toDF("label", "top")
            member = common.stored(_apart(member.join(top, "label", "left").withColumn("label", F.coalesce("top", "label")).drop("top")), "members")
        if WORTH * linked_now < member.count():
            break
    compared(_near_pairs(member, member, F.col("label_a") < F.col("label_b")))
    return docs, nodes, found


def clustered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    docs, nodes, found = links(df, id_col, text_col)
    label = components(found)
    own = nodes.join(label, "node", "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    least = own.groupBy("label").agg(F.min("first_id").alias("least"))
    ids = own.join(least, "label").select("node", "least", F.explode(F.array(*map(F.lit, range(16)))).alias("salt"))
    # A third of the rows may be copies of one text: they meet their node's id by a salt.
    salted = docs.select("id", "n", "node").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"))
    out = salted.join(ids, ["node", "salt"], "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
