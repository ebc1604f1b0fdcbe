"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstone.session import ensure_checkpoint_dir

#: Bytes of text that one step of a Python worker handles at a time.
SLICE_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again.

    Unlike ``checkpoint`` it runs the plan a single time, and what is read is columnar. The
    shuffle files of the run go at its end, since nothing reads them again.
    """
    path = shared_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what is run drops its shuffle files when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` by workers that can import this package."""
    importable(df.sparkSession)
    return df.mapInArrow(run, schema)


def importable(spark: SparkSession) -> None:
    """Puts this package on the path of Python workers that run beside the driver's files.

    Where executors have no such folder, install the package there or pass it by ``--py-files``.
    """
    root, own = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in (paths := own.get("PYTHONPATH", "").split(os.pathsep)):
        own["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def fold(key: Column, divisor: int) -> Column:
    """crc32 of a key's text modulo ``divisor``; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows holding about ``limit`` bytes of ``column``, text or a list of numbers; one row at least."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        sizes = pc.multiply(pc.list_value_length(values), values.type.value_type.bit_width // 8)
    else:
        sizes = pc.binary_length(values)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


_state: dict[str, object] = {}


def only(owner: object, make: Callable[[], object]) -> object:
    """The state that ``owner`` keeps in this worker process; what another one kept is let go first.

    Workers are used again by later stages, so without it the caches of every operator add up.
    """
    if _state.get("owner") != owner:
        _state.clear()
        gc.collect()
        _trim(0)
        _state.update(owner=owner, value=make())
    return _state["value"]


def _trim(pad: int) -> None:
    """Gives freed memory back to the system where the C library can."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(pad)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8, a null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def map_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str,
    column: str = "text", limit: int = SLICE_BYTES,
) -> DataFrame:
    """``work`` over slices of rows; it gives the columns of ``schema`` as arrays or lists."""
    empty = df.sparkSession.createDataFrame([], schema)
    target = pa.schema([
        pa.field(f.name, pa_type(f.dataType.simpleString())) for f in empty.schema.fields
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                if (made := work(part)) is not None:
                    yield pa.RecordBatch.from_arrays(
                        [x.cast(f.type) if isinstance(x := made[f.name], pa.Array) else pa.array(x, type=f.type)
                         for f in target], schema=target)

    return in_arrow(df, run, schema)


def keep_rows(df: DataFrame, verdict: Callable[[list[bytes]], np.ndarray], column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """The rows whose text ``verdict`` accepts, with all their columns as they are."""
    names = df.columns
    place = names.index(column)
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, f"c{place}", limit):
                yield part.filter(pa.array(verdict(texts_of(part, f"c{place}")), pa.bool_()))

    return in_arrow(plain, run, plain.schema).toDF(*names)


_PA = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
    "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
}


def pa_type(name: str) -> pa.DataType:
    return pa.list_(pa_type(name[6:-1])) if name.startswith("array<") else _PA[name]


def nested(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list per row from the flat values and the length of each row."""
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions starts[i], ..., starts[i] + lengths[i] - 1 for every i, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(np.asarray(starts, np.int64) - before, lengths) + np.arange(total, dtype=np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread over the whole range (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64).copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Interned(dict):
    """Word to number, handing out the next number to a new word and noting it."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class WordCache:
    """Per-word arrays of integers, each distinct word worked out once while it is held.

    ``make`` gives the values of a list of new words: a list for each, or all values one after
    another and how many each word has. At ``limit`` words all are let go,
    so memory stays bounded whatever the vocabulary.
    """

    def __init__(self, make: Callable[[list[bytes]], list], limit: int = 800_000, dtype: type = np.uint32) -> None:
        self.make, self.limit, self.dtype = make, limit, dtype
        self._clear()

    def _clear(self) -> None:
        self.known, self.flat = Interned(), np.empty(1 << 12, self.dtype)
        self.used, self.starts, self.sizes = 0, np.empty(1 << 10, np.int64), np.empty(1 << 10, np.int32)
        self.count = 0

    def _learn(self) -> None:
        values = self.make(self.known.new)
        self.known.new = []
        if isinstance(values, tuple):
            flat, sizes = values
        else:
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            flat = np.fromiter(chain.from_iterable(values), self.dtype, int(sizes.sum()))
        more, total = len(sizes), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while self.count + more > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        self.flat[self.used:self.used + total] = flat
        self.starts[self.count:self.count + more] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count:self.count + more] = sizes
        self.used, self.count = self.used + total, self.count + more

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; good until the next call."""
        if len(self.known) > self.limit:
            self._clear()
        at = self.known.numbers(words)
        if self.known.new:
            self._learn()
        return at

    def values(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words one after another, and how many each word has."""
        at = self.numbers(words)
        sizes = self.sizes[at]
        return self.flat[spans(sizes, self.starts[at])], sizes


def per_text(sizes: np.ndarray, words: list[int]) -> np.ndarray:
    """Sums of ``sizes`` over consecutive runs of words, one run per text."""
    ends = np.cumsum(words, dtype=np.int64)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return total[ends] - total[ends - np.asarray(words, np.int64)]
