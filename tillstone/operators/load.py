"""Idempotent loads: surrogate keys, insert-ignore, upsert, full reload."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.operators.lookup import with_single_row

#: Ranges that dense keys are dealt from; a range is numbered by one task.
KEY_RANGES = 4096


def surrogate_key(*natural: Column) -> Column:
    """60-bit integer key from the natural key, NULL-safe.

    A hash needs no global order, so keys are assigned in parallel, and a reload or an
    incremental load gives an old row the key it had. ``duplicate_keys`` in
    ``operators.profile`` reports a collision.
    """
    parts = [F.coalesce(c.cast("string"), F.lit("\u0002")) for c in natural]
    digest = F.md5(F.concat_ws("\u0001", *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def first_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by the remaining columns in order."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def new_rows(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows, one per key, whose key the target does not hold. NULL equals NULL,
    so that loading twice is the same as loading once."""
    unique = first_per_key(incoming, keys)
    return unique.join(target, _same_key(unique, target, keys), "left_anti")


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target plus the incoming rows with a new key; existing rows win."""
    return target.unionByName(new_rows(target, incoming, keys))


def _key_range(keys: Sequence[str], ranges: int) -> Column:
    """The range of a row's key: the first digits of its surrogate key."""
    return (surrogate_key(*[F.col(k) for k in keys]) % ranges).cast("int")


def dense_keys(target: DataFrame, incoming: DataFrame, keys: Sequence[str], alias: str, ranges: int = KEY_RANGES) -> DataFrame:
    """Incoming rows with a new key, one per key, numbered on from the target's greatest ``alias`` without gaps.

    Keys fall into hashed ranges. A range is numbered in order of the key by one task, and begins where the
    ranges before it, counted in a first pass, end; so there is no global sort, and the numbers do not
    depend on partitions. Stored keys stay as they are, whatever is loaded later.
    """
    fresh = new_rows(target.select(*keys), incoming.select(*keys).distinct(), keys).withColumn("_range", _key_range(keys, ranges))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = fresh.groupBy("_range").agg(F.count("*").alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    last = target.agg(F.coalesce(F.max(alias), F.lit(0)).cast("bigint").alias("_last"))
    within = Window.partitionBy("_range").orderBy(*[F.asc_nulls_first(k) for k in keys])
    placed = with_single_row(fresh.join(offsets, "_range"), last)
    return placed.select(*keys, (F.col("_last") + F.col("_before") + F.row_number().over(within)).cast("bigint").alias(alias))


def upsert_update(target: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace target rows of the same key; other target rows stay.

    ``incoming`` must be unique by key. Write the result to a path that is not being read.
    """
    kept = target.join(incoming, _same_key(target, incoming, keys), "left_anti")
    return kept.unionByName(incoming)


def full_reload(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace the table at ``path``."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
