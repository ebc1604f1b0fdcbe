"""Line numbers within a ticket, without putting a whole ticket into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a ticket up to which one task numbers it.
TARGET = 1_000_000
BUCKETS = 256
#: Hashed groups of tickets that are counted first: a ticket over the target is in a group over it.
SLOTS = 4096


def _bounds(sizes: DataFrame, target: int) -> DataFrame:
    """Percentiles of the line ids of every ticket of over ``target`` lines, one row each.

    Tickets are counted only in the few hashed groups that are over the target themselves, so an ordinary
    table is read once and shuffles ``SLOTS`` rows a task. There is at most one large ticket to ``target``
    lines, so they are broadcast.
    """
    slot = F.pmod(F.xxhash64("tx_id"), F.lit(SLOTS)).alias("_slot")
    counted = sizes.groupBy(slot).agg(F.count("*").alias("_n")).filter(F.col("_n") > target).select("_slot")
    near = sizes.select("tx_id", "line_id", slot).join(F.broadcast(counted), "_slot", "left_semi").select("tx_id", "line_id")
    large = near.groupBy("tx_id").agg(F.count("*").alias("_n")).filter(F.col("_n") > target).select("tx_id")
    steps = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    return near.join(F.broadcast(large), "tx_id", "left_semi").groupBy("tx_id").agg(
        F.percentile_approx("line_id", steps, 10_000).alias("_bounds"))


def _cut(lines: DataFrame, bounds: DataFrame, how: str) -> DataFrame:
    below = F.size(F.filter("_bounds", lambda x: x < F.col("line_id")))
    return (
        lines.join(F.broadcast(bounds), "tx_id", how)
        .withColumn("_bucket", F.when(F.col("_bounds").isNull(), 0).otherwise(below)).drop("_bounds")
    )


def bucketed(lines: DataFrame, target: int = TARGET) -> DataFrame:
    """Add ``_bucket``: 0, or for a ticket of over ``target`` lines its part of the line ids.

    The bounds are percentiles of the ticket's own ids, so clumped and sparse ids split too.
    Only large tickets have bounds, one row each.
    """
    return _cut(lines, _bounds(lines, target), "left")


def number_lines(
    lines: DataFrame, target: int = TARGET, alias: str = "linea_ticket", sizes: DataFrame | None = None, distinct: bool = False,
) -> DataFrame:
    """Add 1, 2, 3 ... per ``tx_id`` in ``line_id`` order; the result does not depend on ``target``.

    An ordinary ticket is numbered by one task. A ticket of over ``target`` lines is cut into
    up to 256 ranges of line ids that are numbered apart, and a range gets the number of
    lines in earlier ranges added. Rows are shuffled once. With ``distinct``, equal rows are one, told by the
    order that numbers them. ``sizes`` is a cheaper table (tx_id, line_id) to learn large tickets from, which holds
    every line of ``lines``; more of them change no number.
    """
    bounds = _bounds(lines if sizes is None else sizes, target)
    parts, split = _cut(lines, bounds, "left"), _cut(lines, bounds, "inner")
    in_bucket = Window.partitionBy("tx_id", "_bucket").orderBy("line_id")
    if distinct:  # equal rows rank alike, and only the first of them has its rank as its number
        in_bucket = in_bucket.orderBy("line_id", *[c for c in lines.columns if c not in ("tx_id", "line_id")])
        numbered = parts.select("*", *[f.over(in_bucket).alias(n) for f, n in (
            (F.row_number(), "_all"), (F.rank(), "_first"), (F.dense_rank(), "_row"))])
        numbered, split = numbered.where("_all = _first").drop("_all", "_first"), split.distinct()
    else:
        numbered = parts.withColumn("_row", F.row_number().over(in_bucket))
    earlier = Window.partitionBy("tx_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # of large tickets only
        split.groupBy("tx_id", "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(earlier))
        .filter(F.col("_before") > 0)
        .select("tx_id", "_bucket", "_before")
    )
    return (
        numbered.join(offsets, ["tx_id", "_bucket"], "left")
        .withColumn(alias, (F.col("_row") + F.coalesce("_before", F.lit(0))).cast("bigint"))
        .drop("_bucket", "_row", "_before")
    )
