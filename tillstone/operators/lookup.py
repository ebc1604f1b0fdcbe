"""Dimension lookups as left joins.

No broadcast hint: Spark broadcasts a dimension when its size is below
``spark.sql.autoBroadcastJoinThreshold`` (re-checked at run time by AQE) and otherwise
shuffles, splitting skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(
    df: DataFrame, dim: DataFrame, on: Mapping[str, Column], value: str, alias: str | None = None
) -> DataFrame:
    """Add the smallest ``value`` among dimension rows whose keys equal ``on``, or NULL."""
    reduced = dim.groupBy(*on).agg(F.min(value).alias("_value"))
    return _left(df, reduced, on, alias or value)


def only_match(
    df: DataFrame, dim: DataFrame, on: Mapping[str, Column], value: str, alias: str | None = None
) -> DataFrame:
    """Like ``first_match``, but the job fails if a key that is looked up has more than one row."""
    message = F.lit(f"more than one {value} for one key")
    found = F.struct(F.min(value).alias("value"), F.count("*").alias("rows"))
    joined = _left(df, dim.groupBy(*on).agg(found.alias("_value")), on, "_found")
    one = F.when(F.col("_found.rows") > 1, F.raise_error(message)).otherwise(F.col("_found.value"))
    return joined.withColumn(alias or value, one).drop("_found")


def _left(df: DataFrame, reduced: DataFrame, on: Mapping[str, Column], alias: str) -> DataFrame:
    renamed = reduced.select(
        *[F.col(k).alias(f"_key_{i}") for i, k in enumerate(on)], F.col("_value").alias(alias)
    )
    condition = None
    for i, expression in enumerate(on.values()):
        equal = expression == F.col(f"_key_{i}")
        condition = equal if condition is None else condition & equal
    return df.join(renamed, condition, "left").drop(*[f"_key_{i}" for i in range(len(on))])


def with_single_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a table of one row, such as a global aggregate, to every row.

    The row is taken by an aggregate, so the side that is broadcast is one row whatever is given.
    """
    row = one_row.agg(*[F.first(c).alias(c) for c in one_row.columns])
    return df.crossJoin(F.broadcast(row))


def keep_known(df: DataFrame, ids: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``ids``. Ids are made distinct first: that shuffles on the
    join key anyway, and a key repeated in a third of ``ids`` arrives once per map task."""
    return df.join(ids.select(on).distinct(), on, "left_semi")
