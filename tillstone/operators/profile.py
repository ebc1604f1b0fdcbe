"""Table diagnostics as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(tabla, registros): one row per table."""
    counts = [
        df.agg(F.count("*").alias("registros")).select(F.lit(name).alias("tabla"), "registros")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def distinct_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(info, conteo): distinct non-blank values of each column, in one scan.

    Columns are unpivoted and deduplicated with partial aggregation, so a value that
    fills a third of a column costs one row per map task.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("info"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    none = df.sparkSession.createDataFrame([(c, None) for c in columns], "info string, value string")
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.info", "p.value")
        .union(none)  # a row per column even where the table is empty
        .distinct()
        .groupBy("info")
        .agg(F.count(F.nullif("value", F.lit(""))).alias("conteo"))
    )


def distinct_sample(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """First ``n`` distinct non-NULL values in order."""
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(n)


def unmatched_counts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(clave, sin_referencia): facts whose lookup found no dimension row."""
    sums = facts.agg(*[F.count(F.when(F.col(k).isNull(), 1)).alias(k) for k in keys])
    return sums.unpivot([], list(keys), "clave", "sin_referencia")


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    """Key values held by more than one row; empty when the key is unique."""
    return dim.groupBy(key).agg(F.count("*").alias("filas")).filter(F.col("filas") > 1)
