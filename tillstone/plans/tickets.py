"""Distinct tickets that add up: stored bitmaps of ticket numbers.

A distinct count cannot be summed over days. Here ticket ids get dense numbers, stored once, and each
(date, hour, branch) stores the bitmaps of its tickets' numbers. Any period, hour or branch total is the
union of stored bitmaps, exact, and a further day is added without reading older lines. A union of a
bitmap with itself changes nothing, so exports may overlap and a load may be repeated.

A bitmap is an integer of 64 numbers. Tickets of one hour hold few of all numbers, so that longer bitmaps (Spark's
binary ones hold 32,768) would be nearly all zeros, and the more of them the more tickets there are; short ones
take at most one row for every ticket, place and hour.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.functions import branch as branches
from tillstone.operators import load
from tillstone.plans.hours import peak_lines
from tillstone.session import scratch
from tillstone.vocab import Vocabulary

_NUMBERS = "tx_id string, numero bigint"
_BITMAPS = "fecha date, hora_del_dia int, sede string, mapa bigint, bits bigint, mes_key int"
BITS = 64
#: Stands for all branches, whether a line's branch is known or not.
ALL = "total"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def add(spark: SparkSession, lines: DataFrame, root: str, vocab: Vocabulary) -> None:
    """Adds the lines of an export to the store at ``root``, which may not exist yet."""
    kept = peak_lines(lines, vocab).where("tx_id IS NOT NULL")
    norm = F.col("branch_norm")
    places = F.filter(
        F.array(F.lit(ALL), *[F.when(branches.is_narrow_match(norm, b), F.lit(b.slug)) for b in vocab.branches]), lambda x: x.isNotNull())
    seen = kept.select("tx_id", F.to_date("sold_at").alias("fecha"), F.hour("sold_at").alias("hora_del_dia"), F.explode(places).alias("sede"))
    path = scratch(spark, "seen-tickets")
    load.full_reload(seen.distinct(), path)
    seen = spark.read.schema(seen.schema).parquet(path)
    numbers = load.dense_keys(_stored(spark, f"{root}/numeros", _NUMBERS), seen.select("tx_id"), ["tx_id"], "numero")
    fresh = scratch(spark, "ticket-numbers")
    load.full_reload(numbers, fresh)
    spark.read.schema(_NUMBERS).parquet(fresh).write.mode("append").option("compression", "zstd").parquet(f"{root}/numeros")
    numbered = seen.join(_stored(spark, f"{root}/numeros", _NUMBERS), "tx_id")
    bit = F.expr(f"shiftleft(1L, cast(numero % {BITS} as int))")
    bitmaps = numbered.groupBy("fecha", "hora_del_dia", "sede", F.expr(f"numero div {BITS}").alias("mapa")).agg(F.bit_or(bit).alias("bits"))
    month = (F.year("fecha") * 100 + F.month("fecha")).alias("mes_key")
    bitmaps.select("*", month).hint("rebalance", "mes_key").write.mode("append").option("compression", "zstd").partitionBy("mes_key").parquet(f"{root}/mapas")


def read(spark: SparkSession, root: str) -> DataFrame:
    """The stored bitmaps; several rows of one place and time are parts of one union."""
    return _stored(spark, f"{root}/mapas", _BITMAPS)


def distinct_tickets(bitmaps: DataFrame, by: Sequence[str], alias: str = "tickets") -> DataFrame:
    """Distinct tickets by any of the stored columns, over whatever rows are given."""
    unions = bitmaps.groupBy(*by, "mapa").agg(F.bit_count(F.bit_or("bits")).alias("n"))
    return unions.groupBy(*by).agg(F.sum("n").cast("bigint").alias(alias))


def peak_hours(bitmaps: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct tickets per hour of day, every branch and in total, from stored bitmaps."""
    names = {b.slug: f"sede_{b.slug}" for b in vocab.branches} | {ALL: "total_transacciones"}
    counts = distinct_tickets(bitmaps, ["hora_del_dia", "sede"])
    return counts.groupBy("hora_del_dia").agg(*[
        F.coalesce(F.sum(F.when(F.col("sede") == place, F.col("tickets"))), F.lit(0)).alias(name) for place, name in names.items()
    ]).orderBy("hora_del_dia")
