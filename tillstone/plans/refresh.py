"""Incremental loads: a further export changes only the months it has something new for.

A store is a folder with the dimensions and both facts, the facts partitioned by month. The stored
facts carry, besides their own columns, the line id and what a key was looked up by where the lookup missed, so that
a dimension row that comes later still finds the facts waiting for it. Loading exports one
after another, overlapping or late as they may be, gives the facts that one load of all of them gives.

A load is idempotent: run again, it finds nothing new and writes nothing. Months are
replaced by dynamic partition overwrite: tasks write beside the table and the folders are swapped at the
end, so a lost executor costs a retry, never a month.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.operators import load, lookup
from tillstone.operators.numbering import number_lines
from tillstone.plans import star
from tillstone.plans.star import NATURAL_KEYS, Star
from tillstone.session import scratch
from tillstone.vocab import Vocabulary

_SOUGHT = {"producto_sk": ("busca_descripcion", "busca_tipo_iva"), "sede_sk": ("busca_sede",), "pago_sk": ("busca_pago",)}
_VALUES = tuple(c for c in star._FACT_LINES if c != "linea_ticket")


@dataclass(frozen=True)
class Refreshed:
    """The months (yyyymm) that a load rewrote."""

    lines: list[int]
    payments: list[int]


def month_of(day_key: Column) -> Column:
    return F.floor(day_key / 100).cast("int")


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``, or no rows of the same columns."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], like.schema)


def _written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` in a scratch folder, so that several readers do not each compute it."""
    path = scratch(spark, name)
    load.full_reload(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _months(df: DataFrame) -> list[int]:
    """The months of the rows: as many as the calendar has, twelve a year."""
    return sorted(r[0] for r in df.select("mes_key").distinct().collect())


def _in(months: Iterable[int]) -> Column:
    """A partition filter; no month gives no row."""
    return F.col("mes_key").isin(list(months))


def _replace_months(df: DataFrame, path: str) -> None:
    (df.hint("rebalance", "mes_key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").partitionBy("mes_key").parquet(path))


def load_dimensions(spark: SparkSession, lines: DataFrame, tx: DataFrame, root: str, vocab: Vocabulary) -> dict[str, DataFrame]:
    """Adds the new dimension rows of an export to the stored ones; gives the dimensions."""
    def merged(name: str, incoming: DataFrame) -> DataFrame:
        stored = _existing(spark, f"{root}/{name}", incoming)
        fresh = _written(spark, load.new_rows(stored, incoming, NATURAL_KEYS[name]), name)
        fresh.write.mode("append").parquet(f"{root}/{name}")
        return spark.read.schema(incoming.schema).parquet(f"{root}/{name}")

    dims = {
        "dim_date": merged("dim_date", star.dim_date(lines, tx)),
        "dim_product": merged("dim_product", star.dim_product(lines, vocab)),
        "dim_branch": merged("dim_branch", star.dim_branch(lines, vocab)),
        "dim_payment": merged("dim_payment", star.dim_payment(lines, vocab)),
        "dim_card": merged("dim_card", star.dim_card(tx, vocab)),
    }
    dims["dim_device"] = merged("dim_device", star.dim_device(lines, dims["dim_branch"], vocab))
    return dims


def _line_rows(keyed: DataFrame) -> DataFrame:
    """Keyed lines as they are stored, but for the line number; lookup values only where a key is missing."""
    sought = [F.when(F.col(key).isNull(), F.col(c)).alias(c) for key, columns in _SOUGHT.items() for c in columns]
    return keyed.withColumnRenamed("tx_id", "id_transaccion").select(*_VALUES, "line_id", *sought, month_of(F.col("fecha_key")).alias("mes_key"))


def _repaired(stored: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Stored lines with the keys that a later dimension row has made findable, ``late`` where one is new."""
    keys = list(_SOUGHT)
    old = stored.withColumnsRenamed({k: f"old_{k}" for k in keys})
    again = star.looked_up(old, dims["dim_product"], dims["dim_branch"], dims["dim_payment"])
    late = F.lit(False)
    for key in keys:
        late = late | (F.col(f"old_{key}").isNull() & F.col(key).isNotNull())
    found = again.withColumn("late", late).withColumns({k: F.coalesce(f"old_{k}", k) for k in keys})
    sought = {c: F.when(F.col(key).isNull(), F.col(c)) for key, columns in _SOUGHT.items() for c in columns}
    return found.withColumns(sought).select(*stored.columns, "late")


def load_lines(spark: SparkSession, lines: DataFrame, dims: dict[str, DataFrame], root: str, vocab: Vocabulary) -> list[int]:
    """Merges an export's lines into the line fact; gives the months rewritten.

    New rows are told by ticket, line id and a hash of all values within their month. Tickets that gain
    a line are numbered again whole; a month is rewritten if it has a new line, a line whose number
    changes or one that found a late dimension row.
    """
    path = f"{root}/fact_lines"
    keyed = star.keyed_lines(lines, dims["dim_date"], dims["dim_product"], dims["dim_branch"], dims["dim_payment"], vocab)
    incoming = _line_rows(keyed)  # a row that the export holds twice becomes one where tickets are numbered
    shape = incoming.withColumn("linea_ticket", F.lit(0).cast("bigint"))
    table = _existing(spark, path, shape)
    stored = _repaired(table, dims)
    print_ = F.xxhash64(*_VALUES, "line_id").alias("huella")
    own = ["mes_key", "id_transaccion", "line_id", "huella"]
    held = stored.where(_in(_months(incoming))).select("mes_key", "id_transaccion", "line_id", print_)
    new = _written(spark, incoming.select("*", print_).join(held, own, "left_anti").drop("huella"), "new-lines")
    gaining = new.select("id_transaccion").distinct()
    where = _months(stored.select("id_transaccion", "mes_key").join(gaining, "id_transaccion", "left_semi"))
    old = stored.where(_in(where)).join(gaining, "id_transaccion", "left_semi").withColumnRenamed("linea_ticket", "antes")
    again = old.drop("late").unionByName(new.withColumn("antes", F.lit(None).cast("bigint")))
    ticket_lines = [F.col("id_transaccion").alias("tx_id"), "line_id"]
    sizes = table.where(_in(where)).select(*ticket_lines).unionByName(new.select(*ticket_lines))
    numbers = number_lines(again.withColumnRenamed("id_transaccion", "tx_id"), sizes=sizes, distinct=True)
    numbered = _written(spark, numbers.withColumnRenamed("tx_id", "id_transaccion"), "numbered-lines")
    moved = numbered.where(F.col("antes").isNull() | (F.col("antes") != F.col("linea_ticket")))
    touched = sorted({*_months(moved), *_months(stored.where("late"))})
    if touched:
        rest = stored.where(_in(touched)).join(gaining, "id_transaccion", "left_anti").drop("late")
        _replace_months(rest.unionByName(numbered.where(_in(touched)).drop("antes")), path)
    return touched


def load_payments(spark: SparkSession, tx: DataFrame, dims: dict[str, DataFrame], root: str, vocab: Vocabulary) -> list[int]:
    """Merges an export's payments into the payment fact; gives the months rewritten.

    The row kept per payment id is the least of all its rows, which the stored one and the new
    ones decide without the rows seen before. A payment may move to an earlier month.
    """
    path = f"{root}/fact_tx"
    rows = star.payment_rows(tx, vocab)
    columns = rows.columns
    shape = star.keyed_payments(rows, dims["dim_date"], dims["dim_card"]).withColumn("mes_key", month_of(F.col("fecha_key")))
    stored = _existing(spark, path, shape)
    ids = rows.select("id_transaccion")
    where = _months(stored.select("id_transaccion", "mes_key").join(ids, "id_transaccion", "left_semi"))
    old = stored.where(_in(where)).join(ids, "id_transaccion", "left_semi")
    best = load.first_per_key(old.select(*columns).unionByName(rows), ["id_transaccion"])
    keyed = star.keyed_payments(best, dims["dim_date"], dims["dim_card"]).withColumn("mes_key", month_of(F.col("fecha_key")))
    print_ = F.xxhash64(*shape.columns)
    before = old.select("id_transaccion", F.col("mes_key").alias("mes_antes"), print_.alias("antes"))
    merged = keyed.withColumn("ahora", print_).join(before, "id_transaccion", "left")
    changed = _written(spark, merged.where(F.col("antes").isNull() | (F.col("antes") != F.col("ahora"))), "changed-payments")
    repaired = star.keyed_payments(stored.withColumnRenamed("tarjeta_sk", "old_sk").drop("fecha_key"), dims["dim_date"], dims["dim_card"])
    repaired = repaired.withColumn("late", F.col("old_sk").isNull() & F.col("tarjeta_sk").isNotNull()).withColumn(
        "tarjeta_sk", F.coalesce("old_sk", "tarjeta_sk"))
    gone = changed.where("mes_antes IS NOT NULL").select(F.col("mes_antes").alias("mes_key"))
    touched = sorted({*_months(changed), *_months(gone), *_months(repaired.where("late"))})
    if touched:
        rest = repaired.where(_in(touched)).join(changed.select("id_transaccion"), "id_transaccion", "left_anti")
        kept = rest.select(*shape.columns).unionByName(changed.select(*shape.columns))
        emptied = set(touched) - set(_months(kept))
        _replace_months(kept, path)
        _drop_emptied(spark, path, emptied)
    return touched


def _drop_emptied(spark: SparkSession, path: str, months: Iterable[int]) -> None:
    """Removes months that no row was written to. Where a load ends before this, the next one finds
    the rows left there in two months and mends it."""
    for month in months:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/mes_key={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def load_increment(spark: SparkSession, lines: DataFrame, tx: DataFrame, root: str, vocab: Vocabulary) -> Refreshed:
    """Loads one export (clean lines and payments) into the store at ``root``, which may not exist yet."""
    dims = load_dimensions(spark, lines, tx, root, vocab)
    return Refreshed(load_lines(spark, lines, dims, root, vocab), load_payments(spark, tx, dims, root, vocab))


def stored_star(spark: SparkSession, root: str) -> Star:
    """The store as a star. The branch of a payment is any branch, the least one, so it is added here:
    stored, a new branch would change every payment."""
    dims = {name: spark.read.parquet(f"{root}/{name}") for name in NATURAL_KEYS}
    payments = lookup.with_single_row(spark.read.parquet(f"{root}/fact_tx"), star.any_branch(dims["dim_branch"]))
    return Star(
        **dims, fact_lines=spark.read.parquet(f"{root}/fact_lines").select(*star._FACT_LINES, "mes_key"),
        fact_tx=payments.select(*star._FACT_TX))
