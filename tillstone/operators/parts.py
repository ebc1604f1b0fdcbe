"""Tables kept in parts, for upserts that read and write only where there is news.

The table lies in the catalog, partitioned by a hash of its key (``parte``) and, within, bucketed and sorted
by the key. An upsert then joins without shuffling the table, and rewrites only parts that hold a
key of the incoming rows. Which parts may hold one is told by a summary of keys, a Bloom filter
of some 16 bits a key built from Spark's bitmap aggregates; parts that hold none get their new
rows appended, without being read.

Keys are one column, not NULL. ``incoming`` must be unique by key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.session import scratch

#: Bits that a key sets in its part's summary, and bits of one bitmap of Spark's aggregate.
PROBES, BITMAP_BITS = 3, 32768


@dataclass(frozen=True)
class Parted:
    """A parted table: its qualified name, key, and how it is cut. ``bits`` is the summary's size per part."""

    name: str
    key: str
    parts: int
    buckets: int
    bits: int
    folder: str

    @property
    def summary(self) -> str:
        return f"{self.folder}/claves"


@dataclass(frozen=True)
class Upserted:
    """The parts that were rewritten and those that rows were only added to."""

    rewritten: list[int]
    appended: list[int]


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create(rows: DataFrame, name: str, key: str, parts: int = 64, buckets: int = 8, keys_in_part: int = 1 << 16) -> Parted:
    """Stores ``rows`` as the parted table ``name``."""
    spark = rows.sparkSession
    table = Parted(name, key, parts, buckets, max(BITMAP_BITS, 16 * keys_in_part), scratch(spark, "parted"))
    placed = rows.withColumn("parte", part_of(F.col(key), parts)).repartition(buckets, key)
    (placed.write.partitionBy("parte").bucketBy(buckets, key).sortBy(key).option("path", f"{table.folder}/filas")
     .format("parquet").saveAsTable(name))
    _summed(spark.table(name), table).write.partitionBy("parte").parquet(table.summary)
    return table


def read(spark: SparkSession, table: Parted) -> DataFrame:
    return spark.table(table.name).drop("parte")


def _probes(rows: DataFrame, table: Parted) -> DataFrame:
    """(key, parte, mapa, sitio): the bits of each key, by bitmap and place in it."""
    slots = F.array(*[F.pmod(F.xxhash64(F.col(table.key), F.lit(i)), F.lit(table.bits)) + 1 for i in range(PROBES)])
    return rows.select(table.key, part_of(F.col(table.key), table.parts).alias("parte"), F.explode(slots).alias("slot")).select(
        table.key, "parte", F.bitmap_bucket_number("slot").alias("mapa"), F.bitmap_bit_position("slot").alias("sitio"))


def _summed(rows: DataFrame, table: Parted) -> DataFrame:
    return _probes(rows, table).groupBy("parte", "mapa").agg(F.bitmap_construct_agg("sitio").alias("bits"))


def may_hold(spark: SparkSession, incoming: DataFrame, table: Parted) -> DataFrame:
    """The keys of ``incoming`` that the table may hold; none that it does hold is missing."""
    summary = spark.read.schema("mapa bigint, bits binary, parte int").parquet(table.summary)
    asked = _probes(incoming, table).join(summary, ["parte", "mapa"], "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("sitio") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("sitio") % 8)).cast("int").bitwiseAND(1), F.lit(0))
    return asked.groupBy(table.key, "parte").agg(F.min(is_set).alias("all_set")).where("all_set = 1").select(table.key, "parte")


def _parts(df: DataFrame) -> list[int]:
    """As many numbers as the table has parts at most."""
    return sorted(r[0] for r in df.select("parte").distinct().collect())


def merged(spark: SparkSession, incoming: DataFrame, table: Parted, parts: list[int]) -> DataFrame:
    """The rows of these parts after the upsert. The table's side keeps its buckets and order."""
    columns = spark.table(table.name).columns
    target = spark.table(table.name).where(F.col("parte").isin(parts))
    new = incoming.withColumn("parte", part_of(F.col(table.key), table.parts)).where(F.col("parte").isin(parts))
    new = new.select(*[F.col(c).alias(f"new_{c}") for c in columns])
    fresh = F.col(f"new_{table.key}").isNotNull()
    joined = target.join(new, target[table.key] == new[f"new_{table.key}"], "full_outer")
    return joined.select(*[F.when(fresh, F.col(f"new_{c}")).otherwise(target[c]).alias(c) for c in columns])


def _replacing_parts(spark: SparkSession) -> SparkSession:
    """A session on the same catalog in which an overwrite replaces the written parts alone.

    Writing into a bucketed table takes this from the session, and the caller's is not ours to change.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    return session


def upsert(spark: SparkSession, incoming: DataFrame, table: Parted) -> Upserted:
    """Incoming rows replace rows of the same key and are added otherwise; other parts keep their files."""
    path = scratch(spark, "incoming")
    incoming.write.parquet(path)
    caller, spark = spark, _replacing_parts(spark)
    incoming = spark.read.schema(incoming.schema).parquet(path)
    rows = incoming.withColumn("parte", part_of(F.col(table.key), table.parts))
    touched = _parts(rows)
    rewritten = _parts(may_hold(spark, incoming, table))
    appended = sorted(set(touched) - set(rewritten))
    columns = spark.table(table.name).columns
    if rewritten:
        merged(spark, incoming, table, rewritten).write.insertInto(table.name, overwrite=True)
    if appended:
        rows.where(F.col("parte").isin(appended)).repartition(table.buckets, table.key).select(*columns).write.insertInto(table.name)
    old = spark.read.schema("mapa bigint, bits binary, parte int").parquet(table.summary).where(F.col("parte").isin(touched))
    new = old.unionByName(_summed(incoming, table)).groupBy("parte", "mapa").agg(F.bitmap_or_agg("bits").alias("bits"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("parte").parquet(table.summary)
    caller.catalog.refreshTable(table.name)  # it has the files from before in mind
    return Upserted(rewritten, appended)
