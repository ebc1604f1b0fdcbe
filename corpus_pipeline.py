"""The corpus pipeline: language, quality, near duplicates, benchmark leaks, token ids.

Each stage takes the documents its predecessor kept and, but for the last, gives documents
with the same columns. ``run`` writes every stage as a table in the shared folder and reads it
for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillstone.llm import bpe, common, decontaminate, hosts, jaccard, langid


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the profiles know; texts without letters or like none go.

    Rows are judged by themselves: null ids stay if their text does, repeated rows are all judged alike.
    Where no row has a language nothing can be learned, no language is known and every document goes.
    An empty table gives no rows.
    """
    learned = langid.profiles(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.accepted(docs, learned)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host rules keep.

    Rows are judged by id, text and source, so of rows that share an id, null or not, each stands for
    itself; a null text is too short and goes. An empty table gives no rows.
    """
    dropped = hosts.verdicts(docs).where(~F.col("kept")).select(F.col("doc_id").alias("id"), "row_key").distinct()
    wanted = docs["doc_id"].eqNullSafe(dropped["id"]) & (F.xxhash64(docs["text"], docs["source"]) == dropped["row_key"])
    return docs.join(dropped, wanted, "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies, once; null ids stay.

    Where an id has several texts, the one with the least hash goes by the id and the others by numbers
    above all ids, so that each is a document of its own. Of rows alike in id and text one stays.
    An empty table gives no rows.
    """
    number, nth, low, high = (_unused(docs, x) for x in ("_number", "_nth", "_low", "_high"))
    of = F.xxhash64("text")
    several = (docs.groupBy("doc_id").agg(F.min(of).alias(low), F.max(of).alias(high)).where(F.col(low) < F.col(high)).select("doc_id", low))
    further = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) + F.lit(1 << 62)
    numbered = docs.join(several, "doc_id", "left").withColumn(
        number, F.when(F.col(low) < of, further).otherwise(F.col("doc_id"))).drop(low)
    first = jaccard.clustered(numbered, id_col=number).where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(number)).distinct()
    order = Window.partitionBy(number).orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in docs.columns if c != "doc_id"])
    kept = (numbered.where(F.col("doc_id").isNotNull()).join(first, number, "left_semi")
            .withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*docs.columns))
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Rows are searched one by one, null ids and repeated rows included; a null text holds nothing and stays.
    An empty benchmark leaves all documents, an empty table gives no rows.
    """
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the documents left, a row each; a null text has no ids."""
    return bpe.digests(docs)


STAGES = [
    ("language ID", language),
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", leaks),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Models and similarity by signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
