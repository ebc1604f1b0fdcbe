"""Upserts into parted tables."""

import uuid

import pytest
from pyspark.sql import functions as F

from tillstone.operators import load, parts


@pytest.fixture
def made(spark):
    names = []

    def make(rows, **cut):
        names.append(f"parted_{uuid.uuid4().hex}")
        return parts.create(rows, names[-1], "k", **{"parts": 8, "buckets": 2, "keys_in_part": 512, **cut})

    yield make
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def numbers(spark, low, high, text):
    return spark.range(low, high).select(F.col("id").alias("k"), F.lit(text).alias("v"), (F.col("id") * 2).alias("w"))


def listed(df):
    return sorted(tuple(r) for r in df.select("k", "v", "w").collect())


def files(spark, table):
    return {f.split("filas/")[1] for f in spark.table(table.name).inputFiles()}


def test_equals_the_plain_upsert(spark, made):
    old = numbers(spark, 0, 1000, "old").withColumn("v", F.when(F.col("k") % 7 == 0, None).otherwise(F.col("v")))
    table, whole = made(old), old
    for new in (numbers(spark, 500, 1200, "one"), numbers(spark, 0, 3, "two"), numbers(spark, 5000, 5001, "three"), numbers(spark, 0, 0, "none")):
        parts.upsert(spark, new, table)
        whole = load.upsert_update(whole, new, ["k"])
        assert listed(parts.read(spark, table)) == listed(whole)


def test_only_parts_with_news_are_written_and_only_those_that_match_rewritten(spark, made):
    table = made(numbers(spark, 0, 1000, "old"))
    before = files(spark, table)
    assert len(before) == 16  # a file for each part and bucket
    done = parts.upsert(spark, numbers(spark, 7, 8, "new"), table)
    assert len(done.rewritten) == 1 and done.appended == []
    after = files(spark, table)
    assert {f.split("/")[0] for f in before ^ after} == {f"parte={done.rewritten[0]}"}
    fresh = parts.upsert(spark, numbers(spark, 10**9, 10**9 + 1, "far"), table)
    assert fresh.rewritten == [] and len(fresh.appended) == 1  # no key like it: nothing is read
    assert after < files(spark, table)
    again = parts.upsert(spark, numbers(spark, 10**9, 10**9 + 1, "far again"), table)
    assert again.rewritten == fresh.appended  # the summary has learned the key
    assert spark.table(table.name).where(f"k = {10**9}").collect()[0]["v"] == "far again"


def test_the_summary_misses_no_key_and_seldom_errs(spark, made):
    table = made(numbers(spark, 0, 4000, "old"))
    assert parts.may_hold(spark, numbers(spark, 0, 4000, ""), table).count() == 4000
    assert parts.may_hold(spark, numbers(spark, 10_000, 14_000, ""), table).count() < 200


def test_the_table_is_not_shuffled(spark, made):
    table = made(numbers(spark, 0, 1000, "old"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = parts.merged(spark, numbers(spark, 500, 700, "new"), table, [1, 2])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1
    target = plan[plan.index("SortMergeJoin"):plan.index("FileScan")]
    assert "Exchange" not in target and "Bucketed: true" in plan and "PartitionFilters: [parte" in plan
