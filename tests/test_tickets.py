"""Dense keys and bitmaps of ticket numbers."""

from tests.shopdata import line, lines, rows
from tillstone.operators import load
from tillstone.plans import hours, tickets
from tillstone.sources.testshop import VOCABULARY as VOCAB


def test_dense_keys_have_no_gaps_and_stay(spark):
    none = spark.createDataFrame([], "k string, n bigint")
    one = load.dense_keys(none, spark.createDataFrame([(x,) for x in ["b", "a", None, "a", "c"]], "k string"), ["k"], "n", ranges=2).collect()
    assert sorted(r["n"] for r in one) == [1, 2, 3, 4]
    stored = spark.createDataFrame([tuple(r) for r in one], "k string, n bigint")
    more = spark.createDataFrame([(x,) for x in ["a", "z", None, "y", "z"]], "k string").repartition(5)
    assert {r["k"]: r["n"] for r in load.dense_keys(stored, more, ["k"], "n").collect()}.keys() == {"y", "z"}
    assert sorted(r["n"] for r in load.dense_keys(stored, more, ["k"], "n").collect()) == [5, 6]
    assert load.dense_keys(stored, more.limit(0), ["k"], "n").count() == 0


def test_many_dense_keys(spark):
    none = spark.createDataFrame([], "k bigint, n bigint")
    got = load.dense_keys(none, spark.range(20_000).withColumnRenamed("id", "k"), ["k"], "n")
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 20_001))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in load.dense_keys(none, spark.range(20_000).withColumnRenamed("id", "k").repartition(3), ["k"], "n").collect()}


def test_days_add_up_to_the_exact_counts(spark, tmp_path):
    root, norms = str(tmp_path / "store"), ["north", "South kiosk", "west hall", None, "the north west hall"]
    all_lines = lines(spark, *[
        line(f"t{i % 40}" if i % 17 else None, branch_norm=norms[i % 5], sold_at=f"{1 + i % 9:02d}-0{1 + i % 3}-2024, {8 + i % 4:02d}:30", description="Tip" if i % 11 == 0 else "tea")
        for i in range(300)])
    whole = hours.peak_hours_view(all_lines, VOCAB)
    tickets.add(spark, all_lines.where("sold_at < '2024-02-05'"), root, VOCAB)
    months = {f for f in spark.read.parquet(f"{root}/mapas").inputFiles()}
    tickets.add(spark, all_lines.where("sold_at >= '2024-02-03'"), root, VOCAB)
    assert months < {f for f in spark.read.parquet(f"{root}/mapas").inputFiles()}  # older days are left alone
    got = tickets.peak_hours(tickets.read(spark, root), VOCAB)
    assert sorted(rows(got, *whole.columns)) == sorted(rows(whole))
    tickets.add(spark, all_lines, root, VOCAB)
    assert sorted(rows(tickets.peak_hours(tickets.read(spark, root), VOCAB), *whole.columns)) == sorted(rows(whole))
    assert spark.read.parquet(f"{root}/numeros").groupBy().count().first()[0] == len({r["tx_id"] for r in all_lines.where("description <> 'Tip' AND tx_id IS NOT NULL").collect()})
