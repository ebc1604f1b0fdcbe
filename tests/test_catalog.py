"""Views under schemas and the guard of ad-hoc reads."""

import pytest

from tests.shopdata import line, lines, pay, tx
from tillstone.plans import catalog, guard, semantic, star
from tillstone.sources.testshop import VOCABULARY as VOCAB


@pytest.fixture
def shop(spark):
    sold = lines(spark, line("t1", branch_norm="North"), line("t2", branch_norm="South", description="cake"))
    paid = tx(spark, pay("t1", card_last4="1111", fee="1"), pay("t2", card_last4="2222"))
    return semantic.Shop(tx=paid, lines=sold, star=star.star_of(sold, paid, VOCAB), vocab=VOCAB)


def test_a_moved_view_is_read_by_another_session(spark, shop):
    spark.range(3).createOrReplaceTempView("tx")  # the user's own
    assert catalog.publish(spark, shop, old_names=True, only=["peak_hours", "tips_analysis", "busy_hours"]) == [
        "bi.vw_horas_pico", "bi.vw_analisis_propinas", "semantic.busy_hours"]
    want = spark.table("bi.vw_horas_pico").collect()
    assert catalog.migrate(spark) == ["semantic.tips_analysis", "semantic.peak_hours"]
    assert catalog.migrate(spark) == []
    other = spark.newSession()
    assert [tuple(r) for r in other.table("semantic.peak_hours").collect()] == [tuple(r) for r in want] and want
    assert not other.catalog.tableExists("bi.vw_horas_pico")
    assert spark.table("tx").columns == ["id"]
    names = {r["tabla"] for r in catalog.describe(other).collect()}
    assert {"semantic.peak_hours", "semantic.busy_hours"} <= names and "bi.vw_horas_pico" not in names
    assert catalog.drop_view(spark, "peak_hours") and not catalog.drop_view(spark, "peak_hours")
    spark.catalog.dropTempView("tx")


def test_publishing_again_replaces_and_a_broken_move_is_finished(spark, shop):
    catalog.publish(spark, shop, old_names=True, only=["peak_hours"])
    reader = spark.table("bi.vw_horas_pico")
    catalog.publish(spark, shop, old_names=True, only=["peak_hours"])
    assert reader.count() == spark.table("bi.vw_horas_pico").count()
    catalog.create_view(spark, "semantic", "peak_hours", catalog.view_text(spark, "bi", "vw_horas_pico"))  # then it stopped
    assert catalog.migrate(spark) == ["semantic.peak_hours"]


PUBLISHED = {"lines", "semantic.peak_hours"}


@pytest.mark.parametrize("text", [
    "SELECT * FROM lines",
    "select count(*) from `LINES` l join semantic.PEAK_HOURS p on true",
    "WITH secret AS (SELECT * FROM lines) SELECT * FROM Secret WHERE gross > (SELECT avg(gross) FROM secret)",
    "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b, (SELECT explode(array(1)) AS y)",
    "SELECT * FROM VALUES (1), (2)",
    "SELECT * FROM lines WHERE description IN (WITH t AS (SELECT description FROM lines) SELECT * FROM t)",
    "SELECT x.y FROM lines LATERAL VIEW explode(array(1)) x AS y",
])
def test_reads_of_published_names_pass(spark, text):
    guard.check(spark, text, PUBLISHED)


@pytest.mark.parametrize("text", [
    "SELECT * FROM secret",
    "SELECT * FROM other.lines",
    "SELECT * FROM spark_catalog.default.lines",
    "SELECT * FROM parquet.`/tmp/x`",
    "SELECT * FROM parquet . relfile",
    "SELECT * FROM /* lines */ `parquet`.`relfile`",
    "WITH lines AS (SELECT * FROM secret) SELECT * FROM lines",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "SELECT (SELECT max(x) FROM secret) FROM lines",
    "SELECT * FROM lines WHERE EXISTS (SELECT 1 FROM secret)",
    "SELECT * FROM lines WHERE gross IN (SELECT x FROM (SELECT * FROM secret) s)",
    "SELECT * FROM (WITH secret AS (SELECT * FROM lines) SELECT * FROM secret), secret",
    "SELECT * FROM lines UNION ALL SELECT * FROM secret",
    "TABLE secret",
    "SELECT reflect('java.lang.System', 'exit', 0) FROM lines",
    "SELECT `java_method`('java.lang.System', 'getenv') FROM lines",
    "SELECT sum(length(try_reflect('a', 'b'))) FROM lines GROUP BY input_file_name()",
    "SELECT * FROM read_files('/tmp')",
    "INSERT INTO lines SELECT * FROM lines",
    "WITH t AS (SELECT * FROM lines) INSERT INTO lines SELECT * FROM t",
    "DROP VIEW lines",
    "SELECT * FROM lines; SELECT * FROM secret",
    "SELEC * FROM lines",
])
def test_anything_else_is_refused(spark, text):
    with pytest.raises(guard.NotReadOnly):
        guard.check(spark, text, PUBLISHED)
