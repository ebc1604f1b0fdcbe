import pytest

from tests.shopdata import line, lines, pay, rows, tx
from tillstone.plans import semantic, star
from tillstone.sources.tables import TX_HEADERS, capped_json_rows, rename_headers
from tillstone.sources.testshop import VOCABULARY as V


@pytest.fixture(scope="module")
def shop(spark):
    t = tx(spark, pay("1", fee="1", total="30"), pay("2", status="paid", fee="2", total="20"))
    l = lines(spark, line("1", branch_norm="North"), line("1", branch_norm="North"), line("2", branch_norm="North", gross="5"))
    return semantic.Shop(t, l, star.star_of(l, t, V), V)


def test_publish_migrate_drop(spark, shop):
    semantic.publish(spark, shop, old_names=True)
    assert spark.catalog.tableExists("vw_horas_pico")
    assert semantic.migrate_views(spark) == list(semantic.RENAMED_VIEWS.values())
    assert semantic.migrate_views(spark) == []
    assert not spark.catalog.tableExists("vw_horas_pico")
    assert rows(spark.table("peak_hours"), "hora_del_dia", "total_transacciones") == [(10, 2)]
    assert semantic.drop_view(spark, "peak_hours") and not semantic.drop_view(spark, "peak_hours")


def test_every_metric_resolves(spark, shop):
    semantic.publish(spark, shop)
    assert len(semantic.METRICS) == 32
    for name, *_ in semantic.METRICS:
        assert semantic.metric(spark, name).columns
    assert rows(semantic.metric(spark, "venta_bruta")) == [("North", 25.0), (V.overview_total, 25.0)]
    with pytest.raises(KeyError, match="venta_bruta"):
        semantic.metric(spark, "nope")


def test_dictionary_upsert(spark):
    first = semantic.metric_dictionary(spark)
    assert first.count() == 32
    grains = dict(rows(first.groupBy("grain_level").count()))
    assert grains == {"ticket": 20, "mes": 4, "producto": 4, "hora-sede": 2, "hora": 1, "hora-sede-dia": 1}
    other = semantic.metric_dictionary(spark, owner="Finance").limit(2)
    merged = semantic.metric_upsert(first, other)
    assert merged.count() == 32
    assert merged.filter("owner = 'Finance'").count() == 2
    assert sorted(rows(semantic.metric_upsert(merged, other))) == sorted(rows(merged))


def test_kpis(spark, shop):
    semantic.publish(spark, shop)
    assert semantic.kpi_catalog(spark).count() == 9
    for name in semantic.KPIS:
        assert semantic.kpi(spark, name.upper(), V).columns
    with pytest.raises(KeyError, match="ventas_por_sede"):
        semantic.kpi_builder("nope")


def test_readonly_sql(spark, shop):
    semantic.publish(spark, shop)
    assert rows(semantic.readonly_sql(spark, " SELECT count(*) AS created_at FROM lines")) == [(3,)]
    assert semantic.readonly_sql(spark, "select * from range(100)").count() == 50
    assert rows(semantic.mark_empty(semantic.readonly_sql(spark, "select * from range(0)"))) == [("EMPTY_RESULT",)]
    for text in ("drop view lines", "with x as (select 1) insert into t select * from x", "show tables",
                 "select * from parquet.`/tmp/x`", "select reflect('java.lang.System', 'exit', 0)"):
        with pytest.raises(semantic.NotReadOnly):
            semantic.check_readonly(text)
    described = semantic.describe(spark)
    assert described.filter("tabla = 'tx' AND columna = 'fee'").count() == 1


def test_stored_views(spark, shop):
    names = semantic.publish_tables(spark, shop, schema="semantic_test")
    try:
        assert rows(spark.table("semantic_test.sales_overview"), "cuenta") == [("North",), (V.overview_total,)]
    finally:
        for name in names:
            spark.sql(f"DROP TABLE {name}")
        spark.sql("DROP SCHEMA semantic_test")


def test_build_star_twice_adds_nothing(spark, tmp_path):
    from tillstone.sources import testshop

    sf = "/root/testdata/sf0.001"
    l, t = star.store_clean(spark, testshop.raw_lines(spark, sf), testshop.raw_tx(spark, sf), str(tmp_path / "clean"))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    first = star.build_star(spark, l, t, one, V)
    second = star.build_star(spark, l, t, two, V, previous=one)
    for name, df in first.tables().items():
        assert second.tables()[name].count() == df.count(), name
    facts = star.read_star(spark, two).fact_lines
    dated = l.where("tx_id <> '' AND sold_at IS NOT NULL")
    assert facts.count() == dated.distinct().count() < l.count()
    assert facts.select("id_transaccion", "linea_ticket").distinct().count() == facts.count()
    assert second.fact_tx.select("id_transaccion").distinct().count() == second.fact_tx.count()
    with pytest.raises(ValueError):
        star.build_star(spark, l, t, one, V, previous=one)


def test_export_headers_in_both_spellings(spark):
    for name in ("ID de transacción", "ID_de_transacción"):
        df = spark.createDataFrame([("7", 1)], f"`{name}` string, other int")
        assert rename_headers(df, TX_HEADERS).columns == ["tx_id"]


def test_json_rows_keep_nulls_and_cap(spark):
    df = spark.sql("SELECT id, cast(NULL AS string) AS s, date'2024-03-05' AS d FROM range(60)")
    got = capped_json_rows(df)
    assert got.count() == 50
    assert got.first()[0] == '{"id":0,"s":null,"d":"2024-03-05"}'
