"""Published views, metrics, KPIs and guarded SQL over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks.base import LINES, LINES_RAW, TX, VOCAB, clean_tables, money, plain, stored_star, with_
from checks.business import BASKET_SUMS
from checks.business import ORACLE as BUSINESS
from tillstone.plans import catalog, metrics, semantic


def _shop(spark: SparkSession, sf: str) -> semantic.Shop:
    lines, tx = clean_tables(spark, sf)
    return semantic.Shop(tx, lines, stored_star(spark, sf), VOCAB)


def _view(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        semantic.publish(spark, _shop(spark, sf), only=[name])
        return plain(spark.table(name))

    return run


def _migrated(spark: SparkSession, sf: str) -> DataFrame:
    semantic.publish(spark, _shop(spark, sf), old_names=True, only=["peak_hours", "tips_analysis"])
    semantic.migrate_views(spark)
    return plain(spark.table("peak_hours"))


def _dropped(spark: SparkSession, sf: str) -> DataFrame:
    """A dropped view is gone; the ones left still answer."""
    semantic.publish(spark, _shop(spark, sf), only=["products_global", "top_products_alternative"])
    semantic.drop_view(spark, "products_global")
    assert not spark.catalog.tableExists("products_global")
    return plain(spark.table("top_products_alternative"))


def _catalog_view(spark: SparkSession, sf: str) -> DataFrame:
    catalog.publish(spark, _shop(spark, sf), only=["customer_loyalty"])
    return plain(spark.table("semantic.customer_loyalty"))


def _catalog_moved(spark: SparkSession, sf: str) -> DataFrame:
    """Published in ``bi`` under the old name, moved, and read by another session."""
    catalog.publish(spark, _shop(spark, sf), old_names=True, only=["peak_hours"])
    catalog.migrate(spark)
    return plain(spark.table("semantic.peak_hours"))


def _adhoc_names(spark: SparkSession, sf: str) -> DataFrame:
    """A read with names of its own that hide others, a subquery and a qualified view."""
    semantic.publish(spark, _shop(spark, sf), only=[])
    catalog.publish(spark, _shop(spark, sf), only=["peak_hours"])
    return plain(semantic.readonly_sql(
        spark,
        "WITH tx AS (SELECT hora_del_dia, total_transacciones AS n FROM semantic.peak_hours) "
        "SELECT hora_del_dia, n, (SELECT count(*) FROM lines) AS lineas FROM TX "
        "WHERE n > (SELECT avg(n) FROM tx)",
    ))


def _metric(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        semantic.publish(spark, _shop(spark, sf), only=[semantic.metric_view(name)])
        return plain(semantic.metric(spark, name))

    return run


def _defined(source: str, *names: str):
    """All metrics of a source from their definitions."""
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return plain(metrics.compute(spark, _shop(spark, sf), source, names or None))

    return run


def _kpi(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        semantic.publish(spark, _shop(spark, sf), only=[])
        return plain(semantic.kpi(spark, name, VOCAB))

    return run


def _adhoc(spark: SparkSession, sf: str) -> DataFrame:
    semantic.publish(spark, _shop(spark, sf), only=[])
    return plain(semantic.readonly_sql(
        spark,
        "WITH t AS (SELECT account, sum(gross) AS bruto FROM lines GROUP BY account) "
        "SELECT account, bruto FROM t ORDER BY bruto DESC",
    ))


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    semantic.publish(spark, _shop(spark, sf), only=[])
    return semantic.mark_empty(semantic.readonly_sql(
        spark, "SELECT status, count(*) AS n FROM tx WHERE fee < 0 GROUP BY status"
    ))


QUERIES = {
    "s1_published_view": _view("customer_loyalty"),
    "s1_catalog_view": _catalog_view,
    "s2_migrate_views": _migrated,
    "s2_catalog_move": _catalog_moved,
    "s3_drop_view": _dropped,
    "s6_metric_ticket": _metric("margen_operativo_real"),
    "s6_metric_hour": _metric("total_transacciones_hora"),
    "s6_metric_month": _metric("tasa_fidelidad_mes_pct"),
    "s6_metric_product": _metric("share_ventas_pct"),
    "s6_metric_hour_branch": _metric("ventas_brutas_hora"),
    "s6_metric_hour_branch_day": _metric("transacciones_por_hora_sede"),
    "s6_defined_overview": _defined("sales_overview"),
    "s6_defined_overview_one": _defined("sales_overview", "liquido_a_recibir"),
    "s6_defined_tips": _defined("tips_analysis"),
    "s6_defined_peak_hours": _defined("peak_hours"),
    "s6_defined_loyalty": _defined("customer_loyalty"),
    "s6_defined_payment_mix": _defined("payment_methods"),
    "s6_defined_products": _defined("top_products"),
    "s6_defined_behavior": _defined("purchase_behavior"),
    "s6_defined_hourly_sales": _defined("hourly_sales"),
    "s6_defined_busy_hours": _defined("busy_hours"),
    **{f"s7_kpi_{name}": _kpi(name) for name in semantic.KPIS},
    "s8_kpi_lookup": _kpi("Ventas_Por_SEDE"),
    "s9_readonly_sql": _adhoc,
    "s9_readonly_sql_empty": _marked,
    "s9_readonly_sql_names": _adhoc_names,
}


def _picked(name: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({BUSINESS[name]}) v"


_KPI_QUERIES = {
    "ventas_por_sede": "q03_sales_by_branch",
    "top_productos": "q12_top5_products_raw",
    "medios_pago": "q14_payment_mix_raw",
    "analisis_propinas": "q04_tips_raw",
    "horas_pico": "q06_peak_hours_raw",
    "fidelidad_clientes": "q08_loyalty_raw",
    "comportamiento_compra": "q10_purchase_behavior_raw",
    "productos_global": "q18_products_share_raw",
    "horas_concurridas": "q20_busy_hours_raw",
}

ORACLE = {
    "s1_published_view": BUSINESS["q09_loyalty_view"],
    "s1_catalog_view": BUSINESS["q09_loyalty_view"],
    "s2_migrate_views": BUSINESS["q07_peak_hours_view"],
    "s2_catalog_move": BUSINESS["q07_peak_hours_view"],
    "s3_drop_view": BUSINESS["q13_top5_products_view"],
    "s6_metric_ticket": _picked("q02_overview_star", "cuenta, margen_operativo_real"),
    "s6_metric_hour": _picked(
        "q07_peak_hours_view", "hora_del_dia, total_transacciones AS total_transacciones_hora"
    ),
    "s6_metric_month": _picked("q09_loyalty_view", "nombre_sede, mes_operacion, tasa_fidelidad_mes_pct"),
    "s6_metric_product": _picked("q19_products_share_star", "producto, categoria, share_ventas_pct"),
    "s6_metric_hour_branch": _picked(
        "q17_hourly_sales_view", "sede, hora, ventas_brutas AS ventas_brutas_hora"
    ),
    "s6_metric_hour_branch_day": BUSINESS["q21_busy_hours_view"],
    "s6_defined_overview": f"""
SELECT v.cuenta, transacciones, venta_bruta, n.venta_neta, comisiones_sumup, liquido_a_recibir, ticket_promedio, margen_operativo_real
FROM ({BUSINESS["q02_overview_star"]}) v JOIN (SELECT cuenta, margen_operativo_real + comisiones_sumup AS venta_neta
      FROM ({BUSINESS["q02_overview_star"]}) w) n ON v.cuenta = n.cuenta""",
    "s6_defined_overview_one": _picked("q02_overview_star", "cuenta, liquido_a_recibir"),
    "s6_defined_tips": BUSINESS["q05_tips_view"],
    "s6_defined_peak_hours": _picked("q07_peak_hours_view", "hora_del_dia, total_transacciones AS total_transacciones_hora"),
    "s6_defined_loyalty": f"""
SELECT v.*, CAST(CASE WHEN tasa_fidelidad_mes_pct IS NULL THEN 0
  ELSE clientes_un_solo_dia + clientes_recurrentes_2_veces + clientes_fans_3_o_mas END AS BIGINT) AS clientes_del_mes
FROM ({BUSINESS["q09_loyalty_view"]}) v""",
    "s6_defined_payment_mix": _picked("q15_payment_mix_view", """medio_de_pago, total_transacciones AS total_transacciones_medio,
       COALESCE(ventas_totales, 0) AS ventas_totales_medio, COALESCE(comision_total, 0) AS comision_total,
       participacion_transacciones_pct, participacion_ventas_pct, tasa_comision_pct"""),
    "s6_defined_products": _picked("q19_products_share_star", """producto, categoria, unidades_vendidas, ventas_brutas AS ventas_brutas_producto,
       tickets_unicos, share_ventas_pct, tasa_penetracion_pct"""),
    "s6_defined_behavior": f"""
SELECT v.*, s.monto_solo, s.monto_acompanado FROM ({BUSINESS["q11_purchase_behavior_view"]}) v
JOIN ({BASKET_SUMS}) s ON v.sede_unificada IS NOT DISTINCT FROM s.sede_unificada""",
    "s6_defined_hourly_sales": _picked(
        "q17_hourly_sales_view", "sede, hora, transacciones AS transacciones_por_hora, ventas_brutas AS ventas_brutas_hora"),
    "s6_defined_busy_hours": BUSINESS["q21_busy_hours_view"],
    **{f"s7_kpi_{name}": BUSINESS[query] for name, query in _KPI_QUERIES.items()},
    "s8_kpi_lookup": BUSINESS["q03_sales_by_branch"],
    "s9_readonly_sql_names": f"""
WITH h AS ({BUSINESS["q07_peak_hours_view"]})
SELECT hora_del_dia, total_transacciones AS n, (SELECT COUNT(*) FROM ({LINES_RAW}) r) AS lineas FROM h
WHERE total_transacciones > (SELECT AVG(total_transacciones) FROM h)""",
    "s9_readonly_sql": with_(LINES) + f"SELECT account, {money('SUM(gross)')} AS bruto FROM lines GROUP BY 1",
    "s9_readonly_sql_empty": with_(TX) + """
SELECT CASE WHEN COUNT(*) = 0 THEN 'EMPTY_RESULT' ELSE 'rows' END AS json FROM tx WHERE fee < 0""",
}
