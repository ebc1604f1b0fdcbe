"""Named views, metric dictionary, KPI catalogue and guarded read-only SQL."""

from __future__ import annotations

import re
from collections.abc import Callable, Collection
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.operators.load import upsert_update
from tillstone.plans import guard, hours, loyalty, payments, products, sales
from tillstone.plans.agentlog import EMPTY_RESULT, FORBIDDEN, READ_STARTS
from tillstone.plans.guard import NotReadOnly
from tillstone.plans.metrics import DEFINITIONS
from tillstone.plans.star import Star
from tillstone.sources.tables import capped_json_rows
from tillstone.vocab import Vocabulary


@dataclass(frozen=True)
class Shop:
    """Everything a view can read."""

    tx: DataFrame
    lines: DataFrame
    star: Star
    vocab: Vocabulary


View = Callable[[Shop], DataFrame]

VIEWS: dict[str, View] = {
    "sales_overview": lambda s: sales.overview_star(
        s.star.fact_lines, s.star.dim_branch, s.star.fact_tx, s.vocab
    ),
    "tips_analysis": lambda s: sales.tips_view(s.tx, s.lines, s.vocab),
    "peak_hours": lambda s: hours.peak_hours_view(s.lines, s.vocab),
    "customer_loyalty": lambda s: loyalty.loyalty_view(s.tx, s.lines, s.star.dim_branch, s.vocab),
    "payment_methods": lambda s: payments.payment_mix_view(s.tx, s.lines, s.vocab),
    "top_products": lambda s: products.products_share_star(
        s.star.fact_lines, s.star.dim_product, s.vocab
    ),
    "purchase_behavior": lambda s: sales.purchase_behavior(s.tx, s.lines, s.vocab, keep_unnamed=True),
    "top_products_alternative": lambda s: products.top_products(s.lines, s.vocab),
    "hourly_sales": lambda s: hours.hourly_sales(s.tx, s.lines, s.vocab, text_amounts=True),
    "busy_hours": lambda s: hours.busy_hours(s.lines, s.vocab, drop_blank_keys=True),
    "products_global": lambda s: VIEWS["top_products"](s),
}

# Earlier view names and the names they moved to.
RENAMED_VIEWS = {
    "vw_dashboard_resumen": "sales_overview",
    "vw_analisis_propinas": "tips_analysis",
    "vw_horas_pico": "peak_hours",
    "vw_fidelidad_clientes": "customer_loyalty",
    "vw_comportamiento_pago": "payment_methods",
    "vw_productos_top": "top_products",
}


def publish(
    spark: SparkSession, shop: Shop, old_names: bool = False, only: Collection[str] | None = None
) -> list[str]:
    """Register the views (or ``only`` the named ones) and the tables under them as
    temporary views.

    Repeating it replaces them. ``old_names`` registers the six earlier names instead of
    the ones they moved to; ``migrate_views`` performs the move.
    """
    tables = {"tx": shop.tx, "lines": shop.lines, **shop.star.tables()}
    names = {new: old for old, new in RENAMED_VIEWS.items()} if old_names else {}
    chosen = VIEWS if only is None else {name: VIEWS[name] for name in only}
    published = {names.get(name, name): build(shop) for name, build in chosen.items()}
    for name, df in {**tables, **published}.items():
        df.createOrReplaceTempView(name)
    return [*tables, *published]


def migrate_views(spark: SparkSession) -> list[str]:
    """Move every earlier view that exists to its new name; missing ones are skipped."""
    moved = []
    for old, new in RENAMED_VIEWS.items():
        if spark.catalog.tableExists(old):
            spark.table(old).createOrReplaceTempView(new)
            drop_view(spark, old)
            moved.append(new)
    return moved


def drop_view(spark: SparkSession, name: str) -> bool:
    """Drop a view if it exists; tells whether it did."""
    return spark.catalog.dropTempView(name)


def publish_tables(spark: SparkSession, shop: Shop, schema: str = "semantic") -> list[str]:
    """Store every view as a table ``schema.name``, so readers get a stored result
    instead of recomputing it from the lines."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    for name, build in VIEWS.items():
        build(shop).write.mode("overwrite").saveAsTable(f"`{schema}`.`{name}`")
    return [f"{schema}.{name}" for name in VIEWS]


# --- metric dictionary -------------------------------------------------------------------

METRIC_COLUMNS = "metric_name string, business_description string, sql_definition string, grain_level string, owner string"

# Metric, grain, the view that defines it and its column there ("" = the
# metric's own name). The description and the definition are this library's wording.
METRICS: tuple[tuple[str, str, str, str, str, str], ...] = (
    ("transacciones", "ticket", "sales_overview", "", "Distinct tickets", "count(distinct id_transaccion)"),
    ("venta_bruta", "ticket", "sales_overview", "", "Gross sales before fees", "sum(precio_bruto)"),
    ("comisiones_sumup", "ticket", "sales_overview", "", "Card platform fees", "sum(comision)"),
    ("liquido_a_recibir", "ticket", "sales_overview", "", "Gross sales less fees", "venta_bruta - comisiones_sumup"),
    ("ticket_promedio", "ticket", "sales_overview", "", "Average sale per ticket", "venta_bruta / transacciones"),
    ("margen_operativo_real", "ticket", "sales_overview", "", "Net sales less fees", "sum(precio_neto) - comisiones_sumup"),
    ("transacciones_con_propina", "ticket", "tips_analysis", "", "Tickets with a tip", "count(distinct tipped tx_id)"),
    ("tasa_conversion_propina_pct", "ticket", "tips_analysis", "", "Share of tickets with a tip", "transacciones_con_propina / transacciones_totales * 100"),
    ("propinas_totales", "ticket", "tips_analysis", "", "Tips received", "sum(tip net)"),
    ("propina_promedio", "ticket", "tips_analysis", "", "Average tip of a tipped ticket", "propinas_totales / transacciones_con_propina"),
    ("total_transacciones_hora", "hora", "peak_hours", "total_transacciones", "Tickets per hour of day", "count(distinct tx_id)"),
    ("clientes_un_solo_dia", "mes", "customer_loyalty", "", "Cards seen on one day of the month", "count(cards with days = 1)"),
    ("clientes_recurrentes_2_veces", "mes", "customer_loyalty", "", "Cards seen on two days of the month", "count(cards with days = 2)"),
    ("clientes_fans_3_o_mas", "mes", "customer_loyalty", "", "Cards seen on three or more days", "count(cards with days > 2)"),
    ("tasa_fidelidad_mes_pct", "mes", "customer_loyalty", "", "Share of cards seen again in the month", "count(cards with days >= 2) / count(cards) * 100"),
    ("total_transacciones_medio", "ticket", "payment_methods", "total_transacciones", "Tickets per payment medium", "count(*)"),
    ("ventas_totales_medio", "ticket", "payment_methods", "ventas_totales", "Sales per payment medium", "sum(ticket gross)"),
    ("participacion_transacciones_pct", "ticket", "payment_methods", "", "Medium's share of tickets", "total_transacciones_medio / all tickets * 100"),
    ("participacion_ventas_pct", "ticket", "payment_methods", "", "Medium's share of sales", "ventas_totales_medio / all sales * 100"),
    ("tasa_comision_pct", "ticket", "payment_methods", "", "Fee rate of the medium", "comision_total / ventas_totales_medio * 100"),
    ("unidades_vendidas", "producto", "top_products", "", "Units sold of the product", "sum(cantidad)"),
    ("ventas_brutas_producto", "producto", "top_products", "ventas_brutas", "Gross sales of the product", "sum(precio_bruto)"),
    ("share_ventas_pct", "producto", "top_products", "", "Product's share of all sales", "ventas_brutas_producto / all sales * 100"),
    ("tasa_penetracion_pct", "producto", "top_products", "", "Share of tickets with the product", "tickets_unicos / all tickets * 100"),
    ("ventas_solitarias", "ticket", "purchase_behavior", "", "Tickets with one item", "count(tickets with items = 1)"),
    ("ventas_con_acompanamiento", "ticket", "purchase_behavior", "", "Tickets with several items", "count(tickets with items > 1)"),
    ("tasa_de_sugestion_exito_pct", "ticket", "purchase_behavior", "", "Share of tickets with several items", "ventas_con_acompanamiento / tickets * 100"),
    ("ticket_promedio_solo", "ticket", "purchase_behavior", "", "Average one-item ticket", "avg(ticket gross with items = 1)"),
    ("ticket_promedio_acompanado", "ticket", "purchase_behavior", "", "Average several-item ticket", "avg(ticket gross with items > 1)"),
    ("transacciones_por_hora", "hora-sede", "hourly_sales", "transacciones", "Payments per branch and hour", "count(*)"),
    ("ventas_brutas_hora", "hora-sede", "hourly_sales", "ventas_brutas", "Payment totals per branch and hour", "sum(total)"),
    ("transacciones_por_hora_sede", "hora-sede-dia", "busy_hours", "*", "Tickets per date, hour and branch", "count(distinct tx_id)"),
)

GRAIN_KEYS = {
    "sales_overview": ("cuenta",),
    "tips_analysis": ("sede_unificada",),
    "peak_hours": ("hora_del_dia",),
    "customer_loyalty": ("nombre_sede", "mes_operacion"),
    "payment_methods": ("medio_de_pago",),
    "top_products": ("producto", "categoria"),
    "purchase_behavior": ("sede_unificada",),
    "hourly_sales": ("sede", "hora"),
    "busy_hours": ("dia", "dia_semana", "hora_del_dia"),
}


def metric_dictionary(spark: SparkSession, owner: str = "BI") -> DataFrame:
    """The dictionary as a table with one row per metric; definitions are those that ``metrics`` computes from."""
    rows = [
        (name, text, DEFINITIONS[name].expression if name in DEFINITIONS else definition, grain, owner)
        for name, grain, _, _, text, definition in METRICS
    ]
    return spark.createDataFrame(rows, METRIC_COLUMNS)


def metric_upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Reload the dictionary: incoming rows replace rows of the same metric."""
    return upsert_update(stored, incoming, ["metric_name"])


def metric_from(view: DataFrame, name: str) -> DataFrame:
    """Grain keys and the metric, picked from the view that defines it."""
    source, column = _metric_source(name)
    keys = GRAIN_KEYS[source]
    if column == "*":
        return view
    return view.select(*keys, F.col(column).alias(name))


def metric(spark: SparkSession, name: str) -> DataFrame:
    """A metric by name, from the published views."""
    return metric_from(spark.table(metric_view(name)), name)


def metric_view(name: str) -> str:
    """The view that defines a metric."""
    return _metric_source(name)[0]


def _metric_source(name: str) -> tuple[str, str]:
    for metric_name, _, source, column, _, _ in METRICS:
        if metric_name == name:
            return source, column or name
    raise KeyError(f"unknown metric '{name}'; known: {', '.join(m[0] for m in METRICS)}")


# --- KPI catalogue -----------------------------------------------------------------------

Kpi = Callable[[DataFrame, DataFrame, Vocabulary], DataFrame]

# KPI names and keywords. Each builder takes (tx, lines, vocabulary).
KPIS: dict[str, tuple[str, tuple[str, ...], Kpi]] = {
    "ventas_por_sede": (
        "Sales per branch without tips",
        ("ventas por sede", "ventas totales sede", "total ventas por ubicacion"),
        sales.sales_by_branch,
    ),
    "top_productos": (
        "Five best-selling products per branch",
        ("top productos", "productos mas vendidos", "mejores ventas productos"),
        lambda tx, lines, vocab: products.top_products(lines, vocab),
    ),
    "medios_pago": (
        "Payment-media mix",
        ("medios de pago", "distribucion pagos", "metodos pago", "metodos de pago mas usados"),
        payments.payment_mix_raw,
    ),
    "analisis_propinas": (
        "Tips per branch",
        ("analisis propinas", "propinas por sede", "tasa conversion propina"),
        sales.tips_raw,
    ),
    "horas_pico": (
        "Peak hours per branch",
        ("horas pico", "peak hours", "horarios mas concurridos"),
        lambda tx, lines, vocab: hours.peak_hours_raw(lines, vocab),
    ),
    "fidelidad_clientes": (
        "Returning cards per branch and month",
        ("fidelidad clientes", "clientes recurrentes", "tasa fidelidad"),
        loyalty.loyalty_raw,
    ),
    "comportamiento_compra": (
        "Single-item against several-item tickets per branch",
        ("comportamiento compra", "ventas solitarias", "ticket promedio"),
        sales.purchase_behavior,
    ),
    "productos_global": (
        "Fifty best-selling products",
        ("productos global", "top productos mundial", "share ventas productos"),
        lambda tx, lines, vocab: products.products_share_raw(lines, vocab),
    ),
    "horas_concurridas": (
        "Busiest hours per date and branch",
        ("horas concurridas", "traffic hours", "peak times"),
        lambda tx, lines, vocab: hours.busy_hours(lines, vocab),
    ),
}


def kpi_catalog(spark: SparkSession) -> DataFrame:
    rows = [(name, text, list(words)) for name, (text, words, _) in KPIS.items()]
    return spark.createDataFrame(rows, "kpi_name string, description string, keywords array<string>")


def kpi_builder(name: str) -> Kpi:
    """A KPI by name in any case; an unknown name raises ``KeyError`` listing the known."""
    found = KPIS.get(name.lower())
    if found is None:
        raise KeyError(f"KPI '{name}' does not exist; available: {', '.join(KPIS)}")
    return found[2]


def kpi(spark: SparkSession, name: str, vocab: Vocabulary) -> DataFrame:
    """A KPI over the published ``tx`` and ``lines``."""
    return kpi_builder(name)(spark.table("tx"), spark.table("lines"), vocab)


# --- ad-hoc SQL --------------------------------------------------------------------------


def check_readonly(text: str) -> None:
    """Accept statements that start with SELECT or WITH and hold no writing keyword as a
    whole word. (The log classifier matches substrings; here ``created_at`` may be read.)
    Relations named by a file path and calls of Java methods are refused too.
    """
    lowered = text.strip().lower()
    if not lowered.startswith(READ_STARTS):
        raise NotReadOnly("only SELECT or WITH statements are allowed")
    found = set(re.findall(r"\w+", lowered)) & {*FORBIDDEN, "reflect", "try_reflect", "java_method"}
    if found:
        raise NotReadOnly(f"not allowed in a read: {', '.join(sorted(found))}")
    if re.search(r"`[^`]*[/:\\][^`]*`", lowered):
        raise NotReadOnly("only published views may be read, not files")


def published_names() -> set[str]:
    """Names that a read may use: the temporary views of ``publish`` and the catalog's qualified ones."""
    tables = {"tx", "lines", *(f.name for f in fields(Star))}
    return {*tables, *VIEWS, *RENAMED_VIEWS, *(f"semantic.{name}" for name in VIEWS), *(f"bi.{name}" for name in RENAMED_VIEWS)}


def readonly_sql(spark: SparkSession, text: str, cap: int = 50, published: Collection[str] | None = None) -> DataFrame:
    """Run a checked statement over the published views, at most ``cap`` rows.

    Its relations and functions are taken from the statement as parsed, so only ``published`` names
    (by default those of ``published_names``) can be read.
    """
    check_readonly(text)
    guard.check(spark, text, published_names() if published is None else published)
    return spark.sql(text).limit(cap)


def mark_empty(rows: DataFrame, cap: int = 50) -> DataFrame:
    """At most ``cap`` rows as JSON, or the single row 'EMPTY_RESULT' where there are none."""
    gathered = capped_json_rows(rows, cap).agg(F.collect_list("json").alias("all"))
    filled = F.when(F.size("all") == 0, F.array(F.lit(EMPTY_RESULT))).otherwise(F.col("all"))
    return gathered.select(F.explode(filled).alias("json"))


def describe(spark: SparkSession) -> DataFrame:
    """(tabla, columna, tipo) of every published table and view."""
    rows = [
        (table.name, column.name, column.dataType)
        for table in spark.catalog.listTables()
        if table.isTemporary
        for column in spark.catalog.listColumns(table.name)
    ]
    return spark.createDataFrame(rows, "tabla string, columna string, tipo string")
