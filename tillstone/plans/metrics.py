"""Metrics computed from their definitions.

A definition is a SQL expression over the columns of its source or over other metrics of the same
source, by name. Sources are frames of ticket grain, reduced from the stored tables as the views reduce
them. Asking for any metrics of a source makes one aggregate pass over it: the definitions that aggregate are
worked out together, and those built on other metrics follow in the order of their dependencies.

``x_del_total`` in a definition means metric ``x`` over all rows of the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.functions.dates import month_text
from tillstone.operators.lookup import with_single_row
from tillstone.plans import hours, loyalty, payments, products, sales
from tillstone.session import scratch

if TYPE_CHECKING:
    from tillstone.plans.semantic import Shop

OF_TOTAL = "_del_total"


class BadDefinition(ValueError):
    """Definitions that cannot be worked out: a cycle, another source's metric, an unknown name."""


@dataclass(frozen=True)
class Source:
    """A frame to aggregate and the columns that tell its rows apart.

    With ``total`` there is a further row of that label over everything. ``named`` drops the group of
    rows that count in the total alone, and ``top`` keeps the first rows by a metric.
    """

    frame: Callable[[Shop], DataFrame]
    keys: tuple[str, ...]
    total: Callable[[Shop], str] | None = None
    named: bool = False
    top: tuple[str, int] | None = None


@dataclass(frozen=True)
class Definition:
    source: str
    expression: str


def _pct(part: str, whole: str) -> str:
    return f"round(cast({part} AS decimal(22,4)) * 100 / nullif(cast({whole} AS decimal(22,4)), 0), 2)"


def _per_unit(amount: str, units: str) -> str:
    return f"round(cast({amount} AS decimal(22,4)) / nullif(cast({units} AS decimal(20,0)), 0), 0)"


def _or_zero(expression: str) -> str:
    return f"coalesce({expression}, 0)"


def _loyalty_cards(shop: Shop) -> DataFrame:
    cards = loyalty.monthly_cards(loyalty.placed_visits(shop.tx, shop.lines, shop.star.dim_branch, shop.vocab))
    return cards.select(F.col("branch").alias("nombre_sede"), month_text(F.col("month")).alias("mes_operacion"), "card_last4", "days")


SOURCES: dict[str, Source] = {
    "sales_overview": Source(
        lambda s: sales.star_tickets(s.star.fact_lines, s.star.dim_branch, s.star.fact_tx).withColumnRenamed("nombre_sede", "cuenta"),
        ("cuenta",), lambda s: s.vocab.overview_total),
    "tips_analysis": Source(lambda s: sales.tip_tickets(s.tx, s.lines, s.vocab), ("sede_unificada",)),
    "peak_hours": Source(
        lambda s: hours.slot_tickets(hours.peak_lines(s.lines, s.vocab), {"hora_del_dia": F.hour("sold_at")}, {"sold": F.lit(True)}),
        ("hora_del_dia",)),
    "customer_loyalty": Source(_loyalty_cards, ("nombre_sede", "mes_operacion")),
    "payment_methods": Source(
        lambda s: payments.media_tickets(s.tx, s.lines, s.vocab), ("medio_de_pago",), lambda s: s.vocab.general_total),
    "top_products": Source(
        lambda s: products.star_products(s.star.fact_lines, s.star.dim_product, s.vocab), ("producto", "categoria"),
        named=True, top=("ventas_brutas_producto", 100)),
    "purchase_behavior": Source(
        lambda s: sales.basket_tickets(s.tx, s.lines, s.vocab, keep_unnamed=True), ("sede_unificada",)),
    "hourly_sales": Source(
        lambda s: hours.hourly_payments(s.tx, s.lines, s.vocab, text_amounts=True), ("sede", "hora")),
    "busy_hours": Source(
        lambda s: hours.busy_tickets(s.lines, s.vocab, drop_blank_keys=True), ("dia", "dia_semana", "hora_del_dia")),
}

#: The metrics of the dictionary, and the few that they are built on. Names are fixed values.
DEFINITIONS: dict[str, Definition] = {
    name: Definition(source, expression) for source, own in {
        "sales_overview": {
            "transacciones": "count(DISTINCT id_transaccion)",
            "venta_bruta": "sum(gross)",
            "venta_neta": "sum(net)",
            "comisiones_sumup": "coalesce(sum(comision * cast(line_n AS decimal(18,0))), 0)",
            "liquido_a_recibir": "venta_bruta - comisiones_sumup",
            "ticket_promedio": _per_unit("venta_bruta", "transacciones"),
            "margen_operativo_real": "venta_neta - comisiones_sumup",
        },
        "tips_analysis": {
            "transacciones_totales": "count(*)",
            "transacciones_con_propina": "count_if(tip_n > 0)",
            "propinas_totales": "coalesce(sum(tip), 0)",
            "tasa_conversion_propina_pct": _pct("transacciones_con_propina", "transacciones_totales"),
            "propina_promedio": _per_unit("propinas_totales", "transacciones_con_propina"),
        },
        "peak_hours": {"total_transacciones_hora": "count(tx_id)"},
        "customer_loyalty": {
            "clientes_un_solo_dia": "count(CASE WHEN days = 1 THEN card_last4 END)",
            "clientes_recurrentes_2_veces": "count(CASE WHEN days = 2 THEN card_last4 END)",
            "clientes_fans_3_o_mas": "count(CASE WHEN days > 2 THEN card_last4 END)",
            "clientes_del_mes": "count(card_last4)",
            "tasa_fidelidad_mes_pct": _pct("(clientes_recurrentes_2_veces + clientes_fans_3_o_mas)", "clientes_del_mes"),
        },
        "payment_methods": {
            "total_transacciones_medio": "count(*)",
            "ventas_totales_medio": "coalesce(sum(gross), 0)",
            "comision_total": "coalesce(sum(fee), 0)",
            "participacion_transacciones_pct": _or_zero(_pct("total_transacciones_medio", "total_transacciones_medio" + OF_TOTAL)),
            "participacion_ventas_pct": _or_zero(_pct("ventas_totales_medio", "ventas_totales_medio" + OF_TOTAL)),
            "tasa_comision_pct": _or_zero(_pct("comision_total", "ventas_totales_medio")),
        },
        "top_products": {
            "unidades_vendidas": "sum(cantidad)",
            "ventas_brutas_producto": "sum(precio_bruto)",
            "tickets_unicos": "count(DISTINCT id_transaccion)",
            "share_ventas_pct": _or_zero(_pct("ventas_brutas_producto", "ventas_brutas_producto" + OF_TOTAL)),
            "tasa_penetracion_pct": _or_zero(_pct("tickets_unicos", "tickets_unicos" + OF_TOTAL)),
        },
        "purchase_behavior": {
            "ventas_solitarias": "count_if(items = 1)",
            "ventas_con_acompanamiento": "count_if(items > 1)",
            "monto_solo": "sum(CASE WHEN items = 1 THEN amount END)",
            "monto_acompanado": "sum(CASE WHEN items > 1 THEN amount END)",
            "tasa_de_sugestion_exito_pct": _pct("ventas_con_acompanamiento", "(ventas_solitarias + ventas_con_acompanamiento)"),
            "ticket_promedio_solo": _per_unit("monto_solo", "ventas_solitarias"),
            "ticket_promedio_acompanado": _per_unit("monto_acompanado", "ventas_con_acompanamiento"),
        },
        "hourly_sales": {"transacciones_por_hora": "count(*)", "ventas_brutas_hora": "sum(total)"},
    }.items() for name, expression in own.items()
}
#: One metric of the dictionary is a column for each counter branch.
PER_BRANCH = "transacciones_por_hora_sede"


def definitions_for(shop: Shop) -> dict[str, Definition]:
    """The definitions with the metrics that depend on the shop's branches."""
    flags = {f"{PER_BRANCH}.{b.slug}": Definition("busy_hours", f"count(CASE WHEN {b.slug} = 1 THEN tx_id END)") for b in shop.vocab.counter_branches}
    return {**DEFINITIONS, **flags}


def names_in(spark: SparkSession, expression: str) -> set[str]:
    """The columns an expression names, as Spark parses it."""
    found, ahead = set(), [spark._jsparkSession.sessionState().sqlParser().parseExpression(expression)]
    while ahead:
        node = ahead.pop()
        if node.getClass().getSimpleName() == "UnresolvedAttribute":
            found.add(node.name())
        children = node.children().iterator()
        while children.hasNext():
            ahead.append(children.next())
    return found


def dependencies(spark: SparkSession, definitions: Mapping[str, Definition]) -> dict[str, set[str]]:
    """Metric to the metrics its definition names, an ``x_del_total`` counting as ``x``."""
    return {
        name: {n.removesuffix(OF_TOTAL) for n in names_in(spark, d.expression)} & set(definitions) - {name} | (
            {name} if name in names_in(spark, d.expression) else set())
        for name, d in definitions.items()
    }


def in_order(graph: Mapping[str, set[str]], definitions: Mapping[str, Definition], wanted: Iterable[str]) -> list[str]:
    """The wanted metrics and all they need, each after what it needs."""
    done: list[str] = []
    path: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        if name in path:
            raise BadDefinition(f"a cycle: {' -> '.join([*path[path.index(name):], name])}")
        if name not in definitions:
            raise BadDefinition(f"unknown metric '{name}'; known: {', '.join(sorted(definitions))}")
        path.append(name)
        for other in sorted(graph[name]):
            if definitions[other].source != definitions[name].source:
                raise BadDefinition(f"'{name}' is of {definitions[name].source}, '{other}' of {definitions[other].source}: their rows differ")
            visit(other)
        path.pop()
        done.append(name)

    for name in wanted:
        visit(name)
    return done


def compute(spark: SparkSession, shop: Shop, source: str, wanted: Iterable[str] | None = None,
            definitions: Mapping[str, Definition] | None = None) -> DataFrame:
    """The keys of a source and the wanted metrics of it (by default all), from one pass over it.

    The aggregated rows, one for each key, are stored and the metrics built on others are columns over them.
    """
    known = definitions_for(shop) if definitions is None else definitions
    own, kind = {n: d for n, d in known.items() if d.source == source}, SOURCES[source]
    asked = list(own) if wanted is None else list(wanted)
    graph = dependencies(spark, {**known})
    order = in_order(graph, known, [*asked, *([kind.top[0]] if kind.top else [])])
    if strange := [n for n in order if known[n].source != source]:
        raise BadDefinition(f"not of {source}: {', '.join(strange)}")
    base = [n for n in order if not graph[n]]
    totals = {n.removesuffix(OF_TOTAL) for m in order for n in names_in(spark, known[m].expression) if n.endswith(OF_TOTAL)}
    if strange := totals - set(base):
        raise BadDefinition(f"the total of a metric built on others: {', '.join(sorted(strange))}")
    whole = bool(kind.total or totals)
    frame = kind.frame(shop)
    groups = frame.groupingSets([[F.col(k) for k in kind.keys], []], *kind.keys) if whole else frame.groupBy(*kind.keys)
    flag = [F.grouping(kind.keys[0]).cast("int").alias("es_total")] if whole else []
    summed = _stored(spark, groups.agg(*flag, *[F.expr(known[n].expression).alias(n) for n in base]))
    rows = summed
    if whole:
        rows = summed if kind.total else summed.where("es_total = 0")
        if totals:
            of_all = summed.where("es_total = 1").select(*[F.col(n).alias(n + OF_TOTAL) for n in sorted(totals)])
            rows = with_single_row(rows, of_all)
        if kind.total:
            label = F.when(F.col("es_total") == 1, F.lit(kind.total(shop))).otherwise(F.col(kind.keys[0]))
            rows = rows.withColumn(kind.keys[0], label)
    if kind.named:
        rows = rows.where(F.col(kind.keys[0]).isNotNull())
    for name in order:
        if name not in base:
            rows = rows.withColumn(name, F.expr(known[name].expression))
    if kind.top:
        metric, k = kind.top
        rows = rows.orderBy(F.desc_nulls_first(metric), kind.keys[0]).limit(k)
    return rows.select(*kind.keys, *[F.col(f"`{n}`").alias(n.removeprefix(f"{PER_BRANCH}.")) for n in asked])


def _stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = scratch(spark, "metrics")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
