"""Metric definitions: dependencies, order, checks, and one pass over a source."""

import pytest

from tests.shopdata import line, lines, pay, rows, tx
from tillstone.plans import metrics, semantic, star
from tillstone.plans.metrics import BadDefinition, Definition
from tillstone.sources.testshop import VOCABULARY as VOCAB


@pytest.fixture(scope="module")
def shop(spark):
    sold = lines(
        spark, line("t1", branch_norm="North", gross="10", net="8"), line("t1", branch_norm="North", description="cake", gross="5", net="4"),
        line("t2", branch_norm="South", description="cake", gross="7", net="6"), line("t3", branch_norm="North", description="Tip", gross="2", net="2"))
    paid = tx(spark, pay("t1", fee="1", card_last4="1111"), pay("t2", fee="2", card_last4="2222"), pay("t3", fee="0"))
    return semantic.Shop(tx=paid, lines=sold, star=star.star_of(sold, paid, VOCAB), vocab=VOCAB)


def test_every_metric_of_the_dictionary_is_defined(spark, shop):
    known = metrics.definitions_for(shop)
    named = {m[0] for m in semantic.METRICS}
    assert named - {metrics.PER_BRANCH} <= set(known)
    assert sum(n.startswith(f"{metrics.PER_BRANCH}.") for n in known) == len(VOCAB.counter_branches)
    for source in metrics.SOURCES:
        got = metrics.compute(spark, shop, source)
        assert set(metrics.SOURCES[source].keys) <= set(got.columns) and got.count() > 0


def test_equal_to_the_views(spark, shop):
    for view, names in (("sales_overview", ["venta_bruta", "ticket_promedio", "margen_operativo_real"]), ("tips_analysis", ["propina_promedio"]),
                        ("payment_methods", ["participacion_ventas_pct", "tasa_comision_pct"]), ("top_products", ["share_ventas_pct"])):
        keys = metrics.SOURCES[view].keys
        got = metrics.compute(spark, shop, view, names)
        assert sorted(rows(got, *keys, *names), key=str) == sorted(rows(semantic.VIEWS[view](shop), *keys, *names), key=str)


def test_only_what_is_asked_for_is_worked_out_in_one_pass(spark, shop):
    stored = metrics.compute(spark, shop, "sales_overview", ["liquido_a_recibir"])
    assert stored.columns == ["cuenta", "liquido_a_recibir"]
    # fees count once per line of the ticket: 2 for t1, 2 for t2, 0 for t3
    assert dict(rows(stored)) == {"North": 15.0, "South": 5.0, VOCAB.overview_total: 20.0}
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def graph(spark, **expressions):
    definitions = {n: Definition(*e) if isinstance(e, tuple) else Definition("tips_analysis", e) for n, e in expressions.items()}
    return metrics.dependencies(spark, definitions), definitions


def test_order_and_names(spark):
    own = graph(spark, a="count(*)", b="a + `a`", c="b * a - coalesce(tip, 0)", d="'a' || max(tip)", e="c_del_total / c")
    assert own[0] == {"a": set(), "b": {"a"}, "c": {"a", "b"}, "d": set(), "e": {"c"}}
    assert metrics.in_order(*own, ["c", "d"]) == ["a", "b", "c", "d"]


def test_refused(spark, shop):
    with pytest.raises(BadDefinition, match="cycle: a -> b -> c -> a"):
        metrics.in_order(*graph(spark, a="b + 1", b="c", c="a"), ["a"])
    with pytest.raises(BadDefinition, match="cycle: a -> a"):
        metrics.in_order(*graph(spark, a="a + 1"), ["a"])
    with pytest.raises(BadDefinition, match="their rows differ"):
        metrics.in_order(*graph(spark, a=("peak_hours", "count(*)"), b="a * 2"), ["b"])
    with pytest.raises(BadDefinition, match="unknown metric 'x'"):
        metrics.compute(spark, shop, "tips_analysis", ["x"])
    with pytest.raises(BadDefinition, match="not of tips_analysis"):
        metrics.compute(spark, shop, "tips_analysis", ["venta_bruta"])
    with pytest.raises(BadDefinition, match="total of a metric built on others"):
        metrics.compute(spark, shop, "tips_analysis", definitions={
            "a": Definition("tips_analysis", "count(*)"), "b": Definition("tips_analysis", "a + 1"), "c": Definition("tips_analysis", "b / b_del_total")})


def test_a_metric_of_ones_own(spark, shop):
    own = {**metrics.DEFINITIONS, "propina_por_ticket": Definition("tips_analysis", "round(propinas_totales / transacciones_totales, 1)")}
    got = metrics.compute(spark, shop, "tips_analysis", ["propina_por_ticket"], own)
    assert got.columns == ["sede_unificada", "propina_por_ticket"] and got.count() > 0
