"""The semantics that are easy to get wrong, on frames small enough to check by hand."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.shopdata import line, lines, pay, rows, tx
from tillstone.functions import dates
from tillstone.functions.money import pct_of_count, pct_of_money, per_unit, to_money
from tillstone.functions.text import contains_none, initcap_words
from tillstone.operators import grain, load, lookup, profile
from tillstone.operators.numbering import bucketed, number_lines
from tillstone.plans import agentlog, hours, loyalty, payments, products, sales, star
from tillstone.sources.testshop import VOCABULARY as V


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_fee_counts_once_per_ticket_or_once_per_line(spark):
    t = tx(spark, pay("1", fee="2"))
    l = lines(spark, *[line("1", branch_norm="North") for _ in range(3)])
    assert rows(sales.overview_tickets(t, l, V), "cuenta", "comisiones_sumup") == [
        ("North", 2.0), (V.overview_total, 2.0),
    ]
    s = star.star_of(l, t, V)
    assert rows(sales.overview_star(s.fact_lines, s.dim_branch, s.fact_tx, V), "cuenta", "comisiones_sumup") == [
        ("North", 6.0), (V.overview_total, 6.0),
    ]


def test_rollup_total_is_not_a_null_key(spark):
    parts = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n long")
    got = rows(grain.total_row(parts, "k", "TOTAL", {"n": "n"}).orderBy("is_total", "k"), "k", "n")
    assert got == [(None, 1), ("a", 2), ("TOTAL", 3)]


def test_null_order_is_explicit(spark):
    t = tx(spark, pay("1"), pay("2"))
    l = lines(spark, line("1", account=None), line("2", account="x"), line("2", account="x", description="Tip"))
    got = rows(sales.tips_raw(t, l, V), "sede_unificada", "tasa_conversion_propina_pct")
    assert got == [("x", 100.0), (None, 0.0)]


def test_description_filters_keep_three_valued_logic(spark):
    df = texts(spark, None, "", " ", "Tip", "tiple", "tea")
    assert rows(df.filter(contains_none(F.col("t"), ("tip",)))) == [("",), (" ",), ("tea",)]
    l = lines(spark, line("1", description=None), line("2", description=" "), line("3", description="tiple"))
    assert rows(products.products_share_raw(l, V), "producto", "ventas_brutas") == [(V.unnamed_product, 10.0)]
    # Sales by branch drops only a description that is exactly a tip word.
    t = tx(spark, pay("1"), pay("2"), pay("3"), pay("4"))
    more = lines(spark, line("3", description="tiple"), line("4", description="TIP"))
    assert rows(sales.sales_by_branch(t, more, V), "cuenta", "transacciones") == [("North", 1), (V.general_total, 1)]


def test_dates(spark):
    df = texts(
        spark, "05-03-2024, 10:30", "05-03-2024, 10:30:11", "bad", "", None, "2024-03-05", "2024-03-05 07:08:09",
        "31-02-2024, 10:30", "2024-03-05 nonsense",
    )
    got = rows(df.select(
        dates.parse_sold_at(F.col("t")).cast("string").alias("at"), dates.is_day_first(F.col("t")).alias("d")
    ))
    assert got == [
        ("2024-03-05 10:30:00", True), ("2024-03-05 10:30:00", True), (None, False), (None, False), (None, False),
        ("2024-03-05 00:00:00", False), ("2024-03-05 07:08:09", False), (None, True), (None, False),
    ]
    assert rows(texts(spark, "2024-03-05 nonsense", "bad").select(dates.parse_iso(F.col("t")).cast("string"))) == [
        ("2024-03-05 00:00:00",), (None,),
    ]


@pytest.mark.parametrize("zone", ["UTC", "America/Santiago"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = texts(spark, "08-09-2024, 00:30")  # an hour this zone skipped
        assert rows(df.select(dates.parse_sold_at(F.col("t")).cast("string"))) == [("2024-09-08 00:30:00",)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_day_first_spelling_only_where_the_query_asks(spark):
    l = lines(spark, line("1", branch_norm="North"), line("2", branch_norm="North", sold_at="2024-03-05 11:00:00"))
    assert rows(hours.peak_hours_raw(l, V), "hora_del_dia", "sede_north") == [(10, 1)]
    assert rows(hours.peak_hours_view(l, V), "hora_del_dia", "total_transacciones") == [(10, 1), (11, 1)]


def test_initcap_starts_words_after_any_sign(spark):
    df = texts(spark, "café-latte o'neil 2x1", "ÁGUA con GAS", "")
    assert rows(df.select(initcap_words(F.col("t")))) == [("Café-Latte O'Neil 2x1",), ("Água Con Gas",), ("",)]


def test_bad_money_is_null(spark):
    df = texts(spark, "", None, "10.5", "x", "-3")
    assert rows(df.select(to_money(F.col("t")))) == [(None,), (None,), (10.5,), (None,), (-3.0,)]


def test_ratios_are_exact_and_round_half_up(spark):
    df = spark.createDataFrame([(1, 32), (2, 3), (1, 0), (1, 200000)], "a long, b long")
    assert rows(df.select(pct_of_count(F.col("a"), F.col("b")))) == [(3.13,), (66.67,), (None,), (0.0,)]
    money = spark.sql("SELECT cast('0.1235' AS decimal(18,4)) AS a, cast(1 AS decimal(18,4)) AS b, 2L AS n")
    assert rows(money.select(pct_of_money(F.col("a"), F.col("b")), per_unit(F.col("b"), F.col("n")))) == [(12.35, 1.0)]
    third = spark.sql("SELECT cast(1234495 AS decimal(18,4)) AS a, cast(10000000 AS decimal(18,4)) AS b")
    assert rows(third.select(pct_of_money(F.col("a"), F.col("b")))) == [(12.34,)]


def test_one_payment_prefers_card_data_then_the_higher_fee(spark):
    t = tx(
        spark, pay("1", fee="9"), pay("1", run_as="DEBIT", fee="1"), pay("1", run_as="DEBIT", fee="2"),
        pay("1", run_as="DEBIT"), pay("2", fee=""), pay("3", run_as="DEBIT"), pay("3", run_as="CREDIT"),
    )
    got = rows(payments.one_payment_per_ticket(t).orderBy("tx_id"))
    assert got == [("1", "DEBIT", 2.0), ("2", None, None), ("3", "CREDIT", None)]


def test_ticket_split_over_branches(spark):
    t = tx(spark, pay("1", card_last4="1111"), pay("2", card_last4="1111", created_at="2024-03-06 09:00:00"))
    l = lines(spark, line("1"), line("1", account="East"), line("1", account="East", description="Tip"), line("2"))
    # One branch, the greatest, in the overview.
    assert rows(sales.overview_tickets(t, l, V), "cuenta", "transacciones") == [
        ("North", 2), (V.overview_total, 2),
    ]
    # Both branches elsewhere, but one ticket in a distinct total.
    assert rows(sales.sales_by_branch(t, l, V).orderBy("cuenta"), "cuenta", "transacciones") == [
        ("East", 1), ("North", 2), (V.general_total, 2),
    ]
    assert rows(sales.tips_raw(t, l, V).orderBy("sede_unificada"), "sede_unificada", "transacciones_con_propina", "propinas_totales") == [
        ("Sede East", 1, 10.0), ("Sede North", 1, 10.0),
    ]
    assert rows(loyalty.loyalty_raw(t, l, V).orderBy("nombre_sede")) == [
        ("Sede East", "2024-03", 1, 0, 0, 0.0), ("Sede North", "2024-03", 0, 1, 0, 100.0),
    ]


def test_two_payment_rows_double_the_items(spark):
    l = lines(spark, line("1"), line("2"))
    once = sales.purchase_behavior(tx(spark, pay("1"), pay("2")), l, V)
    twice = sales.purchase_behavior(tx(spark, pay("1"), pay("1"), pay("2")), l, V)
    assert rows(once, "ventas_solitarias", "ventas_con_acompanamiento") == [(2, 0)]
    assert rows(twice, "ventas_solitarias", "ventas_con_acompanamiento", "ticket_promedio_acompanado") == [(1, 1, 20.0)]


def test_unnamed_lines_count_in_the_view_variant_only(spark):
    t, l = tx(spark, pay("1")), lines(spark, line("1", description=None))
    assert rows(sales.purchase_behavior(t, l, V)) == []
    assert rows(sales.purchase_behavior(t, l, V, keep_unnamed=True), "ventas_solitarias") == [(1,)]


def test_zero_denominator_is_null_in_raw_and_zero_in_the_view(spark):
    df = spark.createDataFrame([("a", 0, 0)], "medio string, n long, whole long")
    assert rows(df.select(pct_of_count(F.col("n"), F.col("whole")))) == [(None,)]
    t = tx(spark, pay("1", run_as="DEBIT", fee="1"))
    mix = rows(payments.payment_mix_view(t, lines(spark, line("1")), V), "medio_de_pago", "tasa_comision_pct")
    assert mix == [(V.debit, 10.0), (V.general_total, 10.0)]


def test_tips_of_a_ticket_paid_under_two_emails_count_twice(spark):
    t = tx(spark, pay("1", account_email="north@x"), pay("1", account_email="EAST@x"))
    l = lines(spark, line("1", description=" tip ", branch_norm="the West side"))
    got = rows(sales.tips_view(t, l, V), "sede_unificada", "transacciones_totales", "propinas_totales", "propina_promedio")
    assert got == [("West Hall", 1, 20.0, 20.0)]


def test_dimension_lookups_miss_where_the_source_misses(spark):
    l = lines(
        spark, line("1", branch_norm="North", tax_type=None), line("1", branch_norm="south kiosk"),
        line("1", branch_norm="North"),
    )
    s = star.star_of(l, tx(spark, pay("1", card_last4=" 12345 "), pay("2", card_last4="1234")), V)
    got = rows(s.fact_lines.orderBy("linea_ticket").select(
        F.col("producto_sk").isNull().alias("p"), F.col("sede_sk").isNull().alias("b")
    ))
    assert got == [(True, False), (False, True), (False, False)]
    cards = rows(s.dim_card.orderBy("ultimos_4_digitos"), "ultimos_4_digitos")
    assert cards == [("1234",)]
    found = rows(s.fact_tx.orderBy("id_transaccion").select(F.col("tarjeta_sk").isNotNull()))
    assert found == [(False,), (True,)]


def test_strict_facts_fail_on_blank_amounts(spark):
    raw = spark.createDataFrame(
        [(1, "1", "north", "North", "tea", "A", "cash", "1", "", "", "1", "1", "05-03-2024, 10:30")],
        "line_id bigint, tx_id string, account string, branch_norm string, description string, tax_type string, "
        "pay_form string, quantity string, unit_price string, gross string, net string, vat string, sold_at string",
    )
    l = lines(spark, line("1", branch_norm="North"))
    dims = star.dim_product(l, V), star.dim_branch(l, V), star.dim_payment(l, V)
    with pytest.raises(PySparkException):
        star.fact_lines_strict(raw, *dims).collect()
    assert rows(star.fact_lines_strict(raw, *dims, strict=False), "linea_ticket", "precio_bruto") == [(1, 0.0)]


def test_single_match_lookup_fails_on_two(spark):
    facts = spark.createDataFrame([("a",), ("b",)], "k string")
    dim = spark.createDataFrame([("a", 1), ("a", 2)], "k string, sk long")
    assert rows(lookup.first_match(facts, dim, {"k": F.col("k")}, "sk").orderBy("k")) == [("a", 1), ("b", None)]
    with pytest.raises(PySparkException):
        lookup.only_match(facts, dim, {"k": F.col("k")}, "sk").collect()


def test_line_numbers_split_a_hot_ticket_of_sparse_ids(spark):
    """A third of the lines under one ticket, ids far apart or clumped."""
    number = F.col("id")
    for line_id in (number * 10_000_000_000 + F.pmod(F.xxhash64("id"), F.lit(10**9)), F.pow(number, 3).cast("long"), number):
        df = spark.range(1, 3001).select(
            F.when(number % 3 == 0, "hot").otherwise(number.cast("string")).alias("tx_id"), line_id.alias("line_id")
        )
        plain = df.withColumn("want", F.row_number().over(Window.partitionBy("tx_id").orderBy("line_id")))
        for target in (1, 100, 1_000_000):
            got = number_lines(plain, target=target)
            assert got.count() == 3000
            assert got.filter("want <> linea_ticket").count() == 0
        parts = bucketed(plain, 100).groupBy("tx_id", "_bucket").count()
        assert parts.filter("tx_id <> 'hot' AND _bucket > 0").count() == 0
        assert parts.filter("tx_id = 'hot'").count() > 100 and parts.agg(F.max("count")).first()[0] < 50


def test_equal_rows_are_numbered_as_one(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 40).cast("string"))).alias("tx_id"),
        (F.col("id") * 13).alias("line_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 7).alias("v"))
    twice = df.union(df.where("line_id % 2 = 0")).union(df.where("line_id % 3 = 0")).repartition(7)
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("tx_id").orderBy("line_id")))
    for target in (1, 100, 1_000_000):
        got = number_lines(twice, target=target, distinct=True, sizes=twice.select("tx_id", "line_id"))
        assert sorted(map(tuple, got.select("tx_id", "line_id", "linea_ticket").collect())) == sorted(
            map(tuple, want.select("tx_id", "line_id", "want").collect()))
    differ = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), ("a", 1, None), ("a", 1, "x"), ("a", 2, "x")], "tx_id string, line_id bigint, v string")
    assert sorted(r["linea_ticket"] for r in number_lines(differ, distinct=True).collect()) == [1, 2, 3]


def test_lines_are_shuffled_once_to_be_numbered(spark):
    stored = spark.range(5000).select((F.col("id") % 900).cast("string").alias("tx_id"), F.col("id").alias("line_id"), (F.col("id") % 9).alias("v"))
    got = number_lines(stored, distinct=True)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count(" Exchange hashpartitioning(tx_id") == 1, final


def test_a_line_exported_twice_counts_once(spark):
    t, twice = tx(spark, pay("1")), line("1", line_id=7)
    s = star.star_of(lines(spark, twice, twice, line("1", line_id=8)), t, V)
    assert sorted(rows(s.fact_lines, "id_transaccion", "linea_ticket")) == [("1", 1), ("1", 2)]


def test_totals_over_nothing(spark):
    l, t = lines(spark, line("1")).limit(0), tx(spark, pay("1")).limit(0)
    s = star.star_of(l, t, V)
    for got in (sales.overview_tickets(t, l, V), sales.overview_star(s.fact_lines, s.dim_branch, s.fact_tx, V), sales.sales_by_branch(t, l, V)):
        assert rows(got, "cuenta", "transacciones") in ([(V.overview_total, 0)], [(V.general_total, 0)])
    assert rows(payments.payment_mix_raw(t, l, V), "total_transacciones", "ventas_totales") == [(0, None)]
    assert rows(payments.payment_mix_view(t, l, V), "total_transacciones", "ventas_totales", "comision_total", "tasa_comision_pct") == [(0, 0, 0, 0)]
    assert sorted(rows(profile.distinct_profile(l, ["tx_id", "account"]))) == [("account", 0), ("tx_id", 0)]


def test_a_ticket_may_have_very_many_payment_rows(spark):
    """The product in the purchase behaviour for a count given as a column."""
    amount = (F.lit("12345.6789").cast("decimal(28,4)") * F.lit(300_000_000_000).cast("decimal(19,0)")).cast("decimal(38,4)")
    assert str(spark.range(1).select(amount).first()[0]) == "3703703670000000.0000"


def test_json_must_be_the_whole_text(spark):
    good = ['{"a":1}', ' {"a": [1, 2]} ', '{"a":1,"a":2}', "NaN", '{"a": NaN}', "null", "3", '"x"', "[]", "[1, 2]", "true"]
    bad = ['{"a":1} junk', '{"a":1}{"b":2}', "1, 2", "", " ", "{'a':1}", "{", '{"a":1', "abc", None]
    for texts_, wanted in ((good, True), (bad, False)):
        df = spark.createDataFrame([(x,) for x in texts_], "t string")
        got = rows(df.select("t", agentlog._is_json(F.col("t"))))
        assert [r for r in got if r[1] is not wanted] == []


def test_loads_are_idempotent(spark):
    stored = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, k2 string, v int")
    incoming = spark.createDataFrame([("a", None, 9), ("c", None, 3), ("c", None, 4)], "k string, k2 string, v int")
    once = load.insert_ignore(stored, incoming, ["k", "k2"])
    assert sorted(rows(once), key=str) == [("a", None, 1), ("b", "x", 2), ("c", None, 3)]
    assert sorted(rows(load.insert_ignore(once, incoming, ["k", "k2"])), key=str) == sorted(rows(once), key=str)
    update = spark.createDataFrame([("b", "x", 7), ("d", None, 8)], "k string, k2 string, v int")
    merged = load.upsert_update(stored, update, ["k", "k2"])
    assert sorted(rows(merged), key=str) == [("a", None, 1), ("b", "x", 7), ("d", None, 8)]
    assert sorted(rows(load.upsert_update(merged, update, ["k", "k2"])), key=str) == sorted(rows(merged), key=str)


def test_profiles(spark):
    df = spark.createDataFrame([("a", ""), ("a", None), ("b", "x")], "p string, q string")
    assert sorted(rows(profile.distinct_profile(df, ["p", "q"]))) == [("p", 2), ("q", 1)]
    assert rows(profile.row_counts({"t": df, "u": df.limit(1)}).orderBy("tabla")) == [("t", 3), ("u", 1)]
    assert rows(profile.duplicate_keys(df, "p")) == [("a", 2)]
    assert rows(profile.unmatched_counts(df, ["p", "q"]).orderBy("clave")) == [("p", 0), ("q", 1)]


def test_ticket_counts_ignore_missing_ids_but_keep_the_hour(spark):
    l = lines(spark, line(None), line("1", sold_at="05-03-2024, 11:00"), line("1", sold_at="05-03-2024, 11:10"))
    assert rows(hours.peak_hours_raw(l, V), "hora_del_dia", "sede_north") == [(10, 0), (11, 1)]
    assert rows(hours.dates_to_iso(hours.busy_hours(l, V)), "dia", "dia_semana", "hora_del_dia", "north") == [
        ("2024-03-05", "Martes", 10, 0), ("2024-03-05", "Martes", 11, 1),
    ]
