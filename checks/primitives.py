"""Small queries, one per building block: branch rules, predicates, joins, aggregates,
windows, sorts, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.base import (
    LINES, LINES_RAW, TX, TX_RAW, VOCAB, Query, account_case, alias_case, broad_case, cents, money, of_both,
    of_lines, of_table, of_tx, pct, plain, read, with_,
)
from checks.business import TOP5
from tillstone.functions import branch, dates
from tillstone.functions.money import no_zero, pct_of_count, pct_of_money, to_money
from tillstone.functions.text import initcap_words, keyword_category
from tillstone.operators import grain, lookup
from tillstone.operators.load import new_rows
from tillstone.operators.numbering import number_lines
from tillstone.plans.payments import one_payment_per_ticket
from tillstone.plans.products import top_products
from tillstone.sources import testshop


def _count_by(**keys):
    def build(df: DataFrame) -> DataFrame:
        return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count("*").alias("n"))

    return build


def _counts(**conditions):
    """One row: how many rows meet each condition."""
    return lambda df: df.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in conditions.items()])


def _tables(build):
    return lambda spark, sf: plain(build(lambda name: read(spark, sf, name)))


def _positional(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(
        "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {t} GROUP BY 1, 2 ORDER BY 1, 2",
        t=read(spark, sf, "lineitem"),
    )


def _raw_tx(build):
    return lambda spark, sf: plain(build(testshop.raw_tx(spark, sf)))


def _raw_lines(build):
    return lambda spark, sf: plain(build(testshop.raw_lines(spark, sf)))


def _cte_chain(tx: DataFrame, lines: DataFrame) -> DataFrame:
    paid = grain.settled(tx, VOCAB).select("tx_id").distinct()
    tickets = grain.sold(lines).groupBy("tx_id").agg(F.sum("gross").alias("gross"))
    sizes = tickets.join(paid, "tx_id").select(F.floor(F.col("gross") / 50000).cast("bigint").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n"))


def _tickets(lines: DataFrame) -> DataFrame:
    return lines.groupBy("tx_id").agg(F.sum("gross").alias("gross"), F.sum("quantity").alias("quantity"))


def _supplier_nation(table) -> DataFrame:
    return table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))


def _rank_revenue(table) -> DataFrame:
    revenue = table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(cents("l_extendedprice")).alias("v"))
    best = Window.partitionBy("l_suppkey").orderBy(F.desc("v"), "l_partkey")
    return revenue.withColumn("rn", F.row_number().over(best)).filter("rn <= 3")


def _whole_window(orders: DataFrame) -> DataFrame:
    parts = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    everything = parts.agg(F.max(F.when(F.col("o_orderstatus") == "O", F.col("n"))).alias("open_n"))
    return lookup.with_single_row(parts, everything)


def _placed(counts: DataFrame, *order) -> DataFrame:
    """Every row with its place in ``order``. The window has no key: it sees one row per group."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def _accounts_in(*order):
    """Line counts of all accounts with their place in an order that says where NULL goes."""
    return lambda lines: _placed(lines.groupBy("account").agg(F.count("*").alias("n")), *order)


def _parts_of_date(df: DataFrame) -> DataFrame:
    day = F.col("o_orderdate")
    return df.groupBy(
        F.year(day).alias("y"), F.quarter(day).alias("q"), F.month(day).alias("m"), F.dayofmonth(day).alias("d")
    ).agg(F.count("*").alias("n"))


def _build() -> dict[str, Query]:
    """Column expressions need a running session, so the queries are built on first use."""
    acc, norm, email, desc = (
        F.col(c) for c in ("account", "branch_norm", "account_email", "description")
    )
    return {
        # Branch rules
        "n1_branch_by_alias": of_lines(_count_by(sede=branch.by_alias(acc, VOCAB))),
        "n2_branch_by_account_pattern": of_lines(
            _count_by(sede=branch.by_account_pattern(acc, VOCAB, VOCAB.unknown_branch))
        ),
        "n3_branch_by_broad_pattern": of_lines(
            _count_by(sede=branch.by_broad_pattern(norm, VOCAB, F.coalesce(norm, F.lit(VOCAB.unknown_branch))))
        ),
        "n4_branch_by_email": of_tx(_count_by(
            broad=branch.by_email(email, VOCAB), narrow=branch.by_email_or(email, F.lit(None).cast("string"), VOCAB)
        )),
        "n5_branch_trimmed": of_lines(_count_by(
            sede=branch.by_alias_trimmed(acc, VOCAB), blank=branch.by_alias_trimmed(acc, VOCAB, blank_for_null=True)
        )),
        # Projections and predicates
        "p1_searched_case": of_tx(_count_by(
            medio=F.when(F.col("run_as") == "DEBIT", "D").when(F.col("run_as") == "CREDIT", "C").otherwise("E")
        )),
        "p2_weekday_case": of_table("orders", _count_by(
            dia=dates.weekday_name(F.col("o_orderdate"), VOCAB.weekdays)
        )),
        "p3_in_and_not_in": of_tx(_counts(
            inside=F.col("status").isin("successful", "paid"), outside=~F.col("run_as").isin("DEBIT", "debito")
        )),
        "p4_ilike": of_lines(_counts(yes=desc.ilike("%TIP%"), no=~desc.ilike("%TIP%"))),
        "p5_like_on_lower": of_lines(_counts(hit=F.lower(desc).like("%ring%"))),
        "p6_regex_prefix": _raw_lines(_counts(hit=F.col("sold_at").rlike(dates.DAY_FIRST))),
        "p7_predicates": of_tx(_counts(
            known=F.col("run_as").isNotNull() & (F.col("card_last4") != ""), none=F.col("run_as").isNull(),
            big=(F.col("total") >= 100000) | (F.col("fee") > 5000),
        )),
        "p8_any_case_equality": of_tx(_counts(
            low=F.lower("status") == "paid", up=F.upper(F.coalesce("run_as", F.lit(""))).isin("DEBIT", "DEBITO")
        )),
        "p9_boolean_sort_key": of_lines(_accounts_in(acc.isNull(), F.desc("n"), "account")),
        "p10_positional_group": _positional,
        "p11_star_plus_column": of_table("nation", lambda n: n.select("*", (F.col("n_nationkey") % 2).alias("odd"))),
        "p12_cte_chain": of_both(_cte_chain),
        # Joins
        "j1_inner_ticket_grain": of_both(lambda t, l: _tickets(l).join(
            t.groupBy("tx_id").agg(F.max("fee").alias("fee")), "tx_id"
        )),
        "j2_inner_many_to_many": of_both(lambda t, l: grain.per_ticket_branch(l, acc, F.count("*").alias("line_n")).join(
            t.groupBy("tx_id").agg(F.count("*").alias("pay_n")), "tx_id"
        ).groupBy("branch").agg(F.sum(F.col("line_n") * F.col("pay_n")).alias("n"))),
        "j3_fact_dimension": _tables(lambda t: t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).join(
            _supplier_nation(t), F.col("l_suppkey") == F.col("s_suppkey")
        ).groupBy("n_name").agg(F.sum("n").alias("n"))),
        "j4_left_outer": _tables(lambda t: t("customer").select("c_custkey").join(
            t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n")), "c_custkey", "left"
        )),
        "j5_chained_left": _tables(lambda t: t("lineitem").select("l_suppkey").join(
            t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
        ).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(
            F.count("*").alias("n")
        )),
        "j6_cross_single_row": of_table("orders", lambda o: lookup.with_single_row(
            o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), o.agg(F.count("*").alias("all_n"))
        )),
        "j7_semi_join_ids": of_both(lambda t, l: lookup.keep_known(
            _tickets(l), t.filter(F.col("status") == "paid"), "tx_id"
        )),
        "j8_join_distinct_pairs": of_both(lambda t, l: t.filter(F.col("status") == "paid").select("tx_id").join(
            grain.per_ticket_branch(l, acc), "tx_id"
        ).groupBy("branch").agg(F.count("*").alias("n"))),
        "j9_scalar_lookup_single": _tables(lambda t: lookup.only_match(
            t("lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), t("part"),
            {"p_partkey": F.col("l_partkey")}, "p_name",
        )),
        "j10_scalar_lookup_first": _tables(lambda t: lookup.first_match(
            t("part").select("p_partkey", "p_brand"), t("part"), {"p_brand": F.col("p_brand")}, "p_name", "first_name"
        ).select("p_partkey", "first_name")),
        "j11_scalar_total": of_table("lineitem", lambda l: lookup.with_single_row(
            l.groupBy("l_returnflag").agg(F.sum(cents("l_extendedprice")).alias("v")),
            l.agg(F.sum(cents("l_extendedprice")).alias("all_v")),
        ).select("l_returnflag", pct_of_money(F.col("v"), F.col("all_v")).alias("share"))),
        "j12_any_row": _tables(lambda t: lookup.with_single_row(
            t("region"), t("nation").agg(F.min("n_nationkey").alias("any_nation"))
        )),
        "j13_case_key_lookup": of_lines(lambda l: lookup.first_match(  # reduced to its few keys first
            l.groupBy(branch.dimension_name(norm, VOCAB).alias("k")).agg(F.count("*").alias("k_n")),
            l.select("branch_norm").filter("branch_norm <> ''").distinct(), {"branch_norm": F.col("k")}, "branch_norm",
            "found",
        ).groupBy("found").agg(F.sum("k_n").alias("n"))),
        "j14_anti_join": _tables(lambda t: new_rows(
            t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), t("orders").select("o_orderkey"), ["o_orderkey"]
        )),
        # Aggregates
        "a1_basic_aggregates": of_tx(lambda t: t.groupBy("status").agg(
            F.sum("fee").alias("fees"), F.count("*").alias("n"), F.count("fee").alias("n_fee"), F.max("total").alias("top"),
            F.round(F.sum("fee").cast("double") / F.count("fee"), 4).alias("mean"),
        )),
        "a2_count_distinct": of_table("lineitem", lambda l: l.groupBy("l_returnflag", "l_orderkey").agg(
            F.count("*").alias("n")
        ).groupBy("l_returnflag").agg(F.count("l_orderkey").alias("orders"))),
        "a3_conditional_distincts": of_table("lineitem", lambda l: l.groupBy("l_suppkey", "l_orderkey").agg(
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_linestatus") == "O").cast("int")).alias("o")
        ).groupBy("l_suppkey").agg(F.sum("r").alias("returned"), F.sum("o").alias("open"))),
        "a4_conditional_aggregates": of_table("lineitem", lambda l: l.agg(
            F.count(F.when(F.col("l_quantity") > 25, 1)).alias("big"),
            F.sum(F.when(F.col("l_returnflag") == "A", cents("l_extendedprice"))).alias("a_sum"),
            F.max(F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))).alias("f_max"),
        )),
        "a5_rollup_total": of_lines(lambda l: grain.total_row(
            l.groupBy("account").agg(F.count("*").alias("n"), F.sum("gross").alias("gross")),
            "account", "TOTAL", {"n": "n", "gross": "gross"},
        )),
        "a5_rollup_of_nothing": of_lines(lambda l: grain.total_row(
            l.filter(F.col("gross") < -1).groupBy("account").agg(F.count("*").alias("n"), F.sum("gross").alias("gross")),
            "account", "TOTAL", {"n": "n", "gross": "gross"}, counts=("n",),
        )),
        "a6_distinct_rows": of_table("lineitem", lambda l: l.select("l_suppkey", "l_returnflag").distinct()),
        "a7_distinct_on": of_tx(one_payment_per_ticket),
        "a8_group_as_dedupe": of_lines(lambda l: grain.per_ticket_branch(l, acc)),
        "a9_two_level": of_lines(lambda l: grain.sold(l).groupBy("tx_id").agg(F.count("*").alias("items")).groupBy("items").agg(
            F.count("*").alias("tickets")
        )),
        "a10_computed_group": of_tx(_count_by(card=F.coalesce(F.nullif("card_last4", F.lit("")), F.lit("none")))),
        "a11_global_aggregate": of_lines(lambda l: grain.sold(l).agg(F.count("*").alias("n"), F.sum("gross").alias("v"))),
        "a12_share_of_total": of_table("orders", lambda o: lookup.with_single_row(
            o.groupBy("o_orderpriority").agg(F.count("*").alias("n")), o.agg(F.count("*").alias("all_n"))
        ).select("o_orderpriority", pct_of_count(F.col("n"), F.col("all_n")).alias("share"))),
        # Windows
        "w1_rank_in_group": _tables(_rank_revenue),
        "w3_whole_result_window": of_table("orders", _whole_window),
        "w2_line_numbers": of_lines(lambda l: number_lines(l.select("tx_id", "line_id"))),
        # Sorts and limits
        "t1_mixed_sort": of_table("supplier", lambda s: _placed(
            s.groupBy("s_nationkey").agg(F.count("*").alias("n")), F.desc("n"), F.asc("s_nationkey")
        )),
        "t2_desc_nulls_first": of_lines(_accounts_in(F.desc_nulls_first("account"))),
        "t3_asc_nulls_last": of_lines(_accounts_in(F.asc_nulls_last("account"))),
        "t4_nulls_last_pick": of_tx(lambda t: _placed(t.select("run_as").distinct(), F.asc_nulls_last("run_as"))),
        "t5_top_k": of_table("lineitem", lambda l: l.groupBy("l_partkey").agg(
            F.sum(cents("l_extendedprice")).alias("v")
        ).orderBy(F.desc("v"), "l_partkey").limit(50)),
        "t6_limit_whole_key": of_table("nation", lambda n: n.orderBy("n_name", "n_nationkey").limit(10)),
        "t7_top_k_per_group": of_lines(lambda l: top_products(l, VOCAB, k=2)),
        # Set operations
        "u1_union_distinct": _tables(lambda t: t("customer").select(F.col("c_nationkey").alias("k")).union(
            t("supplier").select(F.col("s_nationkey").alias("k"))
        ).distinct()),
        "u2_union_all": _tables(lambda t: t("customer").select(F.col("c_nationkey").alias("k")).unionByName(
            t("supplier").select(F.col("s_nationkey").alias("k"))
        ).groupBy("k").agg(F.count("*").alias("n"))),
        # Scalar functions
        "f1_coalesce": of_lines(_count_by(v=F.coalesce("description", "tax_type", F.lit("none")))),
        "f2_nullif": _raw_tx(lambda t: t.agg(
            F.count(F.nullif("fee", F.lit(""))).alias("fees"),
            F.sum(F.nullif(F.col("fee").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))).alias("v"),
            F.count(no_zero(F.length("tip"))).alias("tips"),
        )),
        "f3_casts": _raw_tx(lambda t: t.groupBy(F.col("created_at").try_cast("date").alias("d")).agg(
            F.sum(to_money(F.col("fee"))).alias("fee"), F.sum(F.col("total").cast("decimal(18,4)").cast("bigint")).alias("whole")
        )),
        "f4_round_half_up": of_table("lineitem", lambda l: l.agg(
            F.sum(F.round(cents("l_extendedprice"), 0)).alias("whole"),
            F.sum(F.round(cents("l_extendedprice") * F.lit(0.125).cast("decimal(4,3)"), 2)).alias("eighth"),
        )),
        "f5_arithmetic": of_table("lineitem", lambda l: l.agg(
            F.sum(cents("l_extendedprice") * F.col("l_quantity").cast("decimal(4,0)") - cents("l_extendedprice")).alias("v")
        )),
        "f6_lower_upper": of_table("part", _count_by(low=F.lower("p_type"), up=F.upper("p_name"))),
        "f7_trim": of_lines(_count_by(t=F.trim(desc))),
        "f8_initcap": of_table("customer", lambda c: c.select(
            "c_custkey", initcap_words(F.concat_ws("-", F.lower("c_name"), F.lower("c_mktsegment"), F.lit("o'neil 2x"))).alias("v")
        )),
        "f9_substring": _raw_tx(_count_by(day=F.substring("created_at", 1, 10))),
        "f10_left": of_tx(_count_by(v=F.left(F.trim(F.coalesce("auth_code", F.lit(""))), F.lit(4)))),
        "f11_day_first_timestamp": of_lines(lambda l: l.select("line_id", "sold_at")),
        "f12_iso_timestamp": of_tx(_count_by(at=F.col("created_at"))),
        "f13_hour": of_lines(lambda l: l.groupBy(F.hour("sold_at").alias("h")).agg(F.count("*").alias("n"))),
        "f14_date_parts": of_table("orders", _parts_of_date),
        "f15_day_of_week": of_table("orders", _count_by(dow=dates.day_of_week(F.col("o_orderdate")))),
        "f16_date_text": of_table("orders", _count_by(
            day=dates.date_key(F.col("o_orderdate")), month=dates.month_text(dates.month_key(F.col("o_orderdate")))
        )),
        "f17_padded_names": of_table("orders", _count_by(
            month=dates.padded_name(F.col("o_orderdate"), "MMMM"), day=dates.padded_name(F.col("o_orderdate"), "EEEE")
        )),
        "f18_date_of_timestamp": of_table("events", _count_by(day=F.to_date("ts"))),
        "f19_days_since": of_table("orders", _count_by(days=dates.days_since(F.to_date("o_orderdate"), F.lit("1996-02-29").cast("date")))),
        "f20_weekend": of_table("events", _count_by(weekend=dates.is_weekend(F.col("ts")))),
        "f21_keyword_category": of_lines(_count_by(
            product=keyword_category(desc, VOCAB.product_categories, VOCAB.other_product),
            form=keyword_category(F.col("pay_form"), VOCAB.payment_categories, VOCAB.other_payment),
        )),
    }


def _lazy(name: str) -> Query:
    return lambda spark, sf: _build()[name](spark, sf)


def _q(table: str, keys: str, where: str = "TRUE") -> str:
    """Count by keys over a test-shop table."""
    names = ", ".join(str(i + 1) for i in range(keys.count(" AS ")))
    return with_(LINES, TX) + f"SELECT {keys}, COUNT(*) AS n FROM {table} WHERE {where} GROUP BY {names}"


def _when(condition: str, name: str) -> str:
    return f"COUNT(CASE WHEN {condition} THEN 1 END) AS {name}"


_DOUBLE_SUM = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE)"
_CENTS = "CAST(ROUND(l_extendedprice * 100) AS BIGINT)"

ORACLE = {
    "n1_branch_by_alias": _q("lines", f"{alias_case()} AS sede"),
    "n2_branch_by_account_pattern": _q("lines", f"{account_case('Sede No Identificada')} AS sede"),
    "n3_branch_by_broad_pattern": _q(
        "lines", broad_case("branch_norm", "COALESCE(branch_norm, 'Sede No Identificada')") + " AS sede"
    ),
    "n4_branch_by_email": with_(TX) + f"""
SELECT {broad_case("lower(COALESCE(account_email, ''))", "'Sede No Identificada'")} AS broad,
       CASE WHEN account_email ILIKE '%north%' THEN 'North' WHEN account_email ILIKE '%south%' THEN 'South'
            WHEN account_email ILIKE '%east%' THEN 'East' WHEN account_email ILIKE '%west%hall%' THEN 'West Hall'
            ELSE 'No Identificada' END AS narrow, COUNT(*) AS n
FROM tx GROUP BY 1, 2""",
    "n5_branch_trimmed": with_(LINES) + f"""
SELECT {alias_case('trim(account)')} AS sede, {alias_case("trim(COALESCE(account, ''))")} AS blank, COUNT(*) AS n
FROM lines GROUP BY 1, 2""",
    "p1_searched_case": _q(
        "tx", "CASE WHEN run_as = 'DEBIT' THEN 'D' WHEN run_as = 'CREDIT' THEN 'C' ELSE 'E' END AS medio"
    ),
    "p2_weekday_case": """
SELECT CASE EXTRACT(DOW FROM o_orderdate) WHEN 1 THEN 'Lunes' WHEN 2 THEN 'Martes' WHEN 3 THEN 'Miércoles'
       WHEN 4 THEN 'Jueves' WHEN 5 THEN 'Viernes' WHEN 6 THEN 'Sábado' WHEN 0 THEN 'Domingo' END AS dia,
       COUNT(*) AS n FROM orders GROUP BY 1""",
    "p3_in_and_not_in": with_(TX) + f"""SELECT {_when("status IN ('successful', 'paid')", 'inside')},
{_when("run_as NOT IN ('DEBIT', 'debito')", 'outside')} FROM tx""",
    "p4_ilike": with_(LINES) + f"""SELECT {_when("description ILIKE '%TIP%'", 'yes')},
{_when("description NOT ILIKE '%TIP%'", 'no')} FROM lines""",
    "p5_like_on_lower": with_(LINES) + f"SELECT {_when("lower(description) LIKE '%ring%'", 'hit')} FROM lines",
    "p6_regex_prefix": f"""SELECT COUNT(*) AS hit FROM ({LINES_RAW}) r
WHERE regexp_matches(sold_at, '^[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}, [0-9]{{2}}:[0-9]{{2}}')""",
    "p7_predicates": with_(TX) + f"""SELECT {_when("run_as IS NOT NULL AND card_last4 <> ''", 'known')},
{_when('run_as IS NULL', 'none')}, {_when('total >= 1000000000 OR fee > 50000000', 'big')} FROM tx""",
    "p8_any_case_equality": with_(TX) + f"""SELECT {_when("lower(status) = 'paid'", 'low')},
{_when("upper(COALESCE(run_as, '')) IN ('DEBIT', 'DEBITO')", 'up')} FROM tx""",
    "p9_boolean_sort_key": with_(LINES) + """
SELECT account, COUNT(*) AS n, row_number() OVER (ORDER BY account IS NULL, COUNT(*) DESC, account) AS place
FROM lines GROUP BY 1""",
    "p10_positional_group": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2",
    "p11_star_plus_column": "SELECT *, n_nationkey % 2 AS odd FROM nation",
    "p12_cte_chain": with_(
        LINES, TX,
        "paid AS (SELECT DISTINCT tx_id FROM tx WHERE status IN ('successful', 'paid'))",
        "tickets AS (SELECT tx_id, SUM(gross) AS gross FROM lines WHERE gross > 0 GROUP BY 1)",
        "sizes AS (SELECT CAST(gross // 500000000 AS BIGINT) AS size FROM tickets JOIN paid USING (tx_id))",
    ) + "SELECT size, COUNT(*) AS n FROM sizes GROUP BY 1",
    "j1_inner_ticket_grain": with_(LINES, TX) + f"""
SELECT l.tx_id, {money('l.gross')} AS gross, {money('l.quantity')} AS quantity, {money('t.fee')} AS fee
FROM (SELECT tx_id, SUM(gross) AS gross, SUM(quantity) AS quantity FROM lines GROUP BY 1) l
JOIN (SELECT tx_id, MAX(fee) AS fee FROM tx GROUP BY 1) t ON l.tx_id = t.tx_id""",
    "j2_inner_many_to_many": with_(LINES, TX) + """
SELECT account AS branch, COUNT(*) AS n FROM tx t JOIN lines l ON t.tx_id = l.tx_id GROUP BY 1""",
    "j3_fact_dimension": """
SELECT n_name, COUNT(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    "j4_left_outer": """
SELECT c_custkey, n FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) o
ON o_custkey = c_custkey""",
    "j5_chained_left": """
SELECT n_name, COUNT(*) AS n FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""",
    "j6_cross_single_row": """
SELECT o_orderstatus, n, all_n FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1) p
CROSS JOIN (SELECT COUNT(*) AS all_n FROM orders) a""",
    "j7_semi_join_ids": with_(LINES, TX) + f"""
SELECT tx_id, {money('SUM(gross)')} AS gross, {money('SUM(quantity)')} AS quantity FROM lines
WHERE tx_id IN (SELECT tx_id FROM tx WHERE status = 'paid') GROUP BY 1""",
    "j8_join_distinct_pairs": with_(LINES, TX) + """
SELECT account AS branch, COUNT(*) AS n FROM tx t
JOIN (SELECT DISTINCT tx_id, account FROM lines) l ON t.tx_id = l.tx_id WHERE status = 'paid' GROUP BY 1""",
    "j9_scalar_lookup_single": """
SELECT l_partkey, n, (SELECT p_name FROM part WHERE p_partkey = l_partkey) AS p_name
FROM (SELECT l_partkey, COUNT(*) AS n FROM lineitem GROUP BY 1) l""",
    "j10_scalar_lookup_first": """
SELECT p_partkey, (SELECT MIN(b.p_name) FROM part b WHERE b.p_brand = a.p_brand) AS first_name FROM part a""",
    "j11_scalar_total": f"""
SELECT l_returnflag, {pct(f'SUM({_CENTS})', f'(SELECT SUM({_CENTS}) FROM lineitem)')} AS share
FROM lineitem GROUP BY 1""",
    "j12_any_row": "SELECT r.*, (SELECT MIN(n_nationkey) FROM nation) AS any_nation FROM region r",
    "j13_case_key_lookup": with_(LINES) + """
SELECT found, COUNT(*) AS n
FROM (SELECT b.branch_norm AS found
      FROM lines l LEFT JOIN (SELECT DISTINCT branch_norm FROM lines WHERE branch_norm <> '') b
        ON b.branch_norm = CASE WHEN l.branch_norm ILIKE '%north%' THEN 'North' WHEN l.branch_norm ILIKE '%south%' THEN 'South'
                                WHEN l.branch_norm ILIKE '%east%' THEN 'East' ELSE l.branch_norm END) x
GROUP BY 1""",
    "j14_anti_join": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "a1_basic_aggregates": with_(TX) + f"""
SELECT status, {money('SUM(fee)')} AS fees, COUNT(*) AS n, COUNT(fee) AS n_fee, {money('MAX(total)')} AS top,
       ROUND({money('SUM(fee)')} / COUNT(fee), 4) AS mean FROM tx GROUP BY 1""",
    "a2_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1",
    "a3_conditional_distincts": """
SELECT l_suppkey, COUNT(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned,
       COUNT(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_orderkey END) AS open FROM lineitem GROUP BY 1""",
    "a4_conditional_aggregates": """
SELECT COUNT(CASE WHEN l_quantity > 25 THEN 1 END) AS big,
       CAST(SUM(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(12,2)) END) AS DOUBLE) AS a_sum,
       MAX(CASE WHEN l_linestatus = 'F' THEN l_partkey END) AS f_max FROM lineitem""",
    "a5_rollup_total": with_(LINES) + f"""
SELECT CASE WHEN GROUPING(account) = 1 THEN 'TOTAL' ELSE account END AS account,
       CAST(GROUPING(account) AS TINYINT) AS is_total, COUNT(*) AS n, {money('SUM(gross)')} AS gross
FROM lines GROUP BY ROLLUP(account)""",
    "a5_rollup_of_nothing": with_(LINES) + f"""
SELECT CASE WHEN GROUPING(account) = 1 THEN 'TOTAL' ELSE account END AS account,
       CAST(GROUPING(account) AS TINYINT) AS is_total, COUNT(*) AS n, {money('SUM(gross)')} AS gross
FROM lines WHERE gross < -10000 GROUP BY ROLLUP(account)""",
    "a6_distinct_rows": "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem",
    "a7_distinct_on": with_(TX) + f"""
SELECT DISTINCT ON (tx_id) tx_id, run_as, {money('fee')} AS fee FROM tx
ORDER BY tx_id, run_as NULLS LAST, tx.fee DESC NULLS LAST""",
    "a8_group_as_dedupe": with_(LINES) + "SELECT tx_id, account AS branch FROM lines GROUP BY 1, 2",
    "a9_two_level": with_(LINES) + """
SELECT items, COUNT(*) AS tickets FROM (SELECT tx_id, COUNT(*) AS items FROM lines WHERE gross > 0 GROUP BY 1) t
GROUP BY 1""",
    "a10_computed_group": _q("tx", "COALESCE(NULLIF(card_last4, ''), 'none') AS card"),
    "a11_global_aggregate": with_(LINES) + f"SELECT COUNT(*) AS n, {money('SUM(gross)')} AS v FROM lines WHERE gross > 0",
    "a12_share_of_total": f"""
SELECT o_orderpriority, {pct('COUNT(*)', '(SELECT COUNT(*) FROM orders)')} AS share FROM orders GROUP BY 1""",
    "w1_rank_in_group": """
SELECT l_suppkey, l_partkey, CAST(v AS DOUBLE) AS v, CAST(rn AS INTEGER) AS rn
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY v DESC, l_partkey) AS rn
      FROM (SELECT l_suppkey, l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS v FROM lineitem GROUP BY 1, 2) a) b
WHERE rn <= 3""",
    "w3_whole_result_window": """
SELECT o_orderstatus, n, MAX(CASE WHEN o_orderstatus = 'O' THEN n END) OVER () AS open_n
FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1) p""",
    "w2_line_numbers": with_(LINES) + """
SELECT tx_id, line_id, row_number() OVER (PARTITION BY tx_id ORDER BY line_id) AS linea_ticket FROM lines""",
    "t7_top_k_per_group": f"SELECT * FROM ({TOP5}) t WHERE ranking <= 2",
    "t1_mixed_sort": "SELECT s_nationkey, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, s_nationkey) AS place FROM supplier GROUP BY 1",
    "t2_desc_nulls_first": with_(LINES) + """
SELECT account, COUNT(*) AS n, row_number() OVER (ORDER BY account DESC NULLS FIRST) AS place FROM lines GROUP BY 1""",
    "t3_asc_nulls_last": with_(LINES) + """
SELECT account, COUNT(*) AS n, row_number() OVER (ORDER BY account NULLS LAST) AS place FROM lines GROUP BY 1""",
    "t4_nulls_last_pick": with_(TX) + "SELECT run_as, row_number() OVER (ORDER BY run_as NULLS LAST) AS place FROM tx GROUP BY 1",
    "t5_top_k": f"SELECT l_partkey, {_DOUBLE_SUM} AS v FROM lineitem GROUP BY 1 ORDER BY v DESC, l_partkey LIMIT 50",
    "t6_limit_whole_key": "SELECT * FROM nation ORDER BY n_name, n_nationkey LIMIT 10",
    "u1_union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "u2_union_all": """
SELECT k, COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) u
GROUP BY 1""",
    "f1_coalesce": _q("lines", "COALESCE(description, tax_type, 'none') AS v"),
    "f2_nullif": f"""
SELECT COUNT(NULLIF(fee, '')) AS fees,
       CAST(SUM(NULLIF(TRY_CAST(fee AS DECIMAL(18,4)), 0)) AS DOUBLE) AS v, COUNT(NULLIF(length(tip), 0)) AS tips
FROM ({TX_RAW}) r""",
    "f3_casts": f"""
SELECT TRY_CAST(created_at AS DATE) AS d, CAST(SUM(CAST(NULLIF(fee, '') AS DECIMAL(18,4))) AS DOUBLE) AS fee,
       CAST(SUM(TRUNC(CAST(total AS DOUBLE))) AS BIGINT) AS whole
FROM ({TX_RAW}) r GROUP BY 1""",
    "f4_round_half_up": f"""
SELECT CAST(SUM(({_CENTS} + 50) // 100) AS DOUBLE) AS whole,
       CAST(SUM(({_CENTS} * 125 + 500) // 1000) AS DOUBLE) / 100 AS eighth FROM lineitem""",
    "f5_arithmetic": f"""
SELECT CAST(SUM({_CENTS} * CAST(l_quantity AS BIGINT) - {_CENTS}) AS DOUBLE) / 100 AS v FROM lineitem""",
    "f6_lower_upper": "SELECT lower(p_type) AS low, upper(p_name) AS up, COUNT(*) AS n FROM part GROUP BY 1, 2",
    "f7_trim": _q("lines", "trim(description) AS t"),
    "f8_initcap": r"""
SELECT c_custkey, array_to_string(list_transform(
         regexp_extract_all(lower(c_name) || '-' || lower(c_mktsegment) || '-o''neil 2x', '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'),
         lambda x: upper(x[1]) || x[2:]), '') AS v FROM customer""",
    "f9_substring": f"SELECT substring(created_at, 1, 10) AS day, COUNT(*) AS n FROM ({TX_RAW}) r GROUP BY 1",
    "f10_left": _q("tx", "left(trim(COALESCE(auth_code, '')), 4) AS v"),
    "f11_day_first_timestamp": with_(LINES) + "SELECT line_id, sold_at FROM lines",
    "f12_iso_timestamp": _q("tx", "created_at AS at"),
    "f13_hour": with_(LINES) + "SELECT CAST(EXTRACT(HOUR FROM sold_at) AS INTEGER) AS h, COUNT(*) AS n FROM lines GROUP BY 1",
    "f14_date_parts": """
SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(EXTRACT(QUARTER FROM o_orderdate) AS INTEGER) AS q,
       CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INTEGER) AS d,
       COUNT(*) AS n FROM orders GROUP BY 1, 2, 3, 4""",
    "f15_day_of_week": "SELECT CAST(EXTRACT(DOW FROM o_orderdate) AS INTEGER) AS dow, COUNT(*) AS n FROM orders GROUP BY 1",
    "f16_date_text": """
SELECT CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day, strftime(o_orderdate, '%Y-%m') AS month, COUNT(*) AS n
FROM orders GROUP BY 1, 2""",
    "f17_padded_names": """
SELECT rpad(strftime(o_orderdate, '%B'), 9, ' ') AS month, rpad(strftime(o_orderdate, '%A'), 9, ' ') AS day, COUNT(*) AS n
FROM orders GROUP BY 1, 2""",
    "f18_date_of_timestamp": "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM events GROUP BY 1",
    "f19_days_since": "SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1996-02-29') AS INTEGER) AS days, COUNT(*) AS n FROM orders GROUP BY 1",
    "f20_weekend": "SELECT EXTRACT(DOW FROM ts) IN (0, 6) AS weekend, COUNT(*) AS n FROM events GROUP BY 1",
    "f21_keyword_category": _q(
        "lines",
        """CASE WHEN lower(description) LIKE '%ring%' OR lower(description) LIKE '%gear%' THEN 'ROUND'
WHEN lower(description) LIKE '%rod%' OR lower(description) LIKE '%bolt%' THEN 'LONG'
WHEN lower(description) LIKE '%anvil%' THEN 'HEAVY' ELSE 'OTROS' END AS product,
CASE WHEN lower(pay_form) LIKE '%card%' THEN 'CARD' WHEN lower(pay_form) LIKE '%cash%' THEN 'CASH'
WHEN lower(pay_form) LIKE '%transfer%' THEN 'TRANSFER' ELSE 'OTRO' END AS form""",
    ),
}

QUERIES = {name: _lazy(name) for name in ORACLE}
