"""What must hold of the physical plans, and results under a hot ticket."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.base import clean_tables, stored_star
from tests.shopdata import rows
from tillstone.operators.cleanse import LINE_MONEY
from tillstone.plans import hours, loyalty, payments, products, sales
from tillstone.sources.testshop import VOCABULARY as V

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(df):
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan(df))


@pytest.mark.parametrize("name", [n for n in entry.queries() if n[0] in "qr"])
def test_no_python_and_no_cartesian(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "EvalPython" not in text
    assert "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark):
    lines, tx = clean_tables(spark, SF)
    text = plan(sales.overview_tickets(tx, lines, V))
    assert "GreaterThan(gross,0.0000)" in text
    assert "In(status, [paid,successful])" in text
    read = "".join(schemas(sales.overview_tickets(tx, lines, V)))
    assert not any(f"{c}:" in read for c in set(LINE_MONEY) - {"gross", "net"})
    assert "account_email" not in read


def test_top_k_is_limited_before_the_shuffle(spark):
    lines, _ = clean_tables(spark, SF)
    assert "WindowGroupLimit" in plan(products.top_products(lines, V))
    assert "TakeOrderedAndProject" in plan(products.products_share_raw(lines, V))


def test_no_distinct_expansion_of_the_lines(spark):
    lines, tx = clean_tables(spark, SF)
    assert "Expand" not in plan(hours.peak_hours_view(lines, V))
    assert "Expand" not in plan(loyalty.loyalty_raw(tx, lines, V))


def test_facts_are_partitioned_by_month(spark):
    facts = stored_star(spark, SF).fact_lines
    one = facts.filter(F.col("mes_key") == 199801)
    assert "PartitionFilters: [isnotnull(mes_key" in plan(one)
    assert one.count() == facts.filter("fecha_key div 100 = 199801").count() > 0


def test_hot_ticket_gives_the_same_sums(spark):
    """A third of all lines under one ticket id, with the skew handling forced on."""
    lines, tx = clean_tables(spark, SF)
    hot = lines.withColumn(
        "tx_id", F.when(F.pmod(F.hash("line_id"), F.lit(3)) == 0, F.lit("1")).otherwise(F.col("tx_id"))
    )
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    }
    before = {k: spark.conf.get(k) for k in settings}

    def results():
        return [
            sorted(rows(df), key=str)
            for df in (
                sales.overview_tickets(tx, hot, V), sales.sales_by_branch(tx, hot, V), sales.tips_raw(tx, hot, V),
                payments.payment_mix_raw(tx, hot, V), hours.hourly_sales(tx, hot, V), loyalty.loyalty_raw(tx, hot, V),
            )
        ]

    usual = results()
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert results() == usual
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
