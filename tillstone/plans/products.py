"""Product rankings and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.functions import branch as branches
from tillstone.functions.money import pct_of_count, pct_of_money, per_quantity
from tillstone.functions.text import contains_none, initcap_words
from tillstone.operators import grain
from tillstone.operators.lookup import with_single_row
from tillstone.vocab import Vocabulary


def top_products(lines: DataFrame, vocab: Vocabulary, k: int = 5) -> DataFrame:
    """The ``k`` products with the greatest revenue per branch, ties by name."""
    revenue = (
        grain.sold(lines)
        .filter(contains_none(F.col("description"), (vocab.tip, vocab.manual_amount)))
        .groupBy(
            branches.by_alias(F.col("account"), vocab).alias("sede_unificada"),
            F.col("description").alias("producto"),
        )
        .agg(F.sum("gross").alias("ingresos_producto"))
    )
    best = Window.partitionBy("sede_unificada").orderBy(
        F.desc_nulls_first("ingresos_producto"), F.asc_nulls_last("producto")
    )
    return (
        revenue.withColumn("ranking", F.row_number().over(best))
        .filter(F.col("ranking") <= k)
        .orderBy(F.asc_nulls_last("sede_unificada"), "ranking")
    )


def _ticket_total(lines: DataFrame, tx_id: str, gross: str) -> DataFrame:
    """One row: money and distinct tickets of all given lines."""
    return (
        lines.groupBy(tx_id)
        .agg(F.sum(gross).alias("gross"))
        .agg(F.sum("gross").alias("all_money"), F.count(tx_id).alias("all_tickets"))
    )


def products_share_raw(lines: DataFrame, vocab: Vocabulary, k: int = 50) -> DataFrame:
    """Top products by sales under a normalised name, with shares of money and tickets.
    Totals include manual amounts and exclude tips."""
    description = F.col("description")
    no_tips = grain.sold(lines).filter(contains_none(description, vocab.tip_words))
    # Lower-cased names group exactly like capitalised ones; only the winners are capitalised.
    name = F.when(F.trim(description) == "", F.lit(vocab.unnamed_product.lower())).otherwise(
        F.trim(F.lower(description))
    )
    products = _products(
        no_tips.filter(contains_none(description, (vocab.manual_amount,))),
        {"name": name}, "tx_id", "quantity", "gross",
    )
    top = products.orderBy(F.desc_nulls_first("money"), "name").limit(k)
    shared = with_single_row(top, _ticket_total(no_tips, "tx_id", "gross"))
    return shared.select(
        F.trim(initcap_words(F.col("name"))).alias("producto"),
        F.col("units").alias("unidades_vendidas"),
        F.col("money").alias("ventas_brutas"),
        per_quantity(F.col("money"), F.col("units")).alias("precio_promedio"),
        pct_of_money(F.col("money"), F.col("all_money")).alias("share_ventas_pct"),
        pct_of_count(F.col("tickets"), F.col("all_tickets")).alias("tasa_penetracion_pct"),
    ).orderBy(F.desc_nulls_first("ventas_brutas"), "producto")


def star_products(fact_lines: DataFrame, dim_product: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Positive lines with their product, which is NULL for tips, manual amounts and lines without one."""
    wanted = dim_product.filter(
        contains_none(F.col("descripcion"), (*vocab.tip_words, vocab.manual_amount))
    ).select("producto_sk", F.col("descripcion").alias("producto"), "categoria")
    return fact_lines.filter(F.col("precio_bruto") > 0).join(wanted, "producto_sk", "left")


def products_share_star(
    fact_lines: DataFrame, dim_product: DataFrame, vocab: Vocabulary, k: int = 100
) -> DataFrame:
    """Top products by sales from the star schema. Totals include tips; lines without a
    product key count in the totals only."""
    positive = fact_lines.filter(F.col("precio_bruto") > 0)
    wanted = dim_product.filter(
        contains_none(F.col("descripcion"), (*vocab.tip_words, vocab.manual_amount))
    ).select("producto_sk", "descripcion", "categoria")
    products = _products(
        positive.join(wanted, "producto_sk"),
        {"name": F.col("descripcion"), "categoria": F.col("categoria")},
        "id_transaccion", "cantidad", "precio_bruto",
    )
    top = products.orderBy(F.desc_nulls_first("money"), "name").limit(k)
    shared = with_single_row(top, _ticket_total(positive, "id_transaccion", "precio_bruto"))
    units, money, tickets = F.col("units"), F.col("money"), F.col("tickets")
    all_money, all_tickets = F.col("all_money"), F.col("all_tickets")
    return shared.select(
        F.col("name").alias("producto"),
        "categoria",
        units.alias("unidades_vendidas"),
        money.alias("ventas_brutas"),
        _or_zero_pct(per_quantity(money, units, 2), units).alias("precio_promedio_unitario"),
        _or_zero_pct(pct_of_money(money, all_money), all_money).alias("share_ventas_pct"),
        _or_zero_pct(pct_of_count(tickets, all_tickets), all_tickets).alias("tasa_penetracion_pct"),
        tickets.alias("tickets_unicos"),
    ).orderBy(F.desc_nulls_first("ventas_brutas"), "producto")


def _or_zero_pct(value: Column, whole: Column) -> Column:
    return F.when(whole > 0, value).otherwise(F.lit(0))


def _products(
    lines: DataFrame, keys: dict[str, Column], tx_id: str, quantity: str, gross: str
) -> DataFrame:
    """Units, money and distinct tickets per product: first per (product, ticket), then
    per product, so a best-seller is never counted in one task."""
    baskets = lines.groupBy(*[c.alias(n) for n, c in keys.items()], tx_id).agg(
        F.sum(quantity).alias("units"), F.sum(gross).alias("money")
    )
    return baskets.groupBy(*keys).agg(
        F.sum("units").alias("units"), F.sum("money").alias("money"), F.count(tx_id).alias("tickets")
    )
