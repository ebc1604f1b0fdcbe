"""Returning cards per branch and month.

A month has at most 31 days, so the days a card was seen are the bits of one integer:
``bit_or`` collects them with partial aggregation in one shuffle, where a distinct count
would need two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.functions import branch as branches
from tillstone.functions.dates import month_key, month_text
from tillstone.functions.money import pct_of_count
from tillstone.operators import grain
from tillstone.operators.cleanse import present
from tillstone.vocab import Vocabulary


def monthly_cards(visits: DataFrame) -> DataFrame:
    """(branch, month, card_last4, days): on how many days of the month each card was seen."""
    day_bit = F.expr("shiftleft(1L, dayofmonth(created_at) - 1)")
    return visits.groupBy("branch", month_key(F.col("created_at")).alias("month"), "card_last4").agg(
        F.coalesce(F.bit_count(F.bit_or(day_bit)), F.lit(0)).alias("days")
    )


def _monthly(visits: DataFrame) -> DataFrame:
    """(branch, card, created_at) visits to the monthly loyalty buckets."""
    cards = monthly_cards(visits)

    def holders(condition: Column) -> Column:
        return F.count(F.when(condition, F.col("card_last4")))

    days = F.col("days")
    months = cards.groupBy("branch", "month").agg(
        holders(days == 1).alias("clientes_un_solo_dia"),
        holders(days == 2).alias("clientes_recurrentes_2_veces"),
        holders(days > 2).alias("clientes_fans_3_o_mas"),
        holders(days >= 2).alias("again"),
        F.count("card_last4").alias("all_cards"),
    )
    return months.select(
        F.col("branch").alias("nombre_sede"),
        month_text(F.col("month")).alias("mes_operacion"),
        "clientes_un_solo_dia",
        "clientes_recurrentes_2_veces",
        "clientes_fans_3_o_mas",
        pct_of_count(F.col("again"), F.col("all_cards")).alias("tasa_fidelidad_mes_pct"),
    ).orderBy(F.desc_nulls_first("mes_operacion"), F.asc_nulls_last("nombre_sede"))


def loyalty_raw(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Loyalty by the accounts on the ticket's lines."""
    visits = (
        grain.settled(tx, vocab, with_paid=False)
        .filter(F.col("card_last4").isNotNull())
        .select("tx_id", "card_last4", F.to_date("created_at").alias("created_at"))
        .distinct()
    )
    where = grain.per_ticket_branch(lines, branches.by_alias(F.col("account"), vocab))
    return _monthly(visits.join(where, "tx_id"))


def placed_visits(tx: DataFrame, lines: DataFrame, dim_branch: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(branch, card_last4, created_at): visits by the payment's e-mail, else by the branch dimension through the lines."""
    visits = (
        present(grain.settled_any_case(tx, vocab, with_paid=False), "card_last4", "created_at")
        .select("tx_id", "account_email", "card_last4", F.to_date("created_at").alias("created_at"))
        .distinct()
    )
    named = (
        grain.per_ticket_branch(lines, F.col("branch_norm"))
        .join(dim_branch.select(F.col("nombre_sede").alias("branch"), "nombre_sede"), "branch", "left")
        .select("tx_id", "nombre_sede")
    )
    return visits.join(named, "tx_id", "left").select(
        branches.by_email_or(F.col("account_email"), F.col("nombre_sede"), vocab).alias("branch"),
        "card_last4",
        "created_at",
    )


def loyalty_view(
    tx: DataFrame, lines: DataFrame, dim_branch: DataFrame, vocab: Vocabulary
) -> DataFrame:
    """Loyalty by the payment's e-mail, else by the branch dimension through the lines."""
    return _monthly(placed_visits(tx, lines, dim_branch, vocab))


def newest(loyalty: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest rows, as the dashboard reads them."""
    return loyalty.orderBy(
        F.desc_nulls_first("mes_operacion"), F.asc_nulls_last("nombre_sede")
    ).limit(n)
