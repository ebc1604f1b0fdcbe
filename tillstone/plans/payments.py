"""Payment-media mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.functions.money import or_zero, pct_of_count, pct_of_money
from tillstone.functions.text import contains_none
from tillstone.operators import grain
from tillstone.operators.cleanse import present
from tillstone.vocab import Vocabulary


def one_payment_per_ticket(tx: DataFrame) -> DataFrame:
    """(tx_id, run_as, fee): the row with the smallest non-NULL ``run_as``, the greatest
    fee among equals. A minimum over a struct, so it is partially aggregated map-side."""
    order = F.struct(
        F.col("run_as").isNull().alias("run_as_missing"),
        "run_as",
        F.col("fee").isNull().alias("fee_missing"),
        (-F.col("fee")).alias("minus_fee"),
        "fee",
    )
    return tx.groupBy("tx_id").agg(F.min(order).alias("p")).select("tx_id", "p.run_as", "p.fee")


def payment_mix_raw(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Debit, credit and cash with shares of the total; an empty denominator gives NULL."""
    payments = one_payment_per_ticket(grain.settled(tx, vocab))
    tickets = _ticket_sales(lines, contains_none(F.col("description"), vocab.tip_words))
    run_as = F.col("run_as")
    media = _media(run_as == vocab.debit_words[0], run_as == vocab.credit_words[0], vocab)
    return _mix(tickets.join(payments, "tx_id"), media, vocab)


def _view_tickets(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> tuple[DataFrame, Column]:
    payments = one_payment_per_ticket(present(grain.settled_any_case(tx, vocab), "tx_id"))
    described = F.coalesce("description", F.lit(""))
    tickets = _ticket_sales(lines, contains_none(described, vocab.tip_words))
    run_as = F.upper(F.coalesce("run_as", F.lit("")))
    media = _media(run_as.isin(*vocab.debit_words), run_as.isin(*vocab.credit_words), vocab)
    return tickets.join(payments, "tx_id"), media


def media_tickets(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(tx_id, medio_de_pago, gross, fee): one row per paid ticket, as the view counts them."""
    tickets, media = _view_tickets(tx, lines, vocab)
    return tickets.select("tx_id", media.alias("medio_de_pago"), "gross", or_zero(F.col("fee")).alias("fee"))


def payment_mix_view(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Same with any-case status, all card spellings, blank keys removed, lines without a
    description kept, and 0 for an empty denominator."""
    mix = _mix(*_view_tickets(tx, lines, vocab), vocab)
    rates = (
        "participacion_transacciones_pct", "ventas_totales", "participacion_ventas_pct", "comision_total",
        "tasa_comision_pct",
    )
    return mix.withColumns({c: F.coalesce(c, F.lit(0).cast(mix.schema[c].dataType)) for c in rates})


def _ticket_sales(lines: DataFrame, keep: Column) -> DataFrame:
    return grain.sold(lines).filter(keep).groupBy("tx_id").agg(F.sum("gross").alias("gross"))


def _media(is_debit: Column, is_credit: Column, vocab: Vocabulary) -> Column:
    return (
        F.when(is_debit, F.lit(vocab.debit)).when(is_credit, F.lit(vocab.credit)).otherwise(F.lit(vocab.cash))
    )


def _mix(tickets: DataFrame, media: Column, vocab: Vocabulary) -> DataFrame:
    parts = tickets.groupBy(media.alias("medio_de_pago")).agg(
        F.count("*").alias("n"), F.sum("gross").alias("gross"), F.sum(or_zero(F.col("fee"))).alias("fee")
    )
    rolled = grain.total_row(
        parts, "medio_de_pago", vocab.general_total, {"n": "n", "gross": "gross", "fee": "fee"}, counts=("n",)
    )
    # At most four rows reach this window: three media and the total.
    everything = Window.partitionBy()

    def total(column: str) -> Column:
        return F.max(F.when(F.col("is_total") == 1, F.col(column))).over(everything)

    shaped = rolled.select(
        "is_total",
        "medio_de_pago",
        F.col("n").alias("total_transacciones"),
        pct_of_count(F.col("n"), total("n")).alias("participacion_transacciones_pct"),
        F.col("gross").alias("ventas_totales"),
        pct_of_money(F.col("gross"), total("gross")).alias("participacion_ventas_pct"),
        F.col("fee").alias("comision_total"),
        pct_of_money(F.col("fee"), F.col("gross")).alias("tasa_comision_pct"),
    )
    return shaped.orderBy(
        "is_total", F.desc_nulls_first("ventas_totales"), "medio_de_pago"
    ).drop("is_total")
