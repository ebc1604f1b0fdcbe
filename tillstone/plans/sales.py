"""Branch overview, sales by branch, tips and basket behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.functions import branch as branches
from tillstone.functions.money import or_zero, pct_of_count, per_unit
from tillstone.functions.text import contains_none
from tillstone.operators import grain
from tillstone.operators.cleanse import present
from tillstone.operators.lookup import keep_known
from tillstone.vocab import Vocabulary

_OVERVIEW = (
    "cuenta", "transacciones", "venta_bruta", "comisiones_sumup", "liquido_a_recibir",
    "ticket_promedio", "margen_operativo_real",
)


def _total_last(df: DataFrame, value: str, key: str) -> DataFrame:
    return df.orderBy("is_total", F.desc_nulls_first(value), F.asc_nulls_last(key))


def overview_tickets(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Branch KPIs from raw data: one fee and one branch (the greatest) per ticket."""
    fees = grain.settled(tx, vocab).groupBy("tx_id").agg(F.max("fee").alias("fee"))
    tickets = (
        grain.sold(lines)
        .filter(contains_none(F.col("description"), vocab.tip_words))
        .groupBy("tx_id")
        .agg(
            F.max(branches.by_account_pattern(F.col("account"), vocab, vocab.unknown_branch)).alias("cuenta"),
            F.sum("gross").alias("gross"),
            F.sum("net").alias("net"),
        )
    )
    parts = tickets.join(fees, "tx_id").groupBy("cuenta").agg(
        F.count("*").alias("n"),
        F.sum("gross").alias("gross"),
        F.sum("net").alias("net"),
        F.sum("fee").alias("fee"),
    )
    rolled = grain.total_row(
        parts, "cuenta", vocab.overview_total,
        {"n": "n", "gross": "gross", "net": "net", "fee": "fee"}, counts=("n",),
    )
    return _overview_columns(rolled, F.col("fee"))


def star_tickets(fact_lines: DataFrame, dim_branch: DataFrame, fact_tx: DataFrame) -> DataFrame:
    """(id_transaccion, sede_sk, nombre_sede, line_n, gross, net, comision): one row per ticket and branch."""
    reduced = fact_lines.groupBy("id_transaccion", "sede_sk").agg(
        F.count("*").alias("line_n"),
        F.sum("precio_bruto").alias("gross"),
        F.sum("precio_neto").alias("net"),
    )
    named = reduced.join(dim_branch.select("sede_sk", "nombre_sede"), "sede_sk")
    return named.join(fact_tx.select("id_transaccion", "comision"), "id_transaccion", "left")


def overview_star(
    fact_lines: DataFrame, dim_branch: DataFrame, fact_tx: DataFrame, vocab: Vocabulary
) -> DataFrame:
    """Branch KPIs from the star schema.

    The fee is summed at line grain, so it counts once per line of the ticket and not
    once per ticket as in ``overview_tickets``. Lines are reduced to (ticket, branch)
    first and the fee multiplied by their number, which gives the same sum.
    """
    priced = star_tickets(fact_lines, dim_branch, fact_tx)
    flagged = grain.first_branch_flag(
        priced.withColumnRenamed("id_transaccion", "tx_id"), branch="sede_sk"
    )
    has_id = F.col("tx_id").isNotNull()
    parts = flagged.groupBy(F.col("nombre_sede").alias("cuenta")).agg(
        F.count(F.when(has_id, 1)).alias("n"),
        F.sum(F.when(has_id, F.col("lead"))).alias("n_total"),
        F.sum("gross").alias("gross"),
        F.sum("net").alias("net"),
        F.sum(F.col("comision") * F.col("line_n").cast("decimal(18,0)")).cast("decimal(28,2)").alias("fee"),
    )
    rolled = grain.total_row(
        parts, "cuenta", vocab.overview_total,
        {"n": "n|n_total", "gross": "gross", "net": "net", "fee": "fee"}, counts=("n",),
    )
    return _overview_columns(rolled, or_zero(F.col("fee"), "decimal(28,2)"))


def _overview_columns(rolled: DataFrame, fee: Column) -> DataFrame:
    shaped = rolled.select(
        "is_total",
        "cuenta",
        F.col("n").alias("transacciones"),
        F.col("gross").alias("venta_bruta"),
        fee.alias("comisiones_sumup"),
        (F.col("gross") - fee).alias("liquido_a_recibir"),
        per_unit(F.col("gross"), F.col("n")).alias("ticket_promedio"),
        (F.col("net") - fee).alias("margen_operativo_real"),
    )
    return _total_last(shaped, "venta_bruta", "cuenta").select(*_OVERVIEW)


def sales_by_branch(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Sales and tickets per branch of settled payments. Tip names are excluded only
    when they are the whole description."""
    description = F.lower("description")
    reduced = grain.per_ticket_branch(
        grain.sold(lines).filter(~description.isin(*[w.lower() for w in vocab.tip_words])),
        branches.by_account_pattern(F.col("account"), vocab, vocab.unknown_sales_branch),
        F.sum("gross").alias("gross"),
    )
    known = keep_known(reduced, grain.settled(tx, vocab), "tx_id")
    parts = grain.first_branch_flag(known).groupBy(F.col("branch").alias("cuenta")).agg(
        F.count("*").alias("n"), F.sum("lead").alias("n_total"), F.sum("gross").alias("gross")
    )
    rolled = grain.total_row(
        parts, "cuenta", vocab.general_total, {"n": "n|n_total", "gross": "gross"}, counts=("n",)
    )
    shaped = rolled.select(
        "is_total",
        "cuenta",
        F.col("gross").alias("ventas_totales"),
        F.col("n").alias("transacciones"),
        per_unit(F.col("gross"), F.col("n")).alias("ticket_promedio"),
    )
    return _total_last(shaped, "ventas_totales", "cuenta").drop("is_total")


def _tip_columns(parts: DataFrame, tips: Column) -> DataFrame:
    return parts.select(
        "sede_unificada",
        F.col("n").alias("transacciones_totales"),
        F.col("n_tip").alias("transacciones_con_propina"),
        pct_of_count(F.col("n_tip"), F.col("n")).alias("tasa_conversion_propina_pct"),
        tips.alias("propinas_totales"),
        per_unit(tips, F.col("n_tip")).alias("propina_promedio"),
    ).orderBy(F.desc_nulls_first("tasa_conversion_propina_pct"), F.asc_nulls_last("sede_unificada"))


def tips_raw(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Tips per branch; a ticket's tips are summed first and count in each of its branches."""
    is_tip = F.lower("description") == vocab.tip
    reduced = grain.per_ticket_branch(
        lines,
        branches.by_alias(F.col("account"), vocab),
        F.sum(F.when(is_tip, F.col("net"))).alias("branch_tip"),
        F.count(F.when(is_tip, 1)).alias("branch_tip_n"),
    )
    known = keep_known(reduced, grain.settled(tx, vocab, with_paid=False), "tx_id")
    ticket = Window.partitionBy("tx_id")
    whole = known.select(
        "branch",
        F.sum("branch_tip").over(ticket).alias("tip"),
        F.sum("branch_tip_n").over(ticket).alias("tip_n"),
    )
    parts = whole.groupBy(F.col("branch").alias("sede_unificada")).agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("tip_n") > 0, 1)).alias("n_tip"),
        F.sum("tip").alias("tips"),
    )
    return _tip_columns(parts, F.col("tips"))


def tip_tickets(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(tx_id, sede_unificada, tip, tip_n): one row per paid ticket and branch."""
    norm = F.col("branch_norm")
    tips = grain.per_ticket_branch(
        present(lines, "tx_id").filter(F.lower(F.trim("description")) == vocab.tip),
        branches.by_broad_pattern(norm, vocab, F.coalesce(norm, F.lit(vocab.unknown_branch))),
        F.sum(or_zero(F.col("net"))).alias("tip"),
    ).withColumnRenamed("branch", "tip_branch")
    paid = (
        present(grain.settled_any_case(tx, vocab, with_paid=False), "tx_id")
        .select("tx_id", branches.by_email(F.col("account_email"), vocab).alias("email_branch"))
        .distinct()
    )
    return (
        paid.join(tips, "tx_id", "left")
        .groupBy("tx_id", F.coalesce("tip_branch", "email_branch").alias("sede_unificada"))
        .agg(F.sum("tip").alias("tip"), F.count("tip_branch").alias("tip_n"))
    )


def tips_view(tx: DataFrame, lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Tips per branch, the branch taken from the tip line, else from the payment's
    e-mail. A ticket paid under two e-mails counts its tips under both."""
    per_ticket = tip_tickets(tx, lines, vocab)
    parts = per_ticket.groupBy("sede_unificada").agg(
        F.count("*").alias("n"),
        F.count(F.when(F.col("tip_n") > 0, 1)).alias("n_tip"),
        F.sum("tip").alias("tips"),
    )
    return _tip_columns(parts, or_zero(F.col("tips"), "decimal(28,4)"))


def basket_tickets(tx: DataFrame, lines: DataFrame, vocab: Vocabulary, keep_unnamed: bool = False) -> DataFrame:
    """(sede_unificada, items, amount): one row per successfully paid ticket and branch."""
    description = F.col("description")
    name = F.lower(F.coalesce(description, F.lit("")) if keep_unnamed else description)
    reduced = grain.per_ticket_branch(
        grain.sold(lines).filter(~name.isin(vocab.tip, vocab.manual_amount)),
        branches.by_alias(F.col("account"), vocab),
        F.count("*").alias("line_n"),
        F.sum("gross").alias("gross"),
    )
    payments = (
        grain.settled(tx, vocab, with_paid=False).groupBy("tx_id").agg(F.count("*").alias("pay_n"))
    )
    pay_n = F.col("pay_n")
    return reduced.join(payments, "tx_id").select(
        F.col("branch").alias("sede_unificada"),
        (F.col("line_n") * pay_n).alias("items"),
        # A count has up to 19 digits; the product keeps the four decimals.
        (F.col("gross") * pay_n.cast("decimal(19,0)")).cast("decimal(38,4)").alias("amount"),
    )


def purchase_behavior(
    tx: DataFrame, lines: DataFrame, vocab: Vocabulary, keep_unnamed: bool = False
) -> DataFrame:
    """Single-item against multi-item tickets per branch.

    Lines are joined to every successful payment row, so a ticket paid in two rows counts
    each of its items twice; the number of payment rows enters as a factor.
    ``keep_unnamed`` keeps lines without a description (the view variant).
    """
    tickets = basket_tickets(tx, lines, vocab, keep_unnamed)
    alone, together = F.col("items") == 1, F.col("items") > 1
    parts = tickets.groupBy("sede_unificada").agg(
        F.count("*").alias("n"),
        F.count(F.when(alone, 1)).alias("n_alone"),
        F.count(F.when(together, 1)).alias("n_together"),
        F.sum(F.when(alone, F.col("amount"))).alias("alone"),
        F.sum(F.when(together, F.col("amount"))).alias("together"),
    )
    return parts.select(
        "sede_unificada",
        F.col("n_alone").alias("ventas_solitarias"),
        F.col("n_together").alias("ventas_con_acompanamiento"),
        pct_of_count(F.col("n_together"), F.col("n")).alias("tasa_de_sugestion_exito_pct"),
        per_unit(F.col("alone"), F.col("n_alone")).alias("ticket_promedio_solo"),
        per_unit(F.col("together"), F.col("n_together")).alias("ticket_promedio_acompanado"),
    )
