"""Tickets and sales by hour and day.

Distinct-ticket counts per branch do not use one distinct aggregate per branch. Lines are
reduced to one row per (time slot, ticket) carrying a flag per branch, after which the
counts are plain sums.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.functions import branch as branches
from tillstone.functions.dates import iso_date, weekday_name
from tillstone.functions.money import or_zero
from tillstone.functions.text import contains_none
from tillstone.operators import grain
from tillstone.operators.cleanse import present
from tillstone.vocab import Branch, Vocabulary


def _ticket_counts(
    lines: DataFrame, slot: Mapping[str, Column], flags: Mapping[str, Column], total: str | None = None
) -> DataFrame:
    """Distinct tickets per slot, one column per flag and optionally one for all."""
    tickets = slot_tickets(lines, slot, flags)
    has_id = F.col("tx_id").isNotNull()
    counts = [F.count(F.when(has_id & (F.col(n) == 1), 1)).alias(n) for n in flags]
    if total:
        counts.append(F.count("tx_id").alias(total))
    return tickets.groupBy(*slot).agg(*counts)


def slot_tickets(lines: DataFrame, slot: Mapping[str, Column], flags: Mapping[str, Column]) -> DataFrame:
    """One row per slot and ticket with its flags as 0 or 1."""
    return lines.groupBy(*[c.alias(n) for n, c in slot.items()], "tx_id").agg(
        *[F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()]
    )


def _flags(
    chosen: Sequence[Branch], column: str, test: Callable[[Column, Branch], Column], prefix: str
) -> dict[str, Column]:
    return {prefix + b.slug: test(F.col(column), b) for b in chosen}


def peak_hours_raw(lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct tickets per hour and counter branch; day-first dates only."""
    kept = lines.filter(
        contains_none(F.col("description"), (vocab.tip, vocab.manual_amount)) & F.col("sold_day_first")
        & F.col("sold_at").isNotNull()
    )
    flags = _flags(vocab.counter_branches, "account", branches.is_alias_of, "sede_")
    return _ticket_counts(kept, {"hora_del_dia": F.hour("sold_at")}, flags).orderBy("hora_del_dia")


def peak_lines(lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Dated lines with a positive gross that are neither tips nor manual amounts."""
    return grain.sold(lines).filter(
        contains_none(F.col("description"), (vocab.tip, vocab.manual_amount)) & F.col("sold_at").isNotNull()
    )


def peak_hours_view(lines: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Distinct tickets per hour, every branch and in total, of lines with a positive gross."""
    flags = _flags(vocab.branches, "branch_norm", branches.is_narrow_match, "sede_")
    return _ticket_counts(
        peak_lines(lines, vocab), {"hora_del_dia": F.hour("sold_at")}, flags, total="total_transacciones"
    ).orderBy("hora_del_dia")


def _busy(lines: DataFrame, vocab: Vocabulary, drop_blank_keys: bool) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    kept = lines.filter(
        contains_none(F.col("description"), (vocab.tip, vocab.manual_amount)) & F.col("sold_day_first")
        & F.col("sold_at").isNotNull()
    )
    if drop_blank_keys:
        kept = present(kept, "tx_id")
    flags = _flags(vocab.counter_branches, "account", branches.is_alias_of, "")
    slot = {"dia": F.to_date("sold_at"), "hora_del_dia": F.hour("sold_at")}
    return kept, slot, flags


def busy_tickets(lines: DataFrame, vocab: Vocabulary, drop_blank_keys: bool = False) -> DataFrame:
    """One row per date, hour and ticket, with a 0 or 1 for each counter branch."""
    tickets = slot_tickets(*_busy(lines, vocab, drop_blank_keys))
    return tickets.withColumn("dia_semana", weekday_name(F.col("dia"), vocab.weekdays))


def busy_hours(lines: DataFrame, vocab: Vocabulary, drop_blank_keys: bool = False) -> DataFrame:
    """Distinct tickets per date, weekday and hour. ``drop_blank_keys`` is the view variant."""
    kept, slot, flags = _busy(lines, vocab, drop_blank_keys)
    counts = _ticket_counts(kept, slot, flags)
    return counts.select(
        "dia", weekday_name(F.col("dia"), vocab.weekdays).alias("dia_semana"), "hora_del_dia", *flags
    ).orderBy("dia", "hora_del_dia")


def dates_to_iso(df: DataFrame, column: str = "dia") -> DataFrame:
    """Date column as ISO text."""
    return df.withColumn(column, iso_date(F.col(column)))


def hourly_payments(tx: DataFrame, lines: DataFrame, vocab: Vocabulary, text_amounts: bool = False) -> DataFrame:
    """(tx_id, sede, hora, total, fee): different payments by branch and hour of payment."""
    paid = grain.settled(tx, vocab, with_paid=False).filter(F.col("created_at").isNotNull())
    account = F.col("account")
    if text_amounts:
        paid = paid.withColumns({"total": or_zero(F.col("total")), "fee": or_zero(F.col("fee"))})
        lines = present(lines, "tx_id")
        sede = branches.by_alias_trimmed(account, vocab, blank_for_null=True)
    else:
        sede = branches.by_alias_trimmed(account, vocab)
    payments = paid.select("tx_id", "total", "fee", F.hour("created_at").alias("hora")).distinct()
    where = grain.per_ticket_branch(lines, sede).withColumnRenamed("branch", "sede")
    return payments.join(where, "tx_id")


def hourly_sales(
    tx: DataFrame, lines: DataFrame, vocab: Vocabulary, text_amounts: bool = False
) -> DataFrame:
    """Payments and their totals per branch and hour of payment.

    ``text_amounts`` is the view variant: missing amounts count as zero, blank keys and
    dates are dropped and a missing account is a blank branch.
    """
    return (
        hourly_payments(tx, lines, vocab, text_amounts)
        .groupBy("sede", "hora")
        .agg(F.count("*").alias("transacciones"), F.sum("total").alias("ventas_brutas"))
        .orderBy(F.asc_nulls_last("sede"), F.asc_nulls_last("hora"))
    )
