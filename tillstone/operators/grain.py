"""Grain changes: line to ticket, ticket to branch, branch to total.

Lines are always reduced to (ticket, branch) rows, with map-side partial aggregation,
before they meet the payments. A ticket id that holds a large share of all lines is then
a handful of rows per map task, and no join or window sees it at line grain.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.vocab import Vocabulary


def sold(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("gross") > 0)


def settled(tx: DataFrame, vocab: Vocabulary, with_paid: bool = True) -> DataFrame:
    """Payments whose status is exactly success (or paid)."""
    words = (vocab.success, vocab.paid) if with_paid else (vocab.success,)
    return tx.filter(F.col("status").isin(*words))


def settled_any_case(tx: DataFrame, vocab: Vocabulary, with_paid: bool = True) -> DataFrame:
    words = (vocab.success, vocab.paid) if with_paid else (vocab.success,)
    return tx.filter(F.lower(F.coalesce("status", F.lit(""))).isin(*[w.lower() for w in words]))


def per_ticket_branch(lines: DataFrame, branch: Column, *aggs: Column) -> DataFrame:
    """One row per (tx_id, branch). Without aggregates this is the distinct mapping."""
    keyed = lines.groupBy("tx_id", branch.alias("branch"))
    return keyed.agg(*aggs) if aggs else lines.select("tx_id", branch.alias("branch")).distinct()


def first_branch_flag(ticket_branch: DataFrame, branch: str = "branch") -> DataFrame:
    """Mark one row per ticket with ``lead`` = 1, so that summing it counts tickets once
    across branches. Input is (tx_id, branch) grain: a ticket has at most one row per
    branch, and the window reuses the partitioning of a preceding join on tx_id."""
    first = F.min(branch).over(Window.partitionBy("tx_id"))
    return ticket_branch.withColumn("lead", (F.col(branch) == first).cast("int"))


def total_row(
    parts: DataFrame, key: str, label: str, sums: Mapping[str, str], counts: Sequence[str] = ()
) -> DataFrame:
    """Sum partial sums up to one row per key plus a labelled total.

    ``parts`` already holds one row per key, so the total adds up a small table, not the
    data. ``sums`` maps an output column to the partial column summed for the key rows;
    write ``a|b`` to sum ``b`` on the total row instead. ``is_total`` flags the total.
    The total is a global aggregate: it is there when ``parts`` has no rows, with 0 in the
    columns named in ``counts``.
    """
    by_key, in_total = [], []
    for out, spec in sums.items():
        own, _, whole = spec.partition("|")
        total = F.sum(whole or own)
        by_key.append(F.sum(own).alias(out))
        in_total.append((F.coalesce(total, F.lit(0)) if out in counts else total).alias(out))
    rows = parts.groupBy(key).agg(F.lit(0).cast("tinyint").alias("is_total"), *by_key)
    total = parts.agg(F.lit(1).cast("tinyint").alias("is_total"), *in_total)
    return rows.unionByName(total.withColumn(key, F.lit(label)))
