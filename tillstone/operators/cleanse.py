"""Raw exports to typed canonical tables.

One pass, no shuffle. Store the result: filters on parsed columns reach the Parquet
scan only when the parsed columns are what is stored.

Text columns keep their blanks, because some queries tell a blank from a NULL. Missing
amounts become NULL; queries that count them as zero say so themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillstone.functions import dates
from tillstone.functions.money import MONEY, to_money

LINE_TEXT = ("tx_id", "account", "branch_norm", "description", "tax_type", "pay_form", "device_serial")
LINE_MONEY = ("quantity", "unit_price", "gross", "net", "vat")
TX_TEXT = (
    "tx_id", "status", "run_as", "account_email", "card_last4", "card_type", "capture_mode",
    "auth_code", "tx_type", "pay_method", "reference",
)
TX_MONEY = ("fee", "total", "subtotal", "tax", "tip", "deposits")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _is_text(df: DataFrame, name: str) -> bool:
    return name not in df.columns or isinstance(df.schema[name].dataType, T.StringType)


def _money(df: DataFrame, name: str) -> Column:
    col = _column(df, name)
    return (to_money(col) if _is_text(df, name) else col.cast(MONEY)).alias(name)


def cleanse_lines(raw: DataFrame) -> DataFrame:
    """Line items: typed amounts, ``sold_at`` parsed from either date spelling and
    ``sold_day_first`` telling whether the text had the day-first spelling."""
    if _is_text(raw, "sold_at"):
        text = _column(raw, "sold_at")
        sold_at, day_first = dates.parse_sold_at(text), dates.is_day_first(text)
    else:
        sold_at = F.col("sold_at").cast("timestamp_ntz")
        day_first = F.col("sold_at").isNotNull()
    return raw.select(
        _column(raw, "line_id").cast("bigint").alias("line_id"),
        *[_column(raw, c).cast("string").alias(c) for c in LINE_TEXT],
        sold_at.alias("sold_at"),
        day_first.alias("sold_day_first"),
        *[_money(raw, c) for c in LINE_MONEY],
    )


def cleanse_tx(raw: DataFrame) -> DataFrame:
    """Payments: typed amounts and ``created_at`` from ISO text."""
    if _is_text(raw, "created_at"):
        created_at = dates.parse_iso(_column(raw, "created_at"))
    else:
        created_at = F.col("created_at").cast("timestamp_ntz")
    return raw.select(
        *[_column(raw, c).cast("string").alias(c) for c in TX_TEXT],
        created_at.alias("created_at"),
        *[_money(raw, c) for c in TX_MONEY],
    )


def present(df: DataFrame, *names: str) -> DataFrame:
    """Drop rows where a named column is NULL or blank text."""
    for name in names:
        df = df.filter(F.col(name).isNotNull())
        if isinstance(df.schema[name].dataType, T.StringType):
            df = df.filter(F.col(name) != "")
    return df
