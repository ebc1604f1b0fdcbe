"""Amounts: text to decimal, and exact rounded ratios.

Everything stays decimal. Ratios multiply before dividing and use operand types narrow
enough for Spark to keep at least 12 fractional digits in the quotient, so HALF_UP
rounding sees the true value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"
_SUM = "decimal(22,4)"
_COUNT = "decimal(20,0)"


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def to_money(text: Column, type_: str = MONEY) -> Column:
    """Text amount to decimal; blank, NULL and unreadable text give NULL."""
    return blank_to_null(text).try_cast(type_)


def or_zero(col: Column, type_: str = MONEY) -> Column:
    return F.coalesce(col, F.lit(0).cast(type_))


def no_zero(col: Column) -> Column:
    return F.nullif(col, F.lit(0).cast(_COUNT))


def pct_of_count(part: Column, whole: Column, places: int = 2) -> Column:
    """``part / whole * 100`` of two counts; NULL where the whole is zero."""
    hundredfold = part.cast(_COUNT) * F.lit(100)
    return F.round(hundredfold / no_zero(whole.cast(_COUNT)), places)


def pct_of_money(part: Column, whole: Column, places: int = 2) -> Column:
    hundredfold = part.cast(_SUM) * F.lit(100)
    return F.round(hundredfold / F.nullif(whole.cast(_SUM), F.lit(0).cast(_SUM)), places)


def per_unit(total: Column, units: Column, places: int = 0) -> Column:
    """``total / units`` for a count of units; NULL where there are none."""
    return F.round(total.cast(_SUM) / no_zero(units.cast(_COUNT)), places)


def per_quantity(total: Column, quantity: Column, places: int = 0) -> Column:
    """``total / quantity`` for a decimal quantity; NULL where it is zero."""
    return F.round(total.cast(_SUM) / F.nullif(quantity.cast(_SUM), F.lit(0).cast(_SUM)), places)
