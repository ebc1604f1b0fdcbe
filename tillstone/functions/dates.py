"""Date and time expressions, independent of the session time zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the line export writes "DD-MM-YYYY, HH24:MI", anything may follow.
DAY_FIRST = r"^(\d{2})-(\d{2})-(\d{4}), (\d{2}:\d{2})"


def is_day_first(text: Column) -> Column:
    return F.coalesce(text.rlike(DAY_FIRST), F.lit(False))


def parse_iso(text: Column) -> Column:
    """ISO text to a zone-less timestamp; date-only text gives midnight, bad text NULL.

    Text that carries only a readable date in its first ten characters keeps the date.
    """
    return F.coalesce(
        text.try_cast("timestamp_ntz"),
        F.substring(text, 1, 10).try_cast("timestamp_ntz"),
    )


def parse_sold_at(text: Column) -> Column:
    """Line date in either spelling to a zone-less timestamp, NULL if unreadable.

    Day-first text is rearranged to ISO and ISO text left alone, so one cast reads both,
    whatever the session time zone.
    """
    iso = F.regexp_replace(text, f"(?s){DAY_FIRST}.*", "$3-$2-$1 $4:00")
    return iso.try_cast("timestamp_ntz")


def date_key(day: Column) -> Column:
    """yyyymmdd as an integer."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def month_key(day: Column) -> Column:
    """Year and month as one integer, cheap to group on; see ``month_text``."""
    return F.year(day) * 100 + F.month(day)


def month_text(key: Column) -> Column:
    """``month_key`` as 'YYYY-MM'."""
    text = F.lpad(key.cast("string"), 6, "0")
    return F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2))


def day_of_week(day: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(day) - 1


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def weekday_name(day: Column, names: Sequence[str]) -> Column:
    """Name of the weekday from ``names``, Sunday first."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.dayofweek(day))


def padded_name(day: Column, pattern: str) -> Column:
    """English month ('MMMM') or day ('EEEE') name, blank-padded to nine characters."""
    return F.rpad(F.date_format(day, pattern), 9, " ")


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def days_since(day: Column, today: Column | None = None) -> Column:
    """Whole days from ``day`` to ``today``, by default the current date; negative before it."""
    return F.date_diff(F.current_date() if today is None else today, day)
