"""Text expressions with the source database's semantics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def initcap_words(col: Column) -> Column:
    """Capitalise after every non-alphanumeric character, lower-case the rest.

    Spark's ``initcap`` starts a word only after white space, so the text is cut into
    alphanumeric and other runs first.
    """
    runs = F.regexp_extract_all(col, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def any_ilike(col: Column, patterns: Iterable[str]) -> Column:
    """True where any case-insensitive LIKE pattern matches; NULL text gives NULL."""
    result: Column | None = None
    for pattern in patterns:
        match = col.ilike(pattern)
        result = match if result is None else result | match
    return F.lit(False) if result is None else result


def contains_none(col: Column, words: Iterable[str]) -> Column:
    """``NOT ILIKE '%word%'`` for every word. NULL text gives NULL, so a filter drops it."""
    result: Column | None = None
    for word in words:
        miss = ~col.ilike(f"%{word}%")
        result = miss if result is None else result & miss
    return F.lit(True) if result is None else result


def keyword_category(
    col: Column, rules: Iterable[tuple[str, tuple[str, ...]]], otherwise: str
) -> Column:
    """First category one of whose keywords occurs in the lower-cased text."""
    lowered = F.lower(col)
    chain = F
    for category, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.like(f"%{word}%")
        chain = chain.when(hit, F.lit(category))
    return F.lit(otherwise) if chain is F else chain.otherwise(F.lit(otherwise))
