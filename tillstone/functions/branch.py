"""Branch resolution: raw account, normalised text or e-mail to a branch label.

Rules come from the ``Vocabulary``; the first rule that matches wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillstone.functions.text import any_ilike
from tillstone.vocab import Branch, Vocabulary


def _first_match(rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, F.lit(label))
    return otherwise if chain is F else chain.otherwise(otherwise)


def by_alias(account: Column, vocab: Vocabulary) -> Column:
    """Exact alias list, else the raw account."""
    return alias_or(account, account, vocab)


def by_alias_trimmed(account: Column, vocab: Vocabulary, blank_for_null: bool = False) -> Column:
    """Exact alias list, else the trimmed account (NULL as blank text if asked)."""
    rest = F.coalesce(account, F.lit("")) if blank_for_null else account
    return alias_or(account, F.trim(rest), vocab)


def alias_or(account: Column, otherwise: Column, vocab: Vocabulary) -> Column:
    rules = [
        (account.isin(*b.aliases), vocab.branch_prefix + b.label) for b in vocab.counter_branches
    ]
    return _first_match(rules, otherwise)


def by_account_pattern(account: Column, vocab: Vocabulary, unknown: str) -> Column:
    """Account patterns, else the raw account, else ``unknown`` for NULL."""
    rules = [
        (any_ilike(account, b.account_like), b.label) for b in vocab.branches if b.account_like
    ]
    return _first_match(rules, F.coalesce(account, F.lit(unknown)))


def by_broad_pattern(text: Column, vocab: Vocabulary, otherwise: Column) -> Column:
    """Broad patterns on normalised branch text or an e-mail, else ``otherwise``."""
    rules = [(any_ilike(text, b.broad_like), b.label) for b in vocab.branches if b.broad_like]
    return _first_match(rules, otherwise)


def by_email(email: Column, vocab: Vocabulary) -> Column:
    """Broad patterns on the e-mail, else the unknown-branch label."""
    return by_broad_pattern(F.lower(F.coalesce(email, F.lit(""))), vocab, F.lit(vocab.unknown_branch))


def by_email_or(email: Column, otherwise: Column, vocab: Vocabulary) -> Column:
    """Narrow patterns on the e-mail, else ``otherwise``, else the unidentified label."""
    rules = [(any_ilike(email, b.narrow_like), b.label) for b in vocab.branches if b.narrow_like]
    return _first_match(rules, F.coalesce(otherwise, F.lit(vocab.unidentified)))


def dimension_name(text: Column, vocab: Vocabulary) -> Column:
    """Name a line is looked up under in the branch dimension: counter branches by broad
    pattern, anything else by its own text."""
    rules = [
        (any_ilike(text, b.broad_like), b.label) for b in vocab.counter_branches if b.broad_like
    ]
    return _first_match(rules, text)


def is_alias_of(account: Column, branch: Branch) -> Column:
    return account.isin(*branch.aliases)


def is_narrow_match(text: Column, branch: Branch) -> Column:
    return any_ilike(text, branch.narrow_like)
