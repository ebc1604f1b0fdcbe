"""Host-level quality rules.

Every document is measured against the rules. The rate of failing documents of a host (the
``source`` column) is shrunk towards the rate of all hosts with a beta prior. The prior is
fitted to how far hosts spread beyond what chance alone spreads them, so where hosts do not differ every
rate is the common one, and a host of two documents is not judged by two documents. The
verdict comes back to documents: on a bad host a document must pass every rule, elsewhere only
the base rules. A host is bad if its rate, less ``DOUBTS`` standard deviations of what the prior and its
documents leave open, is above ``MARGIN`` times the common rate. A document that passes all rules is
kept wherever it is.

Nulls: a null text has no words (and fails as too short); a null source is a host of its own.
Rows are judged one by one, repeated ids included. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PCT = 30
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUP_LINE_PCT = 30
MEAN_WORD_CHARS = (2, 14)
MARGIN, DOUBTS = 1.5, 2.0
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"

SCHEMA = (
    "id long, row_key long, host string, n_words long, word_chars long, n_symbols long, n_lines long, "
    "n_dup_lines long, n_repeat_words long"
)


def repeated_words(numbers: np.ndarray, sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows of words that occur twice or more in that text.

    ``numbers`` are the words of all texts one after another as integers, ``sizes`` the
    words of each text.
    """
    n = len(numbers)
    if n < window:
        return np.zeros(len(sizes), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys = common.mixed(numbers + 1)
    with np.errstate(over="ignore"):
        rolling = common.mixed(owner[: n - window + 1].astype(np.uint64))
        for k in range(window):
            rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + keys[k:n - window + 1 + k]
    inside = np.flatnonzero(owner[: n - window + 1] == owner[window - 1:])
    rolling = common.mixed(rolling[inside])
    order = np.argsort(rolling, kind="stable")
    same = rolling[order[1:]] == rolling[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, inside[twice], 1)
    np.add.at(change, inside[twice] + window, -1)
    return common.per_text((np.cumsum(change[:-1]) > 0).astype(np.int64), sizes)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row of counts per document over its whole text; ``row_key`` tells rows that share an id apart."""
    def work(batch: pa.RecordBatch) -> dict[str, object]:
        texts = common.texts_of(batch)
        split = [x.split() for x in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        numbers = common.Interned().numbers([w for words in split for w in words])
        lines = [[x for x in text.split(b"\n") if x.strip()] for text in texts]
        chars = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        return {
            "id": batch.column("id"),
            "row_key": batch.column("row_key"),
            "host": batch.column("host"),
            "n_words": sizes,
            "word_chars": chars - np.array([sum(map(x.count, (_SPACE[i:i + 1] for i in range(6)))) for x in texts], np.int64),
            "n_symbols": [sum(map(x.count, (SYMBOLS[i:i + 1] for i in range(8)))) for x in texts],
            "n_lines": [len(x) for x in lines],
            "n_dup_lines": [len(x) - len(set(x)) for x in lines],
            "n_repeat_words": repeated_words(numbers, sizes),
        }

    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col, host_col).alias("row_key"), F.col(host_col).cast("string").alias("host"),
        F.col(text_col).cast("string").alias("text"),
    )
    return common.map_batches(rows, work, SCHEMA)


def with_failures(measured: DataFrame) -> DataFrame:
    """Adds ``base_failed`` (too short or repetitive) and ``failed`` (any rule)."""
    n = F.col("n_words")
    base = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * n)
    soft = (
        (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * n)
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))
        | (F.col("word_chars") < MEAN_WORD_CHARS[0] * n)
        | (F.col("word_chars") > MEAN_WORD_CHARS[1] * n)
    )
    return measured.withColumn("base_failed", base).withColumn("failed", base | soft)


def host_rates(failures: DataFrame) -> DataFrame:
    """(host, n, bad, rate, least, common): of every host the shrunk failure rate and the rate that it has at least.

    The prior's variance is the spread between hosts less the part that counting so few documents
    makes, both weighted by documents.
    """
    hosts = failures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    total = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("squares"),
    ).first()
    n = total["n"] or 0
    mean = total["bad"] / n if n else 0.0
    chance = (total["hosts"] - 1) / n * (mean * (1 - mean)) if n else 0.0
    spread = total["squares"] / n - mean * mean - chance if n else 0.0
    # Moments of a beta distribution: variance = mean (1 - mean) / (strength + 1).
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 1e-12 else 1e6
    rate = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    open_ = F.sqrt(F.col("rate") * (F.lit(1.0) - F.col("rate")) / (F.col("n") + F.lit(strength + 1)))
    return hosts.withColumn("rate", rate).withColumn("least", F.col("rate") - F.lit(DOUBTS) * open_).withColumn("common", F.lit(mean))


def judged(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every document."""
    return verdicts(df, margin).drop("row_key")


def verdicts(df: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The same with ``row_key``, a hash of text and host.

    Only documents that pass the base rules and fail another one depend on their host, so
    only they meet the hosts, spread over 16 salts since one host may hold a third of them.
    """
    failures = common.stored(with_failures(measures(df)), "measures")
    strict = (host_rates(failures).where(F.col("least") > margin * F.col("common"))
              .select(F.coalesce("host", F.lit("")).alias("key"), F.col("host").isNull().alias("none"))
              .withColumn("salt", F.explode(F.array(*map(F.lit, range(16))))))
    in_doubt = F.col("failed") & ~F.col("base_failed")
    doubtful = failures.where(in_doubt).select(
        "*", F.coalesce("host", F.lit("")).alias("key"), F.col("host").isNull().alias("none"),
        F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(16)).cast("int").alias("salt"))
    found = doubtful.join(strict.withColumn("hit", F.lit(True)), ["key", "none", "salt"], "left")
    columns = ["id", "row_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return (
        failures.where(~in_doubt).select(*columns, (~F.col("base_failed")).alias("kept"))
        .unionByName(found.select(*columns, F.col("hit").isNull().alias("kept")))
        .withColumnRenamed("id", "doc_id")
    )
