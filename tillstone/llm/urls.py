"""URL filter: ratio of two character language models, with rules that come first.

Both models are variable-order Markov models with Witten-Bell smoothing: the chance of a
character after the last ``ORDER`` characters is mixed with its chance after one character
less, and so on down to a uniform chance, the weight of each order depending on how many
different characters followed the context. One model is of accepted, one of rejected URLs,
as the rules judge them. A URL that no rule fits is allowed if the log-likelihood difference
per character reaches a threshold calibrated on ruled URLs that the models have not seen.

DataFrame operations only. Log-ratios are integers (micro-nats), so sums are exact and do not
depend on the order of rows.

Tables of grams are joined by merging, never by a broadcast: Spark takes a table of URLs for as
small as its compressed files, and the grams made from it for no larger, so it would send far
more through the driver than its threshold says.

Nulls: a null URL or one without ``://`` has an empty host and path, no score, and is blocked.
Pages are judged row by row, repeated ids included. Where rules accept nothing or reject
nothing, the threshold is 0. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.llm import common

#: (verdict, host, path) of the rules; a longer rule goes before a shorter one (fixed values).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ORDER = 4
ALPHABET = 256
SALTS = 4
#: One in so many ruled URLs, by a hash, calibrates the threshold and is not learned from.
FOLDS = 5
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, all after the first ://); empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _SMALL), path, rest


def ruled(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def with_grams(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """Adds ``gram``: each character of ``rest``, and its end, after the ``order`` characters before."""
    padded = F.concat(F.lit("\x02" * order), F.col("rest"), F.lit("\x03"))
    return (rows.where(F.col("rest") != "").withColumn("padded", padded)
            .withColumn("at", F.explode(F.sequence(F.lit(1), F.length("rest") + 1)))
            .withColumn("gram", F.expr(f"substring(padded, at, {order + 1})")).drop("padded", "at"))


def log_ratios(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) of every gram of ``rows``: micro-nats by which accepted URLs are likelier.

    Learned from the rows whose ``role`` is allow or block. Tables are of distinct grams, one
    per order, each summed up from the next longer one.
    """
    levels = [None] * (order + 1)
    levels[order] = with_grams(rows.select("rest", "role"), order).groupBy("gram").agg(
        F.sum((F.col("role") == "allow").cast("long")).alias("good"),
        F.sum((F.col("role") == "block").cast("long")).alias("bad")).fillna(0)
    levels[order] = common.stored(levels[order], "grams")
    for n in range(order - 1, -1, -1):
        levels[n] = levels[n + 1].groupBy(F.expr(f"right(gram, {n + 1})").alias("gram")).agg(
            F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    lower = None
    for n, level in enumerate(levels):
        context = Window.partitionBy("context")
        table = level.withColumn("context", F.expr(f"left(gram, {n})"))
        if lower is None:
            table = table.withColumn("below_good", F.lit(1.0 / ALPHABET)).withColumn("below_bad", F.lit(1.0 / ALPHABET))
        else:
            table = table.withColumn("shorter", F.expr(f"right(gram, {n})")).join(lower.hint("merge"), "shorter")
        for side in ("good", "bad"):
            seen = F.sum(side).over(context)
            kinds = F.sum((F.col(side) > 0).cast("long")).over(context)
            below = F.col(f"below_{side}")
            table = table.withColumn(f"chance_{side}", F.when(seen > 0, (F.col(side) + kinds * below) / (seen + kinds)).otherwise(below))
        lower = table.select(
            F.col("gram").alias("shorter"), F.col("chance_good").alias("below_good"), F.col("chance_bad").alias("below_bad"))
    ratio = F.round(1e6 * (F.log("below_good") - F.log("below_bad"))).cast("long")
    return lower.select(F.col("shorter").alias("gram"), ratio.alias("ratio"))


def scored(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """(row, total, places) of every row with a host: the summed ratio and the grams summed.

    A gram that every URL has, such as a common ending, is dealt out by a salt.
    """
    salted = with_grams(rows.select("row", "rest")).withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    copies = ratios.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return salted.join(copies.hint("merge"), ["gram", "salt"]).groupBy("row").agg(
        F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("places"))


def threshold(scores: DataFrame) -> float:
    """The bound, in hundredths of a nat per character, with the least sum of both error rates.

    ``scores`` has ``truth`` (allow or block) and ``score`` of held-out ruled URLs; of equal
    bounds the lowest is taken.
    """
    bins = (scores.where(F.col("score").isNotNull()).groupBy(F.floor(F.col("score") * 100).alias("bin"))
            .agg(F.sum((F.col("truth") == "allow").cast("long")).alias("good"), F.sum((F.col("truth") == "block").cast("long")).alias("bad")))
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # some thousand bins at most
    all_ = Window.partitionBy()
    cut = (bins.withColumn("missed", F.coalesce(F.sum("good").over(up_to), F.lit(0)))
           .withColumn("passed", F.sum("bad").over(all_) - F.coalesce(F.sum("bad").over(up_to), F.lit(0)))
           .withColumn("goods", F.sum("good").over(all_)).withColumn("bads", F.sum("bad").over(all_))
           .where((F.col("goods") > 0) & (F.col("bads") > 0))
           .orderBy(F.col("missed") * F.col("bads") + F.col("passed") * F.col("goods"), "bin").select("bin").first())
    return cut[0] / 100 if cut else 0.0


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page."""
    host, path, rest = parsed(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("truth"))
    calibrating = F.conv(F.substring(F.md5(F.col("rest").cast("binary")), 1, 8), 16, 10).cast("long") % FOLDS == 0
    rows = common.stored(
        rows.withColumn("role", F.when(calibrating & F.col("truth").isNotNull(), F.lit("calibrate")).otherwise(F.col("truth")))
        .withColumn("row", F.monotonically_increasing_id()), "urls")
    totals = scored(rows, log_ratios(rows))
    done = common.stored(
        rows.join(totals, "row", "left").withColumn("score", F.col("total") / (F.col("places") * F.lit(1e6))), "url-scores")
    bound = threshold(done.where(F.col("role") == "calibrate"))
    own = F.when(F.col("score") >= bound, F.lit("allow")).otherwise(F.lit("block"))
    return done.select("page_id", "host", "path", "rule", F.coalesce("truth", own).alias("verdict"), "score")
