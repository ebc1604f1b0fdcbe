"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source the documents are sorted by key in
ranges, and prefix sums of their word counts are taken: within each range, plus the sum of the
ranges before it. A source's budget is then cut exactly: every whole epoch that fits takes all
documents once, and what is left takes the documents at the start of the order, the last of
them in part.

A source's range count is the square root of its rows, so a source that holds a third of
all rows has as many ranges as a range has rows, and neither grows into one task. Rows that
are alike in id, source and size are one row with a count until the end. Texts are never
shuffled. DataFrame operations only.

Nulls: a null text has no words and is taken for 0 words; null sources are one source, the last
in order; null ids are allowed. Repeated rows count each by itself. Where all sizes are 0 all
targets are 0. An empty table gives no rows. Other columns of the documents are not looked at,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillstone.llm import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more than so many times.
MAX_EPOCHS = 3
#: Another seed gives another order.
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60
#: Sources up to which one range of them is summed by one task.
SOURCES_IN_RANGE = 50_000
#: A hot source's rows meet its one row of figures by so many salts.
SALTS = 16
_WIDE = "decimal(38,0)"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """A number of 60 bits, the same for the same id in every run."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` stored in ranges of ``order``, numbered by the column ``part``."""
    parts = 1 + rows.count() // SOURCES_IN_RANGE
    ranged = rows.repartitionByRange(parts, *order) if parts > 1 else rows.coalesce(1)
    return common.stored(ranged.withColumn("part", F.spark_partition_id()), name)


def sums_before(ranged: DataFrame, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds, under each name, the sum of a value over all rows before this one in ``order``.

    ``ranged`` comes from ``placed``: a range is summed by itself and gets the totals of the
    ranges before it, one row a range.
    """
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("part").agg(*[F.sum(v).alias(f"all_{k}") for k, v in values.items()]).select(
        "part", *[F.coalesce(F.sum(f"all_{k}").over(earlier), F.lit(0)).alias(f"all_{k}") for k in values])
    summed = ranged.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(k) for k, v in values.items()])
    kept = ranged.columns
    return summed.join(offsets, "part").select(
        *[F.col(c) for c in kept], *[(F.col(k) + F.col(f"all_{k}")).cast(_WIDE).alias(k) for k in values])


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target``, ``epochs`` and ``rest`` to one row per source with its ``source_size``.

    All sizes are shared out by weight. A target over ``max_epochs`` times its source stops there and the
    excess is shared among the others, until none is above: sorted by the ratio of that bound
    to the weight, the sources up to some place are at their bound and the rest get the same
    multiple of their weight, so the place is found by prefix sums.
    """
    by_name = [F.col("source").asc_nulls_last()]
    n = sums_before(placed(sources, by_name, "mix-sources"), by_name, {"rank": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast(_WIDE)
    scale = 1
    for w in set(weights):
        scale *= w
    weighed = n.select(
        "source", "rows", "source_size", weight.alias("weight"), (F.col("source_size").cast(_WIDE) * max_epochs).alias("bound"),
    ).withColumn("ratio", (F.col("bound") * F.expr(f"{scale} div weight")).cast(_WIDE))
    by_ratio = [F.col("ratio").asc(), F.col("source").asc_nulls_last()]
    ranged = placed(weighed, by_ratio, "mix-ratios")
    summed = sums_before(ranged, by_ratio, {"bounds": F.col("bound"), "weights": F.col("weight")})
    total = ranged.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast(_WIDE).alias("total"), F.sum("weight").cast(_WIDE).alias("all_weights"))
    levels = summed.crossJoin(F.broadcast(total))  # one row
    left, shared = (F.col("total") - F.col("bounds")).cast(_WIDE), (F.col("all_weights") - F.col("weights")).cast(_WIDE)
    # The first source in order whose share of what is left is within its bound ends the capped ones.
    first = levels.where(left * F.col("weight") <= F.col("bound") * shared).agg(
        F.min(F.struct(F.col("ratio"), F.col("source").isNull(), "source", left.alias("left"), shared.alias("shared"))).alias("f")
    ).select(F.col("f.ratio").alias("from_ratio"), "f.left", "f.shared")
    share = (F.col("weight") * F.col("left")).cast("double") / F.col("shared").cast("double")
    target = F.when(F.col("ratio") < F.col("from_ratio"), F.col("bound").cast("double")).otherwise(share)
    budget = F.round("target").cast("long")
    return (
        weighed.crossJoin(F.broadcast(first)).select("source", "rows", "source_size", target.alias("target"))  # one row
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("epochs", F.col("epochs") - F.when(F.col("epochs") * F.col("source_size") > budget, 1).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(kinds, sources): documents alike in id, source and size with key and count, and the sources' targets."""
    kinds = common.stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text").cast("string")).alias("size"))
        .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("key", random_key(F.col("doc_id"), seed)), "mix-kinds")
    sources = common.stored(kinds.groupBy("source").agg(
        F.sum("copies").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("source_size")), "mix-sizes")
    return kinds, common.stored(targets(sources, weights, max_epochs), "mix-targets")


def with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the figures of their source; the rows of a hot source are spread by their key."""
    salted = sources.withColumnRenamed("source", "of").withColumn("of_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return rows.join(
        salted, F.col("source").eqNullSafe(F.col("of")) & (F.pmod("key", F.lit(SALTS)).cast("int") == F.col("of_salt"))
    ).drop("of", "of_salt")


def ordered(kinds: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``start``: the words of the source's documents before this one in the random order."""
    count = F.ceil(F.sqrt(F.col("rows")))
    bucket = F.least(F.floor(F.col("key") / F.lit(float(1 << KEY_BITS)) * count), count - 1).cast("long")
    rows = with_source(kinds, sources).withColumn("bucket", bucket)
    weight = F.col("size") * F.col("copies")
    within = (Window.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("source", "bucket").agg(F.sum(weight).alias("words")).select(
        F.col("source").alias("of"), F.col("bucket").alias("of_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    return (
        rows.withColumn("inside", F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket")))
        .withColumn("start", F.col("before") + F.col("inside"))
        .drop("of", "of_bucket", "before", "inside", "bucket")
    )


def shares(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, start, taken) of every document.

    ``taken`` are the words the mix takes of it over all epochs. They add up to the rounded
    target of the source.
    """
    copy = F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy", "nth")
    rows = ordered(*plan(docs, weights, max_epochs, seed)).select("*", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    cut = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start")))
    return rows.select("doc_id", "source", "size", "source_size", "target", "start", (F.col("size") * F.col("epochs") + cut).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mix itself: the documents with all their columns, once per epoch that takes them.

    Adds ``mix_epoch`` (from 1), ``mix_key`` (the random order) and ``mix_words``, the words taken: all,
    but for the one document at the end of a source's budget. Only the place of the cut is
    brought to the documents, one row per source, so texts stay where they are. Rows that are alike in
    id, source and size and lie at the cut share the words left evenly, rounded down.
    """
    kinds, sources = plan(docs, weights, max_epochs, seed)
    at = ordered(kinds, sources).where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("size") * F.col("copies")))
    ends = at.select(
        "source", F.struct("key", F.col("doc_id").isNotNull(), "doc_id", "size").alias("cut"),
        F.floor((F.col("rest") - F.col("start")) / F.col("copies")).cast("long").alias("cut_words"))
    facts = common.stored(sources.join(
        ends.withColumnRenamed("source", "at"), F.col("source").eqNullSafe(F.col("at")), "left").drop("at"), "mix-cuts")
    names = docs.columns
    rows = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, source, text = (F.col(f"c{names.index(x)}") for x in ("doc_id", "source", "text"))
    rows = with_source(rows.select(
        "*", source.cast("string").alias("source"), words(text.cast("string")).alias("size"), random_key(doc_id, seed).alias("key"),
        doc_id.cast("long").alias("id")), facts.drop("rows", "source_size", "target"))
    own = F.struct("key", F.col("id").isNotNull(), "id", "size")
    last = F.when(own < F.col("cut"), F.col("size")).when(own == F.col("cut"), F.col("cut_words")).otherwise(0)
    taken = F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.array(last))
    epochs = rows.select("*", F.posexplode(taken).alias("nth", "mix_words")).where("mix_words > 0")
    return epochs.select(
        *[F.col(f"c{i}").alias(x) for i, x in enumerate(names)], (F.col("nth") + 1).alias("mix_epoch"), F.col("key").alias("mix_key"), "mix_words")
