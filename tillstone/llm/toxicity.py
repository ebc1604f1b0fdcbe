"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram is present or absent in a text and falls into one of ``BUCKETS`` by a hash. Its
log-count ratio compares how many toxic and other training texts hold it; a logistic
regression learns one weight per n-gram on features scaled by the ratio, so that a score is
sigmoid(sum ratio * weight + bias).

The counts behind the ratios are over all labelled training texts. The weights are fitted on
at most about ``FIT_ROWS`` of either class (taken by a hash of the id, the same on every run), as
``SHARDS`` models on disjoint shares that are then averaged.

Nulls: a null text is empty and is scored by the bias alone; rows with a null label or id are
not learned from. Where a document is labelled more than once, any toxic label counts. Without
any labels every score is 0.5. Repeated rows are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common

ORDERS = (3, 4, 5)
BUCKETS = 1 << 18
#: At most about so many texts of either class are fitted on.
FIT_ROWS = 8_000
SHARDS = 4
EPOCHS = 5
RATE = 0.5
L2 = 1e-4
SMOOTHING = 30.0
_CHUNK = 1 << 12


def features(text: bytes) -> np.ndarray:
    """Buckets of the character n-grams of a text, each once and in order.

    In lower case, and with one space for white space, before the text and after it.
    """
    plain = " ".join(text.decode("utf-8", "replace").lower().split())
    chars = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    present = np.zeros(BUCKETS, bool)
    with np.errstate(over="ignore"):
        rolling = chars + np.uint64(1)
        for order in range(2, max(ORDERS) + 1):
            if len(chars) < order:
                break
            rolling = rolling[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[order - 1:] + np.uint64(1)
            if order in ORDERS:
                hashed = rolling ^ (rolling >> np.uint64(29))
                present[((hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)).astype(np.int64)] = True
    return np.flatnonzero(present)


def presence_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(texts that hold each bucket, texts) by class, over (text, toxic) rows.

    Each task adds up its own table; Spark adds the tables chunk by chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, texts = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, toxic in zip(common.texts_of(batch), batch.column("toxic").to_pylist()):
                table[toxic, features(text)] += 1
                texts[toxic] += 1
        for toxic in (0, 1):
            if texts[toxic]:
                places = np.arange(0, BUCKETS, _CHUNK)
                yield pa.RecordBatch.from_arrays([
                    pa.array([toxic] * (len(places) + 1), pa.int32()),
                    pa.array([*(places // _CHUNK).tolist(), -1], pa.int32()),
                    pa.array([*(table[toxic, p:p + _CHUNK].astype("<i8").tobytes() for p in places), texts[toxic:toxic + 1].astype("<i8").tobytes()], pa.binary()),
                ], ["toxic", "chunk", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"toxic": [key[0].as_py()], "chunk": [key[1].as_py()], "counts": [total.astype("<i8").tobytes()]},
                        schema=pa.schema([("toxic", pa.int32()), ("chunk", pa.int32()), ("counts", pa.binary())]))

    schema = "toxic int, chunk int, counts binary"
    counts, texts = np.zeros((2, BUCKETS)), np.zeros(2)
    # BUCKETS counts of each class, whatever the corpus.
    for toxic, chunk, held in common.in_arrow(rows, run, schema).groupBy("toxic", "chunk").applyInArrow(add, schema).collect():
        if chunk < 0:
            texts[toxic] = np.frombuffer(held, "<i8")[0]
        else:
            counts[toxic, chunk * _CHUNK:(chunk + 1) * _CHUNK] = np.frombuffer(held, "<i8")
    return counts, texts


def log_ratios(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """log of the ratio of the shares of toxic and other texts that hold each n-gram.

    ``SMOOTHING`` texts with every n-gram are added in the classes' own proportion, so an
    n-gram met a few times has a ratio near 0.
    """
    share = (counts + SMOOTHING * (texts / texts.sum())[:, None]) / texts[:, None]
    return np.log(share[1] / share[0])


def fit(texts: list[bytes], toxic: list[int], ratios: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Weights (bias last) by adaptive gradient steps on one text at a time, classes weighted alike."""
    rows = [features(x) for x in texts]
    labels = np.array(toxic, np.float64)
    positive = max(labels.sum(), 1.0)
    weight = np.where(labels > 0, len(labels) / (2 * positive), len(labels) / (2 * max(len(labels) - positive, 1.0)))
    weights, squares = np.ones(BUCKETS), np.full(BUCKETS, 1e-3)
    bias, bias_square = 0.0, 1e-3
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            own = rows[i]
            ratio = ratios[own]
            z = float(ratio @ weights[own]) / np.sqrt(max(len(own), 1)) + bias
            slope = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[i]) * weight[i]
            step = slope * ratio / np.sqrt(max(len(own), 1)) + L2 * weights[own]
            squares[own] += step * step
            weights[own] -= rate * step / np.sqrt(squares[own])
            bias_square += slope * slope
            bias -= rate * slope / np.sqrt(bias_square)
    return np.append(weights, bias)


def train(rows: DataFrame) -> np.ndarray | None:
    """Scaled weights (ratio * weight per bucket, bias last) from (id, text, toxic) rows."""
    counts, texts = presence_counts(rows.select("text", "toxic"))
    if not texts.min():
        return None
    ratios = log_ratios(counts, texts)
    spark = rows.sparkSession
    shipped = spark.sparkContext.broadcast(ratios.astype(np.float32))
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    bounds = [int(min(1.0, FIT_ROWS / n) * (1 << 30)) for n in texts]
    chosen = (rows.where(place < F.when(F.col("toxic") == 1, bounds[1]).otherwise(bounds[0]))
              .withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARDS)).cast("int")))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        texts = [x or b"" for x in table.column("text").cast(pa.binary()).to_pylist()]
        made = fit(texts, table.column("toxic").to_pylist(), shipped.value.astype(np.float64))
        return pa.table({"n": pa.array([len(texts)], pa.int64()), "weights": pa.array([made.astype("<f4").tobytes()], pa.binary())})

    made = chosen.groupBy("shard").applyInArrow(one, "n long, weights binary").collect()
    if not made:
        return None
    total = sum(n for n, _ in made)
    mean = sum(np.frombuffer(w, "<f4").astype(np.float64) * n for n, w in made) / total
    mean[:-1] *= ratios
    return mean


def score(df: DataFrame, weights: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shipped = df.sparkSession.sparkContext.broadcast(None if weights is None else weights.astype(np.float32))

    def work(batch: pa.RecordBatch) -> dict[str, object]:
        own = shipped.value
        scores = []
        for text in common.texts_of(batch):
            at = features(text)
            z = 0.0 if own is None else float(own[at].sum(dtype=np.float64)) / np.sqrt(max(len(at), 1)) + float(own[-1])
            scores.append(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        return {"id": batch.column("id"), "score": scores}

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return common.map_batches(rows, work, "id long, score double")


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, toxic) of the documents with a label."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(
        F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # Labels grow with the documents, so the join is the same shuffle at every size.
    return texts.join(marks.hint("merge"), "id").select("id", "text", "toxic")


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of documents, learned from labels of rows not held out."""
    learnable = common.fold(F.col("doc_id"), 5) != 0
    rows = common.stored(labelled(documents.where(learnable), labels.where(learnable)), "labelled")
    return score(documents, train(rows)).select(
        F.col("id").alias("doc_id"), (common.fold(F.col("id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
