"""Source mixing against plain Python and SQL."""

import random
from collections import Counter, defaultdict

import pytest

from checks.compare import differences
from pyspark.sql import functions as F
from tests.llm import frames
from tests.llm.test_sql import connected
from tillstone.llm import mixing, oracles


def filled(sizes: dict, weights=mixing.WEIGHTS, most=mixing.MAX_EPOCHS) -> dict:
    """Targets by resharing the excess until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] > most * sizes[s] * total}
        if not above:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return out


def by_source(rows):
    sizes, targets, taken = Counter(), {}, Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        targets[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    return sizes, targets, taken


def check(rows):
    sizes, targets, taken = by_source(rows)
    want = filled(sizes)
    assert {s: round(t, 6) for s, t in targets.items()} == {s: round(t, 6) for s, t in want.items()}
    for s, t in want.items():
        assert abs(taken[s] - t) <= 0.5
    assert all(0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] for r in rows)


def test_awkward_rows(spark, tmp_path):
    df = frames.docs(spark)
    rows = mixing.shares(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r[0], len(frames.split(r[1]))) for r in frames.rows())
    check(rows)
    assert differences(mixing.shares(df), connected(df, "documents", tmp_path), oracles.mixing()) == ""
    assert mixing.shares(frames.empty(spark)).count() == 0
    assert Counter(map(tuple, mixing.shares(df.repartition(7)).collect())) == Counter(map(tuple, rows))


def many(spark, n=4000):
    """A hot source, tiny sources that reach their bound, ids that repeat and texts that are alike."""
    rnd, rows = random.Random(5), []
    for i in range(n):
        source = "hot" if i % 3 else f"s{rnd.randrange(40):02d}"
        rows.append((i if i % 10 else 7, frames.text(rnd.randrange(50), rnd.randrange(60)), source))
    rows += [(None, None, "nothing"), (1, "", "nothing")] + [(n + i, "one", f"z{i}") for i in range(9)] + [(3, "same words here", "hot")] * 50
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_many_sources(spark, tmp_path, monkeypatch):
    df = many(spark)
    want = Counter(map(tuple, mixing.shares(df).collect()))
    check(mixing.shares(df).collect())
    assert differences(mixing.shares(df), connected(df, "documents", tmp_path), oracles.mixing()) == ""
    monkeypatch.setattr(mixing, "SOURCES_IN_RANGE", 7)  # sources ranked and summed in several ranges
    assert Counter(map(tuple, mixing.shares(df).collect())) == want


def test_a_source_without_words_and_one_at_its_bound(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, "w", "b"), (3, "w " * 99, "c")], "doc_id long, text string, source string")
    got = {r["source"]: (r["target"], r["taken"]) for r in mixing.shares(df).collect()}
    assert got == {"a": (0.0, 0), "b": (3.0, 3), "c": (97.0, 97)}
    nothing = df.withColumn("text", F.lit(None).cast("string"))
    assert {(r["target"], r["taken"]) for r in mixing.shares(nothing).collect()} == {(0.0, 0)}


def test_the_mix_itself(spark):
    df = many(spark).select("*", F.lit(1).alias("key"), F.lit(2).alias("size"), F.lit("x").alias("rest"))
    plan = Counter()
    for r in mixing.shares(df).collect():
        plan[r["source"], r["doc_id"], r["size"]] += r["taken"]
    got, epochs = Counter(), defaultdict(set)
    for r in mixing.mixed(df).collect():
        size = len(frames.split(r["text"]))
        assert r["mix_words"] <= size and (r["key"], r["size"], r["rest"]) == (1, 2, "x")
        got[r["source"], r["doc_id"], size] += r["mix_words"]
        epochs[r["source"]].add(r["mix_epoch"])
    far = {k: (plan[k], got[k]) for k in plan if abs(plan[k] - got[k]) >= 60}
    assert far == {} and set(got) <= set(plan)
    assert max(max(e) for e in epochs.values()) == 3 and epochs["hot"] == {1}


def test_no_python_and_no_text_shuffle(spark):
    plan = mixing.shares(frames.docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_source_mix"])
def test_registered(spark, name):
    from checks.compare import connect
    from tillstone.llm import queries

    assert differences(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), queries.ORACLE[name]) == ""
