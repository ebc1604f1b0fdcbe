"""Spelling variants against comparisons of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import frames
from tillstone.llm import spelling


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] or (len(a) == len(b) and a[i + 1:] == b[i + 1:])


def words_of(rows) -> Counter:
    out = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = frames.lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 7 and n >= 2})


def expected(words: Counter) -> dict:
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x)) for w in words if near[w]}
    form = {w: x for w, x in best.items() if words[x] >= 10 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root)
    return out


def given(df) -> dict:
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}


@pytest.mark.parametrize(("letters", "low", "high", "n"), [("ab", 1, 9, 250), ("abcé", 7, 12, 400), ("xyz", 7, 8, 500), ("q", 1, 40, 30)])
def test_index(letters, low, high, n):
    rnd = random.Random(n)
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(n)})
    rnd.shuffle(words)
    index, got = spelling.Index(words), set()
    for end in (0, 1):
        asked, hits = index.near(np.arange(len(words)), end)
        got |= {tuple(sorted((words[a], words[b]))) for a, b in zip(asked.tolist(), hits.tolist())}
    assert got == {tuple(sorted((a, b))) for a in words for b in words if one_edit(a, b)}


def test_only_the_half_before_the_error_is_exact():
    index = spelling.Index(["abcdefgh", "abcdefgX", "Xbcdefgh", "abcdefghi", "iabcdefgh"])
    right, left = ({index_word for _, index_word in zip(*(x.tolist() for x in index.near(np.array([0]), end)))} for end in (1, 0))
    assert (right, left) == ({1, 3}, {2, 4})


def corpus(n=900):
    """Common words, rarer variants of them one and two edits away, runs of one letter and accented words."""
    rnd = random.Random(11)
    letters = "abcdeéñz"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 12))) for _ in range(40)] + ["a" * 7, "a" * 8, "a" * 9, "ÀÿÉabcdé", "x" * 300, "x" * 301]
    rows = []
    for i in range(n):
        out = []
        for _ in range(rnd.randint(0, 60)):
            word = stems[min(int(rnd.expovariate(0.15)), len(stems) - 1)]
            for _ in range(rnd.choice([0] * 12 + [1, 1, 2])):
                at = rnd.randrange(len(word))
                word = word[:at] + rnd.choice(["", rnd.choice(letters), word[at] * 2]) + word[at + 1:]
            out.append(word.upper() if rnd.random() < 0.1 else word)
        rows.append((rnd.choice([i, i, 3, None]), rnd.choice([" ", ", ", "1", "\n"]).join(out), 1, "x", 5))
    return [*rows, (1, None, 1, "x", 5), (2, "", None, None, None), rows[0], rows[0]]


SCHEMA = "doc_id long, text string, n int, word string, block int"


def test_against_all_pairs(spark):
    rows = corpus()
    df, want = spark.createDataFrame(rows, SCHEMA), expected(words_of(rows))
    assert sum(x[2] is not None for x in want.values()) > 50 and any(x[4] != x[2] for x in want.values() if x[2])
    assert given(spelling.grouped(df)) == want
    assert given(spelling.grouped(df.repartition(5), block=20)) == want  # halves cut into several blocks
    assert spelling.grouped(df.limit(0)).count() == 0


def test_awkward_rows(spark):
    assert given(spelling.grouped(frames.docs(spark))) == expected(words_of(frames.rows()))


def test_registered(spark):
    from tillstone.llm import common, queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.read(spark, sf, "documents").select("doc_id", "text").collect()]
    words = words_of(rows)
    got = given(queries.QUERIES["op13_spelling_variants"](spark, sf))
    assert {w: x[0] for w, x in got.items()} == dict(words)
    some = sorted(words, key=lambda w: zlib.crc32(w.encode()))[:300]
    for w in some:
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if near and words[best] >= 10 * words[w] else None
        assert got[w][1:4] == (len(near), form, words[form] if form else None)
