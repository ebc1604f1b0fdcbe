"""Host rules, language ID, licences, class n-grams, toxicity and leaks on awkward rows."""

import collections
import math
import random
import re

import numpy as np
import pytest

from tests.llm import frames
from tillstone.llm import brown, decontaminate, hosts, langid, licences, toxicity


def by_row(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=frames.key)


# --- host rules --------------------------------------------------------------------------

def measured(text):
    words = frames.split(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if frames.split(x)]
    return len(words), sum(len(x) for x in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_host_rules_equal_brute_force(spark):
    got = by_row(hosts.judged(frames.docs(spark)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    expected = []
    for doc_id, text, *_ in frames.rows():
        n, chars, symbols, dup, repeats = measured(text)
        expected.append((doc_id, n, chars, symbols, dup, repeats, n < 20 or 100 * repeats > 30 * n))
    assert got == sorted(expected, key=frames.key)
    assert hosts.judged(frames.empty(spark)).count() == 0


def test_a_bad_host_is_strict_and_clean_documents_stay(spark):
    good, noisy = frames.text(1, 60), frames.text(2, 60) + " ###" * 20
    rows = [(i, noisy if i % 10 else good, "bad") for i in range(200)]
    rows += [(1000 + i, noisy if i % 10 == 0 else good, f"host{i // 20}") for i in range(400)]
    rows += [(2000, noisy, None), (2001, good, None)]
    kept = {r["doc_id"]: r["kept"] for r in hosts.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(kept[i] == (i % 10 == 0) for i in range(200))  # the bad host keeps what passes every rule
    assert all(kept[1000 + i] for i in range(400))  # a noisy one among many is let off
    assert kept[2001]


def planted(spark, bad_rate, seed=1):
    """Twenty hosts that fail one rule in twelve, as in the given tables, the first of them more often."""
    rnd, rows = random.Random(seed), []
    for i in range(10_000):
        host = i % 20
        fails = rnd.random() < (bad_rate if host == 0 else 1 / 12)
        rows.append((i, frames.text(rnd.randrange(40), 60) + (" ###" * 20 if fails else ""), f"src{host}", fails))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fails boolean")


@pytest.mark.parametrize("bad_rate", [1 / 12, 0.1, 0.25, 0.6])
def test_a_bad_host_stands_out_and_chance_does_not(spark, bad_rate):
    docs = planted(spark, bad_rate)
    lost = {r["source"] for r in hosts.judged(docs).where("not kept").join(docs, "doc_id").select("source", "fails").collect()}
    assert lost == ({"src0"} if bad_rate >= 0.25 else set())
    kept = hosts.judged(docs).where("kept").join(docs, "doc_id")
    assert kept.where("not fails").count() == docs.where("not fails").count()  # what passes every rule stays


def test_the_prior_leaves_out_what_chance_spreads(spark):
    same = hosts.host_rates(hosts.with_failures(hosts.measures(planted(spark, 1 / 12)))).collect()
    assert max(abs(r["rate"] - r["common"]) for r in same) < 0.01
    apart = {r["host"]: r for r in hosts.host_rates(hosts.with_failures(hosts.measures(planted(spark, 0.6)))).collect()}
    assert abs(apart["src0"]["rate"] - apart["src0"]["bad"] / apart["src0"]["n"]) < 0.01


# --- language ID -------------------------------------------------------------------------

def grams_of(word):
    """Letters, pairs and triples of the runs of letters, with marks around each run."""
    out = []
    for run in re.findall(r"[^\W\d_]+", word):
        if any(c.isalpha() for c in run):
            marked = f"_{run}_"
            out += [*run, *(marked[i:i + n] for n in (2, 3) for i in range(len(marked) - n + 1))]
    return out


def test_packed_grams():
    rnd = random.Random(6)
    letters = "aBz éÉñß²³½ªΣσςﬁİ1_9-.日本ꙮ𝒜😀\n\t\u00a0_"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(300)] + ["", "ΑΣ", "x" * 500, "²³", "İi"]
    keys, sizes = langid.grams([t.encode() for t in texts])
    parts = np.split(keys, np.cumsum(sizes)[:-1])
    for text, part in zip(texts, parts):
        assert [langid.unpacked(k) for k in part.tolist()] == sorted(g for w in text.lower().split() for g in grams_of(w))
        assert [langid.packed(langid.unpacked(k)) for k in part.tolist()] == part.tolist()


def profile_brute(texts, size):
    counts = collections.Counter(g for t in texts for w in (t or "").split() for g in grams_of(w.lower()))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def test_language_equals_brute_force(spark):
    train = [r for r in frames.rows() if frames.fold(r[0], 3) != 1 and r[2] is not None]
    learned = {x: profile_brute([r[1] for r in train if r[2] == x], langid.PROFILE) for x in sorted({r[2] for r in train})}
    expected = []
    for doc_id, text, *_ in frames.rows():
        own = profile_brute([text], langid.PROFILE)
        if not own:
            expected.append((doc_id, frames.fold(doc_id, 3) == 1, "und", 0.0))
            continue
        away = {x: sum(abs(i - (p.index(g) if g in p else langid.PROFILE)) for i, g in enumerate(own)) for x, p in learned.items()}
        best = min(away, key=lambda x: (away[x], x))
        expected.append((doc_id, frames.fold(doc_id, 3) == 1, best, 1 - away[best] / (langid.PROFILE * len(own))))
    got = by_row(langid.identified(frames.docs(spark)), "doc_id", "held_out", "lang_pred", "score")
    expected.sort(key=frames.key)
    assert [r[:3] for r in got] == [r[:3] for r in expected]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in expected])
    assert langid.identified(frames.empty(spark)).count() == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identified(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.where("lang = lang_pred").count() > 0.97 * found.count()
    learned = langid.profiles(docs)
    assert langid.accepted(docs, learned).count() == docs.count()  # all of them are texts in a language


# --- licences ----------------------------------------------------------------------------

def test_matching_statistics_equal_brute_force():
    automaton, rnd = licences.Automaton(), random.Random(3)
    templates = [licences.words_of(t.encode()) for _, t in licences.TEMPLATES]
    vocabulary = [*automaton.number, b"other"]
    for _ in range(60):
        words = []
        while len(words) < 60:
            t = rnd.choice(templates)
            at = rnd.randrange(len(t))
            words += t[at:at + rnd.randint(1, 9)] if rnd.random() < 0.7 else [rnd.choice(vocabulary)]
        numbers = np.array([automaton.number.get(w, 0) for w in words])
        runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [max((n for n in range(i + 2) if n == 0 or tuple(words[i - n + 1:i + 1]) in runs), default=0) for i in range(len(words))]
        assert [n for _, n in automaton.statistics(numbers.tolist())] == longest
        for at, k, place, length in automaton.matches(numbers):
            assert words[at:at + length] == templates[k][place:place + length]
            assert longest[at + length - 1] == length


def test_licence_columns(spark):
    rows = [(1, "Released under the MIT License. MIT  license!"), (2, "gnu GENERAL-public license / Apache license"), (3, "permission is hereby granted free of charge to any person obtaining a copy of the software and associated documentation files to deal in the software"), (4, None), (5, ""), (6, "mit-licence general public"), (7, "All rights reserved"), (None, "apache license")]
    got = {r["doc_id"]: r for r in licences.labelled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert tuple(got[1])[1:7] == (7, 2, 3, 5, "mit", "mit") and got[1]["score"] == 1
    assert tuple(got[2])[1:6] == (6, 2, 1, 4, "apache,gpl")
    assert got[3]["base_labels"] == "" and got[3]["labels"] == "mit" and got[3]["score"] > 0.8
    assert tuple(got[4])[1:] == tuple(got[5])[1:] == (0, 0, None, None, "", "", 0.0)
    assert got[6]["labels"] == "" and got[7]["labels"] == "reserved" and got[None]["labels"] == "apache"
    assert licences.labelled(frames.docs(spark)).count() == len(frames.rows())
    assert licences.labelled(frames.empty(spark)).count() == 0


# --- class n-grams -----------------------------------------------------------------------

def test_base_score_and_counts_equal_brute_force(spark):
    train = [r for r in frames.rows() if frames.fold(r[0], 7) != 2]
    counts = collections.Counter(w for r in train for w in [*frames.split(frames.lower(r[1])), None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for doc_id, text, *_ in frames.rows():
        words = [*frames.split(frames.lower(text)), None]
        expected.append((doc_id, frames.fold(doc_id, 7) == 2, len(words), sum(counts[w] > 0 for w in words), n,
                         sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)))
    got = by_row(brown.scored(frames.docs(spark)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    expected.sort(key=frames.key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in expected])
    assert brown.scored(frames.empty(spark)).count() == 0


def test_rare_words_are_looked_up(spark, monkeypatch):
    whole = by_row(brown.scored(frames.docs(spark)), "doc_id", "n_tokens", "n_known", "base_score")
    monkeypatch.setattr(brown, "HEAD", 12)
    few = by_row(brown.scored(frames.docs(spark)), "doc_id", "n_tokens", "n_known", "base_score")
    assert [r[:3] for r in whole] == [r[:3] for r in few]
    assert [r[3] for r in whole] == pytest.approx([r[3] for r in few])


def test_exchange_ends_where_no_move_raises_the_likelihood():
    def likelihood(pairs, member):
        one = np.eye(member.max() + 1)[member]
        table = one.T @ pairs @ one
        return sum(float(brown._xlogx(x).sum()) * sign for x, sign in ((table, 1), (table.sum(0), -1), (table.sum(1), -1)))

    rnd = np.random.default_rng(0)
    pairs, kind = rnd.integers(0, 4, (22, 22)).astype(float), rnd.integers(0, 3, 22)
    for i in range(2, 22):  # three kinds of words that follow one another in turn
        for j in range(2, 22):
            pairs[i, j] += rnd.integers(50, 60) if (kind[i] + 1) % 3 == kind[j] else 0
    start = brown.exchange(pairs, classes=3, sweeps=0)
    member = brown.exchange(pairs, classes=3, sweeps=50)
    end = likelihood(pairs, member)
    assert end > likelihood(pairs, start)
    for w in range(2, 22):
        for c in range(2, 5):
            moved = member.copy()
            moved[w] = c
            assert likelihood(pairs, moved) <= end + 1e-4


def kinds_of_words(spark):
    """Texts of 2,400 words of two kinds, each met five times: one follows "the", the other "they"."""
    rnd, texts = random.Random(6), []
    for _ in range(5):
        words = [(f"{kind}{k}", kind) for kind in "nv" for k in range(1200)]
        rnd.shuffle(words)
        for at in range(0, len(words), 8):
            texts.append(" ".join(f"the {w} is" if kind == "n" else f"they {w} it" for w, kind in words[at:at + 8]))
    fit = [(i, t) for i, t in enumerate(texts * 2) if frames.fold(i, 7) != 2]
    ids = [i for i in range(10_000, 11_000) if frames.fold(i, 7) == 2]
    pairs = [(w, f"{a} {w} {z}") for w in ("n7", "n1100", "v7", "v1100") for a, z in (("the", "is"), ("they", "it"))]
    asked = [(i, t) for i, (_, t) in zip(ids, pairs)]
    return fit + asked + [(ids[-1], "the zzz is it"), (ids[-2], "")], asked


def test_every_repeated_word_has_a_class(spark):
    rows, asked = kinds_of_words(spark)
    score = {r["doc_id"]: r["score"] for r in brown.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = [score[i] for i, _ in asked]
    for fit, unfit in ((0, 1), (2, 3), (5, 4), (7, 6)):  # a noun after "the", a verb after "they"
        assert got[fit] > got[unfit] + 1


@pytest.mark.parametrize("head", [brown.HEAD, 40])
def test_score_equals_brute_force_from_the_classes(spark, monkeypatch, head):
    monkeypatch.setattr(brown, "HEAD", head)
    rows, _ = kinds_of_words(spark)
    rows.append((None, "v1 n1 v1"))
    kept = []
    make = brown.Model
    monkeypatch.setattr(brown, "Model", lambda *a: kept.append(make(*a)) or kept[0])
    got = sorted((r for r in brown.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    member = dict(zip((x.decode() for x in kept[0].head), kept[0].member.tolist()))
    member.update((r["word"], r["class"]) for r in kept[0].others.collect())
    train = [t.split() for i, t in rows if frames.fold(i, 7) != 2]
    n = collections.Counter(w for t in train for w in t)
    assert set(member) == set(n) and all((member[w] > 1) == (n[w] > 1) for w in n)
    steps, size = collections.Counter(), collections.Counter()
    path = lambda t: [0, *(member.get(w, 1) for w in t), 0]
    for t in train:
        steps.update(zip(path(t), path(t)[1:]))
        size.update(path(t)[1:])
    out, once, side = collections.Counter(), sum(n[w] == 1 for w in n), kept[0].classes
    for (a, _), k in steps.items():
        out[a] += k
    for r, (_, text) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0]))):
        words, expected = text.split(), 0.0
        for w, (a, b) in zip([*words, None], zip(path(words), path(words)[1:])):
            share = (size[b] + 1) / (sum(size.values()) + side)
            expected += math.log10((steps[a, b] + brown.SMOOTHING * share) / (out[a] + brown.SMOOTHING))
            expected += 0 if b == 0 else math.log10((n[w] + 1) / (size[1] + once + 1)) if b == 1 else math.log10(n[w] / size[b])
        assert r["score"] == pytest.approx(expected)


def test_class_model_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = brown.scored(docs).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert row[0] > row[1]


# --- toxicity ----------------------------------------------------------------------------

def test_toxicity_on_planted_words(spark):
    insult = ["zugblat", "morblin"]
    rows = [(i, frames.text(i, 40 + i % 50) + (f" {insult[i % 2]}s " if i % 5 == 0 else " ") + frames.text(i + 7, 40)) for i in range(600)]
    docs = spark.createDataFrame([*rows, (9001, None), (9002, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), i) for i, _ in rows] + [(None, 1, 0), (3, None, 0), (9002, 0, 0)], "doc_id long, toxic int, quality int")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    held = [i for i, _ in rows if frames.fold(i, 5) == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _ in rows)
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[9001]["score"] == got[9002]["score"]
    none = toxicity.scored(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.scored(frames.empty(spark), labels).count() == 0
    assert toxicity.scored(frames.docs(spark), labels).count() == len(frames.rows())


# --- benchmark leaks ---------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_nearest_equals_brute_force():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = (np.array([rnd.randint(1, 4) for _ in range(rnd.randint(1, n))]) for n in (7, 10))
        cost, first, last = decontaminate.nearest(a, b)
        assert cost == min(edits(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == edits(a, b[first:last + 1])


def test_planted_passages_are_found_and_clean_documents_left(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 7, 8, 20, 40])))) for i in range(60)]
    rows, wanted = [], set()
    for i, text in items:
        own = text.split()
        for k in range(4):
            changed = list(own)
            for _ in range(len(own) * 5 * k // 100):
                at = rnd.randrange(len(changed))
                changed[at:at + rnd.randint(0, 1)] = [rnd.choice(words)] * rnd.randint(0, 1)
            before, after = ([rnd.choice(words) for _ in range(rnd.randint(0, 90))] for _ in range(2))
            doc = 1000 + 4 * i + k
            rows.append((doc, " ".join([*before, *changed, *after]).title()))
            wanted.add((doc, i))
    rows += [(i, " ".join(rnd.choice(words) for _ in range(200))) for i in range(300)]
    benchmark = spark.createDataFrame([*items, (77, None), (78, ""), (None, "w1 w2 w3")], "item_id long, text string")
    docs = spark.createDataFrame([*rows, (None, None), (5000, "")], "doc_id long, text string")
    got = decontaminate.leaks(docs, benchmark).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(wanted - pairs) <= 0.02 * len(wanted)
    texts = dict(rows)
    for r in got:  # every row is an exact distance within the bound, at the words it names
        item = dict(items)[r["item_id"]].split()
        part = texts[r["doc_id"]].lower().split()[r["first_word"]:r["last_word"] + 1]
        assert edits(item, part) == r["n_edits"] <= len(item) * decontaminate.MAX_EDITS_PCT // 100
    assert not [r for r in got if r["doc_id"] < 1000 and r["n_edits"] > 0 and len(dict(items)[r["item_id"]].split()) > 8]
    kept = {r["doc_id"] for r in decontaminate.clean(docs, benchmark).collect()}
    assert kept == {d for d, _ in [*rows, (None, None), (5000, "")]} - {d for d, _ in pairs}


def test_leaks_on_awkward_rows(spark):
    benchmark = spark.createDataFrame([(1, frames.rows()[4][1]), (1, frames.rows()[4][1])], "item_id long, text string")
    assert (4, 1) in {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frames.docs(spark), benchmark).collect()}
    assert decontaminate.leaks(frames.docs(spark), benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(frames.empty(spark), benchmark).count() == 0
    assert decontaminate.clean(frames.docs(spark), benchmark.limit(0)).columns == frames.docs(spark).columns


def edited(rnd, words, others, n):
    """``words`` with ``n`` of them replaced, dropped or doubled by another."""
    words = list(words)
    for _ in range(n):
        at, kind = rnd.randrange(len(words)), rnd.randrange(3)
        words[at:at + (kind != 2)] = [] if kind == 1 and len(words) > 1 else [rnd.choice(others)]
    return words


def recall(n, exact, items=200):
    """The share of items of ``n`` words found in texts that hold them, as they are or with all edits allowed."""
    rnd = random.Random(n)
    words, others = [f"w{i}" for i in range(2000)], [f"w{i}" for i in range(3000)]
    own = [[rnd.choice(words) for _ in range(n)] for _ in range(items)]
    tables = decontaminate.Tables([(i, " ".join(x).encode()) for i, x in enumerate(own)])
    texts = []
    for x in own:
        changed = x if exact else edited(rnd, x, others, n * decontaminate.MAX_EDITS_PCT // 100)
        before, after = ([rnd.choice(others) for _ in range(rnd.randint(0, 60))] for _ in range(2))
        texts.append(" ".join([*before, *changed, *after]).encode())
    found = {(t, k) for t, k, *_ in tables.search(texts)}
    return sum((i, i) in found for i in range(items)) / items


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 25, 30, 40, 60, 120])
def test_recall_at_every_length(n):
    assert recall(n, exact=True) == 1.0
    assert recall(n, exact=False) == 1.0 if n < decontaminate.WALKED else recall(n, exact=False) >= 0.97


def test_many_items_of_distinct_words():
    items = [(i, " ".join(f"i{i}x{k}" for k in range(30)).encode()) for i in range(3000)]
    tables = decontaminate.Tables(items)
    found = [(t, k, edits) for t, k, edits, *_ in tables.search([b"before " + text + b" after" for _, text in items])]
    assert found == [(i, i, 0) for i in range(3000)]
    assert tables.held.nbytes + tables.counts.nbytes + tables.marks.nbytes < 50 * 90_000  # in proportion to words, not items by words


def every_match(items, texts):
    """(text, item, edits) of all items within the bound, by the exact distance over every whole text."""
    out = set()
    for t, text in enumerate(texts):
        part = licences.words_of(text)
        for k, item in enumerate(items):
            number = {}
            a, b = (np.array([number.setdefault(w, len(number)) for w in x]) for x in (licences.words_of(item), part))
            if len(b):
                cost = decontaminate.nearest(a, b)[0]
                if cost <= len(a) * decontaminate.MAX_EDITS_PCT // 100:
                    out.add((t, k, cost))
    return out


def test_leaks_equal_the_exact_search(spark):
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(40)]  # few words, so that much is alike by chance
    items = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 45))) for _ in range(40)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 120))) for _ in range(60)]
    for item in items:
        own = item.split()
        texts.append(" ".join([*edited(rnd, own, words, rnd.randint(0, len(own) // 5)), "tail", rnd.choice(items)]))
    want = every_match([x.encode() for x in items], [x.encode() for x in texts])
    got = {(r["doc_id"], r["item_id"], r["n_edits"]) for r in decontaminate.leaks(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"),
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert {x[:2] for x in got} <= {x[:2] for x in want}
    assert len({x[:2] for x in want} - {x[:2] for x in got}) <= 0.02 * len(want)
    assert len(got & want) >= 0.98 * len(got)  # the least distance, but for a few nearer places not met
