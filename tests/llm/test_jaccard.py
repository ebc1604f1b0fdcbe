"""The Jaccard join against all pairs."""

import random

import numpy as np

from tests.llm import frames
from tillstone.llm import common, jaccard


def shingles(text):
    words = frames.split(frames.lower(text))
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """(set size, least id of the component) by id, from all pairs."""
    sets = {}
    for doc_id, text in rows:
        if doc_id is not None:
            sets[doc_id] = shingles(text)
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in sets}


def copies(seed: int):
    """Texts of many sizes over few words with edits around the bound, and one large group."""
    rnd, out = random.Random(seed), []
    for size in (1, 3, 4, 5, 6, 7, 9, 12, 16, 22, 30, 45, 70, 110, 160, 250):
        base = [rnd.choice("abcdefghijklmn") for _ in range(size)]
        for _ in range(60 if size == 110 else 12):
            words = list(base)
            for _ in range(rnd.randint(0, 1 + size // 18)):
                at = rnd.randrange(len(words)) if words else 0
                words[at:at + rnd.randint(0, 1)] = [rnd.choice("abcxyz")] * rnd.randint(0, 1)
            out.append((len(out), " ".join(words)))
    return out


def test_components_equal_brute_force(spark):
    rows = copies(4)
    got = {r[0]: (r[1], r[2]) for r in jaccard.clustered(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_awkward_rows(spark):
    got = jaccard.clustered(frames.docs(spark)).collect()
    rows = [(r[0], r[1]) for r in frames.rows()]
    expected = brute(rows)
    assert sorted(tuple(r) for r in got if r[0] is not None) == sorted((d, *expected[d]) for d, _ in rows if d is not None)
    assert sorted(tuple(r)[1:] for r in got if r[0] is None) == [(0, None), (len(shingles(frames.rows()[1][1])), None)]
    assert jaccard.clustered(frames.empty(spark)).count() == 0


def test_linked_sets_share_a_signature_whatever_the_sketch():
    rnd = random.Random(9)
    for trial in range(300):
        size = rnd.choice([1, 2, 3, 5, 8, 13, 21, 40, 90, 140, 300])
        a = np.array(rnd.sample(range(1, 1 << 62), size), np.uint64)
        drop = rnd.randint(0, size // 4)
        b = np.concatenate((a[drop:], np.array(rnd.sample(range(1, 1 << 62), rnd.randint(0, max(0, size // 7))), np.uint64)))
        both = len(np.intersect1d(a, b))
        if not len(b) or not jaccard.linked(both, len(a), len(b)):
            continue
        sketch = np.random.default_rng(trial).integers(0, 2000, 1 << jaccard.SKETCH_BITS) ** 2 // 1000 if trial % 2 else None
        flat, sizes = np.concatenate((np.sort(a), np.sort(b))), np.array([len(a), len(b)])
        sigs, owners = jaccard.signatures(flat, sizes, sketch)
        assert set(sigs[owners == 0].tolist()) & set(sigs[owners == 1].tolist()), (size, len(a), len(b), both)


def test_linked_sets_share_a_signature_when_what_differs_comes_first():
    pool = np.array(random.Random(3).sample(range(1, 1 << 62), 600), np.uint64)
    pool = pool[np.argsort(common.mixed(pool ^ np.uint64(0xA5A5A5A5A5A5A5A5)))]  # the order of signatures
    cases, sets = [], []
    for a in range(1, 201):
        for b in range(a, jaccard.largest_partner(a) + 1):
            least = next(s for s in range(a + 1) if jaccard.linked(s, a, b))
            for shared in range(least, a + 1) if a <= 60 else (least,):
                own, both = a - shared, a + b - 2 * shared
                cases.append((a, b, shared))
                sets += [np.concatenate((pool[:own], pool[both:both + shared])), pool[own:both + shared]]
    for sketch in (None, np.zeros(1 << jaccard.SKETCH_BITS, np.int64)):
        lost = []
        for at in range(0, len(cases), 500):
            some = sets[2 * at:2 * at + 1000]
            sigs, owners = jaccard.signatures(np.concatenate(some), np.array([len(x) for x in some]), sketch)
            of = [set(x.tolist()) for x in np.split(sigs[np.argsort(owners, kind="stable")], np.cumsum(np.bincount(owners, minlength=len(some)))[:-1])]
            lost += [case for case, x, y in zip(cases[at:at + 500], of[::2], of[1::2]) if not x & y]
        assert not lost


def test_common_shingles_are_counted_exactly_and_come_last(spark):
    line = "one line that very many of the documents have"
    rows = [(i, f"{line} " + " ".join(f"u{i}x{k}" for k in range(12))) for i in range(80)] + [(100 + i, "the same text again and again") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    levels = jaccard.common_levels(df, 1000, 8)
    of = lambda text: jaccard.common_class(levels, jaccard.shingle_sets([text.encode()])[0])
    assert len(levels) == 1 << jaccard.SKETCH_BITS
    assert of(line).tolist() == [2] * 5  # 80 sets are over twice 32
    assert not of("the same text again and again").any()  # equal sets of a slice are one
    assert np.count_nonzero(levels) == 5
    flat, sizes = jaccard.shingle_sets([rows[0][1].encode(), rows[1][1].encode()])
    sigs, owners = jaccard.signatures(flat, sizes, levels)
    assert not set(sigs[owners == 0].tolist()) & set(sigs[owners == 1].tolist())


def test_levels_of_cells():
    values = np.array([5, 5, 5, 1 << 31, 1 << 31, 9], np.uint32)
    times = np.array([20, 20, 30, 16, 16, 33])
    got = jaccard.levels_of(values, times, 4)
    assert got.tolist() == [2] + [0] * 15  # 70 and 33 times fall on the first cell, 32 is not more than COMMON
    assert not jaccard.levels_of(values[:0], times[:0], 4).any()


def test_most_lacking_is_what_linked_sets_can_lack():
    for a in range(1, 80):
        for partner in range(1, 110):
            lacking = [a - s for b in range(partner, 110) for s in range(min(a, b) + 1) if jaccard.linked(s, a, b)]
            if lacking:
                assert jaccard.most_lacking(a, max(partner, -(-3 * a // 4))) == max(lacking)


def test_a_text_contained_in_a_longer_one_is_linked(spark):
    rnd = random.Random(12)
    rows = []
    for k in range(40):
        words = [f"w{k}x{rnd.randrange(10**6)}" for _ in range(12)]
        cut = k % 3
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[cut:cut + 10]))]
    got = {r[0]: (r[1], r[2]) for r in jaccard.clustered(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_bands_and_distances():
    for (low, high), (after, _) in zip(jaccard._BANDS[:40], jaccard._BANDS[1:41]):
        assert after == high + 1 and jaccard.largest_partner(low) == high
    for a in range(1, 60):
        for b in range(a, 80):
            most = max((s for s in range(a + 1) if jaccard.linked(s, a, b)), default=None)
            least = next((s for s in range(a + 1) if jaccard.linked(s, a, b)), None)
            if least is not None:
                assert a + b - 2 * least <= jaccard.largest_distance(a, b) and most == a


def test_marks_never_part_linked_sets_and_part_most_others(spark):
    rnd, rows, linked = random.Random(6), [], []
    for k in range(300):
        a = np.array(rnd.sample(range(1 << 62), rnd.choice([1, 3, 40, 300, 900, 2500])), np.uint64)
        b = np.concatenate((a[rnd.randint(0, len(a) // (7 if k % 2 else 1)):], np.array(rnd.sample(range(1 << 62), rnd.randint(0, len(a) // 7)), np.uint64)))
        rows.append((k, len(a), len(b), *jaccard.marks_of(a).tolist(), *jaccard.marks_of(b).tolist()))
        linked.append(len(b) > 0 and jaccard.linked(len(np.intersect1d(a, b)), len(a), len(b)))
    names = ["k", "n_a", "n_b", *[f"{m}_a" for m in jaccard.MARKS], *[f"{m}_b" for m in jaccard.MARKS]]
    near = {r["k"] for r in spark.createDataFrame(rows, ", ".join(f"{x} long" for x in names)).where(jaccard._near_marks()).select("k").collect()}
    assert {k for k, x in enumerate(linked) if x} <= near
    assert sum(k not in near for k, x in enumerate(linked) if not x) > 0.8 * linked.count(False)


def test_cells_never_promise_too_little():
    rnd = random.Random(5)
    for _ in range(200):
        a = np.array(rnd.sample(range(1 << 62), rnd.choice([1, 50, 700, 1500, 4000])), np.uint64)
        b = np.concatenate((a[rnd.randint(0, len(a) - 1):], np.array(rnd.sample(range(1 << 62), rnd.randint(0, 900)), np.uint64)))
        most = jaccard.most_shared(jaccard.cells_of(a), jaccard.cells_of(b))
        assert most is None or most >= len(np.intersect1d(a, b))
    same = np.array([8 * 1024 * k for k in range(1, 600)], np.uint64)
    assert jaccard.most_shared(jaccard.cells_of(same), jaccard.cells_of(same)) is None


def test_near_copies_that_no_hub_joins_at_first_are_not_compared_in_all_pairs(spark, monkeypatch):
    run = lambda tag, k: [f"{tag}{i}" for i in range(k)]
    # Six families share a passage, the only shingles they are met by: what is a family's own, other texts make more common.
    texts = [" ".join([*run("p", 40), f"u{f}x{c}", *run(f"q{f}x", 30)]) for f in range(6) for c in range(40)]
    texts += [" ".join(w for f in range(6) for w in [*run(f"q{f}x", 30), *run(f"z{k}x{f}x", 16)]) for k in range(220)]
    counts, verified = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets: counts.append(pairs.count()) or verified(pairs, sets))
    got = {r[0]: r[2] for r in jaccard.clustered(spark.createDataFrame(enumerate(texts), "doc_id long, text string")).collect()}
    assert got == {k: k // 40 * 40 if k < 240 else k for k in range(460)}
    assert sum(counts) < 2000, counts  # 240 near copies have 4,680 pairs


def test_a_task_packs_a_row_for_a_bucket_however_many_slices_it_reads(spark, monkeypatch):
    seen, groups, counted = {}, jaccard._groups, jaccard._counted
    monkeypatch.setattr(jaccard, "_groups", lambda packed, *a: seen.update(packed=packed.count()) or groups(packed, *a))
    monkeypatch.setattr(jaccard, "_counted", lambda rows, top: seen.update(top=top, counted=counted(rows, top).count()) or counted(rows, top))
    rows = [*copies(8), (None, "a row without an id"), (10**6, None), (10**6 + 1, " ")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")  # a slice is of one batch
    try:
        got = {r[0]: (r[1], r[2]) for r in jaccard.clustered(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect() if r[0] is not None}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)
    assert seen["packed"] <= 4 * 8 and seen["top"] == 3 and seen["counted"] <= 4 * 8, seen


def test_what_a_task_holds_is_handed_out_in_parts_with_the_same_result(spark, monkeypatch):
    rows = copies(10)
    parts, groups = [], jaccard._groups
    monkeypatch.setattr(jaccard, "_groups", lambda packed, *a: parts.append(packed.where("bucket = 0").count()) or groups(packed, *a))
    monkeypatch.setattr(jaccard, "HELD_BYTES", 1 << 12)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        got = {r[0]: (r[1], r[2]) for r in jaccard.clustered(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute(rows)
    assert parts[0] > 2, parts
