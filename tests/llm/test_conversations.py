"""Conversation repair against every edit sequence (short) and a backward search (long)."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from tillstone.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, kind int, digest int, own string"


def shown(x) -> str:
    return " " if x is None else str(x)


def after_damage(rows):
    """{conv_id: rows in order} of the damaged table."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = shown(role), shown(text)
        damage = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        out[conv] += []
        if damage == 0:
            continue
        if damage == 1:
            text = ""
        if damage == 2:
            text = re.sub("[.!?]", "", text)
        if damage == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if damage == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, v in out.items()}


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def by_enumeration(turns, found):
    """(cost, audit, roles and texts) over all edits with up to two insertions between turns."""
    best = None
    gaps = ["", "u", "a", "uu", "ua", "au", "aa"]
    each = []
    for (_, role, text), fault in zip(turns, found):
        options = [("D", 4, None)]
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            options += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        each.append(options)
    for choice in itertools.product(*each):
        for between in itertools.product(gaps, repeat=len(turns) + 1):
            cost = sum(c[1] for c in choice) + 3 * sum(map(len, between))
            if best and cost > best[0]:
                continue
            audit, kept = "", []
            for gap, edit in itertools.zip_longest(between, choice):
                audit += "I" * len(gap) + (edit[0] if edit else "")
                kept += [({"u": "user", "a": "assistant"}[g], "") for g in gap] + ([edit[2]] if edit and edit[2] else [])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
                found_ = (cost, audit, kept)
                if best is None or found_[:2] < best[:2]:
                    best = found_
    return best


def by_suffixes(turns, found):
    """The same from the last turn back, where the cheapest and least ending of each place is exact."""
    inf = (10 ** 9, "", ())
    place_after = {"s": "S", "u": "U", "a": "A"}
    pattern = {"": "su", "S": "u", "U": "a", "A": "u"}

    def inserted(table):
        out = dict(table)
        for _ in range(3):
            for place, nexts in pattern.items():
                name = "a" if "a" in nexts else "u"
                cost, audit, kept = out[place_after[name]]
                offer = (cost + 3, "I" + audit, (({"u": "user", "a": "assistant"}[name], ""), kept))
                if offer[:2] < out[place][:2]:
                    out[place] = offer
        return out

    table = inserted({"": (0, "", ()), "S": inf, "U": inf, "A": (0, "", ())})
    for (_, role, text), fault in zip(reversed(turns), reversed(found)):
        new = {}
        for place, nexts in pattern.items():
            cost, audit, kept = table[place]
            offers = [(cost + 4, "D" + audit, kept)]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for name in nexts:
                    cost, audit, kept = table[place_after[name]]
                    if role[:1] == name:
                        offers.append((cost + more, "K" + audit, ((role, text), kept)))
                    if name != "s":
                        offers.append((cost + more + 3, "R" + audit, (({"u": "user", "a": "assistant"}[name], text), kept)))
            new[place] = min(offers, key=lambda o: o[:2])
        table = inserted(new)
    cost, audit, kept = table[""]
    rows = []
    while kept:
        rows.append(kept[0])
        kept = kept[1]
    return cost, audit, rows


def digest(kept) -> str:
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def expected(rows, search):
    out = {}
    for conv, turns in after_damage(rows).items():
        found = faults(turns)
        cost, audit, kept = search(turns, found)
        numbers = [t for t, *_ in turns if t is not None]
        initials = [r[:1] for _, r, _ in turns]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, digest(kept))
    return out


def given(df):
    return {r[0]: tuple(r[1:]) for r in cv.repair_audit(df).collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def conversation(rnd, conv, n, texts=("Yes.", "no", "What?", "", " \n", "So!", "été", None)):
    turn, rows = rnd.choice([0, 0, 3, -2]), []
    for _ in range(n):
        rows.append((conv, rnd.choice([turn, turn, turn, None]) if n < 5 else turn, rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rnd.choice(texts)))
        turn += rnd.choice([1, 1, 1, 2, 0])
    return rows


def test_short_ones_against_all_edits(spark):
    rnd = random.Random(3)
    rows = [r for c in range(150) for r in conversation(rnd, c, rnd.randrange(1, 4))]
    rows = [r for r in rows if len([x for x in rows if x[0] == r[0]]) < 4]
    small = {c for c, t in after_damage(rows).items() if len(t) <= 3}
    rows = [r for r in rows if r[0] in small]
    assert given(frame(spark, rows)) == expected(rows, by_enumeration)
    assert expected(rows, by_suffixes) == expected(rows, by_enumeration)


def test_awkward_conversations(spark):
    rnd = random.Random(4)
    rows = [r for c in range(400) for r in conversation(rnd, c if c % 50 else None, rnd.randrange(1, 30))]
    rows += [(1000, t, "user", f"again {t}.") for t in range(300)]  # never settled before the end
    rows += [(1001, None, "user" if t % 2 else "assistant", f"{t}.") for t in range(60)] + [(1002, 5, "user", "Same.")] * 40
    rows += [(1003, t, ("user", "assistant")[t % 2], "x" * 300_000 + ".") for t in range(3)] + [(2 ** 62, -(2 ** 62), None, None)]
    want = expected(rows, by_suffixes)
    df = frame(spark, rows)
    assert given(df) == want
    assert given(df.repartition(13)) == want
    assert cv.repair_audit(df.limit(0)).count() == 0


def test_dropped_whole(spark):
    gone = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    empty = hashlib.sha256(b"").hexdigest()
    assert given(frame(spark, [(c, 0, "user", "Hi.") for c in gone])) == {c: (0, 0, 0, 0, 0, 0, "", empty) for c in gone}


def test_repaired_rows_give_the_hash(spark):
    rnd = random.Random(8)
    rows = [r for c in range(120) for r in conversation(rnd, c if c % 30 else None, rnd.randrange(1, 12))]
    turns = cv.damaged(frame(spark, rows))
    audits = {r["conv_id"]: r for r in cv.audited(turns).collect()}
    parts = defaultdict(list)
    for r in sorted(cv.repaired(turns).collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"], r["position"])):
        assert len(parts[r["conv_id"]]) == r["position"]
        parts[r["conv_id"]].append((r["role"], r["text"]))
    for conv, a in audits.items():
        assert digest(parts[conv]) == a["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in parts[conv]))


def test_what_is_held_does_not_grow_with_the_conversation():
    rnd, held = random.Random(1), 0
    one = cv.Conversation()
    for i in range(30_000):
        role = ("user", "assistant")[i % 2] if rnd.random() > 0.05 else rnd.choice(["user", "assistant", "system"])
        one.add(role, b"text.", rnd.random() < 0.02, rnd.random() < 0.02, rnd.random() < 0.05)
        held = max(held, one.held)
    assert held < 100 and len(one.end()["audit"]) >= 30_000
    assert cv.step.cache_info().currsize < 5_000


def test_registered(spark):
    from tillstone.llm import common, queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op12_conversation_repair"](spark, sf).collect()}
    assert got == expected(rows, by_suffixes)
