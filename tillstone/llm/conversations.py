"""Conversation structure repair by Viterbi with survivor coalescence.

A conversation is right if its roles are an optional system turn and then one or more pairs of
user and assistant, or if it is empty. Keeping a turn costs nothing, giving it another
role 3, deleting it 4, inserting an empty turn 3, and leaving a truncated turn in 3; blank and
repeated turns must go. The cheapest edits are found turn by turn. At most four survivors are
carried along, one for each place in the role pattern: its cost, its edits as a path in
a tree of backpointers, and the hash of its repaired text so far. A tree node counts the paths
through it and goes with the last; once all survivors pass through one node, the edits
up to there are settled and leave the tree. So what is held does not grow with the
conversation but with the stretch that is still undecided, a few bytes a turn and no text.

Of equally cheap edits the least in ASCII is taken. Survivors of equal cost are compared
by their whole undecided edits: their order is kept as a rank and brought up to date with
each turn. That is enough, since two different paths over the same turns differ before
either ends; if one only had further insertions at its end, it would cost more.

Turns of a conversation meet in one task as a sorted stream, because the hash of a conversation
is sequential. What a turn must know of all others, whether role and text were seen at an earlier turn number,
is found before, by joins on hashes, and comes as marks in the same stream.

Nulls: a null id, turn number, role or text stands for one space; a null id is a conversation of its
own, a null turn number comes first. Turns of one number are taken in order of role and text.
Repeated rows are repeated turns. A conversation whose rows are all dropped is there with zeros.
An empty table gives no rows. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillstone.llm import common

RELABEL, DELETE, INSERT, LEFT_TRUNCATED = 3, 4, 3, 3
#: Places in the role pattern; the empty one and the one after an assistant may end it.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Insertions that can be of use before a turn, by place.
_INSERTS = (2, 2, 1, 1)
_LEGAL = {"su", "ua", "au"}
SPACE, SALTS = " \t\n\x0b\x0c\r", 16

Config = tuple[tuple[int, int] | None, ...]


def _after(place: int) -> int:
    """The place after a user or assistant turn, whichever the pattern wants."""
    return ASSISTANT if place == USER else USER


@lru_cache(maxsize=None)
def step(config: Config, initial: str, forced: bool, truncated: bool) -> tuple[Config, int, tuple]:
    """One turn: the survivors' costs and ranks after it, the cost common to all, and where each comes from.

    ``config`` holds (cost, rank) by place, least cost 0. Costs and ranks are small, so few
    different calls exist however long the conversation is.
    """
    best: list[tuple | None] = [None] * 4
    for place, held in enumerate(config):
        if held is None:
            continue
        cost, rank = held
        offers = [(place, cost + DELETE, "D")]  # insertions before it are better made after it
        at, more = place, cost + LEFT_TRUNCATED * truncated
        for inserted in range(0 if forced else _INSERTS[place] + 1):
            if inserted:
                at, more = _after(at), more + INSERT
            offers.append((_after(at), more + RELABEL, "I" * inserted + "R"))
            if initial == ("a" if at == USER else "u"):
                offers.append((_after(at), more, "I" * inserted + "K"))
            if initial == "s" and at == START:
                offers.append((SYSTEM, more, "K"))
        for target, total, letters in offers:
            offer = (total, (rank, letters), place)
            if best[target] is None or offer < best[target]:
                best[target] = offer
    _prune(best)
    least = min(b[0] for b in best if b)
    ranks = {key: i for i, key in enumerate(sorted(b[1] for b in best if b))}
    return (
        tuple(b and (b[0] - least, ranks[b[1]]) for b in best), least,
        tuple(b and (b[2], b[1][1]) for b in best),
    )


def _prune(best: list[tuple | None]) -> None:
    """Drops survivors that cannot be part of the cheapest edits, so that costs stay close.

    What can follow an assistant turn can follow a system turn, and but for a system turn, which
    may be deleted, the start; a user and an assistant turn are one insertion apart.
    """
    def cost(place: int) -> float:
        return best[place][0] if best[place] else float("inf")

    user, assistant = min(cost(USER), cost(ASSISTANT) + INSERT), min(cost(ASSISTANT), cost(USER) + INSERT)
    bounds = (assistant + DELETE, assistant, user, assistant)
    for place, bound in enumerate(bounds):
        if cost(place) > bound:
            best[place] = None


class Node:
    """The edits of one turn, after those of ``parent``; ``live`` are the nodes that follow."""

    __slots__ = ("edits", "live", "parent")

    def __init__(self, parent: Node | None, edits: str) -> None:
        self.parent, self.edits, self.live = parent, edits, []
        if parent is not None:
            parent.live.append(self)


class Conversation:
    """Survivors over the turns of one conversation; ``held`` nodes are undecided."""

    def __init__(self) -> None:
        self.config: Config = ((0, 0), None, None, None)
        self.cost = 0
        self.root = Node(None, "")
        self.heads: list[Node | None] = [self.root, None, None, None]
        self.hashes = [hashlib.sha256(), None, None, None]
        self.settled = io.StringIO()
        self.held = 0
        self.counts = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal
        self.before: str | None = None
        self.turns = [None, None, 0]  # least, largest, different

    def number(self, turn: int | None) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]

    def add(self, role: str, text: bytes, blank: bool, duplicate: bool, truncated: bool) -> None:
        initial = role[:1]
        if self.before is not None and self.before + initial not in _LEGAL:
            self.counts[3] += 1
        self.before = initial
        duplicate, truncated = duplicate and not blank, truncated and not blank and not duplicate
        for i, fault in enumerate((blank, duplicate, truncated)):
            self.counts[i] += fault
        self.config, more, choices = step(self.config, initial if initial in "sua" else "", blank or duplicate, truncated)
        self.cost += more
        heads, hashes = [None] * 4, [None] * 4
        for target, choice in enumerate(choices):
            if choice:
                place, edits = choice
                heads[target] = Node(self.heads[place], edits)
                hashes[target] = _hashed(self.hashes[place].copy(), place, edits, role, text)
                self.held += 1
        old, self.heads, self.hashes = self.heads, heads, hashes
        for node in filter(None, old):
            while node is not self.root and not node.live:  # no survivor passes through it
                node.parent.live.remove(node)
                node, self.held = node.parent, self.held - 1
        while len(self.root.live) == 1:  # all survivors pass through the next node
            self.root = self.root.live[0]
            self.root.parent = None
            self.settled.write(self.root.edits)
            self.held -= 1

    def end(self) -> dict[str, object]:
        tails = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        cost, _, place = min(
            (held[0] + INSERT * len(tails[p]), (held[1], tails[p]), p) for p, held in enumerate(self.config) if held)
        edits, node = [tails[place]], self.heads[place]
        while node is not self.root:
            edits.append(node.edits)
            node = node.parent
        low, high, different = self.turns
        return {
            "gaps": high - low + 1 - different if different else 0,
            **dict(zip(("blank", "duplicate", "truncated", "illegal"), self.counts)),
            "cost": self.cost + cost, "audit": self.settled.getvalue() + "".join(reversed(edits)),
            "repaired_sha256": _hashed(self.hashes[place], place, tails[place], "", b"").hexdigest(),
        }


def outputs(place: int, edits: str, role: str, text: bytes) -> Iterator[tuple[str, str, bytes]]:
    """(edit, role, text) of each turn that edits made from ``place`` leave or put in."""
    for edit in edits:
        if edit == "D":
            continue
        wanted = "assistant" if place == USER else "user"
        if edit == "K":
            place = SYSTEM if place == START and role[:1] == "s" else _after(place)
            yield edit, role, text
        else:
            place = _after(place)
            yield edit, wanted, text if edit == "R" else b""


def _hashed(digest, place: int, edits: str, role: str, text: bytes):
    first = place == START
    for _, own, content in outputs(place, edits, role, text):
        digest.update(b"%s%s:" % (b"" if first else b"\n", own.encode()))
        digest.update(content)
        first = False
    return digest


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, kind) after the damage; kind -1 stands for a dropped row, 1 for a turn.

    The damage depends on the crc32 of id and turn number: one twentieth each of the turns are
    dropped, emptied, robbed of their full stops, repeated and given to the user.
    """
    def shown(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        shown(F.col("role")).alias("role"), shown(F.col("text")).alias("text"),
        (F.crc32(F.concat(shown(F.col("conv_id")), F.lit(":"), shown(F.col("turn"))).cast("binary")) % 20).alias("damage"))
    times = F.when(F.col("damage") == 0, F.array(F.lit(-1))).when(F.col("damage") == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage").isin(0, 1), "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(times).alias("kind"))


def stream(turns: DataFrame) -> DataFrame:
    """Turns with their faults, and marks (kind 0) of texts seen at an earlier turn number, by conversation and in order."""
    shut = F.expr(r"trim(TRAILING ' \t\n\u000b\f\r' FROM text)")
    rows = turns.select(
        "*", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))).alias("digest"),
        (shut == "").alias("blank"), (~F.right(shut, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    own, at = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.struct(F.col("turn").isNotNull(), "turn")
    keys = (rows.where("kind = 1").select(own.alias("own"), "conv_id", "digest", "turn").distinct()
            .withColumn("at", at).withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")))
    first = (keys.groupBy("own", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1")
             .withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))))
    marks = keys.join(first, ["own", "digest", "salt"]).where("at > first").select(
        "conv_id", "turn", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).alias("kind"), "digest",
        F.lit(False).alias("blank"), F.lit(False).alias("truncated"))
    return (rows.unionByName(marks).repartition("conv_id")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "kind", "role", "text"))


_COLUMNS = ("conv_id", "turn", "kind", "role", "text", "digest", "blank", "truncated")
SCHEMA = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, repaired_sha256 string"
)
_FIELDS = pa.schema([
    pa.field(name, pa.string() if kind == "string" else pa.int64())
    for name, kind in (x.split() for x in SCHEMA.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for part in common.slices(batch, "text", 1 << 20):
            columns = [part.column(c).cast(pa.binary()) if c == "text" else part.column(c) for c in _COLUMNS]
            yield from zip(*(c.to_pylist() for c in columns))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: list[dict[str, object]] = []
    current: Conversation | None = None
    own = at = last = None
    marked: set[bytes] = set()
    for conv, turn, kind, role, text, digest, blank, truncated in _rows(batches):
        if current is None or conv != own:
            if current is not None:
                done.append({"conv_id": own, **current.end()})
            current, own, at, last = Conversation(), conv, (), None
        if at != (turn,):
            at, last, marked = (turn,), None, set()
        if kind == 0:
            marked.add(digest)
        elif kind == 1:
            current.number(turn)
            current.add(role, text, blank, digest in marked or digest == last, truncated)
            last = digest
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema=_FIELDS)
            done = []
    if current is not None:
        done.append({"conv_id": own, **current.end()})
    yield pa.RecordBatch.from_pylist(done, schema=_FIELDS)


def audited(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns`` (as ``damaged`` gives them): faults, cheapest edits and hash of the repaired text."""
    return common.in_arrow(stream(turns).select(*_COLUMNS), _repaired, SCHEMA)


def repaired(turns: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text): the turns that are left or put in, in order from 0.

    The edits, found by ``audited``, go ahead of their conversation in the stream and are applied
    turn by turn, so no text is held.
    """
    audits = audited(turns) if audits is None else audits
    rows = turns.where("kind = 1").select("conv_id", "turn", "role", "text", F.lit(1).alias("kind")).unionByName(
        audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(-1).alias("kind")))
    ordered = rows.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("kind") > 0, F.col("turn").asc_nulls_first(), "role", "text")
    return common.in_arrow(ordered, _applied, "conv_id long, position long, edit string, role string, text string")


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("conv_id", "position", "edit", "role", "text")
    kinds = pa.schema([pa.field(n, pa.int64() if n in names[:2] else pa.string()) for n in names])
    audit, at, place, position = "", 0, START, 0
    left: tuple[int | None, str, int] | None = None
    for batch in batches:
        for part in common.slices(batch, "text", 1 << 20):
            out: list[tuple] = []
            for conv, kind, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                if kind < 0:
                    out += _ending(left, audit[at:], place, position)
                    audit, at, place, position, left = text, 0, START, 0, (conv,)
                    continue
                upto = at
                while audit[upto] == "I":
                    upto += 1
                for edit, own, content in outputs(place, audit[at:upto + 1], role, text.encode()):
                    out.append((conv, position, edit, own, content.decode()))
                    place = SYSTEM if place == START and edit == "K" and own[:1] == "s" else _after(place)
                    position += 1
                at = upto + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)] if out else [pa.array([], f.type) for f in kinds], schema=kinds)
    out = _ending(left, audit[at:], place, position)
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)] if out else [pa.array([], f.type) for f in kinds], schema=kinds)


def _ending(left: tuple | None, edits: str, place: int, position: int) -> list[tuple]:
    """Turns inserted after the last one of a conversation."""
    if left is None:
        return []
    return [(left[0], position + i, edit, role, text.decode()) for i, (edit, role, text) in enumerate(outputs(place, edits, "", b""))]


def repair_audit(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, faults, cost, audit, repaired_sha256) of the damaged conversations."""
    return audited(damaged(conversations))
