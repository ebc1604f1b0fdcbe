"""What a statement reads and calls, from the statement as Spark parses it.

Patterns over text can be spelled around. Here the parsed plan is walked with the names in scope:
a relation must be a published one or a name that a WITH clause around it defines, whatever
quotes, case or comments it is written with.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

from pyspark.errors import ParseException
from pyspark.sql import SparkSession

#: Functions that reach outside the data: Java methods, the file read, and the session.
REFUSED_FUNCTIONS = frozenset({
    "reflect", "try_reflect", "java_method", "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_catalog", "current_database", "current_schema", "current_user", "session_user", "user", "version",
})
#: Functions that stand for a table and read none.
TABLE_FUNCTIONS = frozenset({"explode", "explode_outer", "posexplode", "inline", "inline_outer", "range", "stack"})


class NotReadOnly(ValueError):
    """The statement is not a plain read of published views."""


@dataclass
class Reads:
    relations: set[tuple[str, ...]] = field(default_factory=set)
    functions: set[str] = field(default_factory=set)
    table_functions: set[str] = field(default_factory=set)
    writes: set[str] = field(default_factory=set)


def _each(sequence) -> Iterator[object]:
    items = sequence.iterator()
    while items.hasNext():
        yield items.next()


def reads(spark: SparkSession, text: str) -> Reads:
    """Relations, functions and writing parts of one statement; names of WITH clauses are left out."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except ParseException as error:
        raise NotReadOnly(f"not a statement: {error.getCondition()}") from error
    found = Reads()
    kinds = spark._jvm.java.lang.Class
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    writing = [kinds.forName(f"{logical}.{name}") for name in ("Command", "ParsedStatement")]
    _plan(plan, frozenset(), found, writing)
    return found


def _plan(plan, scope: frozenset[str], found: Reads, writing: list) -> None:
    kind = plan.getClass().getSimpleName()
    if any(w.isInstance(plan) for w in writing):
        found.writes.add(kind)
    if kind == "UnresolvedWith":
        for pair in _each(plan.cteRelations()):  # a relation sees the ones before it, not itself
            _plan(pair._2(), scope, found, writing)
            scope = scope | {pair._1().lower()}
        _plan(plan.child(), scope, found, writing)
        return
    if kind == "UnresolvedRelation":
        name = tuple(part.lower() for part in _each(plan.multipartIdentifier()))
        if not (len(name) == 1 and name[0] in scope):
            found.relations.add(name)
    if kind == "UnresolvedTableValuedFunction":
        found.table_functions.add(".".join(_each(plan.name())).lower())
    for child in [*_each(plan.children()), *_each(plan.innerChildren()), *_each(plan.subqueries())]:
        if hasattr(child, "multipartIdentifier") or child.getClass().getName().find(".plans.") >= 0 or child.getClass().getName().find(".analysis.") >= 0:
            _plan(child, scope, found, writing)
    for expression in _each(plan.expressions()):
        _expression(expression, found)


def _expression(expression, found: Reads) -> None:
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        found.functions.add(".".join(_each(expression.nameParts())).lower())
    for child in _each(expression.children()):
        _expression(child, found)


def check(spark: SparkSession, text: str, published: Collection[str]) -> Reads:
    """Refuses a statement that writes, reads anything but ``published`` or calls a refused function."""
    found = reads(spark, text)
    names = {tuple(name.lower().split(".")) for name in published}
    if found.writes:
        raise NotReadOnly(f"not a read: {', '.join(sorted(found.writes))}")
    if strange := found.relations - names:
        raise NotReadOnly(f"not published: {', '.join(sorted('.'.join(n) for n in strange))}")
    called = {name.split(".")[-1] for name in found.functions | found.table_functions}
    if refused := called & REFUSED_FUNCTIONS | {n for n in found.table_functions if n not in TABLE_FUNCTIONS}:
        raise NotReadOnly(f"function not allowed: {', '.join(sorted(refused))}")
    return found
