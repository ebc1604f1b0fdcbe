"""Batch analytics over agent conversation logs and query logs.

Column expressions over a table with one row per message: (conv_id, turn, role, text)
and, for tool outcomes, (tool_name, tool_query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
READ_STARTS = ("select", "with")
FORBIDDEN = (
    "insert", "update", "delete", "drop", "alter", "truncate", "grant", "revoke", "create", "execute",
)
ACTIONS = ("execute_sql", "get_kpi_sql", "retrieve_documents", "final_answer")
EMPTY_RESULT = "EMPTY_RESULT"
SQL_TOOL = "execute_sql"
RETRIEVAL_TOOL = "retrieve_documents"
RETRIEVAL_LIMIT = 3
RETRIEVAL_HISTORY = 5

_BLANKS = " \t\n\r\f\v"


def _strip(col: Column) -> Column:
    return F.btrim(col, F.lit(_BLANKS))


def _any(conditions: list[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def log_sql_guard(log: DataFrame, column: str = "text") -> DataFrame:
    """Add ``verdict``: 'not_select', 'forbidden' or 'allowed'.

    Keywords match as substrings, so ``created_at`` is forbidden too.
    """
    text = F.lower(_strip(F.col(column)))
    reads = _any([text.startswith(word) for word in READ_STARTS])
    forbidden = _any([text.contains(word) for word in FORBIDDEN])
    verdict = (
        F.when(~F.coalesce(reads, F.lit(False)), F.lit("not_select"))
        .when(forbidden, F.lit("forbidden"))
        .otherwise(F.lit("allowed"))
    )
    return log.withColumn("verdict", verdict)


def _is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value; doubled keys and NaN are let through.

    As a member it must be readable, as an array it must have one element: so text after the
    value does not pass. The literal null is no value to the reader and goes by itself.
    """
    strict = {"allowSingleQuotes": "false"}
    member = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string", strict)["v"]
    alone = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    return F.coalesce((F.trim(text) == "null") | (member.isNotNull() & (F.size(alone) == 1)), F.lit(False))


def _after_first(text: Column, marker: str) -> Column:
    """What follows the first colon of the first line containing ``marker``."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.upper(x).contains(marker)), F.lit(0))
    return _strip(F.substring(line, F.instr(line, ":") + 1, F.length(line)))


def log_format_check(log: DataFrame, column: str = "text") -> DataFrame:
    """Add ``has_sections``, ``action_ok``, ``parameters_ok`` and ``valid``."""
    text = F.col(column)
    sections = [F.upper(text).contains(s) for s in ("REASONING:", "ACTION:", "PARAMETERS:")]
    has_sections = sections[0] & sections[1] & sections[2]
    action = F.lower(_after_first(text, "ACTION:"))
    checked = log.withColumns({
        "has_sections": F.coalesce(has_sections, F.lit(False)),
        "action_ok": F.coalesce(_any([action.contains(a) for a in ACTIONS]), F.lit(False)),
        "parameters_ok": F.coalesce(_is_json(_after_first(text, "PARAMETERS:")), F.lit(False)),
    })
    return checked.withColumn("valid", F.col("has_sections") & F.col("action_ok") & F.col("parameters_ok"))


def log_extract_action(log: DataFrame, column: str = "text") -> DataFrame:
    """Add ``reasoning``, ``action``, ``parameters`` (up to the first closing brace) and
    ``contingency``; blank where the section is missing."""
    text = F.col(column)
    # The section patterns.
    return log.withColumns({
        "reasoning": _strip(F.regexp_extract(text, r"(?is)REASONING:(.*?)(?=ACTION:|$)", 1)),
        "action": F.regexp_extract(text, r"(?iU)ACTION:\s*(\w+)", 1),
        "parameters": F.regexp_extract(text, r"(?is)PARAMETERS:\s*(\{.*?\})", 1),
        "contingency": _strip(F.regexp_extract(text, r"(?is)CONTINGENCY:(.*?)(?=\n\n|$)", 1)),
    })


def last_valid_action(log: DataFrame) -> DataFrame:
    """Per conversation, the newest message that has an action and readable parameters."""
    parts = ("reasoning", "action", "parameters", "contingency")
    usable = log_extract_action(log).filter(
        (F.col("action") != "") & (F.col("parameters") != "") & _is_json(F.col("parameters"))
    )
    newest = usable.groupBy("conv_id").agg(F.max(F.struct("turn", *parts)).alias("m"))
    return newest.select("conv_id", "m.turn", *[f"m.{p}" for p in parts])


def tool_outcomes(log: DataFrame) -> DataFrame:
    """Per conversation: tool attempts, failures, empty results, whether the last attempt
    succeeded, the SQL last executed and its number of rows (NULL where it failed or gave no
    JSON list), capped retrieval calls and the last retrieval queries in order.

    The history keeps five queries per conversation by rank before collecting them, so a
    long conversation is never gathered whole.
    """
    tools = log.filter(F.col("role") == "tool")
    failed = F.col("text").contains("ERROR")
    retrieval = F.col("tool_name") == RETRIEVAL_TOOL
    n_rows = F.when(failed, None).when(F.col("text") == EMPTY_RESULT, 0).when(
        _is_json(F.col("text")), F.json_array_length("text")).cast("long")
    executed = F.when(F.col("tool_name") == SQL_TOOL, F.struct("turn", "tool_query", n_rows.alias("n_rows")))
    counts = tools.groupBy("conv_id").agg(
        F.count("*").alias("attempts"),
        F.count(F.when(failed, 1)).alias("failures"),
        F.count(F.when(F.col("text") == EMPTY_RESULT, 1)).alias("empty_results"),
        F.max_by(~failed, "turn").alias("last_success"),
        F.max(executed).alias("sql"),
        F.least(F.count(F.when(retrieval, 1)), F.lit(RETRIEVAL_LIMIT)).alias("retrieval_calls"),
    ).withColumns({"last_sql": F.col("sql.tool_query"), "last_sql_rows": F.col("sql.n_rows")}).drop("sql")
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    queries = (
        tools.filter(retrieval & F.col("tool_query").isNotNull())
        .select("conv_id", "turn", "tool_query")
        .withColumn("_rank", F.row_number().over(latest))
        .filter(F.col("_rank") <= RETRIEVAL_HISTORY)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "tool_query"))).alias("h"))
        .select("conv_id", F.col("h.tool_query").alias("retrieval_queries"))
    )
    empty = F.array().cast("array<string>")
    return counts.join(queries, "conv_id", "left").withColumn(
        "retrieval_queries", F.coalesce("retrieval_queries", empty)
    )
