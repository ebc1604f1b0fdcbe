"""Log analytics over an agent log derived from the events, and over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import AGENT_LOG, of_table, with_
from tillstone.plans import agentlog
from tillstone.sources import testshop


def _log(build):
    return lambda spark, sf: build(testshop.agent_log(spark, sf))


def _joined(df):
    return df.withColumn("retrieval_queries", F.array_join("retrieval_queries", "|"))


QUERIES = {
    "r1_log_sql_guard": _log(lambda g: agentlog.log_sql_guard(g).select("turn", "verdict")),
    "r1_log_sql_guard_conversations": of_table(
        "conversations", lambda c: agentlog.log_sql_guard(c).select("conv_id", "turn", "verdict")
    ),
    "r2_log_format_check": _log(lambda g: agentlog.log_format_check(g).select(
        "turn", "has_sections", "action_ok", "parameters_ok", "valid"
    )),
    "r2_log_format_check_conversations": of_table("conversations", lambda c: agentlog.log_format_check(c).select(
        "conv_id", "turn", "has_sections", "valid"
    )),
    "r3_log_extract_action": _log(lambda g: agentlog.log_extract_action(g).select(
        "turn", "reasoning", "action", "parameters", "contingency"
    )),
    "r4_last_valid_action": _log(agentlog.last_valid_action),
    "r5_tool_outcomes": _log(lambda g: _joined(agentlog.tool_outcomes(g))),
}

_WORDS = ("insert", "update", "delete", "drop", "alter", "truncate", "grant", "revoke", "create", "execute")
_CLEAN = "lower(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
_VERDICT = f"""CASE WHEN NOT COALESCE(starts_with({_CLEAN}, 'select') OR starts_with({_CLEAN}, 'with'), FALSE)
            THEN 'not_select'
            WHEN {' OR '.join(f"contains({_CLEAN}, '{w}')" for w in _WORDS)} THEN 'forbidden'
            ELSE 'allowed' END AS verdict"""

_LOG = f"log AS ({AGENT_LOG})"

_SECTIONS = (
    "contains(upper(text), 'REASONING:') AND contains(upper(text), 'ACTION:') AND contains(upper(text), 'PARAMETERS:')"
)


def _line_value(marker: str) -> str:
    """Text after the first colon of the first line holding the marker."""
    line = f"list_filter(string_split(text, chr(10)), lambda x: contains(upper(x), '{marker}'))[1]"
    return f"trim(substr({line}, strpos({line}, ':') + 1))"


_ACTION_OK = " OR ".join(
    f"contains(lower(action_line), '{a}')"
    for a in ("execute_sql", "get_kpi_sql", "retrieve_documents", "final_answer")
)
_CHECKED = f"""
SELECT conv_id, turn, has_sections, COALESCE({_ACTION_OK}, FALSE) AS action_ok,
       COALESCE(json_valid(parameters_line), FALSE) AS parameters_ok
FROM (SELECT conv_id, turn, COALESCE({_SECTIONS}, FALSE) AS has_sections, {_line_value('ACTION:')} AS action_line,
             {_line_value('PARAMETERS:')} AS parameters_line FROM source) s"""

# RE2 has no look-ahead: sections are cut by position instead.
_UP = "upper(text)"
_AFTER_REASONING = "substr(text, strpos(upper(text), 'REASONING:') + 10)"
_AFTER_CONTINGENCY = "substr(text, strpos(upper(text), 'CONTINGENCY:') + 12)"
_BLANK = "' ' || chr(10)"
_EXTRACTED = f"""
SELECT conv_id, turn,
       CASE WHEN NOT contains({_UP}, 'REASONING:') THEN ''
            WHEN contains(upper({_AFTER_REASONING}), 'ACTION:')
            THEN trim(substr({_AFTER_REASONING}, 1, strpos(upper({_AFTER_REASONING}), 'ACTION:') - 1), {_BLANK})
            ELSE trim({_AFTER_REASONING}, {_BLANK}) END AS reasoning,
       regexp_extract(text, '(?i)ACTION:\\s*(\\w+)', 1) AS action,
       regexp_extract(text, '(?is)PARAMETERS:\\s*(\\{{.*?\\}})', 1) AS parameters,
       CASE WHEN NOT contains({_UP}, 'CONTINGENCY:') THEN ''
            WHEN contains({_AFTER_CONTINGENCY}, chr(10) || chr(10))
            THEN trim(substr({_AFTER_CONTINGENCY}, 1, strpos({_AFTER_CONTINGENCY}, chr(10) || chr(10)) - 1), {_BLANK})
            ELSE trim({_AFTER_CONTINGENCY}, {_BLANK}) END AS contingency
FROM log"""

ORACLE = {
    "r1_log_sql_guard": with_(_LOG) + f"SELECT turn, {_VERDICT} FROM log",
    "r1_log_sql_guard_conversations": f"SELECT conv_id, turn, {_VERDICT} FROM conversations",
    "r2_log_format_check": with_(_LOG, "source AS (SELECT conv_id, turn, text FROM log)") + f"""
SELECT turn, has_sections, action_ok, parameters_ok, has_sections AND action_ok AND parameters_ok AS valid
FROM ({_CHECKED}) c""",
    "r2_log_format_check_conversations": with_("source AS (SELECT conv_id, turn, text FROM conversations)") + f"""
SELECT conv_id, turn, has_sections, has_sections AND action_ok AND parameters_ok AS valid FROM ({_CHECKED}) c""",
    "r3_log_extract_action": with_(_LOG) + f"""
SELECT turn, reasoning, action, parameters, contingency FROM ({_EXTRACTED}) x""",
    "r4_last_valid_action": with_(_LOG) + f"""
SELECT conv_id, turn, reasoning, action, parameters, contingency
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM ({_EXTRACTED}) x
      WHERE action <> '' AND parameters <> '' AND json_valid(parameters)) r WHERE rn = 1""",
    "r5_tool_outcomes": with_(
        _LOG,
        "tools AS (SELECT * FROM log WHERE role = 'tool')",
        """recent AS (SELECT conv_id, string_agg(tool_query, '|' ORDER BY turn) AS q
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM tools
        WHERE tool_name = 'retrieve_documents' AND tool_query IS NOT NULL) r WHERE rn <= 5 GROUP BY 1)""",
    ) + """
SELECT t.conv_id, COUNT(*) AS attempts, COUNT(CASE WHEN contains(text, 'ERROR') THEN 1 END) AS failures,
       COUNT(CASE WHEN text = 'EMPTY_RESULT' THEN 1 END) AS empty_results,
       arg_max(NOT contains(text, 'ERROR'), turn) AS last_success,
       arg_max_null(tool_query, turn) FILTER (tool_name = 'execute_sql') AS last_sql,
       arg_max_null(CASE WHEN contains(text, 'ERROR') THEN NULL WHEN text = 'EMPTY_RESULT' THEN 0
                         WHEN NOT json_valid(text) THEN NULL
                         WHEN json_type(text) = 'ARRAY' THEN CAST(json_array_length(text) AS BIGINT) END, turn)
         FILTER (tool_name = 'execute_sql') AS last_sql_rows,
       CAST(LEAST(COUNT(CASE WHEN tool_name = 'retrieve_documents' THEN 1 END), 3) AS BIGINT) AS retrieval_calls,
       COALESCE(MAX(q), '') AS retrieval_queries
FROM tools t LEFT JOIN recent r ON t.conv_id = r.conv_id GROUP BY 1""",
}
