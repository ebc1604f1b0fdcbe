from tests.shopdata import rows
from tillstone.plans import agentlog

GOOD = 'REASONING: look it up\nACTION: execute_sql\nPARAMETERS: {"query": "select 1"}\nCONTINGENCY: stop\n\nbye'


def log(spark, *messages):
    return spark.createDataFrame(
        list(messages), "conv_id long, turn long, role string, tool_name string, tool_query string, text string"
    )


def said(conv, turn, text):
    return (conv, turn, "assistant", None, None, text)


def test_guard_matches_substrings(spark):
    texts = ["select 1", "with x as (select 1) select * from x", " \n SELECT 2", "drop table t", "select created_at", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows(agentlog.log_sql_guard(df), "verdict")] == [
        "allowed", "allowed", "allowed", "not_select", "forbidden", "not_select", "not_select",
    ]


def test_format_check(spark):
    df = log(
        spark, said(1, 1, GOOD), said(1, 2, GOOD.replace("execute_sql", "fly")), said(1, 3, GOOD.replace('"}', '"')),
        said(1, 4, GOOD.replace("REASONING:", "")), said(1, 5, GOOD.lower()), said(1, 6, None),
    )
    got = rows(agentlog.log_format_check(df).orderBy("turn"), "has_sections", "action_ok", "parameters_ok", "valid")
    assert got == [
        (True, True, True, True), (True, False, True, False), (True, True, False, False),
        (False, True, True, False), (True, True, True, True), (False, False, False, False),
    ]


def test_extract_action(spark):
    nested = 'action: get_kpi_sql\nparameters: {"a": {"b": 1}} rest'
    got = rows(
        agentlog.log_extract_action(log(spark, said(1, 1, GOOD), said(1, 2, nested))).orderBy("turn"),
        "reasoning", "action", "parameters", "contingency",
    )
    assert got == [
        ("look it up", "execute_sql", '{"query": "select 1"}', "stop"), ("", "get_kpi_sql", '{"a": {"b": 1}', ""),
    ]


def test_last_valid_action_skips_unreadable_parameters(spark):
    broken = "ACTION: final_answer\nPARAMETERS: {oops}"
    df = log(spark, said(1, 1, GOOD), said(1, 2, broken), said(2, 1, "hello"))
    assert rows(agentlog.last_valid_action(df), "conv_id", "turn", "action") == [(1, 1, "execute_sql")]


def test_tool_outcomes(spark):
    calls = [(1, i, "tool", "retrieve_documents", f"q{i}", "[]") for i in range(1, 8)]
    calls += [
        (1, 8, "tool", "execute_sql", "select 1", "SQL_ERROR: no"), (1, 9, "tool", "execute_sql", None, "EMPTY_RESULT"),
        (1, 10, "assistant", None, None, "ERROR"), (2, 1, "tool", "retrieve_documents", None, "SQL_ERROR: x"),
    ]
    got = rows(agentlog.tool_outcomes(log(spark, *calls)).orderBy("conv_id"))
    assert got == [
        (1, 9, 1, 1, True, 3, None, 0, ["q3", "q4", "q5", "q6", "q7"]), (2, 1, 1, 0, False, 1, None, None, []),
    ]


def test_last_sql_and_its_rows(spark):
    results = ['[{"a": 1}, {"a": 2}]', "EMPTY_RESULT", "SQL_ERROR: no", '{"a": 1}', "[1, 2", None, "[]"]
    calls = [(1, 1, "tool", "execute_sql", "select 0", "[1]"), (1, 3, "tool", "retrieve_documents", "q", "[1, 2, 3]")]
    calls += [(c, 2, "tool", "execute_sql", f"select {c}", text) for c, text in enumerate(results, 1)]
    calls += [(9, 1, "tool", "get_kpi_sql", None, "[1]"), (10, 1, "user", "execute_sql", "select 9", "[1]")]
    got = rows(agentlog.tool_outcomes(log(spark, *calls)).orderBy("conv_id"), "conv_id", "last_sql", "last_sql_rows")
    counts = [2, 0, None, None, None, None, 0]
    assert got == [(c, f"select {c}", n) for c, n in enumerate(counts, 1)] + [(9, None, None)]
