"""A point-of-sale shop over the TPC-H-like test tables.

The two statements below give the raw exports of an imaginary shop with four branches:
every amount and date is text, with blanks, NULLs, alias spellings, tip and manual lines,
duplicate payment rows, lines that the export holds twice, blank and missing tickets, dates in
both spellings and in none, unreadable amounts and card numbers with blanks around them. They are ANSI SQL, so another engine can build the same
input; tables are written as ``{name}``. Amounts become DECIMAL before any arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstone.operators.cleanse import cleanse_lines, cleanse_tx
from tillstone.vocab import Branch, Vocabulary

VOCABULARY = Vocabulary(
    branches=(
        Branch("North", ("north", "north@shop.example"), ("%north%",), ("%north%",), ("%north%",)),
        Branch("South", ("South", "south@shop.example"), ("%south@%", "%South%"), ("%south%",), ("%south%",)),
        Branch("East", ("East", "east@shop.example"), ("%east%",), ("%east%",), ("%east%",)),
        Branch("West Hall", (), (), ("%west%", "%hall%"), ("%west%hall%",)),
    ),
    success="successful",
    paid="paid",
    tip="tip",
    tip_words=("tip", "gratuity"),
    manual_amount="custom amount",
    unspecified="unspecified",
    missing="UNSPECIFIED",
    product_categories=(
        ("ROUND", ("ring", "gear")),
        ("LONG", ("rod", "bolt")),
        ("HEAVY", ("anvil",)),
    ),
    payment_categories=(("CARD", ("card",)), ("CASH", ("cash",)), ("TRANSFER", ("transfer",))),
)

LINES_SQL = """
SELECT CASE WHEN l_partkey % 211 = 0 AND l_linenumber < 3 THEN '' WHEN l_partkey % 211 = 1 AND l_linenumber < 3 THEN NULL
            ELSE CAST(l_orderkey AS STRING) END AS tx_id,
       l_orderkey * 10000000000
         + (CAST(l_linenumber AS BIGINT) * 7919 + l_partkey * 104729 + l_suppkey * 1299709
            + (EXTRACT(YEAR FROM l_shipdate) * 10000 + EXTRACT(MONTH FROM l_shipdate) * 100
               + EXTRACT(DAY FROM l_shipdate)) * CAST(15485863 AS BIGINT)) % 10000000000 AS line_id,
       CASE WHEN n_nationkey = 24 THEN NULL
            WHEN n_regionkey = 0 THEN CASE WHEN l_linestatus = 'F' THEN 'north' ELSE 'north@shop.example' END
            WHEN n_regionkey = 1 THEN CASE WHEN l_linestatus = 'F' THEN 'South' ELSE 'south@shop.example' END
            WHEN n_regionkey = 2 THEN CASE WHEN l_linestatus = 'F' THEN 'East' ELSE 'east@shop.example' END
            ELSE r_name END AS account,
       CASE WHEN n_nationkey = 24 THEN NULL
            WHEN n_nationkey = 23 THEN 'unspecified'
            WHEN n_nationkey = 22 THEN ''
            WHEN n_regionkey = 0 THEN 'North'
            WHEN n_regionkey = 1 THEN CASE WHEN l_linestatus = 'F' THEN 'South' ELSE 'south kiosk' END
            WHEN n_regionkey = 2 THEN 'the east side'
            WHEN n_regionkey = 3 THEN CASE WHEN l_linestatus = 'F' THEN 'West Hall' ELSE 'west' END
            ELSE r_name END AS branch_norm,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN 'Tip'
            WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN 'Custom amount'
            WHEN l_returnflag = 'R' AND l_linenumber = 3 AND l_linestatus = 'F' THEN ' '
            WHEN l_returnflag = 'R' AND l_linenumber = 3 THEN NULL
            ELSE p_name END AS description,
       CASE WHEN p_size <= 25 THEN 'A' WHEN p_size <= 45 THEN 'B' ELSE NULL END AS tax_type,
       CASE WHEN p_size % 4 = 0 THEN 'card' WHEN p_size % 4 = 1 THEN 'cash'
            WHEN p_size % 4 = 2 THEN 'transfer' ELSE 'unspecified' END AS pay_form,
       CASE WHEN l_suppkey % 17 = 0 THEN NULL WHEN l_suppkey % 17 = 1 THEN ''
            WHEN l_suppkey % 17 = 2 THEN 'unspecified'
            ELSE CONCAT('SN-', CAST(l_suppkey % 50 AS STRING)) END AS device_serial,
       CAST(CAST(l_quantity AS INT) AS STRING) AS quantity,
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING) AS unit_price,
       CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN '' WHEN l_partkey % 199 = 7 THEN 'n/a'
            ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS gross,
       CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN ''
            ELSE CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.8 AS DECIMAL(2,1)) AS DECIMAL(14,3)) AS STRING) END AS net,
       CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(0.2 AS DECIMAL(2,1)) AS DECIMAL(14,3)) AS STRING) AS vat,
       CASE WHEN l_partkey % 197 = 0 THEN NULL WHEN l_partkey % 197 = 1 THEN '' WHEN l_partkey % 197 = 2 THEN 'pending'
            WHEN l_partkey % 197 < 8
            THEN CONCAT(CAST(CAST(l_shipdate AS DATE) AS STRING), ' ', LPAD(CAST(l_partkey % 24 AS STRING), 2, '0'), ':30:00')
            ELSE CONCAT(LPAD(CAST(EXTRACT(DAY FROM l_shipdate) AS STRING), 2, '0'), '-',
              LPAD(CAST(EXTRACT(MONTH FROM l_shipdate) AS STRING), 2, '0'), '-',
              CAST(EXTRACT(YEAR FROM l_shipdate) AS STRING), ', ',
              LPAD(CAST(l_partkey % 24 AS STRING), 2, '0'), ':',
              LPAD(CAST(l_suppkey % 60 AS STRING), 2, '0')) END AS sold_at
FROM {lineitem}
JOIN (SELECT 1 AS copy UNION ALL SELECT 2 AS copy) c ON c.copy = 1 OR l_partkey % 97 = 5
JOIN {part} ON l_partkey = p_partkey
JOIN {supplier} ON l_suppkey = s_suppkey
JOIN {nation} ON s_nationkey = n_nationkey
JOIN {region} ON n_regionkey = r_regionkey
"""

TX_SQL = """
SELECT CASE WHEN o_custkey % 229 = 0 THEN '' WHEN o_custkey % 229 = 1 THEN NULL ELSE CAST(o_orderkey AS STRING) END AS tx_id,
       CASE o_orderstatus WHEN 'F' THEN 'successful' WHEN 'O' THEN 'paid' ELSE 'failed' END AS status,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'DEBIT' WHEN o_orderpriority LIKE '2%' THEN 'CREDIT'
            WHEN o_orderpriority LIKE '3%' THEN 'debito' ELSE NULL END AS run_as,
       CASE WHEN o_orderkey % 13 = 0 THEN ''
            ELSE CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.02 AS DECIMAL(3,2)) AS DECIMAL(14,4)) AS STRING) END AS fee,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS total,
       CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.8 AS DECIMAL(2,1)) AS DECIMAL(14,3)) AS STRING) AS subtotal,
       CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * CAST(0.2 AS DECIMAL(2,1)) AS DECIMAL(14,3)) AS STRING) AS tax,
       CASE WHEN o_orderkey % 7 = 0 THEN '500' ELSE '' END AS tip,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING) AS deposits,
       CASE o_custkey % 5 WHEN 0 THEN 'north@shop.example' WHEN 1 THEN 'south@shop.example'
            WHEN 2 THEN 'EAST@shop.example' WHEN 3 THEN 'west@shop.example' ELSE NULL END AS account_email,
       CASE WHEN o_custkey % 17 = 0 THEN NULL WHEN o_custkey % 17 = 1 THEN ''
            WHEN o_custkey % 17 = 2 THEN CONCAT(' ', LPAD(CAST(o_custkey % 100 AS STRING), 4, '0'), ' ')
            ELSE LPAD(CAST(o_custkey % 100 AS STRING), 4, '0') END AS card_last4,
       CASE WHEN o_orderpriority LIKE '1%' THEN 'VISA' WHEN o_orderpriority LIKE '2%' THEN 'MASTERCARD'
            WHEN o_orderpriority LIKE '3%' THEN 'AMEX' ELSE NULL END AS card_type,
       CASE o_custkey % 3 WHEN 0 THEN 'chip' WHEN 1 THEN 'contactless' ELSE NULL END AS capture_mode,
       LPAD(CAST(o_orderkey % 1000000 AS STRING), 6, '0') AS auth_code,
       CASE WHEN o_orderkey % 50 = 0 THEN 'refund' ELSE 'sale' END AS tx_type,
       CASE WHEN o_orderpriority LIKE '5%' THEN 'cash' ELSE 'card' END AS pay_method,
       CONCAT('R-', CAST(o_orderkey AS STRING)) AS reference,
       CASE WHEN o_custkey % 223 = 0 THEN NULL WHEN o_custkey % 223 = 1 THEN '' WHEN o_custkey % 223 = 2 THEN 'soon'
            WHEN o_custkey % 223 = 3 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
            ELSE CONCAT(CAST(CAST(o_orderdate AS DATE) AS STRING), ' ',
              LPAD(CAST(o_custkey % 24 AS STRING), 2, '0'), ':15:00') END AS created_at
FROM {orders}
UNION ALL
SELECT CAST(o_orderkey AS STRING), 'paid', NULL, '0',
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), '0', '0', '',
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS STRING), NULL, NULL, NULL, NULL,
       NULL, 'sale', 'cash', CONCAT('R-', CAST(o_orderkey AS STRING)),
       CONCAT(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 00:00:00')
FROM {orders} WHERE o_orderkey % 10 = 0
"""

# One message per event: a user's events are a conversation, the payload number picks
# whether the message keeps or breaks the block format.
AGENT_LOG_SQL = """
SELECT user_id AS conv_id,
       event_id AS turn,
       CASE WHEN event_type IN ('click', 'error') THEN 'tool'
            WHEN event_type = 'view' THEN 'user' ELSE 'assistant' END AS role,
       CASE WHEN event_type = 'error' THEN 'execute_sql'
            WHEN event_type = 'click' AND value < 10 THEN 'get_kpi_sql'
            WHEN event_type = 'click' THEN 'retrieve_documents' END AS tool_name,
       CASE WHEN event_type = 'error' THEN CONCAT('select ', CAST(event_id AS STRING))
            WHEN event_type = 'click' AND value >= 10 AND event_id % 9 <> 0
            THEN CONCAT('rule ', CAST(event_id AS STRING)) END AS tool_query,
       CASE WHEN event_type = 'error' AND value < 5 THEN CONCAT('SQL_ERROR: column ', CAST(event_id AS STRING))
            WHEN event_type = 'error' AND value < 9 THEN 'EMPTY_RESULT'
            WHEN event_type IN ('click', 'error') THEN CONCAT('[', props, ']')
            WHEN event_type = 'view' THEN CONCAT('  Select ', props, ' from lines')
            WHEN event_type = 'signup' AND value < 4 THEN CONCAT('with x as (select created_at) ', props)
            WHEN event_type = 'signup' AND value < 12
            THEN CONCAT('Reasoning: need ', CAST(event_id AS STRING), CHR(10), 'Action: execute_sql', CHR(10),
                        'Parameters: ', props, CHR(10), 'Contingency: retry', CHR(10), CHR(10), 'end')
            WHEN event_type = 'signup'
            THEN CONCAT('REASONING: none', CHR(10), 'ACTION: fly', CHR(10), 'PARAMETERS: ', props)
            WHEN value < 8
            THEN CONCAT('REASONING: broken', CHR(10), 'ACTION: final_answer', CHR(10), 'PARAMETERS: {{k: ',
                        CAST(event_id AS STRING), '}}')
            ELSE CONCAT('ACTION: get_kpi_sql', CHR(10), 'PARAMETERS: ', props) END AS text
FROM {events}
"""


# Given schemas spare a job per table that would only read file footers.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "part": "p_partkey bigint, p_name string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "events": "event_id bigint, user_id bigint, event_type string, value double, props string",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files up to which its rows are spread by a shuffle: so small a file may be one task's.
SPREAD_BYTES = 64 << 20


def _spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows every task gets a share of. Turning them into text is the dear part.

    A larger file has row groups enough for all tasks, and shuffling it would cost more than it evens out.
    """
    files = spark.read.format("binaryFile").load(f"{sf_dir}/{name}.parquet")
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    table = _table(spark, sf_dir, name)
    return table.hint("rebalance") if size <= SPREAD_BYTES else table


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {n: _table(spark, sf_dir, n) for n in ("part", "supplier", "nation", "region")}
    return spark.sql(LINES_SQL, lineitem=_spread(spark, sf_dir, "lineitem"), **tables)


def raw_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TX_SQL, orders=_spread(spark, sf_dir, "orders"))


def agent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(AGENT_LOG_SQL, events=_table(spark, sf_dir, "events"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse_lines(raw_lines(spark, sf_dir))


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse_tx(raw_tx(spark, sf_dir))
