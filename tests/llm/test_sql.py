"""The operators that have SQL, against DuckDB on awkward rows."""

import random

import duckdb
import pytest

from checks.compare import differences
from tests.llm import frames
from tillstone.llm import hosts, oracles, urls


def connected(df, name, tmp_path):
    df.write.parquet(f"{tmp_path}/{name}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    return con


def pages(spark):
    rnd, rows = random.Random(1), []
    for i in range(300):
        name = rnd.choice(["alpha", "beta", "spam1", "zz9"])
        host = rnd.choice([f"{name}.example.com", f"m.{name}.example.net", f"{name}.org", "net", f"{name}.fr.org", f"x{name}net"])
        rows.append((i, f"http{rnd.choice(['', 's'])}://{host}/{rnd.choice(['en', 'de', 'fr', 'es'])}/{rnd.randint(0, 99)}{rnd.choice(['', '?p=1', '#top'])}", "x", i, i))
    odd = [None, "", "no scheme", "://", "http://", "HTTP://EXAMPLE.NET/EN/a", "http://EXAMPLE.net/en/1", "http://a.net", "http://a.net?x=/", "ftp://org/fr/",
           "http://xorg/fr/", "a://b://c.net/", "http://" + "a" * 5000 + ".net/", "http://straße.org/fr/ü?é"]
    rows += [(1000 + i, u, None, i, i) for i, u in enumerate(odd)] + [(5, rows[5][1], None, 0, 0), (None, rows[6][1], None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, row long, gram long")


def test_url_filter(spark, tmp_path):
    df = pages(spark)
    assert differences(urls.judged(df), connected(df, "pages", tmp_path), oracles.url_filter()) == ""
    assert urls.judged(df.limit(0)).count() == 0
    got = {r["page_id"]: r for r in urls.judged(df).collect()}
    assert (got[1000]["host"], got[1000]["path"], got[1000]["rule"], got[1000]["verdict"]) == ("", "", None, "block")
    assert (got[1006]["host"], got[1006]["rule"], got[1006]["verdict"]) == ("example.net", "example.net/en/", "allow")
    assert (got[1005]["path"], got[1005]["rule"], got[1005]["verdict"]) == ("/EN/a", "net/", "block")
    assert got[1007]["rule"] is None and got[1008]["path"] == "" and got[1009]["rule"] == "org/fr/" and got[1010]["rule"] is None


def test_url_filter_learns_the_ruled_urls(spark):
    got = urls.judged(pages(spark)).where("rule is not null")
    right = got.where("(score >= 0) = (verdict = 'allow')").count()
    assert right > 0.9 * got.count()


def test_rules_of_one_kind_only(spark):
    only = spark.createDataFrame([(1, "http://a.net/"), (2, "http://b.com/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judged(only).collect()}[1] == "block"


def test_grams_are_not_broadcast(spark, tmp_path):
    pages(spark).selectExpr("monotonically_increasing_id() AS row", "coalesce(substring(url, 8), '') AS rest",
                            "CASE pmod(page_id, 3) WHEN 0 THEN 'allow' WHEN 1 THEN 'block' END AS role").write.parquet(f"{tmp_path}/urls")
    rows = spark.read.parquet(f"{tmp_path}/urls")
    got = urls.scored(rows, urls.log_ratios(rows))
    lengths = {r["row"]: len(r["rest"]) for r in rows.where("rest <> ''").collect()}
    assert {r["row"]: r["places"] - 1 for r in got.collect()} == lengths
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_host_rules(spark, tmp_path):
    df = frames.docs(spark)
    assert differences(hosts.judged(df), connected(df, "documents", tmp_path), oracles.host_rules()) == ""


@pytest.mark.parametrize("name", ["op3_url_filter", "op5_host_rules"])
def test_registered(spark, name):
    from checks.compare import connect
    from tillstone.llm import queries

    assert differences(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), queries.ORACLE[name]) == ""
