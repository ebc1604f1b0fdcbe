"""Registered queries against their SQL, and the invariants of the results."""

import pytest

import __spark_entry__ as entry
from checks import business, etl, logs, primitives, semantic
from checks.base import clean_lines
from checks.compare import connect, differences
from tests.shopdata import rows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return connect(SF)


def test_every_query_has_sql():
    own = {name for module in (business, etl, semantic, logs, primitives) for name in module.QUERIES}
    assert own <= set(QUERIES) and own <= set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for module in (business, etl, logs, semantic, primitives) for n in module.QUERIES])
def test_matches_sql(spark, oracle, name):
    assert differences(QUERIES[name](spark, SF), oracle, ORACLE[name]) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 1


def test_totals_and_shares(spark):
    overview = rows(QUERIES["q01_overview_tickets"](spark, SF), "transacciones", "venta_bruta")
    assert overview[-1][0] == sum(r[0] for r in overview[:-1])
    assert overview[-1][1] == pytest.approx(sum(r[1] for r in overview[:-1]))
    mix = rows(
        QUERIES["q14_payment_mix_raw"](spark, SF), "participacion_transacciones_pct", "participacion_ventas_pct"
    )
    for column in (0, 1):
        assert mix[-1][column] == 100.0
        assert sum(r[column] for r in mix[:-1]) == pytest.approx(100, abs=0.1)


def test_dates_are_profiled_as_read_and_as_written(spark):
    """Two spellings of a minute are one date among the clean lines and two texts in the export."""
    profiles = [dict(rows(QUERIES[q](spark, SF), "info", "conteo")) for q in ("e16_distinct_profile", "e16_distinct_texts")]
    clean = clean_lines(spark, SF)
    assert profiles[0]["sold_at"] == clean.where("sold_at IS NOT NULL").select("sold_at").distinct().count() != profiles[1]["sold_at"]
    assert {c: profiles[0][c] == profiles[1][c] for c in ("description", "branch_norm", "device_serial")} == dict.fromkeys(
        ("description", "branch_norm", "device_serial"), True)
