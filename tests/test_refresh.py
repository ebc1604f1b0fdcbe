"""Incremental loads: two exports give what one gives, and only what changes is written."""

import pytest

from tests.shopdata import line, lines, pay, rows, tx
from tillstone.plans import refresh, star
from tillstone.sources.testshop import VOCABULARY as VOCAB

LINES = [
    line("t1", branch_norm="north stand", sold_at="05-03-2024, 10:30"),
    line("t1", description="cake", sold_at="05-03-2024, 10:31"),
    line("t2", branch_norm="North", sold_at="07-04-2024, 09:00"),
    line("t3", sold_at="08-05-2024, 09:00", tax_type=None),
    line("t4", sold_at="01-06-2024, 12:00", description="scone"),
    line("t4", sold_at="02-07-2024, 12:00", description="scone"),
]
PAYMENTS = [
    pay("t1", created_at="2024-03-05 10:31:00", card_last4="1111"), pay("t2", created_at="2024-04-07 09:01:00"),
    pay("t3", created_at="2024-05-08 09:01:00", total="5"), pay("t3", created_at="2024-05-08 09:01:00", total="4"),
]


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def kept(spark, *wanted):
    """Clean lines of LINES by place, ids as in the whole export."""
    return lines(spark, *LINES).where(f"line_id IN ({', '.join(str(i + 1) for i in wanted)})")


def payments(spark, *wanted):
    return tx(spark, *[PAYMENTS[i] for i in wanted])



def same(spark, root, whole):
    got = refresh.stored_star(spark, root)
    facts = [c for c in whole.fact_lines.columns]
    assert sorted(rows(got.fact_lines, *facts), key=str) == sorted(rows(whole.fact_lines, *facts), key=str)
    assert sorted(rows(got.fact_tx), key=str) == sorted(rows(whole.fact_tx), key=str)


def files(spark, root, table="fact_lines"):
    return {f.split(f"{table}/")[1] for f in spark.read.parquet(f"{root}/{table}").inputFiles()}


def load(spark, root, line_frame, tx_frame):
    return refresh.load_increment(spark, line_frame, tx_frame, root, VOCAB)


def test_two_overlapping_exports_equal_one(spark, root):
    all_tx = payments(spark, 0, 1, 2, 3)
    assert load(spark, root, kept(spark, 1, 3, 4), payments(spark, 0, 2)).lines == [202403, 202405, 202406]
    done = load(spark, root, kept(spark, 0, 2, 3, 5), payments(spark, 0, 1, 3))
    # t1 gains an earlier line, so its other line moves; t4's first line keeps its number and its month its files
    assert (done.lines, done.payments) == ([202403, 202404, 202407], [202404, 202405])
    same(spark, root, star.star_of(kept(spark, 0, 1, 2, 3, 4, 5), all_tx, VOCAB))


def test_months_without_news_keep_their_files(spark, root):
    load(spark, root, kept(spark, 0, 1, 2, 3), payments(spark, 0, 1, 2))
    before, before_tx = files(spark, root), files(spark, root, "fact_tx")
    load(spark, root, kept(spark, 2, 4), payments(spark, 1, 3))
    after, after_tx = files(spark, root), files(spark, root, "fact_tx")
    assert before <= after and {f.split("/")[0] for f in after - before} == {"mes_key=202406"}
    assert {f.split("/")[0] for f in before_tx ^ after_tx} == {"mes_key=202405"}


def test_loading_again_writes_nothing(spark, root):
    load(spark, root, lines(spark, *LINES), tx(spark, *PAYMENTS))
    before = files(spark, root)
    assert load(spark, root, lines(spark, *LINES), tx(spark, *PAYMENTS)) == refresh.Refreshed([], [])
    assert files(spark, root) == before


def test_a_late_dimension_row_finds_the_facts_that_wait_for_it(spark, root):
    load(spark, root, kept(spark, 0, 1), payments(spark, 0))  # "north stand" is looked up as North, which is not there yet
    assert {r["sede_sk"] for r in refresh.stored_star(spark, root).fact_lines.collect()} == {None}
    assert load(spark, root, kept(spark, 2), payments(spark)).lines == [202403, 202404]
    same(spark, root, star.star_of(kept(spark, 0, 1, 2), payments(spark, 0), VOCAB))


def test_a_payment_may_move_to_an_earlier_month_and_empty_its_own(spark, root):
    late, early = pay("t9", created_at="2024-09-01 08:00:00"), pay("t9", created_at="2024-02-01 08:00:00")
    assert load(spark, root, kept(spark, 0), tx(spark, late)).payments == [202409]
    assert load(spark, root, kept(spark, 0), tx(spark, early)).payments == [202402, 202409]
    same(spark, root, star.star_of(kept(spark, 0), tx(spark, late, early), VOCAB))
    assert load(spark, root, kept(spark, 0), tx(spark, late)).payments == []


def test_empty_exports(spark, root):
    assert load(spark, root, kept(spark, 0), payments(spark, 0)).lines == [202403]
    nothing = lines(spark, *LINES).limit(0), tx(spark, *PAYMENTS).limit(0)
    assert load(spark, root, *nothing) == refresh.Refreshed([], [])
    same(spark, root, star.star_of(kept(spark, 0), payments(spark, 0), VOCAB))
