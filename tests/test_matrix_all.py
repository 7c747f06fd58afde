"""The date x ticker matrix and the rating flags over all values."""

from recordvol import queries
from recordvol.plans import orders

SF = "/root/testdata/sf0.001"


def test_matrix_holds_every_ticker(spark):
    bars = orders.bars(spark, SF, "daily")
    rows = queries.queries()["close_matrix_all"](spark, SF).collect()
    assert len(rows) == bars.count()
    assert {r["ticker"] for r in rows} == {r[0] for r in bars.select("ticker").distinct().collect()}


def test_every_rating_has_a_flag(spark):
    rows = queries.queries()["rating_flags_all"](spark, SF).collect()
    assert rows and all(sum(r[1:]) == 1 for r in rows)
