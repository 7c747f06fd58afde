"""Recursive averages and moving ranks against plain Python, row by row."""

from datetime import date, timedelta

import numpy as np
import pytest

from recordvol.operators import averages, ranks
from recordvol.schema import BARS

DAY = date(2020, 1, 1)


def bars(spark, closes, ticker="AAA", timeframe="daily", volume=lambda i: 100.0, width=1.0):
    rows = [(timeframe, ticker, DAY + timedelta(i), c, None if c is None else c + width * (i % 3), None if c is None else c - width * (i % 2), c, volume(i)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def walk(n, seed=1):
    return (100 + np.cumsum(np.random.default_rng(seed).normal(0, 1, n))).round(2).tolist()


def plain(values, weight):
    out = []
    for x in values:
        out.append(x if not out else weight * x + (1 - weight) * out[-1])
    return out


def column(df, name):
    return [r[name] for r in df.orderBy("timeframe", "ticker", "d").collect()]


@pytest.mark.parametrize("block", [1, 7, 64, 5000])
def test_recursive_means_of_a_long_series(spark, block):
    closes = walk(700)
    got = averages.recursive_means(bars(spark, closes), {"a": ("close", 0.5), "b": ("close", 2 / 61), "c": ("close", 1.0), "v": ("volume", 0.01)}, block)
    for name, weight in (("a", 0.5), ("b", 2 / 61), ("c", 1.0)):
        assert column(got, name) == pytest.approx(plain(closes, weight), rel=1e-12)
    assert column(got, "v") == pytest.approx([100.0] * 700, rel=1e-12)


def test_weights_by_timeframe_and_series_apart(spark):
    a, b = walk(90, 2), walk(130, 3)
    both = bars(spark, a, "AAA", "daily").unionByName(bars(spark, b, "BBB", "weekly"))
    got = averages.recursive_means(both.repartition(5), {"m": ("close", {"daily": 0.1, "weekly": 0.7})}, 16)
    assert column(got, "m") == pytest.approx(plain(a, 0.1) + plain(b, 0.7), rel=1e-12)


def test_one_exchange_for_all_averages(spark):
    got = averages.guppy(bars(spark, walk(80)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_atr_bands(spark):
    closes = [100.0] * 30 + [100.5, 103.0, 110.0, 109.8, 100.0]
    rows = averages.atr_bands(bars(spark, closes)).orderBy("d").collect()
    high, low = [c + i % 3 for i, c in enumerate(closes)], [c - i % 2 for i, c in enumerate(closes)]
    ranges = [high[0] - low[0]] + [max(h - lo, abs(h - c), abs(lo - c)) for h, lo, c in zip(high[1:], low[1:], closes)]
    atr = plain(ranges, 1 / 20)
    assert [r["atr"] for r in rows] == pytest.approx(atr, abs=1e-4) and rows[0]["signal"] == "inside"
    for i in range(1, len(closes)):
        move, a = closes[i] - closes[i - 1], atr[i - 1]
        want = "strong up" if move > 3 * a else "strong down" if move < -3 * a else "up" if move > 1.5 * a else "down" if move < -1.5 * a else "inside"
        assert rows[i]["signal"] == want
    assert {"inside", "strong up", "strong down"} <= {r["signal"] for r in rows}


def test_bars_without_a_close_take_no_part(spark):
    closes = walk(100)
    gaps = [None if i in (0, 17, 64, 65) else c for i, c in enumerate(closes)]
    got = averages.atr_bands(bars(spark, gaps))
    assert got.count() == 96
    assert averages.guppy(bars(spark, gaps)).count() == 96 and averages.guppy(bars(spark, closes[:64])).count() == 0
    assert averages.guppy(bars(spark, [])).count() == 0 and ranks.atr_percentile(bars(spark, [])).count() == 0


@pytest.mark.parametrize("kind", ["EMA", "SMA"])
def test_guppy_states(spark, kind):
    closes = [100.0] * 70 + [100 + 1.5 * i for i in range(40)] + [160 - 2.0 * i for i in range(60)]
    g = averages.Guppy(kind=kind)
    rows = averages.guppy(bars(spark, closes, volume=lambda i: 500.0 if i > 70 and i < 75 else 100.0), g).orderBy("d").collect()
    mean = lambda n, i: plain(closes[: i + 1], 2 / (n + 1))[-1] if kind == "EMA" else sum(closes[max(0, i - n + 1) : i + 1]) / min(n, i + 1)
    trends = []
    for i, r in enumerate(rows):
        short, long = ([int(mean(n, i) * 10_000 + 0.3137) for n in own] for own in (g.short, g.long))
        assert (r["short_low"], r["short_high"], r["long_low"], r["long_high"]) == (min(short), max(short), min(long), max(long))
        trends.append("bullish" if min(short) > max(long) else "bearish" if max(short) < min(long) else "mixed")
        assert r["trend"] == trends[-1]
        held = len(trends) > 3 and trends[-1] == trends[-2] == trends[-3] != trends[-4] and trends[-1] != "mixed"
        assert r["crossover"] == (trends[-1] if held else None) and (r["volume_confirmed"] is not None) == held
    assert [r["crossover"] for r in rows if r["crossover"]] == ["bullish", "bearish"]
    assert [r["volume_confirmed"] for r in rows if r["crossover"]] == [True, False]
    assert rows[20]["width"] == "compression" and rows[-1]["width"] == "expansion"
    with pytest.raises(ValueError):
        averages.guppy(bars(spark, closes), averages.Guppy(kind="WMA"))


def test_rolling_rank_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        a, b = np.random.default_rng(5).integers(0, 9, 300).tolist(), walk(80, 6)
        both = bars(spark, [float(x) for x in a], "AAA").unionByName(bars(spark, b, "BBB", "monthly"))
        rows = ranks.rolling_rank(both.repartition(3), "close", {"daily": 25, "monthly": 1}).orderBy("timeframe", "d").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for i, r in enumerate(rows[:300]):
        own = a[max(0, i - 24) : i + 1]
        assert (r["rank"], r["frame"]) == (sum(x <= a[i] for x in own), len(own))
    assert all((r["rank"], r["frame"]) == (1, 1) for r in rows[300:])


def test_atr_percentile(spark):
    closes = walk(160, 7)
    rows = ranks.atr_percentile(bars(spark, closes, width=2.0)).orderBy("d").collect()
    high, low = [c + 2 * (i % 3) for i, c in enumerate(closes)], [c - 2 * (i % 2) for i, c in enumerate(closes)]
    ranges = [high[0] - low[0]] + [max(h - lo, abs(h - c), abs(lo - c)) for h, lo, c in zip(high[1:], low[1:], closes)]
    atr = [int(x * 10_000 + 0.3137) for x in plain(ranges, 1 / 14)]
    for i, r in enumerate(rows):
        own, mean = atr[max(0, i - 99) : i + 1], sum(closes[max(0, i - 49) : i + 1]) / min(50, i + 1)
        share = sum(x <= atr[i] for x in own) / len(own)
        assert r["percentile"] == share and r["volatility"] == ("high" if share >= 0.8 else "low" if share <= 0.2 else "normal")
        assert r["distance"] == (pytest.approx((closes[i] - mean) / (atr[i] / 10_000), abs=1e-3) if atr[i] else None)
    flat = ranks.atr_percentile(bars(spark, [5.0] * 20, width=0.0)).collect()
    assert all(r["distance"] is None and r["reach"] is None and r["percentile"] == 1 for r in flat)
