"""Levels, their first breakout, timing dots, cross-sectional ranks and rotation against plain Python."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from recordvol.operators import levels, strength
from recordvol.operators.levels import Dots, GreenLines
from recordvol.schema import BARS
from recordvol.sources.settings import Period, period, period_lists
from tests.test_averages import bars, plain, walk

DAY = date(2020, 1, 1)


def test_pivots_need_both_sides_and_take_the_first_of_equals(spark):
    highs = [1, 2, 5, 2, 1, 3, 3, 1, 0, 9]
    rows = [("daily", "A", DAY + timedelta(i), 1.0, float(h), 0.0, 1.0, 1.0) for i, h in enumerate(highs)]
    found = levels.pivots(spark.createDataFrame(rows, BARS), 2).collect()
    assert sorted((r["n"], r["level"], r["seen_n"]) for r in found) == [(2, 5.0, 4), (5, 3.0, 7)]


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_first_above_in_every_tier(spark, fan):
    rng = random.Random(fan)
    series = {"A": [rng.randint(0, 60) for _ in range(200)], "B": [rng.randint(0, 9) for _ in range(7)], "C": [5] * 70 + [6]}
    table = spark.createDataFrame([("daily", t, n, float(v), DAY + timedelta(n)) for t, own in series.items() for n, v in enumerate(own)], "timeframe string, ticker string, n long, v double, day date")
    asked = [("daily", t, float(level), after) for t, own in series.items() for level in (*range(0, 61, 7), 5, 5.5) for after in (-1, 0, 3, 63, 150, len(own) - 1, len(own) + 5)] + [("weekly", "A", 1.0, 0)]
    got = levels.first_above(spark.createDataFrame(asked, "timeframe string, ticker string, level double, after long").repartition(3), table.repartition(5), "v", "after", ("day",), 200, fan)
    rows = got.collect()
    assert len(rows) == len(asked)
    for r in rows:
        own = series[r["ticker"]] if r["timeframe"] == "daily" else []
        want = next((DAY + timedelta(i) for i, v in enumerate(own) if i > r["after"] and v > r["level"]), None)
        assert r["day"] == want, r


def test_first_above_compares_by_equality_joins_only(spark):
    plan = levels.green_lines(bars(spark, walk(300)))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_green_lines(spark, seed):
    closes = walk(400, seed)
    table = bars(spark, closes, width=0.5)
    highs = [c + 0.5 * (i % 3) for i, c in enumerate(closes)]
    found = {r["pivot_date"]: r for r in levels.green_lines(table, GreenLines(strength=3, lookback="1m", history="2m", confirmation="1w"), most_bars=400).collect()}
    last, want = DAY + timedelta(len(closes) - 1), 0
    for i in range(3, len(closes) - 3):
        if not (highs[i] > max(highs[i - 3 : i]) and highs[i] >= max(highs[i + 1 : i + 4])):
            continue
        r, want, day = found[DAY + timedelta(i)], want + 1, DAY + timedelta(i)
        at = next((j for j in range(i + 4, len(closes)) if closes[j] > highs[i]), None)
        assert r["level"] == highs[i] and r["seen_date"] == day + timedelta(3)
        assert r["breakout_date"] == (None if at is None else DAY + timedelta(at)) and r["breakout_close"] == (None if at is None else closes[at])
        status = "open" if at is None else "failed" if min(closes[at : at + 8]) < highs[i] else "confirmed" if at + 7 < len(closes) else "pending"
        assert r["status"] == status
        month = (day.month % 12) + 1
        later = date(day.year + (day.month == 12), month, min(day.day, (date(day.year + (day.month >= 11), (month % 12) + 1, 1) - timedelta(1)).day))
        assert r["is_green"] == ((r["breakout_date"] or last) >= later)
    assert len(found) == want > 10
    assert levels.green_lines(bars(spark, [])).count() == 0 and levels.green_lines(bars(spark, [None] * 30)).count() == 0


def test_spans():
    assert period(" 3M ") == Period(3, True) and period("1y") == Period(12, True) and period("2w") == Period(14, False) and period("10d") == Period(10, False)
    assert period_lists("3m;6m", "1y", "2w; 1w;3w") == [("3m", "1y", "2w"), ("6m", "1y", "1w"), ("3m", "1y", "3w")]
    assert GreenLines.sets("3m;6m", "1y", "2w", 5) == [GreenLines(5, "3m", "1y", "2w"), GreenLines(5, "6m", "1y", "2w")]
    for wrong in ("m", "3", "3q", ""):
        with pytest.raises(ValueError):
            period(wrong)
    with pytest.raises(ValueError):
        period_lists("3m", ";")


def test_dots(spark):
    closes = walk(260, 11)
    p = Dots(blue_mean=20, black_mean=15, black_ema=8)
    rows = levels.dots(bars(spark, closes), p).orderBy("d").collect()
    high, low = [c + i % 3 for i, c in enumerate(closes)], [c - i % 2 for i, c in enumerate(closes)]
    tick = lambda x: int(x * 10_000 + 0.3137)
    mean = lambda n, i: tick(sum(closes[max(0, i - n + 1) : i + 1]) / min(n, i + 1))
    k = []
    for i, c in enumerate(closes):
        a, b = min(low[max(0, i - 9) : i + 1]), max(high[max(0, i - 9) : i + 1])
        k.append((c - a) / (b - a) * 100 if b > a else None)
    ema = [tick(x) for x in plain(closes, 2 / 9)]
    for i, r in enumerate(rows):
        blue = i > 0 and k[i - 1] is not None and k[i - 1] < 20 <= k[i] and mean(20, i) > mean(20, i - 1)
        recent = [x for x in k[max(0, i - 2) : i + 1] if x is not None]
        black = i > 0 and bool(recent) and min(recent) < 25 and tick(closes[i]) > tick(closes[i - 1]) and (tick(closes[i]) > mean(15, i) or tick(closes[i]) > ema[i])
        assert (r["blue_dot"], r["black_dot"]) == (blue, black), i
    assert any(r["blue_dot"] for r in rows) and any(r["black_dot"] for r in rows)


def test_cross_ranks_with_ties_nulls_and_extremes(spark):
    rng = random.Random(1)
    rows = [(d, i, rng.choice([None, 0.0, rng.uniform(-0.02, 0.02), rng.uniform(-9, 99), 0.005])) for d in range(5) for i in range(120)]
    got = strength.cross_ranks(spark.createDataFrame(rows, "d int, i int, x double").repartition(7), ("d",), "x").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for d, _, x in rows if d == r["d"] and x is not None]
        assert (r["at_most"], r["of"]) == ((None, None) if r["x"] is None else (sum(x <= r["x"] for x in own), len(own)))


def test_strength(spark):
    series = {f"T{i}": walk(150, 20 + i) for i in range(6)}
    table = None
    for t, closes in series.items():
        own = bars(spark, closes, t)
        table = own if table is None else table.unionByName(own)
    found = {(r["ticker"], (r["d"] - DAY).days): r for r in strength.strength(table, strength.Strength(top=80.0, leader=60.0, atr_rating=20.0)).collect()}
    for (t, i), r in found.items():
        ratings = []
        for n in (5, 20, 60, 120):
            returns = {x: c[i] / c[i - n] - 1 for x, c in series.items()} if i >= n else {}
            want = sum(v <= returns[t] for v in returns.values()) * 100 / 6 if returns else None
            assert r[f"rating_{n}"] == (pytest.approx(want) if returns else None)
            ratings.append(want)
        assert r["leader"] == (None not in ratings and sum(ratings) / 4 >= 60)
        if r["qualified"]:
            assert max(x for x in ratings if x is not None) >= 80 and r["atr_rating"] >= 20 and r["position"] >= 0.5
        assert r["extended"] == (None if r["extension"] is None or r["extension"] < 7 else "warning" if r["extension"] < 11 else "danger")
    assert len(found) == 900 and any(r["qualified"] for r in found.values()) and any(r["leader"] for r in found.values())


def test_rotation_and_months_without_bars(spark):
    rng, rows, prices = random.Random(3), [], {}
    for t in range(9):
        for m in range(30):
            if t == 4 and 10 <= m <= 13:
                continue  # no bar: the last price goes on, without a volume
            price = float(rng.randint(50, 60))
            prices[f"T{t}", m] = price
            day = date(2020 + m // 12, m % 12 + 1, 3)
            rows += [("daily", f"T{t}", day, 1.0, 1.0, 1.0, 10.0, 9.0), ("daily", f"T{t}", day + timedelta(20), 1.0, 1.0, 1.0, price, 9.0 if t != 7 else 1.0)]
    for m in range(10, 14):
        prices["T4", m] = prices["T4", 9]
    got = strength.rotation(spark.createDataFrame(rows, BARS).repartition(4), strength.Rotation(keep=(5, 3, 2), min_price=1.0, min_volume=5)).collect()
    by = {}
    for r in got:
        by.setdefault((r["month"].year - 2020) * 12 + r["month"].month - 1, []).append(r["ticker"])
    for m in range(12, 30):
        own = [f"T{t}" for t in range(9) if t != 7 and not (t == 4 and 10 <= m <= 13)]
        for months, keep in ((12, 5), (6, 3), (3, 2)):
            own = sorted(own, key=lambda t: (-(prices[t, m] / prices[t, m - months] - 1), t))[:keep]
        assert sorted(by.pop(m)) == sorted(own)
    assert not by
    ends = strength.month_ends(spark.createDataFrame(rows, BARS).where("ticker = 'T4'"))
    assert ends.count() == 30 and ends.where(F.col("volume").isNull()).count() == 4
