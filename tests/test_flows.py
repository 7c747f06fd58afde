"""Breakouts, contraction patterns, volume, flows and leaders against plain Python, row by row."""

import math
import random
import statistics
from datetime import date, timedelta

import pytest

from recordvol.operators import breakouts, flows, leaders
from recordvol.operators.averages import runs
from recordvol.schema import BARS
from tests.test_averages import DAY, bars, walk


def tick(x):
    return math.floor(x * 10_000 + 0.3137)


def ohlcv(n, seed, step=timedelta(1), big=0.05):
    rng, rows, c = random.Random(seed), [], 100.0
    for i in range(n):
        c = round(max(20.0, c + rng.gauss(0.1 if i % 120 < 60 else -0.1, 1.5)), 2)
        h, low = round(c + rng.random() * 2, 2), round(c - rng.random() * 2, 2)
        rows.append(("daily", "A", DAY + step * i, c, h, low, c, float(rng.randint(50, 150) * (8 if rng.random() < big else 1))))
    return rows


def test_runs_count_from_each_change(spark):
    rows = [("daily", "A", DAY + timedelta(i), x) for i, x in enumerate([None, None, "a", "a", "b", None, "a"])]
    got = runs(spark.createDataFrame(rows, "timeframe string, ticker string, d date, x string"), "x").orderBy("d").collect()
    assert [(r["run"], r["place"]) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1)]


@pytest.mark.parametrize("direction", ["Long", "Long and Short"])
def test_price_volume_signals(spark, direction):
    rows = ohlcv(500, 4, big=0.2)
    p = breakouts.PriceVolume(*({"daily": n} for n in (15, 10, 20, 3, 25)), direction=direction)
    got = breakouts.price_volume(spark.createDataFrame(rows, BARS), p).orderBy("d").collect()
    close, volume = [r[6] for r in rows], [r[7] for r in rows]
    start, kind, given_up, wrong, seen = None, None, False, 0, set()
    for i, r in enumerate(got):
        slope = None
        if i >= 19:
            ys, mx = [tick(c) for c in close[i - 19 : i + 1]], 9.5
            slope = sum((x - mx) * (y - statistics.fmean(ys)) for x, y in enumerate(ys)) / sum((x - mx) ** 2 for x in range(20))
            assert r["trend"] == pytest.approx(slope, abs=1e-6)
        event = None
        if i >= 15 and volume[i] > max(volume[i - 10 : i]) and slope is not None:
            event = "Buy" if close[i] > max(close[i - 15 : i]) and slope > 0 else "Sell" if close[i] < min(close[i - 15 : i]) and slope < 0 and direction != "Long" else None
        assert r["event"] == event
        if event:
            start, kind, given_up, wrong = i, event, False, 0
        if start is not None:
            wrong = wrong + 1 if (close[i] < close[start] if kind == "Buy" else close[i] > close[start]) else 0
            given_up = given_up or wrong >= 3
        holds = start is not None and i - start <= 25 and not given_up
        assert (r["signal"], r["age"], r["signal_close"]) == ((kind, i - start, close[start]) if holds else (None, None, None))
        seen.add(r["signal"])
    assert seen == ({"Buy", None} if direction == "Long" else {"Buy", "Sell", None})
    with pytest.raises(ValueError):
        breakouts.price_volume(spark.createDataFrame(rows[:1], BARS), breakouts.PriceVolume(direction="Up"))


def test_contraction_pattern(spark):
    rng, rows, price = random.Random(6), [], 100.0
    for i in range(600):
        calm = i % 40 < 22
        price += rng.choice([-1, 1]) * (0.01 if calm else 1.5)
        rows.append(("daily", "A", DAY + timedelta(i), price, price + (0.02 if calm else 1.0), price - (0.02 if calm else 1.0), price, 1.0))
    c = breakouts.Contraction(period=30, short=3, expansion=1.5, consolidation=4, confirmation=2)
    got = breakouts.contraction(spark.createDataFrame(rows, BARS), c).orderBy("d").collect()
    high, low, close = ([r[k] for r in rows] for k in (4, 5, 6))
    span = [None if i < 2 else tick(max(high[i - 2 : i + 1]) - min(low[i - 2 : i + 1])) for i in range(600)]
    index, run, side, edge = [], [], [], []
    for i, r in enumerate(got):
        own = span[max(0, i - 29) : i + 1]
        full = len(own) == 30 and None not in own and max(own) > min(own)
        index.append((span[i] - min(own)) * 100 / (max(own) - min(own)) if full else None)
        quiet = index[i] is not None and index[i] < 20
        run.append((run[i - 1] if i and run[i - 1] else 0) + 1 if quiet else 0)
        side.append(None)
        edge.append(None)
        if i and index[i] is not None and index[i - 1] is not None and index[i] >= 1.5 * index[i - 1] and not quiet and run[i - 1] >= 4:
            top, bottom = max(high[i - run[i - 1] : i]), min(low[i - run[i - 1] : i])
            side[i], edge[i] = ("up", top) if close[i] > top else ("down", bottom) if close[i] < bottom else (None, None)
        held = None
        if i >= 2 and side[i - 2]:
            beyond = min(close[i - 1 : i + 1]) > edge[i - 2] if side[i - 2] == "up" else max(close[i - 1 : i + 1]) < edge[i - 2]
            held = side[i - 2] if beyond else None
        want = "breakout" if side[i] else "confirmed" if held else "consolidation" if run[i] >= 4 else "contraction" if run[i] >= 2 else None
        assert (r["pattern"], r["side"], r["quiet_run"]) == (want, side[i] or held, run[i]), i
        assert r["index"] == index[i] and r["zone"] == (None if index[i] is None else 1 if index[i] <= 5 else 2 if index[i] <= 10 else 3 if index[i] <= 15 else 0)
    assert {"breakout", "confirmed", "consolidation", "contraction"} <= {r["pattern"] for r in got}
    assert breakouts.Contraction().scaled(0.2) == breakouts.Contraction(period=10, short=2, quiet_bars=1, consolidation=1, confirmation=1)


def test_volume_suite(spark):
    rows = ohlcv(420, 8, timedelta(2))
    v = flows.VolumeSuite(months=4, recent=20, deviations=2.5, vroc=6, rvol=12, mfi=7, vpt=9, adtv=10, adtv_thresholds=((1, 1.05), (5, 1.01)))
    got = flows.volume_suite(spark.createDataFrame(rows, BARS).repartition(4), v).orderBy("d").collect()
    day, high, low, close, vol = ([r[k] for r in rows] for k in (2, 4, 5, 6, 7))
    back = lambda d, m: date(d.year + (d.month - 1 - m) // 12, (d.month - 1 - m) % 12 + 1, min(d.day, 28 if (d.month - 1 - m) % 12 == 1 and (d.year + (d.month - 1 - m) // 12) % 4 else 29 if (d.month - 1 - m) % 12 == 1 else 30 if (d.month - 1 - m) % 12 in (3, 5, 8, 10) else 31))
    typical = [tick(h) + tick(lo) + tick(c) for h, lo, c in zip(high, low, close)]
    vpt = [0]
    for i in range(1, len(rows)):
        vpt.append(vpt[-1] + tick(vol[i] * (close[i] / close[i - 1] - 1)))
    mean = [statistics.fmean(vol[max(0, i - 9) : i + 1]) for i in range(len(rows))]
    for i, r in enumerate(got):
        months = [vol[j] for j in range(i) if day[j] >= back(day[i], 4)]
        assert r["is_high"] == (bool(months) and vol[i] > max(months)) and r["is_recent_high"] == (r["is_high"] and i >= 400)
        own = vol[max(0, i - 12) : i]
        sd = statistics.stdev(own) if len(own) > 1 else 0
        assert r["z"] == (pytest.approx((vol[i] - statistics.fmean(own)) / sd) if sd else None) and r["is_deviant"] == (bool(sd) and r["z"] >= 2.5)
        assert r["rvol"] == (pytest.approx(vol[i] / statistics.fmean(own)) if own else None) and r["activity"] == (None if not own or r["rvol"] < 2 else "high" if r["rvol"] < 5 else "extreme")
        assert r["vroc"] == (pytest.approx((vol[i] / vol[i - 6] - 1) * 100) if i >= 6 else None) and r["is_jump"] == (i >= 6 and r["vroc"] >= 50)
        up = sum(typical[j] * vol[j] for j in range(max(1, i - 6), i + 1) if typical[j] > typical[j - 1])
        down = sum(typical[j] * vol[j] for j in range(max(1, i - 6), i + 1) if typical[j] < typical[j - 1])
        assert r["mfi"] == (pytest.approx(up * 100 / (up + down)) if up + down else None)
        assert r["pressure"] == (None if r["mfi"] is None or 20 < r["mfi"] < 80 else "overbought" if r["mfi"] >= 80 else "oversold")
        last = vpt[max(0, i - 8) : i + 1]
        off, level = vpt[i] * len(last) - sum(last), 0.05 * abs(sum(last))
        assert r["vpt"] == vpt[i] and r["vpt_signal"] == ("up" if off > level else "down" if off < -level else None)
        for m in (1, 5):
            then = [mean[j] for j in range(len(rows)) if day[j] <= back(day[i], m)]
            assert r[f"adtv_{m}"] == (pytest.approx(mean[i] / then[-1]) if then else None)
        assert r["is_busy"] == (r["adtv_1"] is not None and r["adtv_5"] is not None and r["adtv_1"] >= 1.05 and r["adtv_5"] >= 1.01)
    assert flows.VolumeSuite().scaled(0.05) == flows.VolumeSuite(months=1, recent=1, vroc=1, rvol=1, mfi=1, vpt=1, adtv=2)
    assert flows.volume_suite(spark.createDataFrame([], BARS)).count() == 0


def test_divergences(spark):
    rows = ohlcv(500, 9)
    got = {(r["kind"], r["d"]): r for r in flows.divergences(spark.createDataFrame(rows, BARS)).collect()}
    high, low, close, vol = ([r[k] for r in rows] for k in (4, 5, 6, 7))
    line, total = [], 0
    for h, lo, c, v in zip(high, low, close, vol):
        total += tick(((c - lo) - (h - c)) / (h - lo) * v) if h > lo else 0
        line.append(total)
    want = {}
    for side, x in (("bearish", high), ("bullish", [-v for v in low])):
        pivots = [i for i in range(3, len(x) - 3) if x[i] > max(x[i - 3 : i]) and x[i] >= max(x[i + 1 : i + 4])]
        for a, b in zip(pivots, pivots[1:]):
            if b - a <= 20 and x[b] > x[a] and (line[b] < line[a] if side == "bearish" else line[b] > line[a]):
                want[side, DAY + timedelta(b)] = (DAY + timedelta(a), DAY + timedelta(b + 3), abs(x[a]), abs(x[b]), line[a], line[b])
    assert {k: tuple(r[c] for c in ("last_d", "seen_date", "last_price", "price", "last_line", "line")) for k, r in got.items()} == want
    assert {k for k, _ in want} == {"bullish", "bearish"}


def test_monthly_accumulation(spark):
    lines = [100, 120, 145, 180, 185, 190, None, 240, 300, 380, 0, 50]
    rows, last = [], 0
    for m, line in enumerate(lines):
        if line is not None:
            flow, last = line - last, line
            rows.append(("daily", "A", date(2021, m + 1, 5), 1.0, 2.0, 1.0, 2.0 if flow >= 0 else 1.0, float(abs(flow))))
    got = flows.monthly_accumulation(spark.createDataFrame(rows, BARS), flows.Divergence(lookback=5)).orderBy("month").collect()
    assert [r["line"] // 10_000 for r in got] == [x for x in lines if x is not None]
    change = [None, 20, 145 / 1.2 - 100, 180 / 1.45 - 100, 185 / 1.8 - 100, 190 / 1.85 - 100, None, 25, 80 / 3, -100, None]
    assert [r["change"] for r in got] == [None if c is None else pytest.approx(c) for c in change]
    assert [r["streak"] for r in got] == [0, 1, 2, 3, 0, 0, 0, 1, 2, 0, 0]
    assert [r["is_signal"] for r in got] == [False] * 11 and [r["score_ok"] for r in got] == [False] * 5 + [True] + [False] * 5
    steady = [("daily", "A", date(2021, m + 1, 5), 1.0, 2.0, 1.0, 2.0, 100.0 * 1.2**m) for m in range(12)]
    assert flows.monthly_accumulation(spark.createDataFrame(steady, BARS)).orderBy("month").collect()[-1]["is_signal"]


def test_leaders_and_hierarchy(spark):
    rng, table, groups, last = random.Random(5), None, [], {}
    for i in range(30):
        closes = walk(60, 50 + i) if i != 7 else walk(40, 57)
        own = bars(spark, closes, f"T{i:02}")
        table = own if table is None else table.unionByName(own)
        group = rng.choice(["metals", "banks", "tech", "food", None]) if i < 28 else "few"
        groups.append((f"T{i:02}", group))
        if i != 7 and group:
            last.setdefault(group, []).append((tick(closes[59] / closes[9] - 1), f"T{i:02}"))
    known = spark.createDataFrame(groups, "ticker string, group string")
    rolled = {(r["level"], r["group"]): r for r in leaders.hierarchy(leaders.latest_returns(table, 50).join(known.where("group is not null"), "ticker"), "group").collect()}
    every = [x for own in last.values() for x in own]
    for key, own in [(("group", g), own) for g, own in last.items()] + [(("all", None), every)]:
        r = rolled.pop(key)
        assert (r["series"], r["rising"], r["best"]) == (len(own), sum(c > 0 for c, _ in own), max(own)[1]) and r["mean_change"] == pytest.approx(sum(c for c, _ in own) / len(own) / 10_000)
    assert not rolled
    got = [tuple(r[c] for c in ("group", "group_rank", "rank", "ticker")) for r in leaders.industry_leaders(table, known, p=leaders.Leaders(top_percent=40.0, top_series=2)).collect()]
    means = sorted((-sum(c for c, _ in own) / len(own), g) for g, own in last.items() if len(own) >= 3)
    want = [(g, k, i, t) for k, (_, g) in enumerate(means[: math.ceil(len(means) * 0.4)], 1) for i, (_, t) in enumerate(sorted(last[g], key=lambda x: (-x[0], x[1]))[:2], 1)]
    assert sorted(got) == sorted(want)
    assert leaders.industry_leaders(table.where("false"), known).count() == 0
