"""Launch pads and movers against plain Python, row by row."""

import statistics
from datetime import timedelta

import pytest

from recordvol.operators import launch
from recordvol.schema import BARS
from tests.test_averages import DAY, bars, plain, walk
from tests.test_flows import ohlcv, tick


@pytest.mark.parametrize("kind", ["EMA", "SMA", "WMA"])
def test_launch_pads(spark, kind):
    closes = [round(100 + c / 40 + i * 0.02, 2) for i, c in enumerate(walk(260, 31))]
    p = launch.LaunchPad(periods=(4, 9, 20), kind=kind, window=30, near=5.0, near_window=10)
    got = launch.launch_pads(bars(spark, closes, width=0.01), p).orderBy("d").collect()
    exponential = {n: [tick(x) for x in plain(closes, 2 / (n + 1))] for n in p.periods}

    def mean(n, i):
        own = closes[max(0, i - n + 1) : i + 1]
        if kind == "EMA":
            return exponential[n][i]
        if kind == "SMA":
            return tick(sum(own) / len(own))
        y = [tick(c) for c in own]
        return int(sum(w * v for w, v in enumerate(y, 1)) / (n * (n + 1) / 2) + 0.3137) if len(y) == n else None

    spreads, seen = [], set()
    for i, r in enumerate(got):
        means = {n: mean(n, i) for n in p.periods}
        known = [m for m in means.values() if m is not None]
        spreads.append(max(known) - min(known) if known else None)
        assert r["spread"] == spreads[-1]
        own = spreads[max(0, i - 29) : i + 1]
        z = (spreads[i] - statistics.fmean(own)) / statistics.stdev(own) if None not in own and len(own) == 30 and len(set(own)) > 1 else None
        assert r["spread_z"] == (pytest.approx(z, abs=1e-6) if z is not None else None) and r["tight"] == (z is not None and z <= 1)
        rising = True
        for n in p.periods:
            back = max(1, int(n * 0.3))
            last = mean(n, i - back) if i >= back else None
            rising = rising and last is not None and means[n] is not None and means[n] - last >= 0.0001 * back * last
        assert r["rising"] == rising
        around = [tick(c) for c in closes[max(0, i - 9) : i + 1]]
        near = means[20] is not None and len(around) > 1 and abs(around[-1] - means[20]) <= 5 * statistics.stdev(around)
        assert r["near"] == near and r["is_launch"] == (r["tight"] and rising and near)
        seen.add(r["is_launch"])
    assert seen == {True, False}
    with pytest.raises(ValueError):
        launch.launch_pads(bars(spark, closes), launch.LaunchPad(kind="HMA"))


def test_movers(spark):
    rows = ohlcv(300, 12, big=0.2)
    p = launch.Movers(volume=500, week_gain=2.0, week_volume=150, day_gain=0.8, day_volume=100, ratio_bars=15, means=(20, 40))
    got = launch.movers(spark.createDataFrame(rows, BARS).repartition(3), p).orderBy("d").collect()
    close, volume = [r[6] for r in rows], [r[7] for r in rows]
    for i, r in enumerate(got):
        back = volume[max(0, i - 15) : i]
        ratio = volume[i] / statistics.fmean(back) if back else None
        day, week = (close[i] / close[i - k] * 100 - 100 if i >= k else None for k in (1, 5))
        assert r["ratio"] == (pytest.approx(ratio) if back else None) and r["day_gain"] == day and r["week_gain"] == week
        above = all(tick(close[i]) > tick(sum(close[max(0, i - n + 1) : i + 1]) / min(n, i + 1)) for n in (20, 40))
        flags = (
            ratio is not None and volume[i] >= 500 and ratio >= 1.25,
            week is not None and week >= 2 and ratio >= 1.25 and sum(back) >= 150 * len(back),
            day is not None and day >= 0.8 and ratio >= 1.5 and volume[i] >= 100 and above,
        )
        assert (r["is_volume_mover"], r["is_week_mover"], r["is_day_mover"]) == flags
    assert all(any(r[f] for r in got) for f in ("is_volume_mover", "is_week_mover", "is_day_mover"))
    assert launch.Movers().scaled(0.2) == launch.Movers(week=3, ratio_bars=4, means=(10, 40))
    empty = spark.createDataFrame([("daily", "A", DAY + timedelta(i), None, None, None, None, None) for i in range(3)], BARS)
    assert launch.movers(empty).count() == 0 and launch.launch_pads(empty).count() == 0
