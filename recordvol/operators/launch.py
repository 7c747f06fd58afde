"""Launch pads, where averages lie close together, rise and hold the price, and movers by gain and relative volume."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordvol.operators.averages import priced, recursive_means, simple_mean, ticks
from recordvol.operators.frames import moving, size
from recordvol.operators.records import series


def weighted_mean(value: str, bars: int) -> Column:
    """Mean of the last `bars` values (whole numbers) with weights 1 to bars; null with fewer. Needs the bar's place `_x`."""
    frame = series().rowsBetween(1 - bars, 0)
    y = F.sum(value).over(frame)
    xy = F.sum(F.col(value) * F.col("_x")).over(frame) - F.col("_x") * y  # places from 1 - bars to 0
    return F.when(F.count(value).over(frame) == bars, (bars * y + xy) / F.lit(bars * (bars + 1) / 2))


@dataclass(frozen=True)
class LaunchPad:
    """Averages and what counts as tight, rising and near. Defaults are fixed values."""

    periods: tuple[int, ...] = (10, 20, 50)
    kind: str = "EMA"  # or SMA, WMA
    window: int = 50
    spread: float = 1.0
    slope_share: float = 0.3
    least_slope: float = 0.0001
    near: float = 2.0
    near_window: int = 20


def launch_pads(bars: DataFrame, p: LaunchPad = LaunchPad()) -> DataFrame:
    """Adds spread, the distance between the lowest and highest average in ticks, its z-score, and whether a bar is a launch pad.

    spread_z is the spread against the last p.window spreads (null until they are there or where they do not
    vary), tight if it is at most p.spread. rising: every average of n bars has gained at least
    p.least_slope of itself a bar over its last p.slope_share * n bars (one at least). near: the close is
    within p.near sample deviations of the last p.near_window closes from the slowest average. is_launch is all three.
    """
    if p.kind not in ("EMA", "SMA", "WMA"):
        raise ValueError(f"{p.kind!r} is not EMA, SMA or WMA")
    rows = priced(bars)
    names = {f"_m{n}": n for n in sorted(set(p.periods))}
    if p.kind == "EMA":
        rows = recursive_means(rows, {name: ("close", 2 / (n + 1)) for name, n in names.items()})
        rows = rows.withColumns({name: ticks(F.col(name)) for name in names})
    elif p.kind == "SMA":
        rows = rows.withColumns({name: ticks(simple_mean("close", n)) for name, n in names.items()})
    else:
        rows = rows.withColumns({"_x": F.row_number().over(series()) - 1, "_y": ticks(F.col("close"))})
        rows = rows.withColumns({name: F.floor(weighted_mean("_y", n) + 0.3137) for name, n in names.items()})
    rows = rows.withColumns({"spread": F.greatest(*names) - F.least(*names) if len(names) > 1 else F.lit(0).cast("long"), "_tick": ticks(F.col("close"))})
    rising = F.lit(True)
    for name, n in names.items():
        back = max(1, int(n * p.slope_share))
        last = F.lag(name, back).over(series())
        rising = rising & F.coalesce(F.col(name) - last >= p.least_slope * back * last, F.lit(False))
    slowest = F.col(max(names, key=names.get))
    off = F.abs(F.col("_tick") - slowest) <= p.near * deviation("_tick", p.near_window)
    rows = rows.withColumns({"spread_z": F.when(F.count("spread").over(series().rowsBetween(1 - p.window, 0)) == p.window, z_score("spread", p.window)), "rising": rising, "near": F.coalesce(off, F.lit(False))})
    rows = rows.withColumn("tight", F.coalesce(F.col("spread_z") <= p.spread, F.lit(False)))
    rows = rows.withColumn("is_launch", F.col("tight") & F.col("rising") & F.col("near"))
    return rows.select(*bars.columns, "spread", "spread_z", "tight", "rising", "near", "is_launch")


def _moments(value: str, bars: int) -> tuple[Column, Column, Column]:
    frame = series().rowsBetween(1 - bars, 0)
    n, total = F.count(value).over(frame), F.sum(value).over(frame)
    return n, total, F.sum(F.col(value) * F.col(value)).over(frame) * n - total * total


def z_score(value: str, bars: int) -> Column:
    """A whole number's distance from the mean of the last ones in sample deviations; null where they do not vary."""
    n, total, spread = _moments(value, bars)
    return F.when((n > 1) & (spread > 0), (F.col(value) * n - total) / F.sqrt(spread * n / (n - 1)))


def deviation(value: str, bars: int) -> Column:
    """Sample deviation of the last whole numbers; null with one."""
    n, _, spread = _moments(value, bars)
    return F.when(n > 1, F.sqrt(spread / (n * (n - 1))))


@dataclass(frozen=True)
class Movers:
    """Thresholds of the three kinds of movers. Defaults are fixed values, in bars of daily series."""

    volume: float = 9_000_000
    volume_ratio: float = 1.25
    week: int = 5
    week_gain: float = 20.0
    week_ratio: float = 1.25
    week_volume: float = 100_000
    day_gain: float = 4.0
    day_ratio: float = 1.5
    day_volume: float = 100_000
    ratio_bars: int = 20
    means: tuple[int, int] = (50, 200)

    def scaled(self, scale: float) -> Movers:
        n = lambda x, least=1: max(least, int(x * scale))
        return Movers(self.volume, self.volume_ratio, n(self.week, 3), self.week_gain, self.week_ratio, self.week_volume, self.day_gain, self.day_ratio, self.day_volume, n(self.ratio_bars), (n(self.means[0]), n(self.means[1])))


def movers(bars: DataFrame, p: Movers = Movers()) -> DataFrame:
    """Adds ratio, the volume against the mean of the p.ratio_bars bars before, both gains in percent, and three flags.

    is_volume_mover: volume and ratio reach their thresholds. is_week_mover: so do the gain over p.week bars,
    the ratio and the mean volume. is_day_mover: so do the gain of the bar, its ratio and its volume, and the
    close is above both means of p.means bars.
    """
    rows = priced(bars)
    back = series().rowsBetween(-p.ratio_bars, -1)
    # Window expressions are columns first, as each use of one would compute it again.
    rows = rows.withColumns({"_total": F.sum("volume").over(back), "_n": F.count("volume").over(back), "_day": F.lag("close", 1).over(series()), "_week": F.lag("close", p.week).over(series())})
    gain = lambda then: F.when(F.col(then) > 0, F.col("close") / F.col(then) * 100 - 100)
    ratio = F.when(F.col("_total") > 0, F.col("volume") * F.col("_n") / F.col("_total"))
    rows = rows.withColumns({"ratio": ratio, "day_gain": gain("_day"), "week_gain": gain("_week"), "_tick": ticks(F.col("close"))})
    rows = moving(rows, {f"_sum_{n}": ("sum", "close", n) for n in p.means})
    rows = rows.withColumn("_above", reduce(and_, (F.col("_tick") > ticks(F.col(f"_sum_{n}") / size(n)) for n in p.means)))
    no = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "is_volume_mover": no((F.col("volume") >= p.volume) & (F.col("ratio") >= p.volume_ratio)),
        "is_week_mover": no((F.col("week_gain") >= p.week_gain) & (F.col("ratio") >= p.week_ratio) & (F.col("_total") >= p.week_volume * F.col("_n"))),
        "is_day_mover": no((F.col("day_gain") >= p.day_gain) & (F.col("ratio") >= p.day_ratio) & (F.col("volume") >= p.day_volume) & F.col("_above")),
    }
    return rows.withColumns(flags).select(*bars.columns, "ratio", "day_gain", "week_gain", *flags)
