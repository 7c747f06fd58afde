"""Recursive averages (exponential and Wilder's) of series, and the screens that rest on them.

An average y_t = a x_t + (1 - a) y_(t-1), that starts with the first value, is not a window function,
but a bar's step is an affine map, and maps of consecutive bars compose. A series is cut into blocks of
BLOCK bars. Inside a block the composed map is a running sum; what a block hands to the next is one
number, and the carry into a block folds those of the blocks before it, as far back as a value can
still change a double (a weight of 2^-64). So a long series is never one row or one call, and all
averages share one exchange on the series.

Averages are given in steps of TICK, rounded away from the places where doubles of equal decimals
differ; comparisons are made on these steps, so averages that are equal on paper compare as equal.

Bars without a value of what is averaged take no part.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.operators.records import series, whole
from recordvol.schema import KEYS

BLOCK = 64
TICK, SHIFT = 10_000, 0.3137


def ticks(value: Column) -> Column:
    """A value in whole steps of 1 / TICK."""
    return F.floor(value * TICK + SHIFT)


def by_timeframe(values: float | Mapping[str, float]) -> Column:
    """One value, or one for each timeframe (null for others)."""
    if not isinstance(values, Mapping):
        return F.lit(float(values))
    out = F.lit(None).cast("double")
    for timeframe, v in values.items():
        out = F.when(F.col("timeframe") == timeframe, float(v)).otherwise(out)
    return out


def recursive_means(bars: DataFrame, means: Mapping[str, tuple[str, float | Mapping[str, float]]], block: int = BLOCK) -> DataFrame:
    """Adds averages: name -> (column, weight of a new value); a weight may differ by timeframe."""
    rows = bars.withColumn("_n", F.row_number().over(series()) - 1)
    rows = rows.withColumns({"_block": F.floor(F.col("_n") / block), "_k": F.col("_n") % block})
    inside = series("_block").rowsBetween(Window.unboundedPreceding, 0)
    keep, slowest = {}, 0.0
    for name, (column, weight) in means.items():
        slowest = max(slowest, *(1 - w for w in (weight.values() if isinstance(weight, Mapping) else [weight])))
        a = by_timeframe(weight)
        keep[name] = F.when(a < 1, 1 - a)  # null: the average is the value itself
        own = F.when(F.col("_n") == 0, 1.0).otherwise(a) * F.col(column) * F.pow(keep[name], -F.col("_k"))
        rows = rows.withColumn(name, F.when(a < 1, F.sum(own).over(inside) * F.pow(keep[name], "_k")).otherwise(F.col(column)))
    before = max(1, ceil(64 * log(2) / (-log(slowest) * block))) if 0 < slowest < 1 else 1
    blocks = rows.groupBy(*KEYS, "_block").agg(
        F.collect_list(F.struct(*(c for c in rows.columns if c not in (*KEYS, "_block")))).alias("_rows"),  # BLOCK bars at most
        F.max_by(F.struct(*means), "_k").alias("_last"),
    )
    back = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(-before, -1)
    blocks = blocks.withColumn("_back", F.collect_list("_last").over(back))
    for name in means:
        blocks = blocks.withColumn(f"_in_{name}", _carry(name, F.pow(F.coalesce(keep[name], F.lit(0.0)), F.lit(block))))
    rows = blocks.select(*KEYS, *(f"_in_{name}" for name in means), F.inline("_rows"))
    for name in means:
        rows = rows.withColumn(name, F.when(keep[name].isNotNull(), F.col(name) + F.pow(keep[name], F.col("_k") + 1) * F.col(f"_in_{name}")).otherwise(F.col(name)))
    return rows.select(*bars.columns, *means)


def _carry(name: str, share: Column) -> Column:
    """What an average hands into a block: the last values of the blocks before it, each keeping `share` from block to block."""
    return F.aggregate("_back", F.lit(0.0), lambda y, last: y * share + last[name])


def simple_mean(column: str | Column, bars: int) -> Column:
    """Mean of the last `bars` bars, of as many as there are at a series' start."""
    return F.avg(column).over(series().rowsBetween(1 - bars, 0))


def true_range() -> Column:
    """The largest of the bar's range and its extremes' distances from the close before."""
    close = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close))


def priced(bars: DataFrame) -> DataFrame:
    return bars.where("high is not null and low is not null and close is not null")


@dataclass(frozen=True)
class AtrBands:
    """Lengths and factors of two bands around the close by timeframe. Defaults are fixed values."""

    length: Mapping[str, int] = None
    factor: float | Mapping[str, float] = 3.0
    length2: Mapping[str, int] = None
    factor2: float | Mapping[str, float] = 1.5

    def lengths(self, which: str) -> dict[str, int]:
        return dict(getattr(self, which) or {"daily": 20, "weekly": 4, "monthly": 2})


def atr_bands(bars: DataFrame, bands: AtrBands = AtrBands()) -> DataFrame:
    """Two average true ranges of each bar, and where its close lies in the bands of the bar before.

    signal: `strong up` or `strong down` beyond the band of the first range, `up` or `down` beyond that
    of the second, `inside` otherwise and at a series' first bar.
    """
    weights = {name: {t: 1 / n for t, n in bands.lengths(which).items()} for name, which in (("atr", "length"), ("atr2", "length2"))}
    rows = priced(bars).where(F.col("timeframe").isin(list(weights["atr"]))).withColumn("true_range", true_range())
    rows = recursive_means(rows, {name: ("true_range", w) for name, w in weights.items()})
    rows = rows.withColumns({c: ticks(F.col(c)) / TICK for c in ("atr", "atr2")})
    last = {c: F.lag(c).over(series()) for c in ("close", "atr", "atr2")}
    move, wide, narrow = F.col("close") - last["close"], by_timeframe(bands.factor) * last["atr"], by_timeframe(bands.factor2) * last["atr2"]
    signal = F.when(move > wide, "strong up").when(move < -wide, "strong down").when(move > narrow, "up").when(move < -narrow, "down").otherwise("inside")
    return rows.withColumn("signal", signal)


@dataclass(frozen=True)
class Guppy:
    """Two groups of averages and what counts as compressed, expanded and confirmed. Defaults are fixed values."""

    short: tuple[int, ...] = (3, 5, 8, 10, 12, 15)
    long: tuple[int, ...] = (30, 35, 40, 45, 50, 60)
    kind: str = "EMA"  # or SMA
    compression: float = 0.02
    expansion: float = 0.05
    confirmation: int = 3
    volume_ratio: float = 1.2
    volume_bars: int = 20
    least_bars: int = 65


def guppy(bars: DataFrame, g: Guppy = Guppy()) -> DataFrame:
    """Each bar's groups of averages, whether they are compressed or expanded, and confirmed crossovers.

    short_low, short_high, long_low and long_high span the groups, in ticks. trend is `bullish` where all
    short averages are above all long ones, `bearish` where below, else `mixed`. width compares all
    averages' span with the lowest. A crossover is confirmed at the bar where a trend has held for
    `confirmation` bars after another trend, with volume_confirmed if the volume is at least volume_ratio
    times the mean of the volume_bars bars before. Series of fewer than least_bars bars are left out.
    """
    if g.kind not in ("EMA", "SMA"):
        raise ValueError(f"{g.kind!r} is not EMA or SMA")
    rows = priced(bars)
    names = {f"m{n}": n for n in sorted({*g.short, *g.long})}
    if g.kind == "EMA":
        rows = recursive_means(rows, {name: ("close", 2 / (n + 1)) for name, n in names.items()})
    else:
        rows = rows.withColumns({name: simple_mean("close", n) for name, n in names.items()})
    rows = rows.withColumns({name: ticks(F.col(name)) for name in names})
    span = {
        f"{group}_{end}": f(*(f"m{n}" for n in own)) if len(own) > 1 else F.col(f"m{own[0]}")
        for group, own in (("short", g.short), ("long", g.long))
        for end, f in (("low", F.least), ("high", F.greatest))
    }
    rows = rows.withColumns(span).drop(*names)
    low, high = F.least("short_low", "long_low"), F.greatest("short_high", "long_high")
    trend = F.when(F.col("short_low") > F.col("long_high"), "bullish").when(F.col("short_high") < F.col("long_low"), "bearish").otherwise("mixed")
    width = F.when(high - low <= g.compression * low, "compression").when(high - low >= g.expansion * low, "expansion").otherwise("neutral")
    rows = rows.withColumns({"trend": trend, "width": width, "_bars": F.count("*").over(whole())})
    rows = rows.where(F.col("_bars") >= g.least_bars)
    rows = runs(rows, "trend")
    earlier = series().rowsBetween(-g.volume_bars, -1)
    confirmed = F.col("volume") * F.count("volume").over(earlier) >= g.volume_ratio * F.sum("volume").over(earlier)
    crossed = (F.col("run") > 1) & (F.col("place") == g.confirmation) & (F.col("trend") != "mixed")
    return rows.withColumns({"crossover": F.when(crossed, F.col("trend")), "volume_confirmed": F.when(crossed, F.coalesce(confirmed, F.lit(False)))}).drop("_bars", "run", "place")


def runs(rows: DataFrame, column: str) -> DataFrame:
    """Adds `run`, the number of a series' stretch of equal values (from 1), and `place`, the bar's place in it."""
    changed = ~F.col(column).eqNullSafe(F.lag(column).over(series())) | (F.row_number().over(series()) == 1)
    rows = rows.withColumn("_changed", changed.cast("int"))
    rows = rows.withColumn("run", F.sum("_changed").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")
    return rows.withColumn("place", F.row_number().over(series("run")))
