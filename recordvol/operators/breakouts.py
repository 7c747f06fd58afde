"""Breakouts: price and volume with trend lines and ageing signals, and contraction patterns over runs of bars."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.operators.averages import priced, runs, ticks
from recordvol.operators.frames import moving
from recordvol.operators.records import series
from recordvol.schema import KEYS


def _of(values: Mapping[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for timeframe, v in values.items():
        out = F.when(F.col("timeframe") == timeframe, v).otherwise(out)
    return out


def _each(values: Mapping[str, int], f) -> Column:
    """f of each timeframe's number of bars, as frames are fixed in a plan."""
    out = F.lit(None)
    for timeframe, v in values.items():
        out = F.when(F.col("timeframe") == timeframe, f(v)).otherwise(out)
    return out


def slopes(rows: DataFrame, value: str, bars: Iterable[int]) -> DataFrame:
    """Adds `_slope_n` for each n of bars: the slope a bar of the least-squares line through the last n values (whole numbers, none null); null with fewer.

    With x (the column `_x`) counted from 0 at a series' first bar, the sums of y and of x y over the frame
    give it; x is shifted to the frame's end before anything is divided, so it stays exact in whole numbers.
    """
    sums = {f"_{kind}_{n}": ("sum", kind, n) for n in bars for kind in ("_y", "_xy")}
    rows = moving(rows.withColumns({"_y": F.col(value), "_xy": F.col(value) * F.col("_x")}), sums)
    found = {}
    for n in bars:
        y = F.col(f"__y_{n}")
        xy = F.col(f"__xy_{n}") - F.col("_x") * y  # x from 1 - n to 0
        sx, sxx = -n * (n - 1) // 2, (n - 1) * n * (2 * n - 1) // 6
        found[f"_slope_{n}"] = F.when((F.col("_x") >= n - 1) & F.lit(n > 1), (n * xy - sx * y) / F.lit(float(max(1, n * sxx - sx * sx))))
    return rows.withColumns(found).drop("_y", "_xy", *sums)


@dataclass(frozen=True)
class PriceVolume:
    """Bars by timeframe of the price and volume breakouts, the trend line, the threshold and the age. Defaults are fixed values."""

    price: Mapping[str, int] = None
    volume: Mapping[str, int] = None
    trend: Mapping[str, int] = None
    threshold: Mapping[str, int] = None
    max_age: Mapping[str, int] = None
    direction: str = "Long and Short"  # or Long

    def bars(self, which: str) -> dict[str, int]:
        fixed = {
            "price": {"daily": 60, "weekly": 12, "monthly": 6},
            "volume": {"daily": 60, "weekly": 12, "monthly": 6},
            "trend": {"daily": 50, "weekly": 10, "monthly": 4},
            "threshold": {"daily": 5, "weekly": 2, "monthly": 1},
            "max_age": {"daily": 100, "weekly": 20, "monthly": 6},
        }
        return dict(getattr(self, which) or fixed[which])


def price_volume(bars: DataFrame, p: PriceVolume = PriceVolume()) -> DataFrame:
    """Each bar's event and the signal that holds there.

    event is `Buy` where close and volume are both above all of the last p.price closes and p.volume
    volumes before and the trend line (least squares over p.trend closes) rises; `Sell` where the close
    is below all of them, with such a volume and a falling line, if p.direction allows it. signal is the
    last event, with its date, age in bars and close, until the opposite event takes its place, it is
    older than p.max_age, or p.threshold bars in a row close on its wrong side (below a Buy's close, above
    a Sell's).
    """
    if p.direction not in ("Long", "Long and Short"):
        raise ValueError(f"{p.direction!r} is not Long or Long and Short")
    rows = priced(bars).where(F.col("timeframe").isin(list(p.bars("price")))).withColumns({"_x": F.row_number().over(series()) - 1, "_tick": ticks(F.col("close"))})
    full = F.col("_x") >= F.greatest(_of(p.bars("price")), _of(p.bars("volume")))
    frames = [("max", "close", "price"), ("min", "close", "price"), ("max", "volume", "volume")]
    rows = moving(rows, {f"_{how}_{c}_{n}": (how, c, n) for how, c, which in frames for n in set(p.bars(which).values())}, before=1)
    high, low, most = (_each(p.bars(which), lambda n, at=f"_{how}_{c}_": F.col(f"{at}{n}")) for how, c, which in frames)
    rows = slopes(rows.withColumns({"_up": full & (F.col("volume") > most) & (F.col("close") > high), "_down": full & (F.col("volume") > most) & (F.col("close") < low)}), "_tick", set(p.bars("trend").values()))
    rows = rows.withColumn("trend", _each(p.bars("trend"), lambda n: F.col(f"_slope_{n}")))
    event = F.when(F.col("_up") & (F.col("trend") > 0), "Buy")
    if p.direction != "Long":
        event = event.when(F.col("_down") & (F.col("trend") < 0), "Sell")
    rows = rows.withColumn("event", event)
    # The last event is carried on; a new event of either kind starts a stretch of its own.
    running = series().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last(F.when(F.col("event").isNotNull(), F.struct("event", "d", "close", "_x")), ignorenulls=True).over(running))
    last = F.col("_last")
    wrong = F.when(last["event"] == "Buy", F.col("close") < last["close"]).when(last["event"] == "Sell", F.col("close") > last["close"])
    rows = rows.withColumns({"_wrong": F.coalesce(wrong, F.lit(False)), "_start": last["_x"]})
    # How long the bars up to this one have closed on the wrong side: not the bar of the event, so this lies within its stretch.
    rows = rows.withColumn("_right_x", F.max(F.when(~F.col("_wrong"), F.col("_x"))).over(running))
    late = F.col("_x") - F.col("_right_x") >= _of(p.bars("threshold"))
    rows = rows.withColumn("_given_up", F.coalesce(F.max(F.when(late, F.col("_x"))).over(running) >= F.col("_start"), F.lit(False)))
    age = F.col("_x") - last["_x"]
    holds = last.isNotNull() & (age <= _of(p.bars("max_age"))) & ~F.col("_given_up")
    kept = {"signal": last["event"], "signal_date": last["d"], "signal_close": last["close"], "age": age}
    rows = rows.withColumns({c: F.when(holds, v) for c, v in kept.items()})
    return rows.select(*bars.columns, "trend", "event", *kept)


@dataclass(frozen=True)
class Contraction:
    """Bars and thresholds of the range index and its pattern. Defaults are fixed values."""

    period: int = 50
    short: int = 5
    zones: tuple[float, float, float] = (5.0, 10.0, 15.0)
    low: float = 20.0
    expansion: float = 2.0
    quiet_bars: int = 2
    consolidation: int = 3
    confirmation: int = 2

    def scaled(self, scale: float) -> Contraction:
        """Bars for weekly (0.2) or monthly (0.05) series; never fewer than the least that makes sense."""
        at_least = lambda least, n: max(least, int(n * scale))
        return Contraction(at_least(5, self.period), at_least(2, self.short), self.zones, self.low, self.expansion, at_least(1, self.quiet_bars), at_least(1, self.consolidation), at_least(1, self.confirmation))


def contraction(bars: DataFrame, c: Contraction = Contraction()) -> DataFrame:
    """The range index of each bar, its zone, runs of quiet bars, and the steps of the pattern.

    index is where the range of the last c.short bars lies between the smallest and largest such range of
    the last c.period bars, 0 to 100 (null until they are full or where they are equal). zone is 1 to 3 by
    c.zones, else 0; a bar is quiet at an index below c.low. quiet_run counts the quiet bars up to this one.
    An expansion is a bar whose index is at least c.expansion times the one before and not quiet. pattern
    says `contraction` from c.quiet_bars quiet bars in a row on, `consolidation` from c.consolidation on,
    `breakout` at an expansion right after such a consolidation whose close leaves the highest high or
    lowest low of its bars, `confirmed` at the c.confirmation-th bar after a breakout if all closes since
    lie beyond that price, else null. side is `up` or `down` of both.
    """
    rows = priced(bars).withColumn("_x", F.row_number().over(series()) - 1)
    short = series().rowsBetween(1 - c.short, 0)
    full = F.count("*").over(short) == c.short
    rows = rows.withColumn("_range", F.when(full, ticks(F.max("high").over(short) - F.min("low").over(short))))
    wide = series().rowsBetween(1 - c.period, 0)
    low, high, known = F.min("_range").over(wide), F.max("_range").over(wide), F.count("_range").over(wide) == c.period
    rows = rows.withColumn("index", F.when(known & (high > low), (F.col("_range") - low) * 100 / (high - low)))
    zone = F.when(F.col("index") <= c.zones[0], 1).when(F.col("index") <= c.zones[1], 2).when(F.col("index") <= c.zones[2], 3).when(F.col("index").isNotNull(), 0)
    rows = rows.withColumns({"zone": zone, "_quiet": F.coalesce(F.col("index") < c.low, F.lit(False))})
    rows = runs(rows, "_quiet")
    own = Window.partitionBy(*KEYS, "run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"quiet_run": F.when(F.col("_quiet"), F.col("place")).otherwise(0), "_top": F.max("high").over(own), "_bottom": F.min("low").over(own)})
    lag = lambda name, n=1: F.lag(name, n).over(series())
    grown = (F.col("index") >= c.expansion * lag("index")) & ~F.col("_quiet") & (lag("quiet_run") >= c.consolidation)
    side = F.when(grown & (F.col("close") > lag("_top")), "up").when(grown & (F.col("close") < lag("_bottom")), "down")
    rows = rows.withColumns({"_side": side, "_edge": F.when(F.col("close") > lag("_top"), lag("_top")).otherwise(lag("_bottom"))})
    since = series().rowsBetween(1 - c.confirmation, 0)
    then_side, then_edge = lag("_side", c.confirmation), lag("_edge", c.confirmation)
    held = F.when(then_side == "up", F.min("close").over(since) > then_edge).when(then_side == "down", F.max("close").over(since) < then_edge)
    rows = rows.withColumn("_held", F.when(held, then_side))
    pattern = (
        F.when(F.col("_side").isNotNull(), "breakout").when(F.col("_held").isNotNull(), "confirmed")
        .when(F.col("quiet_run") >= c.consolidation, "consolidation").when(F.col("quiet_run") >= c.quiet_bars, "contraction")
    )
    rows = rows.withColumns({"pattern": pattern, "side": F.coalesce("_side", "_held")})
    return rows.select(*bars.columns, "index", "zone", "quiet_run", "pattern", "side")
