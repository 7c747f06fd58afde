"""Price levels: pivots confirmed from both sides, the bar that first breaks each, and timing signals.

`first_above` is the interval join behind it. Bars of a series are summed up in tiers, FAN to one: a row
of a tier holds the largest values of FAN rows below it. A level looks at the rest of its own row, goes up
a tier where nothing there is higher, and comes down again where something is: one equality join a
tier and direction, with FAN values looked at in each. No level meets every later bar, and no row
holds more than FAN values.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.operators.averages import priced, recursive_means, simple_mean, ticks
from recordvol.operators.records import series, whole
from recordvol.schema import KEYS
from recordvol.sources.settings import Period, period, period_lists

FAN = 64


def pivots(bars: DataFrame, strength: int, carried: Mapping[str, Column] | None = None) -> DataFrame:
    """Bars whose high is above those of `strength` bars before and not below those of as many after; all must be there.

    level is the high, n the bar's place in its series (from 0), seen_n that of the bar that confirms it.
    `carried` columns are taken over all bars, so they may look around in the series.
    """
    carried = carried or {}
    ahead, back = series().rowsBetween(1, strength), series().rowsBetween(-strength, -1)
    rows = priced(bars).withColumns(
        {"n": F.row_number().over(series()) - 1, "_higher": F.max("high").over(back), "_ahead": F.max("high").over(ahead), "_back_n": F.count("*").over(back), "_ahead_n": F.count("*").over(ahead), **carried}
    )
    enough = (F.col("_back_n") == strength) & (F.col("_ahead_n") == strength)
    rows = rows.where(enough & (F.col("high") > F.col("_higher")) & (F.col("high") >= F.col("_ahead")))
    return rows.select(*KEYS, "d", "n", F.col("high").alias("level"), (F.col("n") + strength).alias("seen_n"), *carried)


def first_above(levels: DataFrame, bars: DataFrame, value: str, after: str, carried: tuple[str, ...], most_bars: int, fan: int = FAN) -> DataFrame:
    """Adds to each level the `carried` columns of the first bar of its series past place `after` whose value is above it.

    bars has the bar's place as n (from 0, without gaps); most_bars is at least the longest series.
    Null where no bar is above. Bars' values must not be null.
    """
    tiers, below = [], bars.select(*KEYS, "n", F.col(value).alias("v"), F.struct(*carried).alias("bar"))
    size = max(most_bars, 1)
    while True:
        own = F.array_sort(F.collect_list(F.struct("n", "v", "bar") if not tiers else F.struct("n", "v")))  # at most fan
        tier = below.groupBy(*KEYS, F.floor(F.col("n") / fan).alias("_row")).agg(own.alias("_own"), F.max("v").alias("_top"))
        tiers.append(tier.drop("_top"))
        below = tier.select(*KEYS, F.col("_row").alias("n"), F.col("_top").alias("v"))
        size = -(-size // fan)
        if size <= 1:
            break
    columns = levels.columns
    state = levels.withColumns({"_at": F.col(after) + 1, "_hit": F.lit(None).cast("long"), "_tier": F.lit(None).cast("int"), "_bar": F.lit(None).cast(bars.select(F.struct(*carried).alias("b")).schema["b"].dataType)})

    def look(state: DataFrame, t: int, row: Column, skip: Column) -> DataFrame:
        """Joins a tier's row and finds the first of its values, after `skip` of them, that is above the level."""
        state = state.withColumn("_row", row).join(tiers[t], [*KEYS, "_row"], "left")
        level = F.col("level")
        place = F.array_position(F.transform(F.slice("_own", F.coalesce(skip, F.lit(0)) + 1, fan), lambda x: x["v"] > level), True)
        state = state.withColumn("_place", F.when(place > 0, place + F.coalesce(skip, F.lit(0)) - 1))
        if t == 0:
            state = state.withColumn("_bar", F.coalesce("_bar", F.get("_own", F.col("_place").cast("int"))["bar"]))
        return state.drop("_own")

    for t in range(len(tiers)):
        searching = F.col("_hit").isNull()
        state = look(state, t, F.when(searching, F.floor(F.col("_at") / fan)), (F.col("_at") % fan).cast("int"))
        found = searching & F.col("_place").isNotNull()
        state = state.withColumns(
            {
                "_tier": F.when(found, t).otherwise(F.col("_tier")),
                "_at": F.when(searching & ~found, F.floor(F.col("_at") / fan) + 1).otherwise(F.col("_at")),
                "_hit": F.when(found, F.floor(F.col("_at") / fan) * fan + F.col("_place")).otherwise(F.col("_hit")),
            }
        ).drop("_row", "_place")
    for t in range(len(tiers) - 1, 0, -1):
        down = F.col("_tier") == t
        state = look(state, t - 1, F.when(down, F.col("_hit")), F.lit(0))
        state = state.withColumns({"_tier": F.when(down, t - 1).otherwise(F.col("_tier")), "_hit": F.when(down, F.col("_hit") * fan + F.col("_place")).otherwise(F.col("_hit"))}).drop("_row", "_place")
    return state.select(*columns, *(F.col(f"_bar.{c}").alias(c) for c in carried))


def later(d: Column, p: Period, sign: int = 1) -> Column:
    """A date so many months or days later (or before)."""
    return F.add_months(d, sign * p.count) if p.months else F.date_add(d, sign * p.count)


@dataclass(frozen=True)
class GreenLines:
    """How levels are found and judged. Defaults are fixed values."""

    strength: int = 10
    lookback: str = "3m"
    history: str = "1y"
    confirmation: str = "2w"

    @staticmethod
    def sets(lookbacks: str, histories: str, confirmations: str, strength: int = 10) -> list[GreenLines]:
        """One for each place of lists such as `3m;6m`; shorter lists go on with their first."""
        return [GreenLines(strength, *x) for x in period_lists(lookbacks, histories, confirmations)]


def green_lines(bars: DataFrame, g: GreenLines = GreenLines(), most_bars: int = FAN**3) -> DataFrame:
    """Each pivot's level until a close breaks it.

    pivot_date, level, seen_date (the bar that confirms the pivot), breakout_date and its close, and
    is_green: the level held for g.lookback from its pivot, up to the breakout or the last bar.
    is_recent: the pivot lies in the last g.history of its series. status is `open` without a breakout,
    `failed` if a close within g.confirmation from the breakout falls below the level, `confirmed` if none
    does, `pending` if the series ends before.
    """
    holds = period(g.confirmation)
    days = holds.count if not holds.months else 30 * holds.count
    ahead = Window.partitionBy(*KEYS).orderBy(F.unix_date("d")).rangeBetween(0, days)
    rows = priced(bars).withColumns({"n": F.row_number().over(series()) - 1, "low_ahead": F.min("close").over(ahead)})
    rows = rows.select(*KEYS, "n", "close", "low_ahead", F.col("d").alias("breakout_date"))
    found = pivots(bars, g.strength, {"seen_date": F.lead("d", g.strength).over(series()), "ends": F.max("d").over(whole())}).withColumnRenamed("d", "pivot_date")
    found = first_above(found, rows, "close", "seen_n", ("breakout_date", "close", "low_ahead"), most_bars)
    held = F.coalesce("breakout_date", "ends") >= later(F.col("pivot_date"), period(g.lookback))
    status = (
        F.when(F.col("breakout_date").isNull(), "open")
        .when(F.col("low_ahead") < F.col("level"), "failed")
        .when(F.date_add("breakout_date", days) <= F.col("ends"), "confirmed")
        .otherwise("pending")
    )
    recent = F.col("pivot_date") >= later(F.col("ends"), period(g.history), -1)
    return found.select(*KEYS, "pivot_date", "level", "seen_date", "breakout_date", F.col("close").alias("breakout_close"), held.alias("is_green"), recent.alias("is_recent"), status.alias("status"))


@dataclass(frozen=True)
class Dots:
    """Periods and thresholds of the two timing signals. Defaults are fixed values."""

    blue_bars: int = 10
    blue_threshold: float = 20.0
    blue_mean: int = 50
    black_bars: int = 10
    black_threshold: float = 25.0
    black_lookback: int = 3
    black_mean: int = 30
    black_ema: int = 21


def stochastic(bars: int) -> Column:
    """Where the close lies between the lowest low and highest high of the last bars, 0 to 100; null without a range."""
    frame = series().rowsBetween(1 - bars, 0)
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    return F.when(high > low, (F.col("close") - low) / (high - low) * 100)


def dots(bars: DataFrame, p: Dots = Dots()) -> DataFrame:
    """Adds blue_dot and black_dot.

    A blue dot is a bar at which the stochastic comes from below the threshold to it or above while the
    simple mean rises; a black dot one that closes above the close before and above its simple or
    exponential mean, with the stochastic below the threshold in one of the last black_lookback bars.
    """
    rows = recursive_means(priced(bars), {"ema": ("close", 2 / (p.black_ema + 1))})
    rows = rows.withColumns({"blue": stochastic(p.blue_bars), "black": stochastic(p.black_bars), "rising": ticks(simple_mean("close", p.blue_mean)), "mean": ticks(simple_mean("close", p.black_mean)), "ema": ticks(F.col("ema")), "tick": ticks(F.col("close"))})
    lag = lambda c: F.lag(c).over(series())
    low = F.min("black").over(series().rowsBetween(1 - p.black_lookback, 0))
    no = lambda c: F.coalesce(c, F.lit(False))
    blue = (lag("blue") < p.blue_threshold) & (F.col("blue") >= p.blue_threshold) & (F.col("rising") > lag("rising"))
    black = (low < p.black_threshold) & (F.col("tick") > lag("tick")) & ((F.col("tick") > F.col("mean")) | (F.col("tick") > F.col("ema")))
    rows = rows.withColumns({"blue_dot": no(blue), "black_dot": no(black)})
    return rows.select(*bars.columns, "blue_dot", "black_dot")
