"""Cross-sectional strength: percentile ranks of all series on a date, and the rotation that picks leaders step by step.

Ratings need a partitioning by date: bars move there once, with all measures in their row, and each
measure is a sorted window over a date, which spills where a date holds very many series.

`cross_ranks` counts a single measure on two levels: values fall into at most 2 * BUCKETS buckets of a
date, the buckets' counts are summed up over each date (a small table), and only within a bucket are
values put in order, so a date is as many tasks as it has buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.operators.averages import TICK, priced, recursive_means, simple_mean, ticks, true_range
from recordvol.operators.records import series
from recordvol.schema import KEYS

#: Width of a bucket of values, and buckets on each side of 0; what lies beyond is in the outermost ones.
WIDTH, BUCKETS = 0.005, 500


def cross_ranks(rows: DataFrame, by: tuple[str, ...], value: str) -> DataFrame:
    """Adds at_most, how many rows of the same `by` have a value of at most the row's own, and of, how many have a value.

    Rows without a value keep null ranks.
    """
    none = rows.where(F.col(value).isNull()).withColumns({"at_most": F.lit(None).cast("long"), "of": F.lit(None).cast("long")})
    rows = rows.where(F.col(value).isNotNull())
    rows = rows.withColumn("_bucket", F.greatest(F.lit(-BUCKETS), F.least(F.lit(BUCKETS), F.floor(F.col(value) / WIDTH))).cast("int"))
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "of": F.sum("_n").over(Window.partitionBy(*by))}).drop("_n")
    rows = rows.join(counts, [*by, "_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("at_most", F.col("_before") + F.count("*").over(inside)).drop("_bucket", "_before")
    return rows.unionByName(none)


@dataclass(frozen=True)
class Strength:
    """Bars of the returns that are ranked, and thresholds. Defaults are fixed values."""

    spans: tuple[int, ...] = (5, 20, 60, 120)
    leader: float = 70.0
    top: float = 97.0
    atr_rating: float = 50.0
    range_position: float = 0.5
    atr_bars: int = 14
    range_bars: int = 20
    mean_bars: int = 50
    warning: float = 7.0
    danger: float = 11.0


def strength(bars: DataFrame, s: Strength = Strength(), partitions: int | None = None) -> DataFrame:
    """Percentile ratings of each bar among all series of its timeframe and date.

    rating_n is 100 times the share of series whose return over the last n bars is at most the bar's own
    (null without n bars before), atr_rating the same of the average true range per price. leader: the
    mean of all ratings of returns reaches s.leader. qualified: one of them reaches s.top, atr_rating its
    threshold, and the close lies at least range_position up the range of the last range_bars. extension
    is the close's distance from its mean in ranges; extended says `warning` or `danger` of it. The dates
    are dealt into `partitions`, by default the session's.
    """
    rows = priced(bars).withColumn("true_range", true_range())
    rows = recursive_means(rows, {"atr": ("true_range", 1 / s.atr_bars)})
    frame = series().rowsBetween(1 - s.range_bars, 0)
    low, high = F.min("low").over(frame), F.max("high").over(frame)
    earlier = {n: F.lag("close", n).over(series()) for n in s.spans}
    returns = {f"rating_{n}": F.when(c > 0, F.col("close") / c - 1) for n, c in earlier.items()}
    rows = rows.withColumns({"atr": ticks(F.col("atr")), "tick": ticks(F.col("close")), "mean": ticks(simple_mean("close", s.mean_bars)), "position": F.when(high > low, (F.col("close") - low) / (high - low)), **returns})
    rows = rows.withColumn("atr_rating", F.when(F.col("tick") > 0, F.col("atr") / F.col("tick")))
    measures = [*returns, "atr_rating"]
    rows = rows.select(*KEYS, "d", "close", "atr", "tick", "mean", "position", *measures)
    rows = rows.repartition(partitions, "timeframe", "d") if partitions else rows
    # A window a measure over the same rows; nulls come first and are not counted.
    day = Window.partitionBy("timeframe", "d")
    wide = rows.withColumns({f"_of_{m}": F.count(m).over(day) for m in measures})
    for m in measures:
        at_most = F.count(m).over(day.orderBy(m).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        wide = wide.withColumn(m, F.when(F.col(m).isNotNull(), at_most * 100 / F.col(f"_of_{m}")))
    own: list[Column] = [F.col(m) for m in returns]
    total = own[0]
    for c in own[1:]:
        total = total + c
    best = F.greatest(*own) if len(own) > 1 else own[0]
    extension = F.when(F.col("atr") > 0, (F.col("tick") - F.col("mean")) / F.col("atr"))
    no = lambda c: F.coalesce(c, F.lit(False))
    wide = wide.withColumns({"extension": extension, "leader": no(total / len(own) >= s.leader), "qualified": no((best >= s.top) & (F.col("atr_rating") >= s.atr_rating) & (F.col("position") >= s.range_position))})
    wide = wide.withColumn("extended", F.when(F.col("extension") >= s.danger, "danger").when(F.col("extension") >= s.warning, "warning"))
    return wide.select(*KEYS, "d", "close", *measures, (F.col("atr") / TICK).alias("atr"), "position", "extension", "extended", "leader", "qualified")


@dataclass(frozen=True)
class Rotation:
    """Months of the returns, how many series each step keeps, and the least history. Defaults are fixed values."""

    months: tuple[int, ...] = (12, 6, 3)
    keep: tuple[int, ...] = (50, 30, 10)
    history: int = 12
    min_price: float = 5.0
    min_volume: float = 100_000


def month_ends(bars: DataFrame) -> DataFrame:
    """month, price and volume of each series at the end of every month from its first to its last bar.

    A month without a bar has the last price before it, and no volume.
    """
    month = F.trunc("d", "month").alias("month")
    ends = bars.where("close is not null").groupBy(*KEYS, month).agg(F.max_by("close", "d").alias("price"), F.max_by("volume", "d").alias("volume"))
    # The next month with a bar is a window's look ahead, so months in between need no join.
    following = F.lead("month").over(Window.partitionBy(*KEYS).orderBy("month"))
    ends = ends.withColumn("_until", F.coalesce(F.add_months(following, -1), F.col("month")))
    ends = ends.select(*KEYS, F.col("month").alias("_first"), "price", "volume", F.explode(F.sequence("month", "_until", F.expr("interval 1 month"))).alias("month"))
    return ends.select(*KEYS, "month", "price", F.when(F.col("month") == F.col("_first"), F.col("volume")).alias("volume"))


def rotation(bars: DataFrame, r: Rotation = Rotation()) -> DataFrame:
    """What each month's cascade keeps: the best of the first return, of these the best of the second, and so on.

    A series takes part in a month if it has r.history months before it, a price of r.min_price and a
    volume of r.min_volume at least. return_n and rank_n are given for every step (ranks are null for
    what a step before dropped); ties go to the smaller ticker.
    """
    own = Window.partitionBy(*KEYS).orderBy("month")
    rows = month_ends(bars)
    rows = rows.withColumns({f"return_{n}": F.col("price") / F.lag("price", n).over(own) - 1 for n in r.months} | {"_known": F.row_number().over(own) - 1})
    rows = rows.where((F.col("_known") >= r.history) & (F.col("price") >= r.min_price) & (F.coalesce("volume", F.lit(0.0)) >= r.min_volume)).drop("_known")
    for i, (n, keep) in enumerate(zip(r.months, r.keep)):
        rank = F.row_number().over(Window.partitionBy("timeframe", "month").orderBy(F.desc(f"return_{n}"), "ticker"))
        rows = rows.where(F.col(f"return_{n}").isNotNull()).withColumn(f"rank_{n}", rank).where(F.col(f"rank_{n}") <= keep)
    return rows
