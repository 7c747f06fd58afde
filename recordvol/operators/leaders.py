"""Leaders of leading groups: returns of series, groups and the whole in one hierarchical aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordvol.operators.averages import TICK, priced, ticks
from recordvol.operators.records import series
from recordvol.schema import KEYS


@dataclass(frozen=True)
class Leaders:
    """Percent of groups kept, series kept in each, least series of a group, bars of history. Defaults are fixed values."""

    top_percent: float = 20.0
    top_series: int = 4
    least_series: int = 3
    bars: int = 50


def latest_returns(bars: DataFrame, n: int) -> DataFrame:
    """change of each series' last close against the one n bars before, in ticks of 1; series with fewer bars are left out."""
    rows = priced(bars).withColumns({"_past": F.lag("close", n).over(series()), "_next": F.lead("d").over(series())})
    rows = rows.where("_next is null and _past > 0")
    return rows.select(*KEYS, "d", "close", ticks(F.col("close") / F.col("_past") - 1).alias("change"))


def hierarchy(returns: DataFrame, group: str) -> DataFrame:
    """Mean change, number of series and best of them for each timeframe's groups and for all of it (`level` group or all).

    One aggregate over both levels: rows meet their group first, and groups meet the whole.
    """
    rolled = returns.rollup("timeframe", group).agg(
        F.grouping(group).alias("_all"), F.grouping("timeframe").alias("_none"), F.count("*").alias("series"), F.sum("change").alias("total"), F.max(F.struct("change", "ticker")).alias("best"), F.count_if(F.col("change") > 0).alias("rising")
    )
    rolled = rolled.where("_none = 0")
    level = F.when(F.col("_all") == 1, "all").otherwise("group")
    return rolled.select("timeframe", F.when(F.col("_all") == 0, F.col(group)).alias(group), level.alias("level"), "series", (F.col("total") / F.col("series") / TICK).alias("mean_change"), "rising", F.col("best.ticker").alias("best"))


def industry_leaders(bars: DataFrame, groups: DataFrame, group: str = "group", p: Leaders = Leaders()) -> DataFrame:
    """The best series of the best groups: timeframe, group, group_rank, rank, ticker, change, group_change.

    groups has ticker and the group's column, one row a ticker; tickers without a group take no part.
    Groups of at least p.least_series series are ranked by mean change (ties by name), and p.top_percent
    percent of them stay, rounded up; of each its p.top_series best series do (ties by ticker).
    """
    known = groups.where(F.col(group).isNotNull()).select("ticker", group)
    returns = latest_returns(bars, p.bars).join(known, "ticker")
    ranked = hierarchy(returns, group).where((F.col("level") == "group") & (F.col("series") >= p.least_series))
    by = Window.partitionBy("timeframe")
    ranked = ranked.withColumns({"group_rank": F.row_number().over(by.orderBy(F.desc("mean_change"), group)), "_groups": F.count("*").over(by)})
    kept = ranked.where((F.col("group_rank") - 1) * 100 < F.col("_groups") * p.top_percent).select("timeframe", group, "group_rank", F.col("mean_change").alias("group_change"))
    inside = Window.partitionBy("timeframe", group).orderBy(F.desc("change"), "ticker")
    best = returns.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= p.top_series)
    return best.join(kept, ["timeframe", group]).select("timeframe", group, "group_rank", "rank", "ticker", "d", "close", (F.col("change") / TICK).alias("change"), "group_change")
