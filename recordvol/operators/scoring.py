"""Scores, ranking and the sheets of the legacy report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordvol.functions.text import intraday_change
from recordvol.operators.records import ratio, record_flags, whole
from recordvol.schema import KEYS

#: Days that stand for a missing day count.
NO_DAYS = 9999


def score(days: Column, count: Column, ratio_percent: Column) -> Column:
    """0 to 100: half recency, then how many records, then the latest volume against the largest; 0 where a part is null."""
    recency = (
        F.when(days <= 30, F.lit(50.0))
        .when(days <= 90, 50.0 * (1 - (days - 30) / 60 * 0.5))
        .when(days <= 365, 25.0 * (1 - (days - 90) / 275 * 0.8))
        .otherwise(5.0 * F.greatest(F.lit(0.0), 1 - (days - 365) / 365))
    )
    recency = F.when(days.isNotNull(), recency)
    frequency = F.least(F.lit(30.0), count * 3.0)
    # least() would skip a null
    volume = F.when(ratio_percent.isNotNull(), F.least(F.lit(20.0), ratio_percent / 5))
    return F.coalesce(F.round(recency + F.when(count.isNotNull(), frequency) + volume, 2), F.lit(0.0))


def legacy_results(bars: DataFrame, empty: bool = False) -> DataFrame:
    """Per series with a record past its first bar: counts, dates, largest and current values and detailed records.

    empty: series without such a record are there too, with a count of 0 and nothing else.
    """
    rows = record_flags(bars, first_is_record=False).withColumn("max_volume", F.max("volume").over(whole()))
    move = intraday_change(F.col("open"), F.col("close"))
    event = F.struct("d", "volume", "close", "open", "high", "low", move.alias("price_change_pct"))
    out = rows.groupBy(*KEYS).agg(
        F.count_if("is_record").alias("hve_count"),
        F.max(F.when(F.col("is_record"), F.col("d"))).alias("latest_hve_date"),
        F.max("volume").alias("max_volume_ever"),
        F.max_by("volume", "d").alias("current_volume"),
        F.max_by("close", "d").alias("current_price"),
        F.min("d").alias("data_start_date"),
        F.max("d").alias("data_end_date"),
        F.count("*").alias("data_points"),
        F.sort_array(F.collect_list(F.when(F.col("is_record"), event)), asc=False).alias("hve_details"),
    )
    if empty:
        known = [c for c in out.columns if c not in (*KEYS, "hve_count", "data_points", "hve_details")]
        out = out.withColumns({c: F.when(F.col("hve_count") > 0, F.col(c)) for c in known})
        out = out.withColumn("data_points", F.when(F.col("hve_count") > 0, F.col("data_points")).otherwise(0))
    else:
        out = out.where("hve_count > 0")
    out = out.withColumn("days_since_latest_hve", F.datediff("data_end_date", "latest_hve_date"))
    return out.withColumn("volume_ratio_to_max", F.when(F.col("hve_count") > 0, 100 * ratio(F.col("current_volume"), F.col("max_volume_ever"))))


def from_screen(results: DataFrame) -> DataFrame:
    """Results of a screen (`records.summary`) with the names scores and sheets go by; the largest volume is the latest record."""
    names = {
        "hve_count": "total_hve_count", "latest_hve_date": "hve_date", "max_volume_ever": "hve_volume", "current_volume": "latest_volume", "current_price": "latest_close",
        "data_end_date": "latest_date", "data_points": "data_points", "days_since_latest_hve": "days_since_hve",
    }
    percent = (100 * F.col("volume_ratio")).alias("volume_ratio_to_max")
    return results.select(*KEYS, *(F.col(c).alias(n) for n, c in names.items()), F.lit(None).cast("date").alias("data_start_date"), percent)


def scored(results: DataFrame) -> DataFrame:
    """Legacy results with their score, best first."""
    value = score(F.col("days_since_latest_hve"), F.col("hve_count"), F.col("volume_ratio_to_max"))
    return results.withColumn("score", value).orderBy(F.desc("score"), "ticker", "timeframe")


def summary_sheet(results: DataFrame) -> DataFrame:
    names = {
        "Ticker": "ticker", "Timeframe": "timeframe", "Score": "score", "HVE Count": "hve_count", "Latest HVE Date": "latest_hve_date", "Days Since HVE": "days_since_latest_hve",
        "Max Volume": "max_volume_ever", "Current Volume": "current_volume", "Volume % of Max": "volume_ratio_to_max", "Current Price": "current_price",
        "Data Start": "data_start_date", "Data End": "data_end_date", "Data Points": "data_points",
    }
    return results.select(*(F.col(c).alias(n) for n, c in names.items()))


def details_sheet(results: DataFrame) -> DataFrame:
    """One row per record."""
    names = {"HVE Date": "d", "Volume": "volume", "Close Price": "close", "Open Price": "open", "High Price": "high", "Low Price": "low", "Price Change %": "price_change_pct"}
    rows = results.select(F.col("ticker").alias("Ticker"), F.col("timeframe").alias("Timeframe"), F.explode("hve_details").alias("e"))
    return rows.select("Ticker", "Timeframe", *(F.col(f"e.{c}").alias(n) for n, c in names.items()))


def stats_sheet(results: DataFrame) -> DataFrame:
    """Per timeframe: how many series, and averages, extremes and recency counts."""
    days = F.col("days_since_latest_hve")
    mean = lambda c: F.round(F.sum(c) / F.count("*"), 2)
    return results.groupBy("timeframe").agg(
        F.count("*").alias("tickers"),
        mean("hve_count").alias("avg_count"), F.max("hve_count").alias("max_count"), F.min("hve_count").alias("min_count"),
        mean(days).alias("avg_days"), F.min(days).alias("min_days"), F.max(days).alias("max_days"),
        mean("score").alias("avg_score"), F.max("score").alias("max_score"), mean("volume_ratio_to_max").alias("avg_ratio"),
        F.count_if(days <= 30).alias("last_30"), F.count_if(days <= 90).alias("last_90"), F.count_if(days <= 365).alias("last_365"),
    )


def all_combined(*per_timeframe: DataFrame) -> DataFrame:
    """Summary sheets of several timeframes as one, best score first."""
    out, *more = per_timeframe
    for table in more:
        out = out.unionByName(table)
    return out.orderBy(F.desc("Score"), "Ticker", "Timeframe")
