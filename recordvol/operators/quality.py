"""Validation of series: one lag over closes, one aggregate, one verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.operators.records import whole
from recordvol.schema import KEYS

#: Least bars of a series by timeframe, and otherwise.
LEAST_BARS = {"daily": 252, "weekly": 52, "monthly": 12, "intraday": 100}
LEAST_OTHER = 50
MOST_MISSING, EXTREME_MOVE, MOST_EXTREME = 0.1, 0.5, 0.01


def least_bars(override: int | None = None) -> Column:
    if override is not None:
        return F.lit(override)
    out = F.lit(LEAST_OTHER)
    for timeframe, n in LEAST_BARS.items():
        out = F.when(F.col("timeframe") == timeframe, n).otherwise(out)
    return out


def close_changes(bars: DataFrame) -> DataFrame:
    """Per bar, the change against the close before it that is not null (null where there is none)."""
    before = Window.partitionBy(*KEYS).orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("close", ignorenulls=True).over(before)
    return bars.withColumn("change", F.when(last != 0, F.col("close") / last - 1))


def stats() -> dict[str, Column]:
    """What a series' verdict rests on, as aggregates of `close_changes`; rows without a date only say that there is a file."""
    extreme, dated = F.abs("change") > EXTREME_MOVE, F.col("d").isNotNull()
    return {
        "bars": F.count("d"),
        "missing": F.count_if(dated & F.col("close").isNull()),
        "bad_prices": F.count_if(F.col("close") <= 0),
        "changes": F.count("change"),
        "extreme": F.count_if(extreme),
        "first_date": F.min("d"),
        "last_date": F.max("d"),
    }


def series_stats(bars: DataFrame) -> DataFrame:
    """bars, missing, bad_prices, changes and extreme moves of each series."""
    return close_changes(bars).groupBy(*KEYS).agg(*(c.alias(name) for name, c in stats().items()))


def verdict(override: int | None = None, closes: Column | None = None) -> Column:
    """The first test a series fails by its statistics, or "Valid data". Texts are fixed values."""
    n = F.col("bars")
    least = least_bars(override)
    return (
        F.when(n == 0, "No data available")
        .when(n < least, F.format_string("Insufficient data: %d < %d (%s)", n, least, F.col("timeframe")))
        .when(F.lit(False) if closes is None else ~closes, "Missing Close price column")
        .when(F.col("missing") > n * MOST_MISSING, F.format_string("Too many missing Close prices: %d", F.col("missing")))
        .when(F.col("bad_prices") > 0, "Invalid price values (≤ 0)")
        .when(F.col("extreme") > F.col("changes") * MOST_EXTREME, F.format_string("Too many extreme price movements: %d", F.col("extreme")))
        .otherwise("Valid data")
    )


def _closes(bars: DataFrame) -> dict[str, Column]:
    """Whether a series' source has closes, where bars say so by their column has_close."""
    return {"closes": F.bool_and("has_close")} if "has_close" in bars.columns else {}


def verdicts(bars: DataFrame, override: int | None = None) -> DataFrame:
    """timeframe, ticker, valid and reason of each series; bars as of `with_files` also tell of missing columns and rows."""
    own = stats() | _closes(bars)
    found = close_changes(bars).groupBy(*KEYS).agg(*(c.alias(name) for name, c in own.items()))
    reason = verdict(override, F.col("closes") if "closes" in own else None)
    return found.select(*KEYS, (reason == "Valid data").alias("valid"), reason.alias("reason"))


def valid_bars(bars: DataFrame, override: int | None = None) -> DataFrame:
    """Bars of the valid series; their verdicts are windows over the exchange that records use as well."""
    own = stats() | _closes(bars)
    rows = close_changes(bars).withColumns({name: c.over(whole()) for name, c in own.items()})
    rows = rows.where(verdict(override, F.col("closes") if "closes" in own else None) == "Valid data").where("d is not null")
    return rows.select(*(c for c in bars.columns if c != "has_close"))


def data_summary(bars: DataFrame, sample: int | None = None) -> DataFrame:
    """series, valid, mean bars of the valid (rounded down) and their dates; over the first `sample` tickers, or all."""
    if sample is not None:
        first = bars.select("ticker").distinct().orderBy("ticker").limit(sample)
        bars = bars.join(F.broadcast(first), "ticker", "left_semi")
    ok = verdict() == "Valid data"
    n = F.count_if(ok)
    return series_stats(bars).agg(
        F.count("*").alias("series"),
        n.alias("valid"),
        F.when(n > 0, F.floor(F.sum(F.when(ok, F.col("bars"))) / n)).alias("mean_bars"),
        F.min(F.when(ok, F.col("first_date"))).alias("first_date"),
        F.max(F.when(ok, F.col("last_date"))).alias("last_date"),
    )
