"""Record-volume detection: one exchange on (timeframe, ticker) feeds every window and the summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from recordvol.schema import HEAD, KEYS, TAIL, TRAILING


def series(*more: str) -> WindowSpec:
    """Bars of a series by date. All frames below share its exchange and sort."""
    return Window.partitionBy(*KEYS, *more).orderBy("d")


def whole(*more: str) -> WindowSpec:
    return series(*more).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def before(*more: str) -> WindowSpec:
    return series(*more).rowsBetween(Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Screen:
    """Settings of a screen. `as_of` (yyyy-mm-dd) is the day a rolling range counts back from."""

    as_of: str | None = None
    limit_years: int = 0
    min_price: float = 0.0
    min_volume: float = 0.0
    range_mode: str = "rolling"
    start: str | None = None
    end: str | None = None
    trailing: bool = True
    window_days: int = 365
    first_is_record: bool = True
    null_resets: bool = False

    def in_range(self) -> Column | None:
        """The date condition, or None where all dates count."""
        if self.range_mode == "fixed" and self.start and self.end:
            return F.col("d").between(F.lit(self.start).cast("date"), F.lit(self.end).cast("date"))
        if self.limit_years > 0:
            if not self.as_of:
                raise ValueError("a rolling range needs as_of")
            # The cutoff has a time of day, so the boundary day is before it.
            return F.col("d") > F.add_months(F.lit(self.as_of).cast("date"), -12 * self.limit_years)
        return None


def running_max(bars: DataFrame) -> DataFrame:
    return bars.withColumn("running_max", F.max("volume").over(series().rowsBetween(Window.unboundedPreceding, 0)))


def previous_max(*more: str, null_resets: bool = False) -> Column:
    """The largest volume before a bar. With null_resets a null right before it counts as none."""
    largest = F.max("volume").over(before(*more))
    return F.when(F.lag("volume").over(series(*more)).isNotNull(), largest) if null_resets else largest


def is_record(first_is_record: bool = True, null_resets: bool = False) -> Column:
    """Whether a bar's volume is above all before it; null volumes never are.

    first_is_record=False: a series' first bar, with nothing before it, is none.
    """
    largest = previous_max(null_resets=null_resets)
    largest = F.coalesce(largest, F.lit(0.0)) if first_is_record else largest
    return F.coalesce(F.col("volume") > largest, F.lit(False))


def record_flags(bars: DataFrame, first_is_record: bool = True, null_resets: bool = False) -> DataFrame:
    return bars.withColumn("is_record", is_record(first_is_record, null_resets))


def record_events(bars: DataFrame, first_is_record: bool = True) -> DataFrame:
    """One row per record: timeframe, ticker, d, volume."""
    return record_flags(bars, first_is_record).where("is_record").select(*KEYS, "d", "volume")


def latest_filter(bars: DataFrame, screen: Screen) -> DataFrame:
    """Series whose latest close and volume are not below the minima; a null latest value passes."""
    keep = F.lit(True)
    for column, least in (("close", screen.min_price), ("volume", screen.min_volume)):
        if least > 0:
            keep = keep & ~F.coalesce(F.last(column).over(whole()) < F.lit(float(least)), F.lit(False))
    if screen.min_price <= 0 and screen.min_volume <= 0:
        return bars
    return bars.withColumn("_keep", keep).where("_keep").drop("_keep")


def flagged(bars: DataFrame, screen: Screen) -> DataFrame:
    """Bars in range of series with two bars at least, with records, trailing window and its records."""
    rows = latest_filter(bars, screen)
    condition = screen.in_range()
    rows = rows if condition is None else rows.where(condition)
    rows = rows.withColumns({"_n": F.count("*").over(whole()), "latest_date": F.max("d").over(whole()), "max_volume": F.max("volume").over(whole())}).where("_n >= 2")
    rows = rows.withColumn("is_record", is_record(screen.first_is_record, screen.null_resets))
    if not screen.trailing:
        return rows
    # The running maximum starts again in the window; the flag is one more key of the same partitioning.
    rows = rows.withColumn("in_window", F.col("d") >= F.date_sub("latest_date", screen.window_days))
    above = F.coalesce(F.col("volume") > F.coalesce(previous_max("in_window", null_resets=screen.null_resets), F.lit(0.0)), F.lit(False))
    return rows.withColumns({"is_window_record": F.col("in_window") & above, "window_max": F.when(F.col("in_window"), F.max("volume").over(whole("in_window")))})


def _events(flag: str) -> Column:
    return F.sort_array(F.collect_list(F.when(F.col(flag), F.struct("d", "volume"))), asc=False)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def summary(bars: DataFrame, screen: Screen = Screen()) -> DataFrame:
    """The flagship result, one row per series that has a volume, in the contractual column order."""
    rows = flagged(bars, screen)
    last_year = F.col("d") >= F.add_months("latest_date", -12)
    found = {
        "hve_date": F.min(F.when(F.col("volume") == F.col("max_volume"), F.col("d"))),
        "hve_volume": F.max("volume"),
        "hve_occ_1y": F.count_if(F.col("is_record") & last_year).cast("int"),
        "total_hve_count": F.count_if("is_record").cast("int"),
        "all_hve_details": _events("is_record"),
        "latest_date": F.max("d"),
        "latest_volume": F.max_by("volume", "d"),
        "latest_close": F.max_by("close", "d"),
        "data_points": F.count("*").cast("int"),
    }
    if screen.trailing:
        found |= {
            "window_bars": F.count_if("in_window"),
            "hv1y_date": F.min(F.when(F.col("in_window") & (F.col("volume") == F.col("window_max")), F.col("d"))),
            "hv1y_volume": F.max("window_max"),
            "hv1y_occ_1y": F.count_if("is_window_record").cast("int"),
            "all_hv1y_details": _events("is_window_record"),
        }
    out = rows.groupBy(*KEYS).agg(*(c.alias(n) for n, c in found.items())).where("hve_volume is not null")
    out = out.withColumn("days_since_hve", F.datediff("latest_date", "hve_date")).withColumn("volume_ratio", ratio(F.col("latest_volume"), F.col("hve_volume")))
    if not screen.trailing:
        return out.select(*HEAD, *TAIL)
    enough = (F.col("window_bars") >= 2) & F.col("hv1y_volume").isNotNull()
    none = F.filter("all_hv1y_details", lambda x: F.lit(False))
    trailing = {
        "days_since_hv1y": F.when(enough, F.datediff("latest_date", "hv1y_date")),
        "total_hv1y_count": F.when(enough, F.col("hv1y_occ_1y")).otherwise(0),
        "is_hv1y_also_hve": F.when(enough, F.col("hv1y_date") == F.col("hve_date")).otherwise(False),
        "hv1y_to_hve_ratio": F.when(enough, ratio(F.col("hv1y_volume"), F.col("hve_volume"))).otherwise(0.0),
    }
    out = out.withColumns(trailing)
    out = out.withColumns(
        {
            "hv1y_date": F.when(enough, F.col("hv1y_date")),
            "hv1y_volume": F.when(enough, F.col("hv1y_volume")),
            "hv1y_occ_1y": F.when(enough, F.col("hv1y_occ_1y")).otherwise(0),
            "all_hv1y_details": F.when(enough, F.col("all_hv1y_details")).otherwise(none),
        }
    )
    return out.select(*HEAD, *TRAILING, *TAIL)
