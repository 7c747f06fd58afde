"""Volume: records over calendar months, deviations, ratios, and cumulative flows with divergences from the price.

Flows are summed in whole steps of 1 / TICK, so a cumulative flow is exact whatever the order of its sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.operators.averages import priced, ticks
from recordvol.operators.frames import moving, size
from recordvol.operators.levels import pivots
from recordvol.operators.records import series, whole
from recordvol.schema import KEYS

_SERIES = "PARTITION BY timeframe, ticker ORDER BY d"


def above_months(column: str, months: int) -> Column:
    """Whether a bar's value is above all those of the calendar months before it; there must be one.

    The frame has the bar itself as well, as bounds in months and days do not mix: its largest value
    must be the bar's, first reached there.
    """
    frame = f"OVER ({_SERIES} RANGE BETWEEN INTERVAL '{months}' MONTH PRECEDING AND CURRENT ROW)"
    return F.expr(f"count(*) {frame} > 1 AND max(struct({column}, -unix_date(d) AS day)) {frame}.day = -unix_date(d)")


def as_of(column: str, months: int) -> Column:
    """The value of the last bar at least so many calendar months before."""
    return F.expr(f"max_by({column}, d) OVER ({_SERIES} RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '{months}' MONTH PRECEDING)")


@dataclass(frozen=True)
class VolumeSuite:
    """Spans and thresholds. Defaults are fixed values, in bars of daily series."""

    months: int = 15
    recent: int = 3
    deviations: float = 12.0
    vroc_threshold: float = 50.0
    vroc: int = 25
    rvol_threshold: float = 2.0
    rvol_extreme: float = 5.0
    rvol: int = 20
    mfi: int = 14
    overbought: float = 80.0
    oversold: float = 20.0
    vpt_threshold: float = 0.05
    vpt: int = 20
    adtv: int = 50
    adtv_thresholds: tuple[tuple[int, float], ...] = ((3, 2.0), (6, 2.0), (12, 2.0))

    def scaled(self, scale: float) -> VolumeSuite:
        """For weekly (0.2) or monthly (0.05) series; no span is below 1."""
        n = lambda x: max(1, int(x * scale))
        return VolumeSuite(n(self.months), n(self.recent), self.deviations, self.vroc_threshold, n(self.vroc), self.rvol_threshold, self.rvol_extreme, n(self.rvol), n(self.mfi), self.overbought, self.oversold, self.vpt_threshold, n(self.vpt), n(self.adtv), self.adtv_thresholds)


def volume_suite(bars: DataFrame, v: VolumeSuite = VolumeSuite()) -> DataFrame:
    """Adds what each bar's volume looks like.

    is_high: above all volumes of the v.months calendar months before it (there must be one); is_recent_high: such a
    bar among the last v.recent of its series. z: its distance from the mean of the v.rvol bars before in their sample
    deviation (null without deviation), is_deviant from v.deviations up. vroc: change in percent against
    v.vroc bars before. rvol: ratio to that mean; activity is `extreme`, `high` or null by it. mfi: share in
    percent of the typical price's flow that went up over the last v.mfi bars; pressure is `overbought`,
    `oversold` or null. vpt: the cumulative flow of volume times the close's change; vpt_signal is `up` or
    `down` where it is off the mean of its last v.vpt values by more than v.vpt_threshold of it. adtv_n: ratio of
    the mean volume of the last v.adtv bars to the one as of n calendar months before; is_busy if all reach
    their thresholds. Bars without a volume or prices take no part.
    """
    rows = priced(bars).where("volume is not null")
    lag = lambda c, k=1: F.lag(c, k).over(series())
    # Window expressions are columns first, as each use of one would compute it again.
    lags = {"_volume_then": lag("volume", v.vroc), "_close_then": lag("close")}
    rows = rows.withColumns({"_square": F.col("volume") * F.col("volume"), "_n": size(v.rvol, 1), **lags})
    rows = moving(rows, {"_total": ("sum", "volume", v.rvol), "_squares": ("sum", "_square", v.rvol)}, before=1)
    rows = moving(rows, {"_recent": ("sum", "volume", v.adtv)})
    n, total, squares = F.col("_n"), F.col("_total"), F.col("_squares")
    spread = squares * n - total * total
    z = F.when((n > 1) & (spread > 0), (F.col("volume") * n - total) / F.sqrt(spread * n / (n - 1)))
    then, close = F.col("_volume_then"), F.col("_close_then")
    rows = rows.withColumns(
        {
            "is_high": above_months("volume", v.months),
            "_left": F.count("*").over(whole()) - F.row_number().over(series()),
            "z": z,
            "vroc": F.when(then > 0, (F.col("volume") - then) / then * 100),
            "rvol": F.when(total > 0, F.col("volume") * n / total),
            "_typical": ticks(F.col("high")) + ticks(F.col("low")) + ticks(F.col("close")),
            "_pushed": F.when(close > 0, ticks(F.col("volume") * (F.col("close") / close - 1))).otherwise(0),
            "_mean": F.col("_recent") / size(v.adtv),
        }
    )
    running = series().rowsBetween(Window.unboundedPreceding, 0)
    flow = F.col("_typical") * F.col("volume")
    rows = rows.withColumns({"_typical_then": lag("_typical"), "vpt": F.sum("_pushed").over(running)})
    rows = rows.withColumns({"_up": F.when(F.col("_typical") > F.col("_typical_then"), flow).otherwise(0.0), "_down": F.when(F.col("_typical") < F.col("_typical_then"), flow).otherwise(0.0)})
    rows = moving(rows, {"_ups": ("sum", "_up", v.mfi), "_downs": ("sum", "_down", v.mfi), "_flows": ("sum", "vpt", v.vpt)})
    up, down, sums = F.col("_ups"), F.col("_downs"), F.col("_flows")
    off, level = F.col("vpt") * size(v.vpt) - sums, v.vpt_threshold * F.abs(sums)
    ratios = {f"adtv_{m}": F.col("_mean") / as_of("_mean", m) for m, _ in v.adtv_thresholds}
    rows = rows.withColumns({"mfi": F.when(up + down > 0, up * 100 / (up + down)), "vpt_signal": F.when(off > level, "up").when(off < -level, "down"), **ratios})
    no = lambda c: F.coalesce(c, F.lit(False))
    busy = F.lit(True)
    for m, threshold in v.adtv_thresholds:
        busy = busy & no(F.col(f"adtv_{m}") >= threshold)
    rows = rows.withColumns(
        {
            "is_recent_high": F.col("is_high") & (F.col("_left") < v.recent),
            "is_deviant": no(F.col("z") >= v.deviations),
            "activity": F.when(F.col("rvol") >= v.rvol_extreme, "extreme").when(F.col("rvol") >= v.rvol_threshold, "high"),
            "is_jump": no(F.col("vroc") >= v.vroc_threshold),
            "pressure": F.when(F.col("mfi") >= v.overbought, "overbought").when(F.col("mfi") <= v.oversold, "oversold"),
            "is_busy": busy,
        }
    )
    return rows.select(*bars.columns, "is_high", "is_recent_high", "z", "is_deviant", "vroc", "is_jump", "rvol", "activity", "mfi", "pressure", "vpt", "vpt_signal", *ratios, "is_busy")


def accumulation(bars: DataFrame) -> DataFrame:
    """Adds flow, where the close lies in its bar's range (-1 to 1) times the volume, and line, its running sum, in ticks."""
    place = ((F.col("close") - F.col("low")) - (F.col("high") - F.col("close"))) / (F.col("high") - F.col("low"))
    rows = priced(bars).where("volume is not null").withColumn("flow", F.when(F.col("high") > F.col("low"), ticks(place * F.col("volume"))).otherwise(0))
    return rows.withColumn("line", F.sum("flow").over(series().rowsBetween(Window.unboundedPreceding, 0)))


@dataclass(frozen=True)
class Divergence:
    """Bars on both sides of a swing point, most bars between two of them, and the months' conditions. Defaults are fixed values."""

    strength: int = 3
    most_bars: int = 20
    least: float = 15.0
    most: float = 30.0
    consecutive: int = 3
    lookback: int = 6
    consistency: float = 60.0


def divergences(bars: DataFrame, p: Divergence = Divergence()) -> DataFrame:
    """Swing points at which price and accumulation line disagree with the swing point of the same kind before.

    kind is `bullish` where a swing low is below the one before while the line is above it there, `bearish`
    where a swing high is above the one before and the line below it. Swing points are pivots of p.strength
    bars; both lie within p.most_bars of each other. seen_date is the bar that confirms the later one.
    """
    rows = accumulation(bars)
    turned = rows.select(*KEYS, "d", (-F.col("low")).alias("high"), (-F.col("high")).alias("low"), "close", "line")  # a low is a high upside down
    carried = {"line": F.col("line"), "seen_date": F.lead("d", p.strength).over(series())}
    tops = pivots(rows, p.strength, carried).withColumn("side", F.lit("high")).unionByName(pivots(turned, p.strength, carried).withColumn("side", F.lit("low")))
    own = Window.partitionBy(*KEYS, "side").orderBy("n")
    before = {f"last_{c}": F.lag(c).over(own) for c in ("d", "n", "level", "line")}
    tops = tops.withColumns(before)
    against = (F.col("n") - F.col("last_n") <= p.most_bars) & (F.col("level") > F.col("last_level"))
    kind = F.when((F.col("side") == "high") & (F.col("line") < F.col("last_line")), "bearish").when((F.col("side") == "low") & (F.col("line") > F.col("last_line")), "bullish")
    found = tops.where(against).withColumn("kind", kind).where("kind is not null")
    return found.select(*KEYS, "kind", "last_d", "d", "seen_date", F.abs("last_level").alias("last_price"), F.abs("level").alias("price"), "last_line", "line")


def monthly_accumulation(bars: DataFrame, p: Divergence = Divergence()) -> DataFrame:
    """The line's change from month to month, in percent of its size, and how steady it is.

    line is the value at the last bar of a month; change is null without the month before or where that
    one was 0. in_range: p.least to p.most percent; streak counts the months in a row up to this one that
    are (a month without bars ends it); consistency is the share in percent of the last p.lookback changes
    that are above 0, score_ok if it reaches p.consistency with all of them there; is_signal is both: a
    streak of p.consecutive and a steady score.
    """
    month = F.trunc("d", "month").alias("month")
    rows = accumulation(bars).groupBy(*KEYS, month).agg(F.max_by("line", "d").alias("line"))
    own = Window.partitionBy(*KEYS).orderBy("month")
    last, follows = F.lag("line").over(own), F.lag("month").over(own) == F.add_months("month", -1)
    rows = rows.withColumn("change", F.when(follows & (last != 0), (F.col("line") - last) * 100 / F.abs(last)))
    rows = rows.withColumn("in_range", F.coalesce((F.col("change") >= p.least) & (F.col("change") <= p.most), F.lit(False)))
    rows = rows.withColumn("_breaks", F.sum(F.when(F.col("in_range"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*KEYS, "_breaks").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    back = own.rowsBetween(1 - p.lookback, 0)
    rows = rows.withColumns({"streak": F.count_if("in_range").over(inside), "consistency": F.count_if(F.col("change") > 0).over(back) * 100 / p.lookback, "_known": F.count("change").over(back)})
    ok = (F.col("_known") == p.lookback) & (F.col("consistency") >= p.consistency)
    rows = rows.withColumns({"score_ok": ok, "is_signal": ok & (F.col("streak") >= p.consecutive)})
    return rows.select(*KEYS, "month", "line", "change", "in_range", "streak", "consistency", "score_ok", "is_signal")
