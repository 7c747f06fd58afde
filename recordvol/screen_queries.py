"""Queries of the further screens over bars derived from the order tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from recordvol.operators import averages, breakouts, flows, launch, leaders, levels, ranks, strength
from recordvol.plans import orders
from recordvol.queries import BARS_SQL, Query, flat

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- SQL building blocks ---------------------------------------------------------------------------------------------

_W = "(PARTITION BY timeframe, ticker ORDER BY d)"
BASE_SQL = f"WITH RECURSIVE {BARS_SQL}"
NUMBERED_SQL = f"numbered AS MATERIALIZED (SELECT *, row_number() OVER {_W} AS n FROM ranged)"
TRUE_RANGE_SQL = f"ranged AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER {_W}), 0), coalesce(abs(low - lag(close) OVER {_W}), 0)) AS true_range FROM every)"


def ticks_sql(x: str) -> str:
    return f"CAST(floor(({x}) * 10000 + 0.3137::DOUBLE) AS BIGINT)"


def recursive_sql(means: dict[str, tuple[str, str]]) -> str:
    """`averaged`: the numbered bars with recursive averages, name -> (column, weight)."""
    steps = ", ".join(f"{w} * b.{c} + (1 - {w}) * p.{name}" for name, (c, w) in means.items())
    return f"""{NUMBERED_SQL},
stepped(timeframe, ticker, n, {", ".join(means)}) AS (
  SELECT timeframe, ticker, n, {", ".join(c for c, _ in means.values())} FROM numbered WHERE n = 1
  UNION ALL SELECT b.timeframe, b.ticker, b.n, {steps} FROM stepped p JOIN numbered b ON b.timeframe = p.timeframe AND b.ticker = p.ticker AND b.n = p.n + 1),
averaged AS (SELECT b.*, {", ".join(f"p.{name}" for name in means)} FROM numbered b JOIN stepped p ON b.timeframe = p.timeframe AND b.ticker = p.ticker AND b.n = p.n)"""


def each_sql(daily: int, weekly: int, monthly: int) -> str:
    return f"CASE b.timeframe WHEN 'daily' THEN {daily} WHEN 'weekly' THEN {weekly} ELSE {monthly} END"


# --- Recursive averages ----------------------------------------------------------------------------------------------


@_query(f"""{BASE_SQL}, {TRUE_RANGE_SQL}, {recursive_sql({"atr": ("true_range", f"(1e0 / {each_sql(20, 4, 2)})"), "atr2": ("true_range", f"(1e0 / {each_sql(20, 4, 2)})")})},
stepwise AS (SELECT * REPLACE ({ticks_sql("atr")} / 10000e0 AS atr, {ticks_sql("atr2")} / 10000e0 AS atr2) FROM averaged),
moved AS (SELECT *, close - lag(close) OVER {_W} AS move, lag(atr) OVER {_W} AS last, lag(atr2) OVER {_W} AS last2 FROM stepwise)
SELECT timeframe, ticker, d, atr, atr2,
  CASE WHEN move > 3e0 * last THEN 'strong up' WHEN move < -(3e0 * last) THEN 'strong down' WHEN move > 1.5e0 * last2 THEN 'up' WHEN move < -(1.5e0 * last2) THEN 'down' ELSE 'inside' END AS signal
FROM moved""")  # fmt: skip
def atr_bands(spark, sf_dir):
    return averages.atr_bands(orders.bars(spark, sf_dir)).select("timeframe", "ticker", "d", "atr", "atr2", "signal")


_SHORT, _LONG = averages.Guppy().short, averages.Guppy().long
_GUPPY_SQL = f"""{BASE_SQL}, ranged AS (SELECT * FROM every), {recursive_sql({f"m{n}": ("close", f"(2e0 / {n + 1})") for n in (*_SHORT, *_LONG)})},
stepwise AS (SELECT timeframe, ticker, d, volume, {", ".join(f"{ticks_sql(f'm{n}')} AS m{n}" for n in (*_SHORT, *_LONG))}, count(*) OVER (PARTITION BY timeframe, ticker) AS bars FROM averaged),
spans AS (
  SELECT timeframe, ticker, d, volume, least({", ".join(f"m{n}" for n in _SHORT)}) AS short_low, greatest({", ".join(f"m{n}" for n in _SHORT)}) AS short_high,
    least({", ".join(f"m{n}" for n in _LONG)}) AS long_low, greatest({", ".join(f"m{n}" for n in _LONG)}) AS long_high FROM stepwise WHERE bars >= 65),
states AS (
  SELECT *, CASE WHEN short_low > long_high THEN 'bullish' WHEN short_high < long_low THEN 'bearish' ELSE 'mixed' END AS trend, greatest(short_high, long_high) - least(short_low, long_low) AS w,
    least(short_low, long_low) AS low, sum(volume) OVER e AS earlier, count(volume) OVER e AS earlier_bars
  FROM spans WINDOW e AS (PARTITION BY timeframe, ticker ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
changes AS (SELECT *, CASE WHEN trend IS NOT DISTINCT FROM lag(trend) OVER {_W} THEN 0 ELSE 1 END AS changed FROM states),
stretches AS (SELECT *, sum(changed) OVER {_W} AS run FROM changes),
placed AS (SELECT *, row_number() OVER (PARTITION BY timeframe, ticker, run ORDER BY d) AS place FROM stretches),
signals AS (
  SELECT *, CASE WHEN w <= 0.02::DOUBLE * low THEN 'compression' WHEN w >= 0.05::DOUBLE * low THEN 'expansion' ELSE 'neutral' END AS width, CASE WHEN run > 1 AND place = 3 AND trend <> 'mixed' THEN trend END AS crossover,
    coalesce(volume * earlier_bars >= 1.2::DOUBLE * earlier, false) AS enough FROM placed)"""


@_query(f"{_GUPPY_SQL} SELECT timeframe, ticker, d, short_low, short_high, long_low, long_high, trend, width, crossover, CASE WHEN crossover IS NOT NULL THEN enough END AS volume_confirmed FROM signals")
def guppy_averages(spark, sf_dir):
    rows = averages.guppy(orders.bars(spark, sf_dir))
    return rows.select("timeframe", "ticker", "d", "short_low", "short_high", "long_low", "long_high", "trend", "width", "crossover", "volume_confirmed")


@_query(f"""{_GUPPY_SQL}
SELECT timeframe, ticker, count(*) FILTER (WHERE crossover = 'bullish') AS bullish, count(*) FILTER (WHERE crossover = 'bearish') AS bearish, count(*) FILTER (WHERE crossover IS NOT NULL AND enough) AS confirmed,
  count(*) FILTER (WHERE width = 'compression') AS compressed, arg_max(trend, d) AS latest_trend, max(d) FILTER (WHERE crossover IS NOT NULL) AS latest_crossover
FROM signals GROUP BY timeframe, ticker""")  # fmt: skip
def guppy_summary(spark, sf_dir):
    rows = averages.guppy(orders.bars(spark, sf_dir))
    return rows.groupBy("timeframe", "ticker").agg(
        F.count_if(F.col("crossover") == "bullish").alias("bullish"), F.count_if(F.col("crossover") == "bearish").alias("bearish"), F.count_if("volume_confirmed").alias("confirmed"),
        F.count_if(F.col("width") == "compression").alias("compressed"), F.max_by("trend", "d").alias("latest_trend"), F.max(F.when(F.col("crossover").isNotNull(), F.col("d"))).alias("latest_crossover"),
    )


# --- Ranks in moving frames ------------------------------------------------------------------------------------------


@_query(f"""{BASE_SQL}, {TRUE_RANGE_SQL}, {recursive_sql({"atr": ("true_range", "(1e0 / 14)")})},
means AS (
  SELECT timeframe, ticker, d, n, {ticks_sql("atr")} AS atr, {ticks_sql("close")} AS c,
    {ticks_sql(f"CASE timeframe WHEN 'daily' THEN avg(close) OVER (PARTITION BY timeframe, ticker ORDER BY d ROWS 49 PRECEDING) WHEN 'weekly' THEN avg(close) OVER (PARTITION BY timeframe, ticker ORDER BY d ROWS 9 PRECEDING) ELSE avg(close) OVER (PARTITION BY timeframe, ticker ORDER BY d ROWS 3 PRECEDING) END")} AS mean
  FROM averaged),
ranked AS (
  SELECT b.timeframe, b.ticker, b.n, count(*) FILTER (WHERE o.atr <= b.atr) / count(*) AS percentile FROM means b JOIN means o
    ON o.timeframe = b.timeframe AND o.ticker = b.ticker AND o.n <= b.n AND o.n > b.n - {each_sql(100, 20, 6)}
  GROUP BY b.timeframe, b.ticker, b.n),
placed AS (SELECT m.*, r.percentile, CASE WHEN atr > 0 THEN (c - mean) / atr END AS distance FROM means m JOIN ranked r ON m.timeframe = r.timeframe AND m.ticker = r.ticker AND m.n = r.n)
SELECT timeframe, ticker, d, atr / 10000e0 AS atr, mean / 10000e0 AS mean, percentile, distance, CASE WHEN percentile >= 0.8::DOUBLE THEN 'high' WHEN percentile <= 0.2::DOUBLE THEN 'low' ELSE 'normal' END AS volatility,
  CASE WHEN distance >= 2 THEN 'extended' WHEN abs(distance) <= 1 THEN 'optimal' WHEN distance IS NOT NULL THEN 'between' END AS reach
FROM placed""")  # fmt: skip
def atr_percentile(spark, sf_dir):
    return ranks.atr_percentile(orders.bars(spark, sf_dir)).select("timeframe", "ticker", "d", "atr", "mean", "percentile", "distance", "volatility", "reach")





# --- Levels ----------------------------------------------------------------------------------------------------------

_NEAR = "PARTITION BY timeframe, ticker ORDER BY d ROWS BETWEEN"
_LINES_SQL = f"""WITH {BARS_SQL},
numbered AS (
  SELECT *, row_number() OVER {_W} - 1 AS n, max(high) OVER ({_NEAR} 10 PRECEDING AND 1 PRECEDING) AS back, max(high) OVER ({_NEAR} 1 FOLLOWING AND 10 FOLLOWING) AS ahead,
    count(*) OVER ({_NEAR} 10 PRECEDING AND 1 PRECEDING) AS back_n, count(*) OVER ({_NEAR} 1 FOLLOWING AND 10 FOLLOWING) AS ahead_n, max(d) OVER (PARTITION BY timeframe, ticker) AS ends,
    min(close) OVER (PARTITION BY timeframe, ticker ORDER BY d RANGE BETWEEN CURRENT ROW AND INTERVAL 14 DAY FOLLOWING) AS low_ahead
  FROM every),
found AS (SELECT timeframe, ticker, d AS pivot_date, n, high AS level, ends FROM numbered WHERE back_n = 10 AND ahead_n = 10 AND high > back AND high >= ahead),
broken AS (
  SELECT f.timeframe, f.ticker, f.n, min(b.n) AS at FROM found f JOIN numbered b ON b.timeframe = f.timeframe AND b.ticker = f.ticker AND b.n > f.n + 10 AND b.close > f.level GROUP BY f.timeframe, f.ticker, f.n),
greens AS (
  SELECT f.*, s.d AS seen_date, b.d AS breakout_date, b.close AS breakout_close, b.low_ahead FROM found f JOIN numbered s ON s.timeframe = f.timeframe AND s.ticker = f.ticker AND s.n = f.n + 10
  LEFT JOIN broken x ON x.timeframe = f.timeframe AND x.ticker = f.ticker AND x.n = f.n LEFT JOIN numbered b ON b.timeframe = f.timeframe AND b.ticker = f.ticker AND b.n = x.at)"""


@_query(f"""{_LINES_SQL}
SELECT timeframe, ticker, pivot_date, level, seen_date, breakout_date, breakout_close, coalesce(breakout_date, ends) >= pivot_date + INTERVAL 3 MONTH AS is_green, pivot_date >= ends - INTERVAL 12 MONTH AS is_recent,
  CASE WHEN breakout_date IS NULL THEN 'open' WHEN low_ahead < level THEN 'failed' WHEN breakout_date + 14 <= ends THEN 'confirmed' ELSE 'pending' END AS status
FROM greens""")  # fmt: skip
def green_lines(spark, sf_dir):
    return levels.green_lines(orders.bars(spark, sf_dir))


def _stochastic_sql() -> str:
    frame = f"({_NEAR} 9 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN max(high) OVER {frame} > min(low) OVER {frame} THEN (close - min(low) OVER {frame}) / (max(high) OVER {frame} - min(low) OVER {frame}) * 100 END"


@_query(f"""{BASE_SQL}, ranged AS (SELECT * FROM every), {recursive_sql({"ema": ("close", "(2e0 / 22)")})},
stepwise AS (
  SELECT timeframe, ticker, d, {_stochastic_sql()} AS k, {ticks_sql(f"avg(close) OVER ({_NEAR} 49 PRECEDING AND CURRENT ROW)")} AS rising, {ticks_sql(f"avg(close) OVER ({_NEAR} 29 PRECEDING AND CURRENT ROW)")} AS mean,
    {ticks_sql("ema")} AS ema, {ticks_sql("close")} AS c FROM averaged),
moved AS (SELECT *, lag(k) OVER {_W} AS last_k, lag(rising) OVER {_W} AS last_rising, lag(c) OVER {_W} AS last_c, min(k) OVER ({_NEAR} 2 PRECEDING AND CURRENT ROW) AS low FROM stepwise)
SELECT timeframe, ticker, d, coalesce(last_k < 20 AND k >= 20 AND rising > last_rising, false) AS blue_dot, coalesce(low < 25 AND c > last_c AND (c > mean OR c > ema), false) AS black_dot FROM moved""")  # fmt: skip
def timing_dots(spark, sf_dir):
    return levels.dots(orders.bars(spark, sf_dir)).select("timeframe", "ticker", "d", "blue_dot", "black_dot")


# --- Strength --------------------------------------------------------------------------------------------------------

_SPANS = (5, 20, 60, 120)
_RATED_SQL = f"""{BASE_SQL}, {TRUE_RANGE_SQL}, {recursive_sql({"atr": ("true_range", "(1e0 / 14)")})},
measured AS (
  SELECT timeframe, ticker, d, close, {ticks_sql("atr")} AS atr, {ticks_sql("close")} AS tick, {ticks_sql(f"avg(close) OVER ({_NEAR} 49 PRECEDING AND CURRENT ROW)")} AS mean,
    min(low) OVER ({_NEAR} 19 PRECEDING AND CURRENT ROW) AS low, max(high) OVER ({_NEAR} 19 PRECEDING AND CURRENT ROW) AS high, {", ".join(f"close / lag(close, {n}) OVER {_W} - 1 AS r{n}" for n in _SPANS)} FROM averaged),
rated AS (
  SELECT *, CASE WHEN high > low THEN (close - low) / (high - low) END AS position, CASE WHEN atr > 0 THEN (tick - mean) / atr END AS extension, atr / tick AS ra FROM measured),
ratings AS (
  SELECT *, {", ".join(f"CASE WHEN r{n} IS NOT NULL THEN (count(r{n}) OVER (PARTITION BY timeframe, d ORDER BY r{n} NULLS LAST)) * 100 / (count(r{n}) OVER (PARTITION BY timeframe, d)) END AS rating_{n}" for n in (*_SPANS, "a"))} FROM rated)"""


@_query(f"""{_RATED_SQL}
SELECT timeframe, ticker, d, close, {", ".join(f"rating_{n}" for n in _SPANS)}, rating_a AS atr_rating, atr / 10000e0 AS atr, position, extension, CASE WHEN extension >= 11 THEN 'danger' WHEN extension >= 7 THEN 'warning' END AS extended,
  coalesce((rating_5 + rating_20 + rating_60 + rating_120) / 4 >= 70, false) AS leader, coalesce(greatest(rating_5, rating_20, rating_60, rating_120) >= 97 AND rating_a >= 50 AND position >= 0.5::DOUBLE, false) AS qualified
FROM ratings""")  # fmt: skip
def strength_ratings(spark, sf_dir):
    return strength.strength(orders.bars(spark, sf_dir), partitions=orders.partitions(spark, sf_dir))


_ROTATION = strength.Rotation(min_price=900.0, min_volume=10)


@_query(f"""WITH {BARS_SQL},
ends AS (SELECT timeframe, ticker, date_trunc('month', d) AS month, arg_max(close, d) AS price, arg_max(volume, d) AS volume FROM every GROUP BY ALL),
spans AS (SELECT *, coalesce(lead(month) OVER (PARTITION BY timeframe, ticker ORDER BY month) - INTERVAL 1 MONTH, month) AS until FROM ends),
months AS (SELECT timeframe, ticker, CAST(m AS DATE) AS month, price, CASE WHEN CAST(m AS DATE) = month THEN volume END AS volume FROM (SELECT *, unnest(generate_series(CAST(month AS TIMESTAMP), CAST(until AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM spans)),
returned AS (
  SELECT *, row_number() OVER own - 1 AS known, {", ".join(f"price / lag(price, {n}) OVER own - 1 AS return_{n}" for n in (12, 6, 3))} FROM months WINDOW own AS (PARTITION BY timeframe, ticker ORDER BY month)),
a AS (SELECT *, row_number() OVER (PARTITION BY timeframe, month ORDER BY return_12 DESC, ticker) AS rank_12 FROM returned WHERE known >= 12 AND price >= 900 AND coalesce(volume, 0) >= 10),
b AS (SELECT *, row_number() OVER (PARTITION BY timeframe, month ORDER BY return_6 DESC, ticker) AS rank_6 FROM a WHERE rank_12 <= 50),
c AS (SELECT *, row_number() OVER (PARTITION BY timeframe, month ORDER BY return_3 DESC, ticker) AS rank_3 FROM b WHERE rank_6 <= 30)
SELECT timeframe, ticker, month, price, return_12, return_6, return_3, rank_12, rank_6, rank_3 FROM c WHERE rank_3 <= 10""")  # fmt: skip
def rotation(spark, sf_dir):
    return flat(strength.rotation(orders.bars(spark, sf_dir), _ROTATION).drop("volume"))


# --- Breakouts -------------------------------------------------------------------------------------------------------


def _frames_sql(f: str, daily: int, weekly: int, monthly: int, ends: str = "1 PRECEDING") -> str:
    """f over so many bars before a bar (or up to it), by timeframe."""
    at = lambda n: f"{f} OVER ({_NEAR} {n} PRECEDING AND {ends})"
    return f"CASE timeframe WHEN 'daily' THEN {at(daily)} WHEN 'weekly' THEN {at(weekly)} ELSE {at(monthly)} END"


_SLOPE_SQL = f"""CASE WHEN {_frames_sql("count(*)", 49, 9, 3, "CURRENT ROW")} = CASE timeframe WHEN 'daily' THEN 50 WHEN 'weekly' THEN 10 ELSE 4 END
    THEN {_frames_sql("regr_slope(tick, x)", 49, 9, 3, "CURRENT ROW")} END"""
_SIGNALS_SQL = f"""WITH {BARS_SQL},
numbered AS (SELECT *, row_number() OVER {_W} - 1 AS x, {ticks_sql("close")} AS tick, CASE timeframe WHEN 'daily' THEN 60 WHEN 'weekly' THEN 12 ELSE 6 END AS least FROM every),
framed AS (
  SELECT *, {_SLOPE_SQL} AS trend, x >= least AND volume > {_frames_sql("max(volume)", 60, 12, 6)} AS busy, {_frames_sql("max(close)", 60, 12, 6)} AS top, {_frames_sql("min(close)", 60, 12, 6)} AS bottom FROM numbered),
events AS (SELECT *, CASE WHEN busy AND close > top AND trend > 1e-6 THEN 'Buy' WHEN busy AND close < bottom AND trend < -1e-6 THEN 'Sell' END AS event FROM framed),
started AS (SELECT *, max(CASE WHEN event IS NOT NULL THEN x END) OVER {_W} AS start FROM events),
carried AS (
  SELECT s.*, e.event AS last_event, e.d AS last_d, e.close AS last_close FROM started s LEFT JOIN events e ON e.timeframe = s.timeframe AND e.ticker = s.ticker AND e.x = s.start),
sided AS (SELECT *, coalesce(CASE last_event WHEN 'Buy' THEN close < last_close WHEN 'Sell' THEN close > last_close END, false) AS wrong FROM carried),
counted AS (SELECT *, max(CASE WHEN NOT wrong THEN x END) OVER (PARTITION BY timeframe, ticker, start ORDER BY d) AS right_x FROM sided),
ended AS (
  SELECT *, coalesce(bool_or(x - right_x >= CASE timeframe WHEN 'daily' THEN 5 WHEN 'weekly' THEN 2 ELSE 1 END) OVER (PARTITION BY timeframe, ticker, start ORDER BY d), false) AS given_up FROM counted),
held AS (SELECT *, start IS NOT NULL AND x - start <= CASE timeframe WHEN 'daily' THEN 100 WHEN 'weekly' THEN 20 ELSE 6 END AND NOT given_up AS holds FROM ended)"""


@_query(f"""{_SIGNALS_SQL}
SELECT timeframe, ticker, d, close, volume, event, CASE WHEN holds THEN last_event END AS signal, CASE WHEN holds THEN last_d END AS signal_date, CASE WHEN holds THEN last_close END AS signal_close,
  CASE WHEN holds THEN x - start END AS age FROM held""")  # fmt: skip
def price_volume_signals(spark, sf_dir):
    return flat(breakouts.price_volume(orders.bars(spark, sf_dir)).drop("open", "high", "low", "trend"))


def _steady_index(period: int, short: int) -> str:
    wide = f"({_NEAR} {period - 1} PRECEDING AND CURRENT ROW)"
    return f"""ranged AS (
  SELECT *, CASE WHEN count(*) OVER s = {short} THEN {ticks_sql("max(high) OVER s - min(low) OVER s")} END AS r FROM daily WINDOW s AS ({_NEAR} {short - 1} PRECEDING AND CURRENT ROW)),
indexed AS (
  SELECT *, CASE WHEN count(r) OVER {wide} = {period} AND max(r) OVER {wide} > min(r) OVER {wide} THEN (r - min(r) OVER {wide}) * 100 / (max(r) OVER {wide} - min(r) OVER {wide}) END AS index FROM ranged)"""


@_query(f"""WITH {BARS_SQL}, {_steady_index(50, 5)},
quiets AS (SELECT *, coalesce(index < 20, false) AS quiet, CASE WHEN index <= 5 THEN 1 WHEN index <= 10 THEN 2 WHEN index <= 15 THEN 3 WHEN index IS NOT NULL THEN 0 END AS zone FROM indexed),
changed AS (SELECT *, CASE WHEN quiet IS NOT DISTINCT FROM lag(quiet) OVER {_W} THEN 0 ELSE 1 END AS change FROM quiets),
stretches AS (SELECT *, sum(change) OVER {_W} AS run FROM changed),
placed AS (
  SELECT *, CASE WHEN quiet THEN row_number() OVER o ELSE 0 END AS quiet_run, max(high) OVER o AS top, min(low) OVER o AS bottom FROM stretches WINDOW o AS (PARTITION BY timeframe, ticker, run ORDER BY d)),
lagged AS (SELECT *, lag(index) OVER {_W} AS last_index, lag(quiet_run) OVER {_W} AS last_run, lag(top) OVER {_W} AS last_top, lag(bottom) OVER {_W} AS last_bottom FROM placed),
sided AS (
  SELECT *, CASE WHEN index >= 2e0 * last_index AND NOT quiet AND last_run >= 3 THEN CASE WHEN close > last_top THEN 'up' WHEN close < last_bottom THEN 'down' END END AS s,
    CASE WHEN close > last_top THEN last_top ELSE last_bottom END AS edge FROM lagged),
held AS (
  SELECT *, CASE WHEN lag(s, 2) OVER {_W} = 'up' AND min(close) OVER n > lag(edge, 2) OVER {_W} THEN 'up' WHEN lag(s, 2) OVER {_W} = 'down' AND max(close) OVER n < lag(edge, 2) OVER {_W} THEN 'down' END AS h
  FROM sided WINDOW n AS ({_NEAR} 1 PRECEDING AND CURRENT ROW))
SELECT timeframe, ticker, d, index, CAST(zone AS BIGINT) AS zone, quiet_run, CASE WHEN s IS NOT NULL THEN 'breakout' WHEN h IS NOT NULL THEN 'confirmed' WHEN quiet_run >= 3 THEN 'consolidation' WHEN quiet_run >= 2 THEN 'contraction' END AS pattern,
  coalesce(s, h) AS side FROM held""")  # fmt: skip
def contraction_patterns(spark, sf_dir):
    return flat(breakouts.contraction(orders.bars(spark, sf_dir, "daily")).select("timeframe", "ticker", "d", "index", "zone", "quiet_run", "pattern", "side"))


# --- Volume and flows ------------------------------------------------------------------------------------------------

_SUITE = flows.VolumeSuite(months=6, recent=30, deviations=3.0, rvol=20)


def _as_of_sql(months: int) -> str:
    return f"arg_max(mean, d) OVER (PARTITION BY timeframe, ticker ORDER BY d RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL {months} MONTH PRECEDING)"


@_query(f"""WITH {BARS_SQL},
framed AS (
  SELECT *, coalesce(volume > max(volume) OVER (PARTITION BY timeframe, ticker ORDER BY d RANGE BETWEEN INTERVAL 6 MONTH PRECEDING AND INTERVAL 1 DAY PRECEDING), false) AS is_high,
    count(*) OVER (PARTITION BY timeframe, ticker) - row_number() OVER {_W} AS rest, count(volume) OVER e AS n, sum(volume) OVER e AS s, sum(volume * volume) OVER e AS q, lag(volume, 25) OVER {_W} AS v25, lag(close) OVER {_W} AS c1,
    {ticks_sql("high")} + {ticks_sql("low")} + {ticks_sql("close")} AS typical, avg(volume) OVER ({_NEAR} 49 PRECEDING AND CURRENT ROW) AS mean
  FROM every WINDOW e AS ({_NEAR} 20 PRECEDING AND 1 PRECEDING)),
scored AS (
  SELECT *, CASE WHEN n > 1 AND q * n - s * s > 0 THEN (volume * n - s) / sqrt((q * n - s * s) * n / (n - 1)) END AS z, CASE WHEN v25 > 0 THEN (volume - v25) / v25 * 100 END AS vroc, CASE WHEN s > 0 THEN volume * n / s END AS rvol,
    sum(CASE WHEN c1 > 0 THEN {ticks_sql("volume * (close / c1 - 1)")} ELSE 0 END) OVER {_W} AS vpt, CASE WHEN typical > lag(typical) OVER {_W} THEN typical * volume ELSE 0 END AS up, CASE WHEN typical < lag(typical) OVER {_W} THEN typical * volume ELSE 0 END AS down,
    mean / {_as_of_sql(3)} AS adtv_3, mean / {_as_of_sql(6)} AS adtv_6, mean / {_as_of_sql(12)} AS adtv_12
  FROM framed),
flowing AS (SELECT *, sum(up) OVER m AS ups, sum(down) OVER m AS downs, vpt * (count(*) OVER v) - (sum(vpt) OVER v) AS off, 0.05::DOUBLE * abs(sum(vpt) OVER v) AS level
  FROM scored WINDOW m AS ({_NEAR} 13 PRECEDING AND CURRENT ROW), v AS ({_NEAR} 19 PRECEDING AND CURRENT ROW)),
ready AS (SELECT *, CASE WHEN ups + downs > 0 THEN ups * 100 / (ups + downs) END AS mfi FROM flowing)
SELECT timeframe, ticker, d, is_high, is_high AND rest < 30 AS is_recent_high, floor(z * 1e6 + 0.3137::DOUBLE) / 1e6 AS z, coalesce(z >= 3, false) AS is_deviant, vroc, coalesce(vroc >= 50, false) AS is_jump, rvol,
  CASE WHEN rvol >= 5 THEN 'extreme' WHEN rvol >= 2 THEN 'high' END AS activity, mfi, CASE WHEN mfi >= 80 THEN 'overbought' WHEN mfi <= 20 THEN 'oversold' END AS pressure, CAST(vpt AS BIGINT) AS vpt,
  CASE WHEN off > level THEN 'up' WHEN off < -level THEN 'down' END AS vpt_signal, {", ".join(f"floor(adtv_{m} * 1e6 + 0.3137::DOUBLE) / 1e6 AS adtv_{m}" for m in (3, 6, 12))},
  coalesce(adtv_3 >= 2, false) AND coalesce(adtv_6 >= 2, false) AND coalesce(adtv_12 >= 2, false) AS is_busy
FROM ready""")  # fmt: skip
def volume_suite(spark, sf_dir):
    rows = flows.volume_suite(orders.bars(spark, sf_dir), _SUITE).drop("open", "high", "low", "close", "volume")
    return rows.withColumns({c: F.floor(F.col(c) * 1e6 + 0.3137) / 1e6 for c in ("z", "adtv_3", "adtv_6", "adtv_12")})


_LINE_SQL = f"""WITH {BARS_SQL},
flowed AS (SELECT *, CASE WHEN high > low THEN {ticks_sql("((close - low) - (high - close)) / (high - low) * volume")} ELSE 0 END AS flow FROM every),
adl AS (SELECT *, CAST(sum(flow) OVER {_W} AS BIGINT) AS line, row_number() OVER {_W} - 1 AS n FROM flowed)"""


def _swing_sql(side: str, x: str) -> str:
    a, b = f"({_NEAR} 3 PRECEDING AND 1 PRECEDING)", f"({_NEAR} 1 FOLLOWING AND 3 FOLLOWING)"
    return f"""SELECT '{side}' AS side, timeframe, ticker, n, d, {x} AS level, line, lead(d, 3) OVER {_W} AS seen_date, count(*) OVER {a} = 3 AND count(*) OVER {b} = 3 AND {x} > max({x}) OVER {a} AND {x} >= max({x}) OVER {b} AS is_pivot FROM adl"""


@_query(f"""{_LINE_SQL},
swings AS ({_swing_sql("high", "high")} UNION ALL {_swing_sql("low", "-low")}),
paired AS (SELECT *, {", ".join(f"lag({c}) OVER s AS last_{c}" for c in ("d", "n", "level", "line"))} FROM swings WHERE is_pivot WINDOW s AS (PARTITION BY timeframe, ticker, side ORDER BY n)),
kinds AS (SELECT *, CASE WHEN side = 'high' AND line < last_line THEN 'bearish' WHEN side = 'low' AND line > last_line THEN 'bullish' END AS kind FROM paired WHERE n - last_n <= 20 AND level > last_level)
SELECT timeframe, ticker, kind, last_d, d, seen_date, abs(last_level) AS last_price, abs(level) AS price, last_line, line FROM kinds WHERE kind IS NOT NULL""")  # fmt: skip
def flow_divergences(spark, sf_dir):
    return flows.divergences(orders.bars(spark, sf_dir))


@_query(f"""{_LINE_SQL},
ends AS (SELECT timeframe, ticker, CAST(date_trunc('month', d) AS DATE) AS month, arg_max(line, d) AS line FROM adl GROUP BY ALL),
moved AS (
  SELECT *, CASE WHEN lag(month) OVER o = month - INTERVAL 1 MONTH AND lag(line) OVER o <> 0 THEN (line - lag(line) OVER o) * 100 / abs(lag(line) OVER o) END AS change FROM ends WINDOW o AS (PARTITION BY timeframe, ticker ORDER BY month)),
ranged AS (SELECT *, coalesce(change >= 15 AND change <= 30, false) AS in_range FROM moved),
broken AS (SELECT *, sum(CASE WHEN in_range THEN 0 ELSE 1 END) OVER (PARTITION BY timeframe, ticker ORDER BY month) AS breaks FROM ranged),
scored AS (
  SELECT *, count(*) FILTER (WHERE in_range) OVER (PARTITION BY timeframe, ticker, breaks ORDER BY month) AS streak, (count(*) FILTER (WHERE change > 0) OVER b) * 100 / 6 AS consistency, count(change) OVER b AS known
  FROM broken WINDOW b AS (PARTITION BY timeframe, ticker ORDER BY month ROWS 5 PRECEDING))
SELECT timeframe, ticker, month, line, change, in_range, streak, consistency, known = 6 AND consistency >= 60 AS score_ok, known = 6 AND consistency >= 60 AND streak >= 3 AS is_signal FROM scored""")  # fmt: skip
def monthly_accumulation(spark, sf_dir):
    return flows.monthly_accumulation(orders.bars(spark, sf_dir))


# --- Groups ----------------------------------------------------------------------------------------------------------

_LATEST_SQL = f"""WITH {BARS_SQL},
numbered AS (SELECT *, lag(close, 50) OVER {_W} AS past, lead(d) OVER {_W} AS next_d FROM every),
latest AS (SELECT b.timeframe, b.ticker, b.d, b.close, {ticks_sql("close / past - 1")} AS change, n_name AS "group" FROM numbered b JOIN supplier ON s_name = b.ticker JOIN nation ON n_nationkey = s_nationkey WHERE next_d IS NULL AND past > 0)"""



@_query(f"""{_LATEST_SQL}
SELECT timeframe, "group", CASE WHEN grouping("group") = 1 THEN 'all' ELSE 'group' END AS level, count(*) AS series, sum(change) / count(*) / 10000 AS mean_change, count(*) FILTER (WHERE change > 0) AS rising,
  arg_max(ticker, (change, ticker)) AS best FROM latest GROUP BY GROUPING SETS ((timeframe, "group"), (timeframe))""")  # fmt: skip
def group_returns(spark, sf_dir):
    returns = leaders.latest_returns(orders.bars(spark, sf_dir), 50)
    return leaders.hierarchy(returns.join(_groups(spark, sf_dir), "ticker"), "group")


@_query(f"""{_LATEST_SQL},
ranked AS (SELECT timeframe, "group", sum(change) / count(*) / 10000 AS group_change FROM latest GROUP BY ALL HAVING count(*) >= 3),
kept AS (SELECT *, row_number() OVER (PARTITION BY timeframe ORDER BY group_change DESC, "group") AS group_rank, count(*) OVER (PARTITION BY timeframe) AS groups FROM ranked),
best AS (SELECT *, row_number() OVER (PARTITION BY timeframe, "group" ORDER BY change DESC, ticker) AS rank FROM latest)
SELECT timeframe, "group", group_rank, rank, ticker, d, close, change / 10000 AS change, group_change FROM best JOIN kept USING (timeframe, "group") WHERE rank <= 4 AND (group_rank - 1) * 100 < groups * 20""")  # fmt: skip
def industry_leaders(spark, sf_dir):
    return flat(leaders.industry_leaders(orders.bars(spark, sf_dir), _groups(spark, sf_dir)))


def _groups(spark, sf_dir):
    nations = orders.table(spark, sf_dir, "nation")
    return orders.table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("ticker"), F.col("n_name").alias("group"))


# --- Launch pads and movers ------------------------------------------------------------------------------------------

_SPREAD = f"({_NEAR} 49 PRECEDING AND CURRENT ROW)"
_CLOSES = f"({_NEAR} 19 PRECEDING AND CURRENT ROW)"


@_query(f"""{BASE_SQL}, ranged AS (SELECT * FROM every), {recursive_sql({f"m{n}": ("close", f"(2e0 / {n + 1})") for n in (10, 20, 50)})},
stepwise AS (SELECT timeframe, ticker, d, {", ".join(f"{ticks_sql(f'm{n}')} AS m{n}" for n in (10, 20, 50))}, {ticks_sql("close")} AS c FROM averaged),
spreads AS (SELECT *, greatest(m10, m20, m50) - least(m10, m20, m50) AS spread, {", ".join(f"lag(m{n}, {max(1, int(n * 0.3))}) OVER {_W} AS l{n}" for n in (10, 20, 50))} FROM stepwise),
moments AS (
  SELECT *, count(*) OVER {_SPREAD} AS n, sum(spread) OVER {_SPREAD} AS s, sum(spread * spread) OVER {_SPREAD} AS q, count(*) OVER {_CLOSES} AS cn, sum(c) OVER {_CLOSES} AS cs, sum(c * c) OVER {_CLOSES} AS cq FROM spreads),
scored AS (
  SELECT *, CASE WHEN n = 50 AND q * n - s * s > 0 THEN CAST(spread * n - s AS DOUBLE) / sqrt(CAST(q * n - s * s AS DOUBLE) * n / (n - 1)) END AS z, {" AND ".join(f"coalesce(m{n} - l{n} >= 0.0001::DOUBLE * {max(1, int(n * 0.3))} * l{n}, false)" for n in (10, 20, 50))} AS rising,
    coalesce(abs(c - m50) <= 2 * CASE WHEN cn > 1 THEN sqrt(CAST(cq * cn - cs * cs AS DOUBLE) / CAST(cn * (cn - 1) AS DOUBLE)) END, false) AS near FROM moments)
SELECT timeframe, ticker, d, spread, floor(z * 1e6 + 0.3137::DOUBLE) / 1e6 AS spread_z, coalesce(z <= 1, false) AS tight, rising, near, coalesce(z <= 1, false) AND rising AND near AS is_launch FROM scored""")  # fmt: skip
def launch_pads(spark, sf_dir):
    rows = launch.launch_pads(orders.bars(spark, sf_dir)).drop("open", "high", "low", "close", "volume")
    return rows.withColumn("spread_z", F.floor(F.col("spread_z") * 1e6 + 0.3137) / 1e6)


_MOVERS = launch.Movers(volume=100, week_gain=3.0, week_volume=20, day_gain=2.0, day_volume=30)


@_query(f"""WITH {BARS_SQL},
framed AS (
  SELECT *, sum(volume) OVER b AS s, count(volume) OVER b AS n, lag(close) OVER {_W} AS c1, lag(close, 5) OVER {_W} AS c5, {ticks_sql("close")} AS tick, {ticks_sql(f"avg(close) OVER ({_NEAR} 49 PRECEDING AND CURRENT ROW)")} AS m50,
    {ticks_sql(f"avg(close) OVER ({_NEAR} 199 PRECEDING AND CURRENT ROW)")} AS m200 FROM every WINDOW b AS ({_NEAR} 20 PRECEDING AND 1 PRECEDING)),
ratios AS (SELECT *, CASE WHEN s > 0 THEN volume * n / s END AS ratio, CASE WHEN c1 > 0 THEN close / c1 * 100 - 100 END AS day_gain, CASE WHEN c5 > 0 THEN close / c5 * 100 - 100 END AS week_gain FROM framed)
SELECT timeframe, ticker, d, ratio, day_gain, week_gain, coalesce(volume >= 100 AND ratio >= 1.25::DOUBLE, false) AS is_volume_mover, coalesce(week_gain >= 3 AND ratio >= 1.25::DOUBLE AND s >= 20 * n, false) AS is_week_mover,
  coalesce(day_gain >= 2 AND ratio >= 1.5::DOUBLE AND volume >= 30 AND tick > m50 AND tick > m200, false) AS is_day_mover FROM ratios""")  # fmt: skip
def movers(spark, sf_dir):
    return launch.movers(orders.bars(spark, sf_dir), _MOVERS).drop("open", "high", "low", "close", "volume")
