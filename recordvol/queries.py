"""Queries over the driver's tables for the record-volume operators, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordvol.operators import exports, matrix, quality, records, scoring, universe
from recordvol.operators.records import Screen
from recordvol.plans import orders, screen
from recordvol.sources import bars
from recordvol.sources.settings import Settings

START, END, AS_OF = "1996-01-01", "1999-12-31", "2001-11-02"
FIXED = Screen(range_mode="fixed", start=START, end=END)
ROLLING = Screen(range_mode="rolling", limit_years=4, as_of=AS_OF)
ALL = Screen()
FLAGS = ("SP500", "NASDAQ100", "NASDAQComposite", "Russell1000", "MiniRussell2000")

Query = Callable[[SparkSession, str], DataFrame]
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


def flat(df: DataFrame) -> DataFrame:
    """Without event lists, and with whole numbers as BIGINT."""
    df = df.drop(*(c for c in df.columns if isinstance(df.schema[c].dataType, T.ArrayType)))
    return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if isinstance(df.schema[c].dataType, T.IntegerType) else F.col(f"`{c}`") for c in df.columns))


# --- SQL building blocks ---------------------------------------------------------------------------------------------

_ORDER = "l_orderkey, l_linenumber, l_partkey"
BARS_SQL = f"""
lines AS (
  SELECT s_name AS ticker, CAST(l_shipdate AS DATE) AS d, l_quantity AS q, p_retailprice AS p, {_ORDER}
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE isodow(CAST(l_shipdate AS DATE)) < 6),
daily AS (
  SELECT 'daily' AS timeframe, ticker, d, first(p ORDER BY {_ORDER}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {_ORDER}) AS close, sum(q) AS volume
  FROM lines GROUP BY ticker, d),
weekly AS (
  SELECT 'weekly' AS timeframe, ticker, min(d) AS d, first(open ORDER BY d) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY d) AS close, sum(volume) AS volume
  FROM daily GROUP BY ticker, date_trunc('week', d)),
monthly AS (
  SELECT 'monthly' AS timeframe, ticker, min(d) AS d, first(open ORDER BY d) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY d) AS close, sum(volume) AS volume
  FROM daily GROUP BY ticker, date_trunc('month', d)),
every AS (SELECT * FROM daily UNION ALL SELECT * FROM weekly UNION ALL SELECT * FROM monthly)"""
_SERIES = "PARTITION BY timeframe, ticker"
_BEFORE = f"{_SERIES} ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def flags_sql(source: str = "daily", where: str = "true", base: str = BARS_SQL) -> str:
    return f"""{base},
ranged AS (SELECT * FROM {source} WHERE {where}),
flagged AS (
  SELECT *, volume > coalesce(max(volume) OVER ({_BEFORE}), 0) AS is_record, max(d) OVER ({_SERIES}) AS latest_date, max(volume) OVER ({_SERIES}) AS max_volume, count(*) OVER ({_SERIES}) AS n
  FROM ranged),
enough AS (SELECT * FROM flagged WHERE n >= 2),
windowed AS (
  SELECT *, volume > coalesce(max(volume) OVER ({_BEFORE}), 0) AS is_window_record, max(volume) OVER ({_SERIES}) AS window_max, count(*) OVER ({_SERIES}) AS window_n
  FROM enough WHERE d >= latest_date - 365),
hve AS (
  SELECT timeframe, ticker, min(d) FILTER (WHERE volume = max_volume) AS hve_date, max(volume) AS hve_volume, count(*) FILTER (WHERE is_record) AS total_hve_count,
    count(*) FILTER (WHERE is_record AND d >= latest_date - INTERVAL 1 YEAR) AS hve_occ_1y, max(d) AS latest_date, arg_max(volume, d) AS latest_volume, arg_max(close, d) AS latest_close, count(*) AS data_points
  FROM enough GROUP BY timeframe, ticker),
hv1y AS (
  SELECT timeframe, ticker, min(d) FILTER (WHERE volume = window_max) AS hv1y_date, max(volume) AS hv1y_volume, count(*) FILTER (WHERE is_window_record) AS hv1y_occ_1y
  FROM windowed WHERE window_n >= 2 GROUP BY timeframe, ticker)"""


def summary_sql(source: str = "daily", where: str = "true", trailing: bool = False, base: str = BARS_SQL) -> str:
    block = """hv1y_date, hv1y_volume, CAST(h.latest_date - hv1y_date AS BIGINT) AS days_since_hv1y, coalesce(hv1y_occ_1y, 0) AS hv1y_occ_1y, coalesce(hv1y_occ_1y, 0) AS total_hv1y_count,
  coalesce(hv1y_date = hve_date, false) AS is_hv1y_also_hve, CASE WHEN hv1y_volume IS NULL OR NOT hve_volume > 0 THEN 0.0::DOUBLE ELSE hv1y_volume / hve_volume END AS hv1y_to_hve_ratio,"""
    return f"""WITH {flags_sql(source, where, base)}
SELECT h.ticker, h.timeframe, hve_date, hve_volume, CAST(h.latest_date - hve_date AS BIGINT) AS days_since_hve, hve_occ_1y, total_hve_count, {block if trailing else ""}
  h.latest_date, latest_volume, latest_close, CASE WHEN hve_volume > 0 THEN latest_volume / hve_volume ELSE 0.0::DOUBLE END AS volume_ratio, data_points
FROM hve h LEFT JOIN hv1y t ON h.timeframe = t.timeframe AND h.ticker = t.ticker"""


UNIVERSE_SQL = """
raw AS (
  SELECT s_suppkey AS place, CASE WHEN s_suppkey % 7 = 3 THEN s_name || '/P' WHEN s_suppkey % 3 = 0 THEN ' ' || replace(s_name, '#', '.') ELSE s_name END AS symbol, r_name AS exchange,
    CASE WHEN s_acctbal < 0 THEN 'Strong sell' WHEN s_acctbal < 5000 THEN 'Neutral' ELSE 'Strong-buy' END AS rating,
    concat_ws(', ', CASE WHEN s_suppkey % 2 = 0 THEN 'S&P 500' END, CASE WHEN s_suppkey % 3 = 0 THEN 'NASDAQ 100' END, CASE WHEN s_suppkey % 4 = 0 THEN 'NASDAQ (Composite)' END,
      CASE WHEN s_suppkey % 5 = 0 THEN 'Russell 1000' END, CASE WHEN s_suppkey % 6 = 0 THEN 'Mini-Russell 2000' END) AS idx
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
clean AS (SELECT place, replace(trim(symbol), '.', '-') AS ticker, exchange, rating, idx FROM raw WHERE NOT contains(symbol, '/')),
member AS (SELECT place, ticker, translate(trim(i), ' &-./()', '') AS index_name FROM (SELECT place, ticker, unnest(string_split(idx, ',')) AS i FROM clean) WHERE trim(i) <> '')"""


def clean_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.cleaned(orders.universe(spark, sf_dir))


# --- Bars and records ------------------------------------------------------------------------------------------------


@_query(f"WITH {BARS_SQL} SELECT * FROM daily")
def bars_daily(spark, sf_dir):
    return orders.derived(spark, sf_dir, "daily")


@_query(f"WITH {BARS_SQL} SELECT * FROM weekly")
def bars_weekly(spark, sf_dir):
    return orders.derived(spark, sf_dir, "weekly")


@_query(f"WITH {BARS_SQL} SELECT * FROM monthly")
def bars_monthly(spark, sf_dir):
    return orders.derived(spark, sf_dir, "monthly")


@_query(f"WITH {BARS_SQL} SELECT ticker, d, volume, max(volume) OVER ({_SERIES} ORDER BY d ROWS UNBOUNDED PRECEDING) AS running_max FROM daily")
def running_max(spark, sf_dir):
    return records.running_max(orders.bars(spark, sf_dir, "daily")).select("ticker", "d", "volume", "running_max")


@_query(f"WITH {BARS_SQL} SELECT ticker, d, volume, volume > coalesce(max(volume) OVER ({_BEFORE}), 0) AS is_record FROM daily")
def record_flags(spark, sf_dir):
    return records.record_flags(orders.bars(spark, sf_dir, "daily")).select("ticker", "d", "volume", "is_record")


@_query(f"WITH {BARS_SQL} SELECT ticker, d, volume, coalesce(volume > max(volume) OVER ({_BEFORE}), false) AS is_record FROM daily")
def record_flags_first_excluded(spark, sf_dir):
    return records.record_flags(orders.bars(spark, sf_dir, "daily"), first_is_record=False).select("ticker", "d", "volume", "is_record")


@_query(f"WITH {flags_sql('every')} SELECT timeframe, ticker, d, volume FROM flagged WHERE is_record")
def record_events(spark, sf_dir):
    return records.record_events(orders.bars(spark, sf_dir))


@_query(summary_sql())
def hve_summary(spark, sf_dir):
    return flat(records.summary(orders.bars(spark, sf_dir, "daily"), Screen(trailing=False)))


@_query(summary_sql(where=f"d BETWEEN DATE '{START}' AND DATE '{END}'"))
def hve_summary_fixed_range(spark, sf_dir):
    return flat(records.summary(orders.bars(spark, sf_dir, "daily"), Screen(range_mode="fixed", start=START, end=END, trailing=False)))


@_query(summary_sql(where=f"d > DATE '{AS_OF}' - INTERVAL 4 YEAR"))
def hve_summary_rolling(spark, sf_dir):
    return flat(records.summary(orders.bars(spark, sf_dir, "daily"), Screen(limit_years=4, as_of=AS_OF, trailing=False)))


@_query(f"WITH {flags_sql()} SELECT ticker, hv1y_date, hv1y_volume, hv1y_occ_1y FROM hv1y")
def hv1y_metrics(spark, sf_dir):
    return flat(records.summary(orders.bars(spark, sf_dir, "daily")).where("hv1y_date is not null").select("ticker", "hv1y_date", "hv1y_volume", "hv1y_occ_1y"))


@_query(f"WITH {flags_sql('every')} SELECT timeframe, ticker, d, volume FROM windowed WHERE is_window_record")
def hv1y_events(spark, sf_dir):
    return records.flagged(orders.bars(spark, sf_dir), ALL).where("is_window_record").select("timeframe", "ticker", "d", "volume")


@_query(summary_sql("every", f"d BETWEEN DATE '{START}' AND DATE '{END}'", trailing=True))
def hve_hv1y_combined(spark, sf_dir):
    return flat(records.summary(orders.bars(spark, sf_dir), FIXED))


@_query(f"WITH {flags_sql('every')} SELECT timeframe, ticker, d, volume FROM enough WHERE is_record AND d >= latest_date - INTERVAL 1 YEAR")
def events_in_last_year(spark, sf_dir):
    rows = records.flagged(orders.bars(spark, sf_dir), ALL)
    return rows.where(F.col("is_record") & (F.col("d") >= F.add_months("latest_date", -12))).select("timeframe", "ticker", "d", "volume")


@_query(f"""WITH {BARS_SQL}, latest AS (SELECT ticker, arg_max(close, d) AS c, arg_max(volume, d) AS v FROM daily GROUP BY ticker)
SELECT ticker, d, volume FROM daily WHERE ticker IN (SELECT ticker FROM latest WHERE NOT c < 930 AND NOT v < 20)""")  # fmt: skip
def latest_bar_filter(spark, sf_dir):
    return records.latest_filter(orders.bars(spark, sf_dir, "daily"), Screen(min_price=930.0, min_volume=20)).select("ticker", "d", "volume")


# --- Validation ------------------------------------------------------------------------------------------------------

_VERDICT_SQL = f"""
moves AS (
  SELECT *, CASE WHEN last_value(close IGNORE NULLS) OVER ({_BEFORE}) <> 0 THEN close / last_value(close IGNORE NULLS) OVER ({_BEFORE}) - 1 END AS change FROM checked),
stats AS (
  SELECT timeframe, ticker, count(*) AS bars, count(*) FILTER (WHERE close IS NULL) AS missing, count(*) FILTER (WHERE close <= 0) AS bad_prices, count(change) AS changes,
    count(*) FILTER (WHERE abs(change) > 0.5) AS extreme, min(d) AS first_date, max(d) AS last_date FROM moves GROUP BY timeframe, ticker),
verdict AS (
  SELECT *, CASE WHEN bars < least THEN 'Insufficient data: ' || bars || ' < ' || least || ' (' || timeframe || ')' WHEN missing > bars * 0.1 THEN 'Too many missing Close prices: ' || missing
    WHEN bad_prices > 0 THEN 'Invalid price values (≤ 0)' WHEN extreme > changes * 0.01 THEN 'Too many extreme price movements: ' || extreme ELSE 'Valid data' END AS reason
  FROM (SELECT *, CASE timeframe WHEN 'daily' THEN 252 WHEN 'weekly' THEN 52 WHEN 'monthly' THEN 12 WHEN 'intraday' THEN 100 ELSE 50 END AS least FROM stats))"""
STATS_SQL = f"""{BARS_SQL},
intraday AS (
  SELECT 'intraday' AS timeframe, 'U' || user_id AS ticker, CAST(ts AS DATE) AS d, max(value) AS close FROM events GROUP BY user_id, CAST(ts AS DATE)),
checked AS (SELECT timeframe, ticker, d, close FROM every UNION ALL SELECT timeframe, ticker, d, close FROM intraday),{_VERDICT_SQL}"""
UNEVEN_SQL = f"""{BARS_SQL},
uneven AS (
  SELECT timeframe, CASE WHEN k = 6 THEN '^FTSE' || right(ticker, 9) ELSE ticker END AS ticker, d, open, high, low,
    CASE k WHEN 1 THEN CASE WHEN day(d) > 6 THEN calm END WHEN 2 THEN close WHEN 3 THEN CASE WHEN day(d) > 2 THEN calm ELSE 0.0::DOUBLE END WHEN 5 THEN CASE WHEN d < DATE '2001-06-01' THEN calm END ELSE calm END AS close, volume
  FROM (SELECT *, CAST(right(ticker, 9) AS INT) % 10 AS k, 100 + close / 100 AS calm FROM every)),
checked AS (SELECT timeframe, ticker, d, close FROM uneven),{_VERDICT_SQL}"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.bars(spark, sf_dir).unionByName(orders.intraday_bars(spark, sf_dir))


@_query(f"WITH {STATS_SQL} SELECT * FROM stats")
def validation_stats(spark, sf_dir):
    return quality.series_stats(_checked(spark, sf_dir))


@_query(f"WITH {STATS_SQL} SELECT timeframe, ticker, reason = 'Valid data' AS valid, reason FROM verdict")
def validation_verdict(spark, sf_dir):
    return quality.verdicts(_checked(spark, sf_dir))


@_query(f"""WITH {STATS_SQL} SELECT count(*) AS series, count(*) FILTER (WHERE ok) AS valid, CAST(floor(sum(bars) FILTER (WHERE ok) / (count(*) FILTER (WHERE ok))) AS BIGINT) AS mean_bars,
  min(first_date) FILTER (WHERE ok) AS first_date, max(last_date) FILTER (WHERE ok) AS last_date FROM (SELECT *, reason = 'Valid data' AS ok FROM verdict)""")  # fmt: skip
def data_summary(spark, sf_dir):
    return quality.data_summary(_checked(spark, sf_dir))


@_query(f"WITH {UNEVEN_SQL} SELECT timeframe, ticker, reason = 'Valid data' AS valid, reason FROM verdict")
def validation_verdict_uneven(spark, sf_dir):
    return quality.verdicts(orders.uneven_bars(spark, sf_dir))


@_query(f"""WITH {UNEVEN_SQL}, latest AS (SELECT timeframe, ticker, last(close ORDER BY d) AS c, last(volume ORDER BY d) AS v FROM uneven GROUP BY timeframe, ticker)
SELECT timeframe, ticker, d, volume FROM uneven JOIN latest USING (timeframe, ticker) WHERE NOT coalesce(c < 112, false) AND NOT coalesce(v < 20, false)""")  # fmt: skip
def latest_bar_filter_uneven(spark, sf_dir):
    return records.latest_filter(orders.uneven_bars(spark, sf_dir), Screen(min_price=112.0, min_volume=20)).select("timeframe", "ticker", "d", "volume")


@_query(f"WITH {UNEVEN_SQL} SELECT d, open, high, low, close, volume, ticker, timeframe FROM uneven WHERE timeframe = 'daily'")
def csv_bars(spark, sf_dir):
    return bars.read_csv_bars(spark, orders.csv_folder(spark, sf_dir, "daily"), "daily", partitions=orders.file_parts(spark, sf_dir))


#: Of weekly files some have no Close column, some no date.
_FILED = """CASE WHEN timeframe = 'weekly' AND right(ticker, 1) = '8' THEN 'No data available' WHEN bars < least THEN reason WHEN timeframe = 'weekly' AND right(ticker, 1) = '7' THEN 'Missing Close price column' ELSE reason END"""
_SCREENED = f"(SELECT u.* FROM uneven u JOIN (SELECT timeframe, ticker, {_FILED} AS reason FROM verdict) v USING (timeframe, ticker) WHERE v.reason = 'Valid data' AND u.ticker IN (SELECT s_name FROM supplier WHERE s_suppkey % 3 <> 0) AND timeframe <> 'monthly')"


@_query(summary_sql(_SCREENED, f"d BETWEEN DATE '{START}' AND DATE '{END}'", trailing=True, base=UNEVEN_SQL))
def full_screen(spark, sf_dir):
    """From bars files and a selection by file to the results, by the settings of a run."""
    settings = Settings(yf_daily_data=True, yf_weekly_data=True, hve_date_range_mode="fixed", hve_start_date=START, hve_end_date=END)
    rows = screen.bars_of(spark, {t: orders.csv_folder(spark, sf_dir, t) for t in settings.timeframes()}, partitions=orders.file_parts(spark, sf_dir))
    listed = orders.table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("ticker"))
    selection = universe.chosen(universe.one_hot(clean_universe(spark, sf_dir), FLAGS), (6,), {6: listed}, FLAGS)
    return flat(screen.run(rows, selection, settings))


@_query(f"WITH {UNEVEN_SQL}, filed AS (SELECT timeframe, ticker, {_FILED} AS reason FROM verdict WHERE timeframe <> 'monthly') SELECT timeframe, ticker, reason = 'Valid data' AS valid, reason FROM filed")
def file_verdicts(spark, sf_dir):
    """Verdicts of series as their files have them, each timeframe by itself."""
    return quality.verdicts(screen.bars_of(spark, {t: orders.csv_folder(spark, sf_dir, t) for t in ("daily", "weekly")}, partitions=orders.file_parts(spark, sf_dir)))


# --- Exports and cards -----------------------------------------------------------------------------------------------


def _wide_sql(prefix: str, ordered: str) -> str:
    cells = ", ".join(f"max(CASE WHEN place = {i} THEN strftime(d, '%Y-%m-%d') END) AS {prefix}_date_{i}, max(CASE WHEN place = {i} THEN CAST(volume AS BIGINT) END) AS {prefix}_vol_{i}" for i in range(1, 11))
    return f"WITH {flags_sql('every')}, placed AS ({ordered}) SELECT ticker AS Symbol, timeframe, {cells} FROM placed GROUP BY ticker, timeframe"


@_query(_wide_sql("HVE", f"SELECT *, row_number() OVER ({_SERIES} ORDER BY d DESC) AS place FROM enough WHERE is_record"))
def hve_wide_top10(spark, sf_dir):
    return exports.hve_wide(records.summary(orders.bars(spark, sf_dir), ALL))


@_query(_wide_sql("HVD", f"SELECT *, row_number() OVER ({_SERIES} ORDER BY volume DESC, d DESC) AS place FROM enough WHERE is_record"))
def hvd_wide_records(spark, sf_dir):
    return exports.hvd_wide(records.summary(orders.bars(spark, sf_dir), ALL))


@_query(_wide_sql("HVD", f"SELECT *, row_number() OVER ({_SERIES} ORDER BY volume DESC, d) AS place FROM every"))
def hvd_wide_all_days(spark, sf_dir):
    return exports.hvd_wide_all_days(orders.bars(spark, sf_dir))


@_query(f"""WITH {flags_sql('every')}, listed AS (
  SELECT timeframe, ticker, 'HVE' AS section, row_number() OVER ({_SERIES} ORDER BY d DESC) AS place, d, volume, latest_date, CAST(NULL AS DATE) AS hve_date FROM enough WHERE is_record
  UNION ALL SELECT w.timeframe, w.ticker, 'HV1Y', row_number() OVER (PARTITION BY w.timeframe, w.ticker ORDER BY w.d DESC), w.d, w.volume, w.latest_date, h.hve_date
  FROM windowed w JOIN hve h ON w.timeframe = h.timeframe AND w.ticker = h.ticker WHERE w.is_window_record AND w.window_n >= 2)
SELECT timeframe, ticker, section, place, '  ' || place || '. ' || strftime(d, '%Y-%m-%d') || '  Volume: ' || format('{{:,}}', CAST(volume AS BIGINT)) || '  (' || (latest_date - d) || ' days ago)' ||
  CASE WHEN d = hve_date THEN '  [Also HVE]' ELSE '' END AS line FROM listed""")  # fmt: skip
def card_lines(spark, sf_dir):
    return flat(exports.card_lines(records.summary(orders.bars(spark, sf_dir), ALL)))


@_query(f"""WITH {flags_sql('every')} SELECT h.ticker, CAST(sum(total_hve_count) AS BIGINT) AS hve_events, CAST(sum(coalesce(hv1y_occ_1y, 0)) AS BIGINT) AS hv1y_events
FROM hve h LEFT JOIN hv1y t ON h.timeframe = t.timeframe AND h.ticker = t.ticker GROUP BY h.ticker""")  # fmt: skip
def cross_timeframe_totals(spark, sf_dir):
    return exports.cross_timeframe_totals(records.summary(orders.bars(spark, sf_dir), ALL))


@_query(f"""WITH {flags_sql('every')} SELECT ticker, timeframe, days FROM (SELECT ticker, timeframe, CAST(latest_date - hve_date AS BIGINT) AS days,
  row_number() OVER (PARTITION BY ticker ORDER BY latest_date - hve_date, CASE timeframe WHEN 'daily' THEN 1 WHEN 'weekly' THEN 2 ELSE 3 END) AS place FROM hve) WHERE place = 1""")  # fmt: skip
def latest_activity_timeframe(spark, sf_dir):
    return flat(exports.latest_activity(records.summary(orders.bars(spark, sf_dir), ALL)))


# --- Scores and sheets -----------------------------------------------------------------------------------------------

LEGACY_SQL = f"""{BARS_SQL},
old AS (SELECT *, coalesce(volume > max(volume) OVER ({_BEFORE}), false) AS is_record FROM every),
legacy AS (
  SELECT timeframe, ticker, count(*) FILTER (WHERE is_record) AS hve_count, max(d) FILTER (WHERE is_record) AS latest_hve_date, max(volume) AS max_volume_ever, arg_max(volume, d) AS current_volume,
    arg_max(close, d) AS current_price, min(d) AS data_start_date, max(d) AS data_end_date, count(*) AS data_points FROM old GROUP BY timeframe, ticker HAVING count(*) FILTER (WHERE is_record) > 0),
aged AS (
  SELECT *, CAST(data_end_date - latest_hve_date AS BIGINT) AS days_since_latest_hve, CASE WHEN max_volume_ever > 0 THEN 100 * (current_volume / max_volume_ever) ELSE 0.0::DOUBLE END AS volume_ratio_to_max FROM legacy),
graded AS (
  SELECT *, round((CASE WHEN days <= 30 THEN 50.0::DOUBLE WHEN days <= 90 THEN 50.0::DOUBLE * (1 - (days - 30) / 60 * 0.5::DOUBLE) WHEN days <= 365 THEN 25.0::DOUBLE * (1 - (days - 90) / 275 * 0.8::DOUBLE)
    ELSE 5.0::DOUBLE * greatest(0.0::DOUBLE, 1 - (days - 365) / 365) END) + least(30.0::DOUBLE, hve_count * 3.0::DOUBLE) + least(20.0::DOUBLE, volume_ratio_to_max / 5), 2) AS score
  FROM (SELECT *, CAST(days_since_latest_hve AS DOUBLE) AS days FROM aged))"""


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(scoring.legacy_results(orders.bars(spark, sf_dir)))


@_query(f"WITH {LEGACY_SQL} SELECT * EXCLUDE (days) FROM graded")
def score_ranked(spark, sf_dir):
    return flat(_legacy(spark, sf_dir))


@_query(f"""WITH {LEGACY_SQL} SELECT timeframe, count(*) AS tickers, round(sum(hve_count) / count(*), 2) AS avg_count, max(hve_count) AS max_count, min(hve_count) AS min_count,
  round(sum(days_since_latest_hve) / count(*), 2) AS avg_days, min(days_since_latest_hve) AS min_days, max(days_since_latest_hve) AS max_days, round(sum(score) / count(*), 2) AS avg_score, max(score) AS max_score,
  round(sum(volume_ratio_to_max) / count(*), 2) AS avg_ratio, count(*) FILTER (WHERE days <= 30) AS last_30, count(*) FILTER (WHERE days <= 90) AS last_90, count(*) FILTER (WHERE days <= 365) AS last_365
FROM graded GROUP BY timeframe""")  # fmt: skip
def stats_sheet(spark, sf_dir):
    return flat(scoring.stats_sheet(_legacy(spark, sf_dir)))


@_query(f"""WITH {LEGACY_SQL} SELECT ticker AS "Ticker", timeframe AS "Timeframe", d AS "HVE Date", volume AS "Volume", close AS "Close Price", open AS "Open Price", high AS "High Price", low AS "Low Price",
  CASE WHEN open > 0 THEN (close - open) / open * 100 END AS "Price Change %" FROM old WHERE is_record""")  # fmt: skip
def details_sheet(spark, sf_dir):
    return scoring.details_sheet(scoring.legacy_results(orders.bars(spark, sf_dir)))


@_query(f"WITH {BARS_SQL} SELECT * FROM (PIVOT (SELECT d, ticker, close FROM daily) ON ticker USING max(close) GROUP BY d)")
def close_matrix(spark, sf_dir):
    """A column for each ticker; their names, which are columns here, are the only rows that are collected."""
    names = [r[0] for r in orders.table(spark, sf_dir, "supplier").select("s_name").distinct().orderBy("s_name").collect()]
    return matrix.matrix(orders.derived(spark, sf_dir, "daily"), names)


_INDEXES = " OR ".join(f"contains(ticker, '{p}')" for p in matrix.INDEXES)


@_query(f"""WITH {UNEVEN_SQL} SELECT d, ticker, close, reason = 'Valid data' AS valid FROM (SELECT * FROM uneven WHERE timeframe = 'daily') JOIN verdict USING (timeframe, ticker) WHERE NOT ({_INDEXES})""")
def close_matrix_uneven(spark, sf_dir):
    return matrix.long(orders.uneven_bars(spark, sf_dir, "daily"))


@_query(f"""WITH {STATS_SQL} SELECT d, ticker, close, reason = 'Valid data' AS valid FROM daily JOIN verdict USING (timeframe, ticker) WHERE NOT ({_INDEXES})""")
def close_matrix_all(spark, sf_dir):
    return matrix.long(orders.bars(spark, sf_dir, "daily"))


_REPORT_SQL = """round((CASE WHEN days <= 30 THEN 50.0::DOUBLE WHEN days <= 90 THEN 50.0::DOUBLE * (1 - (days - 30) / 60 * 0.5::DOUBLE) WHEN days <= 365 THEN 25.0::DOUBLE * (1 - (days - 90) / 275 * 0.8::DOUBLE)
    ELSE 5.0::DOUBLE * greatest(0.0::DOUBLE, 1 - (days - 365) / 365) END) + least(30.0::DOUBLE, total_hve_count * 3.0::DOUBLE) + least(20.0::DOUBLE, percent / 5), 2)"""


@_query(f"""WITH {flags_sql("every", f"d BETWEEN DATE '{START}' AND DATE '{END}'")},
aged AS (SELECT *, CAST(latest_date - hve_date AS DOUBLE) AS days, 100 * (CASE WHEN hve_volume > 0 THEN latest_volume / hve_volume ELSE 0.0::DOUBLE END) AS percent FROM hve)
SELECT ticker AS "Ticker", timeframe AS "Timeframe", {_REPORT_SQL} AS "Score", total_hve_count AS "HVE Count", hve_date AS "Latest HVE Date", CAST(days AS BIGINT) AS "Days Since HVE", hve_volume AS "Max Volume", latest_volume AS "Current Volume",
  percent AS "Volume % of Max", latest_close AS "Current Price", CAST(NULL AS DATE) AS "Data Start", latest_date AS "Data End", data_points AS "Data Points" FROM aged""")  # fmt: skip
def scored_report(spark, sf_dir):
    """The combined sheet of all timeframes, from the results of a screen."""
    results = scoring.scored(scoring.from_screen(records.summary(orders.bars(spark, sf_dir), FIXED)))
    sheets = [scoring.summary_sheet(results.where(F.col("timeframe") == t)) for t in ("daily", "weekly", "monthly")]
    return flat(scoring.all_combined(*sheets))


# --- Universe --------------------------------------------------------------------------------------------------------


@_query(f"WITH {UNIVERSE_SQL} SELECT place, ticker FROM clean")
def symbol_clean(spark, sf_dir):
    return clean_universe(spark, sf_dir).select("place", "ticker")


@_query(f"""WITH {UNIVERSE_SQL} SELECT place, {", ".join(f"EXISTS (SELECT 1 FROM member m WHERE m.place = c.place AND index_name = '{n}') AS {n}" for n in FLAGS)} FROM clean c""")
def index_one_hot(spark, sf_dir):
    return universe.one_hot(clean_universe(spark, sf_dir), FLAGS).select("place", *FLAGS)


@_query(f"WITH {UNIVERSE_SQL} SELECT index_name, count(*) AS members FROM member GROUP BY index_name ORDER BY members DESC, index_name LIMIT 10")
def index_counts_top10(spark, sf_dir):
    return universe.index_counts(clean_universe(spark, sf_dir), 10)


@_query(f"WITH {UNIVERSE_SQL} SELECT exchange, count(*) AS members FROM clean GROUP BY exchange")
def exchange_counts(spark, sf_dir):
    return universe.category_counts(clean_universe(spark, sf_dir), "exchange")


@_query(f"""WITH {UNIVERSE_SQL} SELECT place, rating = 'Strong sell' AS "rating_Strong_sell", rating = 'Strong-buy' AS "rating_Strong_buy" FROM clean""")
def rating_flags(spark, sf_dir):
    flags = universe.category_flags(clean_universe(spark, sf_dir), "analyst rating", "rating_", ("Strong sell", "Strong-buy"))
    return flags.select("place", "rating_Strong_sell", "rating_Strong_buy")


@_query(f"""WITH {UNIVERSE_SQL} SELECT place, rating = 'Strong sell' AS "rating_Strong_sell", rating = 'Neutral' AS "rating_Neutral", rating = 'Strong-buy' AS "rating_Strong_buy" FROM clean""")
def rating_flags_all(spark, sf_dir):
    flags = universe.category_flags(clean_universe(spark, sf_dir), "analyst rating", "rating_", ("Strong sell", "Neutral", "Strong-buy"))
    return flags.select("place", "rating_Strong_sell", "rating_Neutral", "rating_Strong_buy")


@_query(f"WITH {UNIVERSE_SQL} SELECT DISTINCT place, ticker FROM member WHERE index_name IN ('NASDAQ100', 'Russell1000')")
def choice_filter_or(spark, sf_dir):
    return universe.members(clean_universe(spark, sf_dir), 9).select("place", "ticker")


@_query(f"""WITH {UNIVERSE_SQL}, either AS (SELECT DISTINCT ticker, place, CASE index_name WHEN 'Russell1000' THEN 0 ELSE 1 END AS selection FROM member WHERE index_name IN ('Russell1000', 'NASDAQ100'))
SELECT ticker, place, CAST(min(selection) AS BIGINT) AS selection FROM either GROUP BY ticker, place""")  # fmt: skip
def choice_union_dedupe(spark, sf_dir):
    table = clean_universe(spark, sf_dir)
    return flat(universe.union_selections(*(universe.members(table, c).select("ticker", "place") for c in (4, 2))))


@_query(f"""WITH {UNIVERSE_SQL} SELECT s_name AS ticker, c.exchange, coalesce(EXISTS (SELECT 1 FROM member m WHERE m.ticker = s_name AND index_name = 'SP500'), false) AS SP500
FROM supplier LEFT JOIN clean c ON c.ticker = s_name""")  # fmt: skip
def enrich_left(spark, sf_dir):
    selection = orders.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("ticker"))
    known = universe.one_hot(clean_universe(spark, sf_dir), ("SP500",)).select("ticker", "exchange", "SP500")
    return universe.enriched(selection, known, ("SP500",))


_TWICE = "(SELECT ticker, place, exchange FROM clean UNION ALL SELECT 'Supplier#' || lpad(CAST(place // 4 AS VARCHAR), 9, '0'), place + 1000000, exchange FROM clean)"


@_query(f"""WITH {UNIVERSE_SQL}, listed AS (SELECT 'Supplier#' || lpad(CAST(s_suppkey // 2 AS VARCHAR), 9, '0') AS ticker, min(s_suppkey) AS place FROM supplier GROUP BY 1)
SELECT ticker, l.place, u.exchange, ticker IN (SELECT c.ticker FROM clean c JOIN member m ON m.place = c.place WHERE index_name = 'SP500') AS SP500
FROM listed l LEFT JOIN (SELECT ticker, arg_min(exchange, place) AS exchange FROM {_TWICE} GROUP BY ticker) u USING (ticker)""")  # fmt: skip
def enrich_first_match(spark, sf_dir):
    name = lambda k: F.concat(F.lit("Supplier#"), F.lpad(F.floor(k).cast("string"), 9, "0"))
    listed = orders.table(spark, sf_dir, "supplier").select(name(F.col("s_suppkey") / 2).alias("ticker"), F.col("s_suppkey").alias("place"))
    known = universe.one_hot(clean_universe(spark, sf_dir), ("SP500",)).select("ticker", "place", "exchange", "SP500")
    # Later rows of the same tickers, which must not count.
    again = known.select(name(F.col("place") / 4).alias("ticker"), (F.col("place") + 1000000).alias("place"), "exchange", F.lit(False).alias("SP500"))
    return universe.from_file(listed, known.unionByName(again), ("SP500",))


@_query(f"WITH {UNIVERSE_SQL} SELECT s_name AS ticker FROM supplier WHERE s_name NOT IN (SELECT ticker FROM clean)")
def missing_from_universe(spark, sf_dir):
    return universe.missing(orders.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("ticker")), clean_universe(spark, sf_dir))


_REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@_query(f"""WITH {UNIVERSE_SQL} SELECT ticker, exchange, {", ".join(f"EXISTS (SELECT 1 FROM member m WHERE m.place = c.place AND index_name = '{n}') AS {n.lower()}" for n in FLAGS)},
  {", ".join(f"exchange = '{r}' AS exchange_{r.lower().replace(' ', '_')}" for r in _REGIONS)} FROM clean c""")  # fmt: skip
def universe_file(spark, sf_dir):
    """The universe with its flags, written as a file and read back."""
    path = orders.universe_file(spark, sf_dir, universe.write_universe)
    flags = [*(n.lower() for n in FLAGS), *(f"exchange_{r.lower()}" for r in _REGIONS)]
    return universe.read_universe(spark, path).select("ticker", "exchange", *(F.col(f"`{f}`").cast("boolean").alias(f.replace(" ", "_")) for f in flags))
