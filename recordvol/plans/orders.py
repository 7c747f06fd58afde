"""Bars and a universe derived from the driver's order tables, which have no price histories."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordvol.operators.universe import cleaned
from recordvol.schema import BARS

PERIODS = {"daily": None, "weekly": "week", "monthly": "month"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's shipped quantity per weekday, with the first, largest, smallest and last retail price."""
    n = partitions(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.to_date("l_shipdate").alias("d"))
    prices = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("p"))
    lines = with_keyed(lines.where(F.weekday("d") < 5), prices, "l_partkey", n)
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    # Lines hardly share a supplier and a day: they move as they are, and are sorted once where they arrive.
    per_day = lines.repartition(n, "l_suppkey", "d").groupBy("l_suppkey", "d").agg(
        F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.sum("l_quantity").alias("volume")
    )
    # Suppliers are one row a ticker: their names are joined after the aggregate has shrunk the lines.
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("ticker"))
    return with_keyed(per_day, names, "l_suppkey", n).select(F.lit("daily").alias("timeframe"), *BARS.fieldNames()[1:], "l_suppkey")


def with_keyed(rows: DataFrame, keyed: DataFrame, key: str, n: int) -> DataFrame:
    """Rows joined with a table of a row a key, which goes to every task if it is small; else both are laid out in n partitions."""
    if keyed.count() <= SENT:  # from the files' footers
        return rows.join(F.broadcast(keyed), key)
    return rows.repartition(n, key).join(keyed.repartition(n, key).hint("merge"), key)


def coarser(daily: DataFrame, *timeframes: str) -> DataFrame:
    """Bars of the timeframes, dated by their first trading day; daily ones stay as they are."""
    rows = daily.withColumn("timeframe", F.explode(F.array(*(F.lit(t) for t in timeframes))))
    # A day's bar is a group of its own, also where suppliers share a name.
    period, own = F.to_timestamp("d"), F.col("l_suppkey")
    for timeframe in timeframes:
        if PERIODS[timeframe]:
            is_it = F.col("timeframe") == timeframe
            period, own = F.when(is_it, F.date_trunc(PERIODS[timeframe], "d")).otherwise(period), F.when(~is_it, own)
    rows = rows.groupBy("timeframe", "ticker", period.alias("_period"), own.alias("_own")).agg(
        F.min("d").alias("d"), F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume")
    )
    return rows.select(*BARS.fieldNames())


#: Lines of orders for which there is a partition of series.
LINES = 200_000
#: Most rows of a table that a join sends to every task.
SENT = 2_000_000


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of bars: their number grows with the lines, so that what a task sorts does not."""
    lines = table(spark, sf_dir, "lineitem").count()  # from the files' footers
    return max(spark.sparkContext.defaultParallelism, -(-lines // LINES))


def file_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of bars read from files: fewer, as each of the scan's many small tasks has a block for each of them."""
    return max(spark.sparkContext.defaultParallelism, -(-partitions(spark, sf_dir) // 5))


def bars(spark: SparkSession, sf_dir: str, *timeframes: str) -> DataFrame:
    """Bars of the timeframes (all, if none is named), laid out for windows over series."""
    return derived(spark, sf_dir, *timeframes)


def derived(spark: SparkSession, sf_dir: str, *timeframes: str) -> DataFrame:
    """Daily bars move to their tickers once, and those of all timeframes are put together of them where they lie."""
    daily = daily_bars(spark, sf_dir).repartition(partitions(spark, sf_dir), "ticker")
    if timeframes == ("daily",):
        return daily.select(*BARS.fieldNames())
    return coarser(daily, *timeframes or tuple(PERIODS))


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per supplier: a raw symbol that needs cleaning, exchange, rating and a comma-joined index list."""
    key = F.col("s_suppkey")
    symbol = F.when(key % 7 == 3, F.concat("s_name", F.lit("/P"))).when(key % 3 == 0, F.concat(F.lit(" "), F.translate("s_name", "#", "."))).otherwise(F.col("s_name"))
    lists = ((2, "S&P 500"), (3, "NASDAQ 100"), (4, "NASDAQ (Composite)"), (5, "Russell 1000"), (6, "Mini-Russell 2000"))
    index = F.concat_ws(", ", *(F.when(key % m == 0, F.lit(n)) for m, n in lists))
    rating = F.when(F.col("s_acctbal") < 0, "Strong sell").when(F.col("s_acctbal") < 5000, "Neutral").otherwise("Strong-buy")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(key.alias("place"), symbol.alias("ticker"), F.col("r_name").alias("exchange"), rating.alias("analyst rating"), index.alias("index"))


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short histories from the events table, which validation turns down."""
    rows = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.to_date("ts").alias("d")).agg(F.count("*").cast("double").alias("volume"), F.max("value").alias("close"))
    none = F.lit(None).cast("double")
    return rows.select(F.lit("intraday").alias("timeframe"), "ticker", "d", none.alias("open"), none.alias("high"), none.alias("low"), "close", "volume")


def uneven_bars(spark: SparkSession, sf_dir: str, *timeframes: str) -> DataFrame:
    """Bars with calmer prices, and with what validation and filters look for: missing, bad, wild and last missing closes, and an index symbol."""
    k = F.substring("ticker", -9, 9).cast("int") % 10
    calm = 100 + F.col("close") / 100
    close = F.when(k == 1, F.when(F.dayofmonth("d") > 6, calm)).when(k == 2, F.col("close")).when(k == 3, F.when(F.dayofmonth("d") > 2, calm).otherwise(0.0)).when(k == 5, F.when(F.col("d") < "2001-06-01", calm)).otherwise(calm)
    ticker = F.when(k == 6, F.concat(F.lit("^FTSE"), F.substring("ticker", -9, 9))).otherwise(F.col("ticker"))
    return derived(spark, sf_dir, *timeframes).withColumns({"close": close, "ticker": ticker})


def csv_folder(spark: SparkSession, sf_dir: str, timeframe: str) -> str:
    """A folder of bars files, one per ticker, written once an application: of every other ticker with other columns, order and case.

    In weekly files, tickers ending in 7 have no Close column and those ending in 8 no date.
    """
    key = (spark.sparkContext.applicationId, sf_dir, timeframe)
    if key not in _WRITTEN:
        _WRITTEN[key] = _write_csv(spark, sf_dir, timeframe)
    return _WRITTEN[key]


def universe_file(spark: SparkSession, sf_dir: str, write: Callable[[DataFrame, str], None]) -> str:
    """A file of the clean universe, written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir, "universe")
    if key not in _WRITTEN:
        path = f"{scratch(spark)}/universe-{uuid.uuid4().hex}"
        write(cleaned(universe(spark, sf_dir)).drop("place"), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


_WRITTEN: dict[tuple[str, str, str], str] = {}
_SCRATCH: dict[str, str] = {}


def _write_csv(spark: SparkSession, sf_dir: str, timeframe: str) -> str:
    folder = f"{scratch(spark)}/bars-{uuid.uuid4().hex}"
    last, weekly = F.substring("ticker", -1, 1).cast("int"), F.lit(timeframe == "weekly")
    cell = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in BARS.fieldNames()[2:]}
    dates, stamped = F.when((last == 8) & weekly, '""').otherwise(cell["d"]), F.concat(cell["d"], F.lit(" 00:00:00-05:00"))
    kinds = (
        (last % 2 == 0, {"Date": dates, "Open": cell["open"], "High": cell["high"], "Low": cell["low"], "Close": cell["close"], "Volume": cell["volume"]}),
        ((last == 7) & weekly, {"Date": dates, "Open": cell["open"], "High": cell["high"], "Low": cell["low"], "Volume": cell["volume"]}),
        (last % 2 == 1, {"Adj Close": F.lit("x"), "Volume": cell["volume"], "Close": cell["close"], "low": cell["low"], "High": cell["high"], "Open": cell["open"], "Date": stamped}),
    )
    head, line = F.lit(None).cast("string"), F.lit(None).cast("string")
    for is_it, cells in reversed(kinds):
        head, line = F.when(is_it, ",".join(cells)).otherwise(head), F.when(is_it, F.concat_ws(",", *cells.values())).otherwise(line)
    # Bars lie where their tickers are: the tasks that compute them write their files.
    rows = uneven_bars(spark, sf_dir, timeframe).select("ticker", "d", head.alias("head"), line.alias("line")).where("head is not null")
    write_series(rows, folder)
    return folder


#: Schemes of folders that tasks reach by a local path.
LOCAL = ("file",)


def write_series(rows: DataFrame, folder: str) -> None:
    """A file per ticker of rows (ticker, d, head, line) that are laid out by ticker.

    In a folder that is a local path to all executors, tasks write the files themselves and leave a table of tickers and rows as `{folder}-rows`:
    Hadoop's local file system starts a process or two for each file that it makes (chmod), some 40 ms a file. Elsewhere Spark's writer makes a folder per ticker.
    """
    path = rows.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(rows.sparkSession.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    if files.getUri().getScheme() in LOCAL:
        done = rows.sortWithinPartitions("ticker", "d").drop("d").mapInArrow(partial(_put, folder=path.toUri().getPath()), "ticker string, rows long")
        done.write.parquet(f"{folder}-rows")
        return
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("ticker").orderBy("d")))
    lines = rows.select("ticker", "d", F.posexplode(F.when(F.col("n") == 1, F.array("head", "line")).otherwise(F.array("line"))).alias("at", "line"))
    lines = lines.sortWithinPartitions("ticker", "d", "at").select("ticker", "line")
    lines.write.mode("append").partitionBy("ticker").options(sep="\u0001", quote="").csv(folder)


def _put(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes rows (ticker, head, line), sorted by ticker, to `{ticker}.csv` in a folder of the task's own; gives tickers and numbers of rows.

    A file gets its name when it is whole, so a task that runs again leaves the same files.
    """
    task = TaskContext.get()
    place = f"{folder}/{task.partitionId()}"
    os.makedirs(place, exist_ok=True)
    ticker, out, rows, made = None, None, 0, []
    part = f"{place}/.{task.taskAttemptId()}"

    def close() -> None:
        out.close()
        os.replace(part, f"{place}/{ticker}.csv")
        made.append((ticker, rows))

    for batch in batches:
        runs = pc.run_end_encode(batch.column(0))
        lines, lo = batch.column(2).to_numpy(zero_copy_only=False), 0
        for name, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if name != ticker:
                if out:
                    close()
                ticker, out, rows = name, open(part, "w", encoding="utf-8", newline=""), 0
                out.write(batch.column(1)[lo].as_py() + "\n")
            out.write("\n".join(lines[lo:hi]) + "\n")
            rows, lo = rows + hi - lo, hi
    if out:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["ticker", "rows"])


def scratch(spark: SparkSession) -> str:
    """A folder that goes when the application ends, in the one spark.checkpoint.dir names; one of its own only in local mode."""
    me = spark.sparkContext.applicationId
    if me not in _SCRATCH:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _SCRATCH[me] = f"{(folder or tempfile.mkdtemp(prefix='recordvol-')).rstrip('/')}/recordvol-screens/{me}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_SCRATCH[me])
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _SCRATCH[me]
