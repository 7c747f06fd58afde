"""Bars from files: per-ticker CSV folders, Parquet, ticker lists and ticker information."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordvol.schema import BARS, CSV, KEYS

#: Settings that hold input folders, before the name of the environment.
INPUT_SETTINGS = {"daily": "yf_daily_data_files_", "weekly": "yf_weekly_data_files_", "monthly": "yf_monthly_data_files_", "intraday": "tw_intraday_folder_"}
#: Names a ticker column may have, in order of preference.
TICKER_NAMES = ("ticker", "symbol", "Ticker", "Symbol")


#: Commas that are not between quotes.
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def cells(line: Column) -> Column:
    """The fields of a line of CSV."""
    return F.when(F.contains(line, F.lit('"')), F.split(line, _COMMA)).otherwise(F.split(line, ","))


def bare(cell: Column) -> Column:
    """A field without quotes around it."""
    return F.trim(F.trim(cell), F.lit('"'))


def csv_rows(spark: SparkSession, folder: str, tickers: DataFrame | None = None) -> DataFrame:
    """ticker, line, the columns of CSV as text, and has_close, of all bars files of a folder.

    Line 0 is the file's header and has nulls only, so that a file without rows is there as well (one
    of no bytes is not: the scan skips it).

    Files are `{ticker}.csv`, or lie in folders `ticker={ticker}` as Spark writes them. Each file's
    own header says where its columns are, whatever their order and case; a column that a file does
    not have is null. A file is one row of the scan, which suits files of one series each (a daily
    history takes some hundred KB). With `tickers` other files are left out before they are parsed.
    """
    path = F.col("_metadata.file_path")
    partition, name = F.regexp_extract(path, r"/ticker=([^/]+)/", 1), F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.csv")
    # Paths are URLs, and Spark's partition folders escape their values once more.
    ticker = F.when(partition != "", F.url_decode(F.url_decode(partition))).otherwise(F.url_decode(name))
    files = files.select(ticker.alias("ticker"), F.ltrim(F.col("value"), F.lit("\ufeff")).alias("value"))
    if tickers is not None:
        files = files.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    lines = files.select("ticker", F.split("value", r"\r?\n").alias("lines"))
    # Where the columns are is found once a file; of each line only their fields are looked at.
    lines = lines.withColumn("names", F.transform(cells(F.col("lines")[0]), lambda x: F.lower(bare(x))))
    places = (F.nullif(F.array_position("names", c.lower()), F.lit(0)).cast("int").alias(f"at_{c}") for c in CSV.fieldNames())
    lines = lines.select("ticker", "lines", F.array_contains("names", "close").alias("has_close"), *places)
    # No list of lines is empty; the outer form only spares a filter that splits the text once more.
    rows = lines.select("*", F.posexplode_outer("lines").alias("line", "text")).drop("lines").where("line = 0 or trim(text) <> ''")
    rows = rows.withColumn("cells", F.when(F.col("line") > 0, cells(F.col("text"))))
    return rows.select("ticker", "line", *(bare(F.get("cells", F.col(f"at_{c}") - 1)).alias(c) for c in CSV.fieldNames()), "has_close")


def read_csv_bars(spark: SparkSession, folder: str, timeframe: str, tickers: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """All bars files of a folder as one table; tickers without a file are simply not there."""
    return tidy(csv_rows(spark, folder, tickers), timeframe, partitions)


def tidy(raw: DataFrame, timeframe: str, partitions: int | None = None) -> DataFrame:
    """Bars from text columns: the date before the first space, weekdays only, missing and NaN numbers null.

    Dates that cannot be parsed go with the missing ones (see `unreadable_dates`). Of several rows
    of one day the last in the file (by `line`) stays.
    """
    return one_per_day(_typed(raw, timeframe).where(_dated()), partitions).select(*BARS.fieldNames())


def with_files(raw: DataFrame, timeframe: str, partitions: int | None = None) -> DataFrame:
    """The bars of `tidy` with has_close, whether their file has a Close column, and a row without a date for each file."""
    return one_per_day(_typed(raw, timeframe).where(_dated() | (F.col("line") == 0)), partitions).select(*BARS.fieldNames(), "has_close")


def _dated() -> Column:
    return F.col("d").isNotNull() & (F.weekday("d") < 5)


def _typed(raw: DataFrame, timeframe: str) -> DataFrame:
    numbers = {c.lower(): number(F.col(c)) if c in raw.columns else F.lit(None).cast("double") for c in CSV.fieldNames()[1:]}
    typed = raw.withColumns({"_d": bar_date(F.col("Date")), **{f"_{c}": v for c, v in numbers.items()}})
    more = ["has_close"] if "has_close" in raw.columns else []
    return typed.select(F.lit(timeframe).alias("timeframe"), "ticker", F.col("_d").alias("d"), *(F.col(f"_{c}").alias(c) for c in numbers), "line", *more)


def bar_date(text: Column) -> Column:
    """The day in a date text, whatever time of day or offset follows it."""
    return F.try_to_date(F.substring_index(F.trim(text), " ", 1))


def number(text: Column) -> Column:
    value = F.trim(text).try_cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def unreadable_dates(raw: DataFrame) -> DataFrame:
    """Per ticker, how many rows have a date text that is no date."""
    bad = F.count_if((F.trim(F.col("Date")) != "") & bar_date(F.col("Date")).isNull())
    return raw.groupBy("ticker").agg(bad.alias("unreadable"))


def one_per_day(bars: DataFrame, partitions: int | None = None) -> DataFrame:
    """The last row of each day, by the row's place `line` in its file; bars are laid out by series once, for this and windows after it.

    Where the number of bars is known, it should give the number of partitions; otherwise the session does.
    """
    bars = bars.repartition(partitions, "ticker") if partitions else bars.repartition("ticker")
    last = F.max_by(F.struct(*(c for c in bars.columns if c not in KEYS)), "line")
    return bars.groupBy(*KEYS, "d").agg(last.alias("row")).select(*KEYS, "row.*")


def read_bars(spark: SparkSession, path: str, tickers: DataFrame | None = None) -> DataFrame:
    """Bars staged as Parquet, partitioned by timeframe."""
    bars = spark.read.schema(BARS).parquet(path)
    return bars if tickers is None else bars.join(tickers.select("ticker").distinct(), "ticker", "left_semi")


def write_bars(bars: DataFrame, path: str) -> None:
    bars.repartition("timeframe", "ticker").sortWithinPartitions("ticker", "d").write.partitionBy("timeframe").parquet(path)


def ticker_list(table: DataFrame) -> DataFrame:
    """Distinct non-null tickers under whichever name their column has; a single column counts as one."""
    name = next((c for c in TICKER_NAMES if c in table.columns), None)
    if name is None:
        if len(table.columns) != 1:
            raise ValueError(f"no ticker column among {table.columns}")
        (name,) = table.columns
    ticker = F.trim(F.col(name).cast("string")).alias("ticker")
    return table.select(ticker).where("ticker is not null and ticker <> ''").distinct()


def find_file(spark: SparkSession, name: str, folders: Sequence[str]) -> str | None:
    """The first place where a file of this name is: the name itself where it has a folder or scheme, else each folder in turn."""
    places = [name] if "/" in name else [f"{f.rstrip('/')}/{name}" for f in folders]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for place in places:
        path = hadoop(place)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return place
    return None


def ticker_list_paths(folder: str, choice: str, name: str | None = None) -> list[str]:
    """Where a list of tickers is looked for, in order: the named file here and in the folder, then the files of the choice."""
    # Names of the files.
    own = [name, f"{folder}/{name}"] if name else [f"{folder}/combined_tickers_choice_{choice}.csv"]
    names = [f"combined_info_tickers_clean_{choice}", f"combined_info_tickers_{choice}", "tradingview_universe_bool"]
    return own + [f"{folder}/{n}.csv" for n in names]


def input_folder(settings: dict[str, str], timeframe: str, environment: str, base: str) -> str:
    """The folder of a timeframe's bars: the environment's setting (relative ones below base), else `{base}/data/market_data/{timeframe}`."""
    if timeframe not in INPUT_SETTINGS:
        raise ValueError(f"unknown timeframe {timeframe}")
    path = settings.get(INPUT_SETTINGS[timeframe] + environment, "").strip()
    if not path or path.lower() == "nan":
        return f"{base}/data/market_data/{timeframe}"
    return path if path.startswith("/") or "://" in path else f"{base}/{path}"


def environment_of(override: str | None = None, variables: Mapping[str, str] = os.environ) -> str:
    """local or colab: an override that is one of them, else by a variable that hosted notebooks have."""
    chosen = (override or "").strip().lower()
    return chosen if chosen in ("local", "colab") else "colab" if "COLAB_GPU" in variables else "local"


def read_first(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The first of several CSV files that is there (ticker information falls back that way)."""
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            return spark.read.option("header", True).csv(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of {list(paths)}")


def ticker_info_paths(folder: str, choice: str) -> list[str]:
    """Where ticker information of a choice is looked for, in order."""
    # Names of the files.
    names = [f"combined_info_tickers_clean_{choice}", f"combined_info_tickers_{choice}", "combined_info_tickers_clean_0", "combined_info_tickers_0", "tradingview_universe_bool", "tradingview_universe_info"]
    return [f"{folder}/{n}.csv" for n in names]


def since(bars: DataFrame, as_of: Column, years: int) -> DataFrame:
    """Bars of the last `years` years before as_of (a date); all of them for 0."""
    return bars.where(F.col("d") > F.add_months(as_of, -12 * years)) if years > 0 else bars
