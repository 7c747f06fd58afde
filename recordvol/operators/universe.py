"""The ticker universe: cleaning, membership flags, selections and their union."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Indexes of each choice; 0 is everything.
CHOICES: dict[int, tuple[str, ...]] = {
    0: (),
    1: ("SP500",),
    2: ("NASDAQ100",),
    3: ("NASDAQComposite",),
    4: ("Russell1000",),
    5: ("SP500", "NASDAQ100"),
    6: ("SP500", "NASDAQComposite"),
    7: ("SP500", "Russell1000"),
    8: ("NASDAQ100", "NASDAQComposite"),
    9: ("NASDAQ100", "Russell1000"),
    10: ("NASDAQComposite", "Russell1000"),
    11: ("SP500", "NASDAQ100", "NASDAQComposite"),
    12: ("SP500", "NASDAQ100", "Russell1000"),
    13: ("SP500", "NASDAQComposite", "Russell1000"),
    14: ("NASDAQ100", "NASDAQComposite", "Russell1000"),
    15: ("SP500", "NASDAQ100", "Russell1000", "NASDAQComposite"),
}
#: Choices that stand for a file of tickers rather than for indexes.
FILE_CHOICES = (5, 6, 7, 8)


def clean_symbol(symbol: Column) -> Column:
    """Trimmed, with `-` for `.`; null for symbols with a slash."""
    s = F.trim(symbol)
    return F.when(~F.contains(s, F.lit("/")), F.translate(s, ".", "-"))


def standard_names(raw: DataFrame) -> DataFrame:
    """Symbol becomes ticker, names are lower-cased, market capitalisation gets its short names."""
    short = {"market capitalization": "market_cap", "market capitalization - currency": "market_cap_currency"}
    names = ["ticker" if c.lower() == "symbol" else short.get(c.lower(), c.lower()) for c in raw.columns]
    return raw.toDF(*names)


def cleaned(universe: DataFrame) -> DataFrame:
    return universe.withColumn("ticker", clean_symbol(F.col("ticker"))).where("ticker is not null")


def index_names(text: Column) -> Column:
    """Names of a comma-joined list, each without blanks and `& - . / ( )`."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.translate(x, " &-./()", ""))


def with_indexes(universe: DataFrame) -> DataFrame:
    """Adds `indexes`, an array (empty where there is no list)."""
    return universe.withColumn("indexes", F.coalesce(index_names(F.col("index")), F.array().cast("array<string>")))


def one_hot(universe: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """A boolean column per index; without `names` a first pass finds them."""
    table = with_indexes(universe)
    if names is None:
        names = [r[0] for r in table.select(F.explode("indexes").alias("i")).distinct().orderBy("i").collect()]  # one per index
    return table.withColumns({n: F.array_contains("indexes", n) for n in names}).drop("indexes")


def category_flags(universe: DataFrame, column: str, prefix: str, values: Sequence[str] | None = None) -> DataFrame:
    """A boolean column per value of a category; blanks and dashes of ratings become underscores in names."""
    if values is None:
        values = [r[0] for r in universe.select(column).where(F.col(column) != "").distinct().orderBy(column).collect()]  # one per category
    name = lambda v: prefix + (v.replace(" ", "_").replace("-", "_") if prefix == "rating_" else v)
    return universe.withColumns({name(v): F.coalesce(F.col(column) == v, F.lit(False)) for v in values})


def index_counts(universe: DataFrame, most: int | None = None) -> DataFrame:
    """index_name and members, most first."""
    counts = with_indexes(universe).select(F.explode("indexes").alias("index_name")).groupBy("index_name").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "index_name")
    return counts if most is None else counts.limit(most)


def category_counts(universe: DataFrame, column: str) -> DataFrame:
    return universe.where(F.col(column) != "").groupBy(column).agg(F.count("*").alias("members"))


def members(universe: DataFrame, choice: int) -> DataFrame:
    """Rows in any index of the choice (0: all)."""
    if choice not in CHOICES:
        raise ValueError(f"unknown choice {choice}")
    wanted = CHOICES[choice]
    table = with_indexes(universe)
    return (table.where(F.arrays_overlap("indexes", F.lit(list(wanted)))) if wanted else table).drop("indexes")


def union_selections(*selections: DataFrame) -> DataFrame:
    """Rows of all selections, the first of each ticker, in the order of selections and of `place` in each.

    Each selection has ticker and place; other columns may differ.
    """
    tagged = [s.withColumn("_selection", F.lit(i)) for i, s in enumerate(selections)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    first = Window.partitionBy("ticker").orderBy("_selection", "place")
    out = out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return out.withColumnRenamed("_selection", "selection").orderBy("selection", "place")


def enriched(selection: DataFrame, universe: DataFrame, flags: Sequence[str], key: str = "ticker", place: str | None = None) -> DataFrame:
    """Selection rows with their universe row; without one flags are false and texts null.

    The first universe row of a ticker counts: that of the smallest `place`, a column of universe that
    is not carried over, or in the order of its columns where none is named. Columns of the selection
    stay, so its own ordinal restores its order.
    """
    columns = [c for c in universe.columns if c not in (key, place)]
    first = F.min_by(F.struct(*columns), place) if place else F.min(F.struct(*columns))
    once = universe.groupBy(key).agg(first.alias("_row")).select(key, "_row.*")
    return selection.join(once, key, "left").withColumns({f: F.coalesce(f, F.lit(False)) for f in flags})


def from_file(tickers: DataFrame, universe: DataFrame, flags: Sequence[str]) -> DataFrame:
    """A selection that is a file of tickers (place, ticker): each ticker once, at its first place, with its universe row."""
    listed = tickers.where("ticker is not null").groupBy("ticker").agg(F.min("place").alias("ordinal"))
    return enriched(listed, universe, flags, place="place").withColumnRenamed("ordinal", "place")


def chosen(universe: DataFrame, choices: Sequence[int], files: Mapping[int, DataFrame], flags: Sequence[str]) -> DataFrame:
    """The selection of one or several choices: those of FILE_CHOICES from their files, others by indexes; the first of each ticker counts."""
    one = lambda c: from_file(files[c], universe, flags) if c in FILE_CHOICES else members(universe, c)
    return union_selections(*map(one, choices))


def choice_file_names(choices: Sequence[int], files: Mapping[int, str]) -> list[str]:
    """The files of several choices, each once, in their order."""
    if unknown := [c for c in choices if c not in files]:
        raise ValueError(f"no file for choices {unknown}")
    return list(dict.fromkeys(files[c] for c in choices))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A universe file with standard names, clean tickers and each row's place; market capitalisation is a number."""
    raw = standard_names(spark.read.option("header", True).csv(path)).withColumn("place", F.monotonically_increasing_id())
    if "market_cap" in raw.columns:
        raw = raw.withColumn("market_cap", F.col("market_cap").try_cast("double"))
    return cleaned(raw)


def write_universe(universe: DataFrame, path: str) -> None:
    """The universe with a flag for each index, exchange and rating it knows, as CSV."""
    table = one_hot(universe) if "index" in universe.columns else universe
    for column, prefix in (("exchange", "exchange_"), ("analyst rating", "rating_")):
        if column in table.columns:
            table = category_flags(table, column, prefix)
    table.write.option("header", True).csv(path)


def missing(selection: DataFrame, universe: DataFrame) -> DataFrame:
    """Selected tickers the universe does not have."""
    return selection.select("ticker").distinct().join(universe.select("ticker"), "ticker", "left_anti")


def backfilled(info: DataFrame, selection: DataFrame) -> DataFrame:
    """Information plus a bare row for each selected ticker it lacks."""
    return info.unionByName(missing(selection, info), allowMissingColumns=True)


def write_selection(selection: DataFrame, folder: str, choice: str) -> None:
    """The three files of a choice: tickers, information, and the information again as the clean one."""
    one = selection.repartition(1)
    for name, table in ((f"combined_tickers_{choice}", one.select("ticker")), (f"combined_info_tickers_{choice}", one), (f"combined_info_tickers_clean_{choice}", one)):
        table.write.option("header", True).csv(f"{folder}/{name}.csv")
