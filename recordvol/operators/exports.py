"""Wide top-N tables, ticker cards and result files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordvol.functions.text import date_text, event_line
from recordvol.schema import KEYS, TIMEFRAMES

#: Rules of a card. The wording of cards below is fixed as well.
RULE, LINE = "=" * 80, "-" * 40


def wide(events: DataFrame, prefix: str, most: int = 10, column: str = "events") -> DataFrame:
    """Symbol, timeframe and `most` pairs of date text and volume, null past the last event; series without events are left out."""
    slot = lambda i: F.get(F.col(column), F.lit(i - 1))
    cells = [c for i in range(1, most + 1) for c in (F.date_format(slot(i)["d"], "yyyy-MM-dd").alias(f"{prefix}_date_{i}"), slot(i)["volume"].cast("long").alias(f"{prefix}_vol_{i}"))]
    return events.where(F.size(column) > 0).select(F.col("ticker").alias("Symbol"), "timeframe", *cells)


def hve_wide(results: DataFrame, most: int = 10) -> DataFrame:
    """The newest `most` records of each series."""
    return wide(results.select("ticker", "timeframe", F.slice("all_hve_details", 1, most).alias("events")), "HVE", most)


def hvd_wide(results: DataFrame, most: int = 10) -> DataFrame:
    """The largest `most` records of each series by volume, newest first among equals."""
    by_volume = F.sort_array(F.transform("all_hve_details", lambda x: F.struct(x["volume"].alias("volume"), x["d"].alias("d"))), asc=False)
    return wide(results.select("ticker", "timeframe", F.slice(by_volume, 1, most).alias("events")), "HVD", most)


def hvd_wide_all_days(bars: DataFrame, most: int = 10) -> DataFrame:
    """The largest `most` days of each series, records or not; earlier days first among equals."""
    largest = Window.partitionBy(*KEYS).orderBy(F.col("volume").desc(), "d")
    top = bars.where("volume is not null").withColumn("place", F.row_number().over(largest)).where(F.col("place") <= most)
    events = F.transform(F.array_sort(F.collect_list(F.struct("place", "d", "volume"))), lambda x: F.struct(x["d"].alias("d"), x["volume"].alias("volume")))
    return wide(top.groupBy(*KEYS).agg(events.alias("events")), "HVD", most)


def card_lines(results: DataFrame) -> DataFrame:
    """One line of card text per event: ticker, timeframe, section (HVE or HV1Y), place, line."""
    hve = results.select(*KEYS, F.lit("HVE").alias("section"), F.posexplode("all_hve_details").alias("place", "e"), "latest_date", F.lit(None).cast("date").alias("hve_date"))
    hv1y = results.select(*KEYS, F.lit("HV1Y").alias("section"), F.posexplode("all_hv1y_details").alias("place", "e"), "latest_date", "hve_date")
    rows = hve.unionByName(hv1y).withColumn("place", F.col("place") + 1)
    flag = F.when(F.col("e.d") == F.col("hve_date"), "  [Also HVE]").otherwise("")
    return rows.select(*KEYS, "section", "place", F.concat(event_line(F.col("place"), F.col("e.d"), F.col("e.volume"), F.col("latest_date")), flag).alias("line"))


def _section(title: str, events: Column, none: str, latest: Column, also: Column | None = None) -> Column:
    def line(e: Column, i: Column) -> Column:
        text = event_line(i + 1, e["d"], e["volume"], latest)
        return text if also is None else F.concat(text, F.when(e["d"] == also, "  [Also HVE]").otherwise(""))

    lines = F.when(F.size(events) > 0, F.transform(events, line)).otherwise(F.array(F.lit(none)))
    return F.concat(F.array(F.lit(""), F.lit(title), F.lit(LINE)), lines)


def cards(results: DataFrame, generated: str) -> DataFrame:
    """ticker and the text of its card over all its timeframes."""
    order = F.array_position(F.lit(list(TIMEFRAMES)), F.col("timeframe"))
    has_trailing = "all_hv1y_details" in results.columns
    title = F.concat(F.upper("timeframe"), F.lit(" TIMEFRAME"))
    body = [
        F.array(F.lit(""), title, F.repeat(F.lit("="), F.length(title))),
        _section("HVE Events (Highest Volume Ever):", F.col("all_hve_details"), "  No HVE events found", F.col("latest_date")),
    ]
    if has_trailing:
        body.append(_section("HV1Y Events (Highest Volume in 1 Year):", F.col("all_hv1y_details"), "  No HV1Y events found", F.col("latest_date"), F.col("hve_date")))
    rows = results.select("ticker", order.alias("place"), F.concat(*body).alias("lines"), *totals_columns(has_trailing), "days_since_hve", "timeframe")
    per = rows.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct("place", "lines"))).alias("parts"),
        F.sum("hve_events").alias("hve"),
        *([F.sum("hv1y_events").alias("hv1y")] if has_trailing else []),
        F.min(F.when(F.col("days_since_hve").isNotNull(), F.struct("days_since_hve", "place", "timeframe"))).alias("recent"),
    )
    ends = [F.lit(""), F.lit("Summary:"), F.lit(LINE), F.concat(F.lit("Total HVE events across all timeframes: "), F.col("hve").cast("string"))]
    if has_trailing:
        ends.append(F.concat(F.lit("Total HV1Y events across all timeframes: "), F.col("hv1y").cast("string")))
    recent = F.concat(F.lit("Latest volume activity: "), F.initcap("recent.timeframe"), F.lit(" ("), F.col("recent.days_since_hve").cast("string"), F.lit(" days ago)"))
    lines = F.concat(
        F.array(F.lit(RULE), F.concat(F.lit("TICKER CARD: "), F.col("ticker")), F.lit(RULE), F.lit(f"Generated: {generated}"), F.lit("")),
        F.flatten(F.transform("parts", lambda p: p["lines"])),
        F.array(*ends),
        F.filter(F.array(recent), lambda x: x.isNotNull()),
        F.array(F.lit(""), F.lit(RULE)),
    )
    return per.select("ticker", F.array_join(lines, "\n").alias("card"))


def totals_columns(trailing: bool = True) -> list[Column]:
    return [F.size("all_hve_details").alias("hve_events"), *([F.size("all_hv1y_details").alias("hv1y_events")] if trailing else [])]


def cross_timeframe_totals(results: DataFrame) -> DataFrame:
    return results.select("ticker", *totals_columns()).groupBy("ticker").agg(F.sum("hve_events").alias("hve_events"), F.sum("hv1y_events").alias("hv1y_events"))


def latest_activity(results: DataFrame) -> DataFrame:
    """Per ticker the timeframe whose last record is the fewest days old; the shorter one among equals."""
    place = F.array_position(F.lit(list(TIMEFRAMES)), F.col("timeframe"))
    best = F.min(F.struct("days_since_hve", place.alias("place"), "timeframe"))
    rows = results.where("days_since_hve is not null").groupBy("ticker").agg(best.alias("b"))
    return rows.select("ticker", F.col("b.timeframe").alias("timeframe"), F.col("b.days_since_hve").alias("days"))


def most_recent(results: DataFrame, most: int = 10) -> DataFrame:
    """The `most` series with the youngest record (10 in the printed list, 20 in the chart, 50 charts of single series)."""
    return by_recency(results).limit(most)


def by_recency(results: DataFrame) -> DataFrame:
    return results.orderBy("days_since_hve", "ticker")


def flat(results: DataFrame) -> DataFrame:
    """Results for text sinks: event lists as JSON."""
    return results.withColumns({c: F.to_json(c) for c in results.columns if c.endswith("_details")})


def write_results(results: DataFrame, path: str) -> None:
    """One folder of CSV per timeframe, most recent record first."""
    flat(results).repartition("timeframe").sortWithinPartitions("days_since_hve", "ticker").write.partitionBy("timeframe").option("header", True).csv(path)


def write_cards(results: DataFrame, path: str, generated: str) -> None:
    """A folder per ticker with its card as text."""
    cards(results, generated).repartition("ticker").write.partitionBy("ticker").text(path)


def write_wide(table: DataFrame, path: str) -> None:
    table.repartition("timeframe").sortWithinPartitions("Symbol").write.partitionBy("timeframe").option("header", True).option("nullValue", "").csv(path)
