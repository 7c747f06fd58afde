"""The full screen: bars to results, and from results to all reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordvol.operators import exports, scoring
from recordvol.operators.quality import valid_bars
from recordvol.operators.records import Screen, summary
from recordvol.sources.bars import csv_rows, with_files
from recordvol.sources.settings import Settings, output_name


def screen_of(settings: Settings, as_of: str | None) -> Screen:
    return Screen(
        as_of=as_of,
        limit_years=settings.hve_limit_years,
        min_price=settings.hve_min_price,
        min_volume=settings.hve_min_volume,
        range_mode=settings.hve_date_range_mode,
        start=settings.hve_start_date,
        end=settings.hve_end_date,
        trailing=settings.hv1y_enable,
        window_days=settings.hv1y_window_days,
    )


def run(bars: DataFrame, selection: DataFrame, settings: Settings, as_of: str | None = None) -> DataFrame:
    """Results of the selected tickers in the enabled timeframes; one plan over all of them, one exchange on the series."""
    chosen = bars.where(F.col("timeframe").isin(list(settings.timeframes()))).join(selection.select("ticker").distinct(), "ticker", "left_semi")
    return summary(valid_bars(chosen), screen_of(settings, as_of))


def bars_of(spark: SparkSession, folders: Mapping[str, str], tickers: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Bars of all timeframes (timeframe: folder of CSV files), each folder read once, as of `with_files`."""
    return reduce(DataFrame.unionByName, (with_files(csv_rows(spark, folder, tickers), t, partitions) for t, folder in folders.items()))


def write_reports(results: DataFrame, settings: Settings, folder: str, generated: str, stamp: str | None = None) -> None:
    """Result files, cards and, where they are enabled, both wide tables. The results are read from what was written.

    With a stamp (such as 20240131_180000) the scored sheet of all timeframes is written under a name of its own.
    """
    path = f"{folder}/results"
    results.write.partitionBy("timeframe").parquet(path)
    stored = results.sparkSession.read.schema(results.schema).parquet(path)
    exports.write_results(stored, f"{folder}/csv")
    exports.write_cards(stored, f"{folder}/ticker_cards", generated)
    if settings.hve_historical_export:
        exports.write_wide(exports.hve_wide(stored, settings.hve_historical_max_events), f"{folder}/hve_historical")
    if settings.hvd_historical_export:
        exports.write_wide(exports.hvd_wide(stored, settings.hvd_historical_max_days), f"{folder}/hvd_historical")
    if stamp:
        sheet = scoring.summary_sheet(scoring.scored(scoring.from_screen(stored)))
        scoring.all_combined(sheet).write.option("header", True).csv(f"{folder}/{output_name('hve_report', settings.ticker_choice, stamp)}")
