"""Text forms of report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def volume_text(volume: Column) -> Column:
    """Whole number with thousands separators, N/A for null."""
    return F.coalesce(F.format_number(F.floor(volume), 0), F.lit("N/A"))


def date_text(d: Column) -> Column:
    return F.coalesce(F.date_format(d, "yyyy-MM-dd"), F.lit("N/A"))


def days_ago_text(d: Column, latest: Column) -> Column:
    """`(n days ago)`, empty where a date is missing."""
    return F.coalesce(F.concat(F.lit("("), F.datediff(latest, d).cast("string"), F.lit(" days ago)")), F.lit(""))


def event_line(place: Column, d: Column, volume: Column, latest: Column) -> Column:
    return F.concat(F.lit("  "), place.cast("string"), F.lit(". "), date_text(d), F.lit("  Volume: "), volume_text(volume), F.lit("  "), days_ago_text(d, latest))


def intraday_change(open_: Column, close: Column) -> Column:
    """Move from open to close in percent, null where the open is missing or not positive."""
    return F.when(open_ > 0, (close - open_) / open_ * 100)
