"""Shapes of bars and results."""

from __future__ import annotations

from pyspark.sql import types as T

#: Bar sizes in the order reports list them.
TIMEFRAMES = ("daily", "weekly", "monthly")
KEYS = ("timeframe", "ticker")

BARS = T.StructType(
    [
        T.StructField("timeframe", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("d", T.DateType()),
        *(T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")),
    ]
)
#: What a bars file holds; the ticker is its name.
CSV = T.StructType([T.StructField(c, T.StringType()) for c in ("Date", "Open", "High", "Low", "Close", "Volume")])

#: Result columns in their contractual order; the middle block is there if trailing records are asked for.
HEAD = ("ticker", "timeframe", "hve_date", "hve_volume", "days_since_hve", "hve_occ_1y", "total_hve_count", "all_hve_details")
TRAILING = (
    "hv1y_date", "hv1y_volume", "days_since_hv1y", "hv1y_occ_1y", "total_hv1y_count", "is_hv1y_also_hve", "hv1y_to_hve_ratio", "all_hv1y_details",
)
TAIL = ("latest_date", "latest_volume", "latest_close", "volume_ratio", "data_points")
EVENTS = "array<struct<d: date, volume: double>>"
