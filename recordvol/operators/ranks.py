"""Ranks inside moving frames of a series.

How many of a frame's values are at most the current one is no built-in window function. Rows of a
series arrive in order of date, as the windows before left them; a task slides over them in blocks of
BLOCK bars with the frame's last bars carried over, so neither a series nor a list a bar is held.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordvol.operators.averages import TICK, priced, recursive_means, simple_mean, ticks, true_range
from recordvol.operators.records import series
from recordvol.schema import KEYS

BLOCK = 4096


def frame_ranks(values: np.ndarray, before: np.ndarray, frame: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of the last `frame` values (the current included) are at most the current, and how many there are."""
    every = np.concatenate([np.full(frame - 1 - len(before), np.inf), before, values])
    windows = np.lib.stride_tricks.sliding_window_view(every, frame)
    size = np.minimum(np.arange(len(values)) + len(before) + 1, frame)
    return (windows <= values[:, None]).sum(axis=1), size


def rolling_rank(rows: DataFrame, column: str, frames: Mapping[str, int]) -> DataFrame:
    """Adds `rank`, how many of a bar's frame (bars by timeframe) are at most its own value, and `frame`, its bars.

    Rows must have a value, and their timeframe a frame.
    """
    # A window over the series lays its bars out in one task, in order; that order is used here.
    ordered = rows.withColumn("_n", F.row_number().over(series())).sortWithinPartitions(*KEYS, "d")
    columns = ordered.columns
    at = [columns.index(c) for c in (*KEYS, column)]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before = None, np.zeros(0)
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                timeframe, ticker = (batch.column(j).to_pylist() for j in at[:2])
                keys, values = list(zip(timeframe, ticker)), batch.column(at[2]).to_numpy(zero_copy_only=False).astype(float)
                starts = [0, *(j for j in range(1, len(keys)) if keys[j] != keys[j - 1]), len(keys)]
                rank, size = [], []
                for lo, hi in zip(starts, starts[1:]):
                    if keys[lo] != key:
                        key, before = keys[lo], np.zeros(0)
                    n = frames[key[0]]
                    r, s = frame_ranks(values[lo:hi], before, n)
                    rank.append(r)
                    size.append(s)
                    before = np.concatenate([before, values[lo:hi]])[-(n - 1) :] if n > 1 else before
                out = [pa.array(np.concatenate(x).astype(np.int64)) for x in (rank, size)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*columns, "rank", "frame"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("rank", T.LongType()), T.StructField("frame", T.LongType())])
    return ordered.mapInArrow(ranked, schema).drop("_n")


@dataclass(frozen=True)
class AtrPercentile:
    """Bars by timeframe and what counts as volatile, calm, extended and near. Defaults are fixed values."""

    atr: Mapping[str, int] = None
    mean: Mapping[str, int] = None
    frame: Mapping[str, int] = None
    high: float = 0.8
    low: float = 0.2
    extended: float = 2.0
    optimal: float = 1.0

    def bars(self, which: str) -> dict[str, int]:
        fixed = {"atr": {"daily": 14, "weekly": 14, "monthly": 14}, "mean": {"daily": 50, "weekly": 10, "monthly": 4}, "frame": {"daily": 100, "weekly": 20, "monthly": 6}}
        return dict(getattr(self, which) or fixed[which])


def atr_percentile(bars: DataFrame, p: AtrPercentile = AtrPercentile()) -> DataFrame:
    """Where a bar's average true range ranks among the last ones, and how far its close is from the mean close.

    percentile is the share of the frame's ranges that are at most the bar's own; volatility is `high`, `low`
    or `normal` by it. distance is (close - mean close) in ranges; reach is `extended` from p.extended
    up, `optimal` within p.optimal, else `between`; both are null where the range is 0.
    """
    frames = p.bars("frame")
    rows = priced(bars).where(F.col("timeframe").isin(list(frames))).withColumn("true_range", true_range())
    rows = recursive_means(rows, {"atr": ("true_range", {t: 1 / n for t, n in p.bars("atr").items()})})
    mean = F.lit(None).cast("double")
    for timeframe, n in p.bars("mean").items():
        mean = F.when(F.col("timeframe") == timeframe, simple_mean("close", n)).otherwise(mean)
    rows = rows.withColumns({"atr": ticks(F.col("atr")), "mean": ticks(mean)})
    rows = rolling_rank(rows, "atr", frames)
    distance = F.when(F.col("atr") > 0, (ticks(F.col("close")) - F.col("mean")) / F.col("atr"))
    rows = rows.withColumns({"percentile": F.col("rank") / F.col("frame"), "distance": distance})
    volatility = F.when(F.col("percentile") >= p.high, "high").when(F.col("percentile") <= p.low, "low").otherwise("normal")
    reach = F.when(F.col("distance") >= p.extended, "extended").when(F.abs("distance") <= p.optimal, "optimal").when(F.col("distance").isNotNull(), "between")
    return rows.withColumns({"volatility": volatility, "reach": reach, "atr": F.col("atr") / TICK, "mean": F.col("mean") / TICK})
