"""Values over wide moving frames of a series.

A window function visits all rows of a bar's moving frame. Here it visits PIECE of them, and a wider
frame is put together of such pieces, which bars further back have. Sums add disjoint pieces, so
nothing is taken off again: a frame after a NaN, or of small values after large ones, has its own sum.

A window expression that is used twice is computed twice, so each is a column first.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordvol.operators.records import series

PIECE = 10


def moving(rows: DataFrame, values: Mapping[str, tuple[str, str, int]], before: int = 0, piece: int = PIECE) -> DataFrame:
    """Adds values of frames that end `before` bars before a bar: name -> (sum, max or min; column; bars)."""
    narrow, lags, wide = {}, {}, {}
    for name, (how, column, bars) in values.items():
        cuts = [(piece, i) for i in range(0, bars - piece + 1, piece)]
        if rest := bars % piece:
            # The last piece of a maximum may reach into the one before.
            cuts.append((piece, bars - piece) if how != "sum" and cuts else (rest, bars - rest))
        pieces = []
        for length, back in cuts:
            part = f"_{how}_{length}_{column}"
            narrow[part] = getattr(F, how)(column).over(series().rowsBetween(1 - length, 0))
            if back + before:
                lags[f"{part}_{back}"] = F.lag(part, back + before).over(series())
            pieces.append(F.col(f"{part}_{back}" if back + before else part))
        wide[name] = _together(how, pieces)
    return rows.withColumns(narrow).withColumns(lags).withColumns(wide).drop(*narrow, *lags)


def _together(how: str, pieces: list[Column]) -> Column:
    if len(pieces) == 1:
        return pieces[0]
    if how != "sum":
        return (F.greatest if how == "max" else F.least)(*pieces)
    total = F.coalesce(pieces[0], F.lit(0))
    for p in pieces[1:]:
        total = total + F.coalesce(p, F.lit(0))
    return F.when(F.coalesce(*pieces).isNotNull(), total)


def size(bars: int, before: int = 0) -> Column:
    """Bars of a moving frame, fewer at a series' start."""
    return F.least(F.lit(bars), F.row_number().over(series()) - before)
