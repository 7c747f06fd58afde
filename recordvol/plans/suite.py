"""The further screens by name, as a settings file asks for them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordvol.operators import averages, breakouts, flows, launch, leaders, levels, ranks, records, strength
from recordvol.sources import screen_settings

#: What runs each screen: (bars, parameters) to rows.
RUNS = {
    "atr1": averages.atr_bands,
    "atr2": ranks.atr_percentile,
    "guppy": averages.guppy,
    "price_volume": breakouts.price_volume,
    "dots": levels.dots,
    "strength": strength.strength,
    "rotation": strength.rotation,
    "contraction": breakouts.contraction,
    "volume_suite": flows.volume_suite,
    "divergence": flows.divergences,
    "launch_pads": launch.launch_pads,
    "movers": launch.movers,
}


def run(screen: str, bars: DataFrame, values: Mapping[str, str], timeframe: str, groups: DataFrame | None = None, group: str = "group") -> DataFrame | None:
    """A screen over the series of a timeframe whose last bar has the least price and volume; None where it is off.

    `leaders` needs groups (ticker and the group's column). Green lines have a column `set`, as there
    may be several sets of spans.
    """
    p = screen_settings.parameters(values, screen, timeframe)
    if p is None:
        return None
    rows = records.latest_filter(bars.where(bars["timeframe"] == timeframe), screen_settings.least(values, screen, timeframe))
    if screen == "green_lines":
        sets = screen_settings.parameter_sets(values, timeframe)
        return reduce(DataFrame.unionByName, (levels.green_lines(rows, g).withColumn("set", F.lit(f"set{i}")) for i, g in enumerate(sets, 1)))
    if screen == "leaders":
        if groups is None:
            raise ValueError("leaders need groups")
        return leaders.industry_leaders(rows, groups, group, p)
    return RUNS[screen](rows, p)
