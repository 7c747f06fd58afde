"""Settings of the further screens, and the screens run by name from a settings file."""

import pytest

from recordvol.operators.averages import AtrBands, Guppy
from recordvol.operators.breakouts import Contraction
from recordvol.operators.levels import GreenLines
from recordvol.operators.strength import Rotation
from recordvol.plans import suite
from recordvol.sources import screen_settings as settings
from recordvol.sources.settings import read_settings
from tests.test_averages import bars, walk

FILE = """# comment,x
ATR1_daily_length,30,days
ATR1_weekly_factor,2.5,
GUPPY_SCREENER_short_term_group_daily,"3,5,8",
GUPPY_SCREENER_long_term_group_daily,30+40,
GUPPY_SCREENER_weekly_enable,TRUE,
GUPPY_SCREENER_min_compression_ratio,wrong,
GUPPY_SCREENER_min_volume_avg,50,
ATR2_enable,False,
RTI_period,60,
RTI_zone2_threshold,12.5,
RTI_weekly_enable,yes,
Giusti_rolling_6m,7,
Giusti_top_3m_count,4,
DRWISH_lookback_period,3m;6m,
DRWISH_confirmation_period,1w,
hve_limit_years,3,
"""


@pytest.fixture
def values(tmp_path):
    (tmp_path / "settings.csv").write_text(FILE)
    assert read_settings(str(tmp_path / "settings.csv")).hve_limit_years == 3
    return settings.read_values(str(tmp_path / "settings.csv"))


def test_parameters_by_timeframe_with_defaults_for_what_is_missing_or_wrong(values):
    bands = settings.parameters(values, "atr1", "daily")
    assert bands == AtrBands(length={"daily": 30, "weekly": 4, "monthly": 2}, factor={"daily": 3.0, "weekly": 2.5, "monthly": 3.0})
    assert settings.parameters(values, "guppy", "weekly") == Guppy(short=(3, 5, 8), long=(30, 40)) and settings.parameters(values, "guppy", "monthly") is None
    assert settings.parameters(values, "atr2", "daily") is None and settings.parameters({}, "atr2", "daily") is not None
    assert settings.parameters(values, "contraction", "daily") == Contraction(period=60, zones=(5.0, 12.5, 15.0))
    assert settings.parameters(values, "contraction", "weekly") == Contraction(period=12, short=2, zones=(5.0, 12.5, 15.0), quiet_bars=1, consolidation=1, confirmation=1)
    assert settings.parameters(values, "rotation", "daily") == Rotation(months=(12, 7, 3), keep=(50, 30, 4))
    assert settings.parameter_sets(values, "daily") == [GreenLines(10, "3m", "1y", "1w"), GreenLines(10, "6m", "1y", "1w")]
    assert settings.least(values, "guppy", "daily").min_volume == 50 and settings.least(values, "dots", "daily").min_price == 0
    for screen, timeframe in (("none", "daily"), ("atr1", "hourly")):
        with pytest.raises(ValueError):
            settings.parameters(values, screen, timeframe)
    assert settings.read_values("/nowhere/at/all.csv") == {}


@pytest.mark.parametrize("screen", sorted(settings.KINDS))
def test_every_screen_runs_with_what_its_settings_say(spark, screen):
    on = {f"{settings.KINDS[screen].prefix}_{flag}enable": "true" for flag in ("", "daily_")}
    table = bars(spark, walk(320, 5), "A").unionByName(bars(spark, walk(320, 6), "B")).unionByName(bars(spark, walk(320, 7), "C"))
    groups = spark.createDataFrame([(t, "all") for t in "ABC"], "ticker string, group string")
    rows = suite.run(screen, table, on, "daily", groups)
    assert {"timeframe", "ticker"} <= set(rows.columns) and {r["timeframe"] for r in rows.collect()} <= {"daily"}
    assert suite.run(screen, table, {f"{settings.KINDS[screen].prefix}_enable": "no"}, "daily", groups) is None
    few = {**on, f"{settings.KINDS[screen].prefix}_{settings.KINDS[screen].volume}": "1e9"}
    assert suite.run(screen, table, few, "daily", groups).count() == 0


def test_green_lines_of_several_sets(spark, values):
    table = bars(spark, walk(320, 5), "A")
    rows = suite.run("green_lines", table, values, "daily").collect()
    by = {k: {r["pivot_date"]: r["is_green"] for r in rows if r["set"] == k} for k in ("set1", "set2")}
    assert len(rows) == sum(map(len, by.values())) and set(by["set1"]) == set(by["set2"])
    assert all(by["set1"][d] or not g for d, g in by["set2"].items())  # what holds for six months has held for three
