"""Settings of the further screens: which are on, for which timeframes, and what they are run with."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from recordvol.operators.averages import AtrBands, Guppy
from recordvol.operators.breakouts import Contraction, PriceVolume
from recordvol.operators.flows import Divergence, VolumeSuite
from recordvol.operators.launch import LaunchPad, Movers
from recordvol.operators.leaders import Leaders
from recordvol.operators.levels import Dots, GreenLines
from recordvol.operators.ranks import AtrPercentile
from recordvol.operators.records import Screen
from recordvol.operators.strength import Rotation, Strength
from recordvol.schema import TIMEFRAMES
from recordvol.sources.settings import as_bool, as_ints, log, settings_rows

#: Bars of weekly and monthly series for one of daily series (fixed values).
SCALE = {"daily": 1.0, "weekly": 0.2, "monthly": 0.05}

_whole = lambda x: int(float(x))
_ints = lambda x: tuple(as_ints(x))


@dataclass(frozen=True)
class Kind:
    """How a screen's settings become its parameters: field -> (key, parser); `{t}` in a key stands for the timeframe.

    A field that has such a key is a value by timeframe; `more` has places of tuples.
    """

    defaults: object
    prefix: str
    keys: Mapping[str, tuple[str, Callable]]
    off: tuple[str, ...] = ()
    scaled: bool = False
    volume: str = "min_volume"
    price: str = "min_price"
    more: Mapping[str, tuple[str, Callable]] = field(default_factory=dict)


#: The screens' names, their keys in a settings file, and the timeframes that are off by default.
KINDS = {
    "atr1": Kind(AtrBands(), "atr1", {"length": ("atr1_{t}_length", _whole), "factor": ("atr1_{t}_factor", float), "length2": ("atr1_{t}_length2", _whole), "factor2": ("atr1_{t}_factor2", float)}),
    "atr2": Kind(AtrPercentile(), "atr2", {"atr": ("atr2_{t}_atr_period", _whole), "mean": ("atr2_{t}_sma_period", _whole), "frame": ("atr2_{t}_percentile_period", _whole)}),
    "guppy": Kind(
        Guppy(),
        "guppy_screener",
        {
            "kind": ("guppy_screener_ma_type", str), "short": ("guppy_screener_short_term_group_daily", _ints), "long": ("guppy_screener_long_term_group_daily", _ints), "compression": ("guppy_screener_min_compression_ratio", float),
            "expansion": ("guppy_screener_min_expansion_ratio", float), "confirmation": ("guppy_screener_crossover_confirmation_days", _whole), "volume_ratio": ("guppy_screener_volume_confirmation_threshold", float),
            "least_bars": ("guppy_screener_min_data_length", _whole),
        },
        off=("weekly", "monthly"), volume="min_volume_avg",
    ),
    "price_volume": Kind(
        PriceVolume(),
        "pvb_twmodel",
        {
            "price": ("pvb_twmodel_{t}_price_breakout_period", _whole), "volume": ("pvb_twmodel_{t}_volume_breakout_period", _whole), "trend": ("pvb_twmodel_{t}_trendline_length", _whole),
            "threshold": ("pvb_twmodel_{t}_close_threshold", _whole), "max_age": ("pvb_twmodel_{t}_signal_max_age", _whole), "direction": ("pvb_twmodel_order_direction", str),
        },
    ),
    "green_lines": Kind(
        GreenLines(), "drwish", {"strength": ("drwish_pivot_strength", _whole), "lookback": ("drwish_lookback_period", str), "history": ("drwish_calculate_historical_glb", str), "confirmation": ("drwish_confirmation_period", str)}
    ),
    "dots": Kind(
        Dots(),
        "drwish",
        {
            "blue_bars": ("drwish_blue_dot_stoch_period", _whole), "blue_threshold": ("drwish_blue_dot_stoch_threshold", float), "blue_mean": ("drwish_blue_dot_sma_period", _whole), "black_bars": ("drwish_black_dot_stoch_period", _whole),
            "black_threshold": ("drwish_black_dot_stoch_threshold", float), "black_lookback": ("drwish_black_dot_lookback", _whole), "black_mean": ("drwish_black_dot_sma_period", _whole), "black_ema": ("drwish_black_dot_ema_period", _whole),
        },
    ),
    "strength": Kind(
        Strength(),
        "qullamaggie_suite",
        {
            "top": ("qullamaggie_suite_rs_threshold", float), "atr_rating": ("qullamaggie_suite_atr_rs_threshold", float), "range_position": ("qullamaggie_suite_range_position_threshold", float),
            "warning": ("qullamaggie_suite_extension_warning", float), "danger": ("qullamaggie_suite_extension_danger", float), "leader": ("minervini_rs_min_rating", float),
        },
    ),
    "rotation": Kind(
        Rotation(),
        "giusti",
        {"history": ("giusti_min_history_months", _whole), "min_price": ("giusti_min_price", float), "min_volume": ("giusti_min_volume", float)},
        more={f"{name}:{i}": (f"giusti_{key.format(n)}", _whole) for name, key in (("months", "rolling_{}m"), ("keep", "top_{}m_count")) for i, n in enumerate((12, 6, 3))},
    ),
    "contraction": Kind(
        Contraction(),
        "rti",
        {
            "period": ("rti_period", _whole), "short": ("rti_short_period", _whole), "low": ("rti_low_volatility_threshold", float), "expansion": ("rti_expansion_multiplier", float), "quiet_bars": ("rti_consecutive_low_vol_bars", _whole),
            "consolidation": ("rti_min_consolidation_period", _whole), "confirmation": ("rti_breakout_confirmation_period", _whole),
        },
        off=("weekly", "monthly"), scaled=True, more={f"zones:{i}": (f"rti_zone{i + 1}_threshold", float) for i in range(3)},
    ),
    "volume_suite": Kind(
        VolumeSuite(),
        "volume_suite",
        {
            "months": ("volume_suite_hv_month_cutoff", _whole), "recent": ("volume_suite_hv_day_cutoff", _whole), "deviations": ("volume_suite_stdv_cutoff", float), "vroc_threshold": ("volume_suite_vroc_threshold", float),
            "rvol_threshold": ("volume_suite_rvol_threshold", float), "rvol_extreme": ("volume_suite_rvol_extreme_threshold", float), "overbought": ("volume_suite_mfi_overbought", float), "oversold": ("volume_suite_mfi_oversold", float),
            "vpt_threshold": ("volume_suite_vpt_threshold", float),
        },
        scaled=True, volume="hv_min_volume", price="hv_min_price",
    ),
    "divergence": Kind(
        Divergence(),
        "adl_screener",
        {
            "most_bars": ("adl_screener_divergence_period", _whole), "least": ("adl_screener_mom_min_threshold_pct", float), "most": ("adl_screener_mom_max_threshold_pct", float), "consecutive": ("adl_screener_mom_consecutive_months", _whole),
            "lookback": ("adl_screener_mom_lookback_months", _whole), "consistency": ("adl_screener_mom_min_consistency_score", float),
        },
        off=("daily", "weekly", "monthly"), volume="min_volume_avg",
    ),
    "launch_pads": Kind(
        LaunchPad(),
        "gold_launch_pad",
        {
            "periods": ("gold_launch_pad_ma_periods", _ints), "kind": ("gold_launch_pad_ma_type", str), "window": ("gold_launch_pad_zscore_window", _whole), "spread": ("gold_launch_pad_max_spread_threshold", float),
            "slope_share": ("gold_launch_pad_slope_lookback_pct", float), "least_slope": ("gold_launch_pad_min_slope_threshold", float), "near": ("gold_launch_pad_price_proximity_stdv", float), "near_window": ("gold_launch_pad_proximity_window", _whole),
        },
    ),
    "movers": Kind(
        Movers(),
        "stockbee_suite",
        {
            "volume": ("stockbee_suite_9m_volume_threshold", float), "volume_ratio": ("stockbee_suite_9m_rel_vol_threshold", float), "week_gain": ("stockbee_suite_weekly_gain_threshold", float), "week_ratio": ("stockbee_suite_weekly_rel_vol_threshold", float),
            "week_volume": ("stockbee_suite_weekly_min_avg_volume", float), "day_gain": ("stockbee_suite_daily_gain_threshold", float), "day_ratio": ("stockbee_suite_daily_rel_vol_threshold", float), "day_volume": ("stockbee_suite_daily_min_volume", float),
        },
        off=("weekly", "monthly"), scaled=True,
    ),
    "leaders": Kind(
        Leaders(), "stockbee_suite", {"top_percent": ("stockbee_suite_industry_top_pct", float), "top_series": ("stockbee_suite_industry_top_stocks", _whole), "least_series": ("stockbee_suite_industry_min_size", _whole)}, off=("weekly", "monthly")
    ),
}


def read_values(path: str) -> dict[str, str]:
    """All keys (in lower case) and values of a settings file; none where there is no file."""
    return {key.lower(): value for key, value in settings_rows(path)}


def enabled(values: Mapping[str, str], screen: str, timeframe: str) -> bool:
    """Whether a screen is on for a timeframe: its own flag, then that of the timeframe."""
    kind = _kind(screen, timeframe)
    own = values.get(f"{kind.prefix}_enable", "true")
    return as_bool(own) and as_bool(values.get(f"{kind.prefix}_{timeframe}_enable", str(timeframe not in kind.off)))


def parameters(values: Mapping[str, str], screen: str, timeframe: str):
    """What a screen is run with for a timeframe, or None where it is off; wrong values give way to defaults."""
    if not enabled(values, screen, timeframe):
        return None
    kind, found = KINDS[screen], {}
    for name, (key, parse) in kind.keys.items():
        default = getattr(kind.defaults, name)
        if "{t}" in key:
            every = {t: _parsed(values, key.format(t=t), parse) for t in TIMEFRAMES}
            if any(v is not None for v in every.values()):
                whole = kind.defaults.bars(name) if hasattr(kind.defaults, "bars") else kind.defaults.lengths(name) if name.startswith("length") else dict.fromkeys(TIMEFRAMES, default)
                found[name] = {t: whole[t] if v is None else v for t, v in every.items()}
        elif (v := _parsed(values, key, parse)) is not None:
            found[name] = v
    for place, (key, parse) in kind.more.items():
        name, i = place.split(":")
        if (v := _parsed(values, key, parse)) is not None:
            old = found.get(name, getattr(kind.defaults, name))
            found[name] = (*old[: int(i)], v, *old[int(i) + 1 :])
    out = replace(kind.defaults, **found)
    return out.scaled(SCALE[timeframe]) if kind.scaled and timeframe != "daily" else out


def parameter_sets(values: Mapping[str, str], timeframe: str) -> list[GreenLines]:
    """One for each place of the green lines' lists of spans, such as `3m;6m`."""
    one = parameters(values, "green_lines", timeframe)
    return [] if one is None else GreenLines.sets(one.lookback, one.history, one.confirmation, one.strength)


def least(values: Mapping[str, str], screen: str, timeframe: str) -> Screen:
    """The least price and volume a series' last bar must have."""
    prefix = _kind(screen, timeframe).prefix
    price, volume = (_parsed(values, f"{prefix}_{name}", float) or 0.0 for name in (KINDS[screen].price, KINDS[screen].volume))
    return Screen(min_price=price, min_volume=volume)


def _kind(screen: str, timeframe: str) -> Kind:
    if screen not in KINDS:
        raise ValueError(f"{screen!r} is no screen; there are {', '.join(KINDS)}")
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"{timeframe!r} is no timeframe of screens")
    return KINDS[screen]


def _parsed(values: Mapping[str, str], key: str, parse: Callable):
    text = values.get(key, "")
    if not text:
        return None
    try:
        return parse(text)
    except ValueError:
        log.warning("setting %s has the wrong value %r; the default is used", key, text)
        return None
