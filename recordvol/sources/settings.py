"""Settings from a key/value CSV file, and choices of tickers."""

from __future__ import annotations

import csv
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

log = logging.getLogger(__name__)
#: What counts as true, and files of choices where a settings file names none.
TRUE = ("true", "1", "yes", "on")
DEFAULT_FILES = {
    0: "tradingview_universe.csv",
    5: "indexes_tickers.csv",
    6: "portofolio_tickers.csv",
    7: "etf_tickers.csv",
    8: "test_tickers.csv",
}


@dataclass(frozen=True)
class Settings:
    """The settings a screen depends on, with their defaults."""

    ticker_choice: str = "2"
    batch_size: int = 100
    yf_daily_data: bool = False
    yf_weekly_data: bool = False
    yf_monthly_data: bool = False
    hve_enable: bool = True
    hve_output_dir: str = "results/hve_results"
    hve_limit_years: int = 4
    hve_min_volume: int = 0
    hve_min_price: float = 0.0
    hve_date_range_mode: str = "fixed"
    hve_start_date: str = "2020-01-01"
    hve_end_date: str = "2023-12-31"
    hve_historical_max_events: int = 10
    hve_historical_export: bool = True
    hvd_historical_export: bool = True
    hvd_historical_max_days: int = 10
    hv1y_enable: bool = True
    hv1y_window_days: int = 365

    def timeframes(self) -> tuple[str, ...]:
        return tuple(t for t in ("daily", "weekly", "monthly") if getattr(self, f"yf_{t}_data"))


def as_bool(text: str) -> bool:
    return text.strip().lower() in TRUE


def as_ints(text: str) -> list[int]:
    return [int(x) for x in re.split(r"[+;,]", text) if x.strip()]


@dataclass(frozen=True)
class Period:
    """A span of calendar months, or of days."""

    count: int
    months: bool


def period(text: str) -> Period:
    """A span such as 3m, 1y, 2w or 10d."""
    m = re.fullmatch(r"(\d+)([dwmy])", text.strip().lower())
    if not m:
        raise ValueError(f"{text!r} is not a span such as 3m, 1y, 2w or 10d")
    scale, months = {"d": (1, False), "w": (7, False), "m": (1, True), "y": (12, True)}[m[2]]
    return Period(int(m[1]) * scale, months)


def period_lists(*texts: str) -> list[tuple[str, ...]]:
    """Spans of lists such as `3m;6m`, place by place; a shorter list goes on with its first."""
    lists = [[x.strip() for x in t.split(";") if x.strip()] for t in texts]
    if not all(lists):
        raise ValueError(f"a list of spans is empty: {texts}")
    most = max(map(len, lists))
    return list(zip(*(own + own[:1] * (most - len(own)) for own in lists)))


_PARSERS: dict[str, Callable] = {"bool": as_bool, "int": lambda x: int(float(x)), "float": float, "str": str}


def settings_rows(path: str) -> list[tuple[str, str]]:
    """Keys and values of a file of `variable,value,description` rows, without comments; none where there is no file."""
    try:
        with open(path, newline="", encoding="utf-8") as file:
            rows = [r for r in csv.reader(file) if len(r) >= 2 and not r[0].lstrip().startswith("#")]
    except OSError as e:
        log.warning("settings %s: %s; defaults are used", path, e)
        return []
    return [(key.strip(), value.strip()) for key, value, *_ in rows]


def read_settings(path: str) -> Settings:
    """Settings of a file; defaults for all that is missing or wrong."""
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    found = {}
    for key, value in settings_rows(path):
        name = key.lower()
        if name not in kinds or not value:
            continue
        try:
            found[name] = _PARSERS[kinds[name]](value)
        except ValueError:
            log.warning("setting %s has the wrong value %r; the default is used", key, value)
    if "ticker_choice" in found and not _is_choice(found["ticker_choice"]):
        log.warning("ticker_choice %r is no choice; 2 is used", found["ticker_choice"])
        found["ticker_choice"] = "2"
    return replace(Settings(), **found)


def _is_choice(text: str) -> bool:
    return all(x.strip().isdigit() and int(x) <= 8 for x in text.split("-"))


def parse_choice(text: str | int) -> list[int]:
    """Choices of `0`, `3` or `1-2`; anything else is an error."""
    parts = [x.strip() for x in str(text).split("-")]
    if not all(x.isdigit() for x in parts):
        raise ValueError(f"{text!r} is not a choice such as 0, 3 or 1-2")
    return [0] if parts == ["0"] else [int(x) for x in parts]


def choice_files(path: str) -> dict[int, str]:
    """File names of choices, written as `# N: text,file name,...` in a settings file's comments."""
    with open(path, newline="", encoding="utf-8") as file:
        found = {int(m[1]): r[1].strip() for r in csv.reader(file) if len(r) > 1 and (m := re.match(r"#\s*(\d+):", r[0].strip())) and r[1].strip()}
    return found or dict(DEFAULT_FILES)


def output_name(kind: str, choice: str, stamp: str) -> str:
    """A timestamped file name that is safe for any choice."""
    return f"{kind}_{re.sub(r'[^A-Za-z0-9]+', '_', str(choice))}_{stamp}"
