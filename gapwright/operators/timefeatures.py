"""Lags, leads and calendar features of a regular series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.errors import GapTypeError, GapValueError
from gapwright.operators.timegrid import along, micros, with_neighbours


def check_lags(lags: object) -> list[int]:
    if isinstance(lags, (str, bytes)) or not hasattr(lags, "__iter__"):
        raise GapTypeError("lags must be a list of integers")
    found = list(lags)
    if any(isinstance(k, bool) or not isinstance(k, int) for k in found):
        raise GapTypeError("lags must be integers")
    if 0 in found:
        raise GapValueError("a lag of 0 is the value itself")
    return found


def lag_names(columns: list[str], lags: list[int]) -> dict[str, tuple[str, int]]:
    return {f"{c}_lag_{k}": (c, k) for k in lags for c in columns}


def add_lags(df: DataFrame, columns: list[str], lags: list[int], order: str = "__ord") -> DataFrame:
    """Adds {column}_lag_{k}: the value k rows before (after, for a negative k)."""
    names = lag_names(columns, check_lags(lags))
    taken = sorted(set(names) & set(df.columns))
    if taken:
        raise GapValueError(f"columns {taken} are there already")
    if not names:
        return df
    shifted = {name: F.lag(f"`{c}`", k).over(along(order)) for name, (c, k) in names.items()}
    return with_neighbours(df, shifted, max(abs(k) for k in lags), order)


def free_name(name: str, taken: list[str]) -> str:
    """The name, with _1, _2… if others have it."""
    out, n = name, 0
    while out in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def add_calendar(df: DataFrame, time_col: str) -> tuple[DataFrame, list[str]]:
    """Adds trend (0 to 1), and sine and cosine of the time of day and of the week.

    The day's angle counts hours and minutes; the week's counts whole days from
    Monday.  A series of one time has trend 0.
    """
    names: dict[str, str] = {}
    for n in ("__time_trend", "__time_day_sin", "__time_day_cos", "__time_week_sin", "__time_week_cos"):
        names[n] = free_name(n, [*df.columns, *names.values()])
    t = F.col(f"`{time_col}`")
    first, last = df.agg(F.min(micros(t)), F.max(micros(t))).first()
    span = (last or 0) - (first or 0)
    day = 2 * math.pi * (F.hour(t.cast("timestamp")) + F.minute(t.cast("timestamp")) / 60.0) / 24.0
    week = 2 * math.pi * F.weekday(t) / 7.0
    trend = (micros(t) - (first or 0)) / F.lit(float(span)) if span else F.lit(0.0)
    values = (trend, F.sin(day), F.cos(day), F.sin(week), F.cos(week))
    return df.withColumns(dict(zip(names.values(), values, strict=True))), list(names.values())
