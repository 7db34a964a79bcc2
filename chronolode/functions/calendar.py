"""Calendar parts of a timestamp and their cyclical encoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_calendar(df: DataFrame, ts: str, hour: str = "hour", dow: str = "dow", month: str = "month") -> DataFrame:
    """Add hour 0-23, day of week with Monday = 0, and month 1-12."""
    return df.withColumns({hour: F.hour(ts), dow: F.weekday(ts), month: F.month(ts)})


PERIODS = ("year", "month", "day", "hour")


def period_start(ts: Column, unit: str) -> Column:
    """First instant of the calendar period of a zone-free timestamp. Built from
    its parts, so the zone of the session has no say in it."""
    if unit not in PERIODS:
        raise ValueError(f"unknown unit {unit!r}, one of {PERIODS}")
    parts = [F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts)]
    kept = PERIODS.index(unit) + 1
    rest = [F.lit(1), F.lit(1), F.lit(1), F.lit(0)]
    return F.make_timestamp_ntz(*parts[:kept], *rest[kept:], F.lit(0), F.lit(0))


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a value on a circle of the given period."""
    angle = 2 * F.pi() * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def add_cyclical(df: DataFrame, periods: Mapping[str, float]) -> DataFrame:
    """Add ``<col>_sin`` and ``<col>_cos`` for each column and its period."""
    added = {}
    for name, period in periods.items():
        added[f"{name}_sin"], added[f"{name}_cos"] = cyclical(F.col(name), period)
    return df.withColumns(added)
