"""Date, time and period expressions (session time zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TIMESTAMP_FRACTION = "y-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"
DAY_MONTH_YEAR = "d/M/y"
DAY_MONTH_YEAR_MINUTE = "d/M/y H:m"
HOUR_MINUTE_SECOND = "H:m:s"

# Period of day -> first and last hour.
PERIODS = {"MADRUGADA": (0, 5), "MANHA": (6, 11), "TARDE": (12, 17), "NOITE": (18, 23)}


def parse_date(c: Column, fmt: str) -> Column:
    """Timestamp, or null where the trimmed text does not fit."""
    return F.try_to_timestamp(F.trim(c), F.lit(fmt))


def hour_minute(c: Column) -> tuple[Column, Column]:
    parsed = parse_date(c, HOUR_MINUTE_SECOND)
    return F.hour(parsed), F.minute(parsed)


def period_of_day(hour: Column) -> dict[str, Column]:
    """Four exclusive 0/1 flags; a null hour gives null flags."""
    return {name: hour.between(lo, hi).cast("int") for name, (lo, hi) in PERIODS.items()}


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def month_index(date: Column) -> Column:
    """Months since year 0; differences are whole months."""
    return F.year(date) * 12 + F.month(date)
