"""Days, windows, schedules and back-off."""

from __future__ import annotations

import datetime as dt
import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the zone whose midnight cuts the inbox's days.
ZONE = "America/Sao_Paulo"


def yesterday_midnight(now: Column, zone: str = ZONE) -> Column:
    """The UTC time of yesterday's midnight in a zone; now is in UTC."""
    local = F.from_utc_timestamp(now, zone)
    return F.to_utc_timestamp(F.date_trunc("day", local) - F.expr("INTERVAL '1' DAY"), zone)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def backoff_seconds(failures: Column, base: float, most: float) -> Column:
    """Doubled with every failure, up to a limit; none without a failure."""
    return F.when(failures > 0, F.least(base * F.pow(F.lit(2.0), failures - 1), F.lit(most))).otherwise(0.0)


def _field(text: str, low: int, high: int) -> frozenset[int]:
    found = set()
    for part in text.split(","):
        span, _, step = part.partition("/")
        a, b = (low, high) if span == "*" else (int(span.split("-")[0]), int(span.split("-")[-1]))
        if step and "-" not in span and span != "*":
            b = high
        found |= set(range(a, b + 1, int(step or 1)))
    return frozenset(x % 7 if (low, high) == (0, 7) else x for x in found)


@functools.cache
def _cron(text: str):
    minute, hour, day, month, weekday = text.split()
    return _field(minute, 0, 59), _field(hour, 0, 23), _field(day, 1, 31), _field(month, 1, 12), _field(weekday, 0, 7), day == "*", weekday == "*"


def next_fire(text: str, after: dt.datetime) -> dt.datetime | None:
    """The first minute after a time that a five-field schedule names; within four years."""
    minutes, hours, days, months, weekdays, any_day, any_weekday = _cron(text)
    day = after.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    for k in range(4 * 366):
        date = (day + dt.timedelta(days=k)).date()
        in_month, in_week = date.day in days, date.isoweekday() % 7 in weekdays
        fits = in_month and in_week if any_day or any_weekday else in_month or in_week
        if date.month in months and fits:
            for h in sorted(hours):
                for m in sorted(minutes):
                    at = dt.datetime.combine(date, dt.time(h, m))
                    if at >= day:
                        return at
    return None


def cadence(text: str, start: dt.datetime = dt.datetime(2024, 1, 1), samples: int = 12) -> float | None:
    """The longest gap between fires, in seconds."""
    fires = [start]
    while len(fires) <= samples and (at := next_fire(text, fires[-1])):
        fires.append(at)
    return max(((b - a).total_seconds() for a, b in zip(fires[1:], fires[2:])), default=None)


@F.pandas_udf(T.TimestampNTZType())
def next_due(schedules: pd.Series, last: pd.Series) -> pd.Series:
    """When a schedule is due again; one that never ran is due since the epoch."""
    epoch = dt.datetime(1970, 1, 1)
    return pd.Series([None if s is None else epoch if pd.isna(x) else next_fire(s, x.to_pydatetime()) for s, x in zip(schedules, last, strict=True)], dtype="datetime64[us]")


@F.pandas_udf(T.DoubleType())
def cadence_seconds(schedules: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else cadence(s) for s in schedules], dtype="float64")
