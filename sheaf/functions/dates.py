"""Time and date as Column builders; all in UTC (the session's time zone), with microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.arrays import col

MICROS = {
    "day": 86_400_000_000, "half day": 43_200_000_000, "hour": 3_600_000_000, "minute": 60_000_000,
    "second": 1_000_000, "millisecond": 1_000, "microsecond": 1,
}


def micros_in(unit: str) -> int:
    """Microseconds of a unit, singular or plural; nanoseconds have no place in Spark's time."""
    name = unit.lower().removesuffix("s")
    if name not in MICROS:
        raise ValueError(f"not a unit of time: {unit}")
    return MICROS[name]


year = lambda t: F.year(col(t))
month = lambda t: F.month(col(t))
day_of_month = lambda t: F.dayofmonth(col(t))
day_of_week = lambda t: F.weekday(col(t)) + 1
day_of_year = lambda t: F.dayofyear(col(t))
hour = lambda t: F.hour(col(t))
minute = lambda t: F.minute(col(t))
second = lambda t: F.second(col(t))
to_micros = lambda t: F.unix_micros(col(t))
to_millis = lambda t: F.unix_millis(col(t))
to_seconds = lambda t: F.unix_seconds(col(t))
now = F.current_timestamp
today = F.current_date


def add(t, amount, unit: str) -> Column:
    return F.timestamp_micros(F.unix_micros(col(t)) + (col(amount) * F.lit(micros_in(unit)).cast("bigint")).cast("bigint"))


def subtract(t, amount, unit: str) -> Column:
    return add(t, -col(amount), unit)


def difference(t, start, unit: str) -> Column:
    """Whole units from start to t, cut off towards zero."""
    from sheaf.functions.numbers import divide_int

    return divide_int(F.unix_micros(col(t)) - F.unix_micros(col(start)), F.lit(micros_in(unit)))


def epoch(offset, unit: str) -> Column:
    return F.timestamp_micros((col(offset) * F.lit(micros_in(unit)).cast("bigint")).cast("bigint"))


def parse(s) -> Column:
    """ISO 8601; bad input is an error under ANSI."""
    return col(s).cast("timestamp")


def date_parse(s) -> Column:
    return col(s).cast("date")


def _days(unit: str) -> None:
    if unit.lower().removesuffix("s") != "day":
        raise ValueError(f"dates have no unit {unit}")


def date_add(d, amount, unit: str = "days") -> Column:
    _days(unit)
    return F.date_add(col(d), F.round(col(amount)).cast("int"))


def date_subtract(d, amount, unit: str = "days") -> Column:
    _days(unit)
    return F.date_sub(col(d), F.round(col(amount)).cast("int"))


def date_difference(d, start) -> Column:
    return F.datediff(col(d), col(start)).cast("bigint")
