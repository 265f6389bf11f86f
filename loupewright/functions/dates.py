"""Date expressions. No function reads the clock: "now" is always an argument."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Years from this one on are Buddhist-era years.
BUDDHIST_FLOOR = 2564
BUDDHIST_OFFSET = 543


def moment(value: date | datetime | Column) -> Column:
    """A literal for an "as of" argument, without a time zone."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def days_until(as_of: date | Column, due: Column) -> Column:
    """Midnights between ``as_of`` and ``due``; negative when due lies in the past."""
    return F.datediff(due, moment(as_of))


def gregorian(day: Column) -> Column:
    """A date whose Buddhist-era year, if it has one, is taken back to the common era."""
    return F.when(F.year(day) >= BUDDHIST_FLOOR, F.add_months(day, -12 * BUDDHIST_OFFSET)).otherwise(day)


def buddhist_prefix(day: Column) -> Column:
    """Two-digit Buddhist year followed by the month."""
    year = F.right((F.year(day) + BUDDHIST_OFFSET).cast("string"), F.lit(2))
    return F.concat(year, F.date_format(day, "MM"))


def unset_before(day: Column, year: int) -> Column:
    """True for a date that stands for "not set": NULL or before ``year``."""
    return day.isNull() | (day < F.lit(date(year, 1, 1)))


def month_start(year: int, month: int) -> date:
    return date(year, month, 1)


def shift_hours(stamp: Column, hours: int) -> Column:
    return stamp + F.expr(f"INTERVAL '{int(hours)}' HOUR")
