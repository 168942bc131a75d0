"""Days, periods and relative dates (inventory F1-F3)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_start(moment: Column) -> Column:
    """First second of the session time zone's day, as epoch seconds."""
    return F.unix_timestamp(F.to_timestamp(F.to_date(moment)))


def day_end(moment: Column) -> Column:
    return F.unix_timestamp(F.to_timestamp(F.date_add(F.to_date(moment), 1))) - 1


def period(year: int, month: int = 0, day: int = 0) -> tuple[date, date]:
    """First and last day of a year, month or day; a month or day out of range means the longer period."""
    if not 1 <= month <= 12:
        return date(year, 1, 1), date(year, 12, 31)
    first = date(year, month, 1)
    last = (date(year + month // 12, month % 12 + 1, 1)) - timedelta(1)
    if not 1 <= day <= last.day:
        return first, last
    return date(year, month, day), date(year, month, day)


def relative(day: Column, years: int = 0, months: int = 0, weeks: int = 0, days: int = 0) -> Column:
    """Years, then months, then weeks of seven days, then days."""
    return F.date_add(F.add_months(F.add_months(day, 12 * years), months), 7 * weeks + days)
