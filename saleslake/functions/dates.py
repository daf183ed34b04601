"""Date and time expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# An open interval ends here; weeks run Sunday (1) to Saturday (7).
END_OF_TIME = date(9999, 12, 31)
WEEKEND_DAYS = (1, 7)


def each_day(start: date, end: date) -> list[date]:
    return [start + timedelta(days=i) for i in range((end - start).days + 1)]


def on_days(column: Column, days: Sequence[date]) -> Column:
    """The date is one of `days`: a range where they have no gap."""
    within = column.between(day(min(days)), day(max(days)))
    gaps = (max(days) - min(days)).days + 1 != len(set(days))
    return within & column.isin([day(d) for d in sorted(set(days))]) if gaps else within


def day(value: date) -> Column:
    return F.lit(value).cast("date")


def valid_on(on: Column, start: Column, end: Column) -> Column:
    """`on` lies in the closed interval `start`..`end`, where a null `end` means still open."""
    return on.between(start, F.coalesce(end, day(END_OF_TIME)))


def overlaps(start: Column, end: Column, first: date, last: date) -> Column:
    """The closed interval `start`..`end` (null = open) has a day in common with `first`..`last`."""
    return (start <= day(last)) & (F.coalesce(end, day(END_OF_TIME)) >= day(first))


def minute_start(instant: Column) -> Column:
    return F.date_trunc("minute", instant)
