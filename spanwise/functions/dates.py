"""Dates relative to a person's own index date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_after(date: Column, days: int) -> Column:
    return F.date_add(date, days)


def years_before(date: Column, years: int) -> Column:
    return F.add_months(date, -12 * years)


def years_after(date: Column, years: int) -> Column:
    return F.add_months(date, 12 * years)


def as_date(value: str) -> Column:
    return F.lit(value).cast("date")


def within(date: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """Inclusive window as plain comparisons, which a filter hands to the scan; NULL for an unknown date or bound."""
    inside = date.isNotNull()
    if lower is not None:
        inside = inside & (date >= lower)
    if upper is not None:
        inside = inside & (date <= upper)
    return inside


def completed_years(birth: Column, on: Column) -> Column:
    return F.floor(F.months_between(on, birth) / 12).cast("int")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start)


def time_to_event(origin: Column, event: Column, censor: Column, ignore_censoring: bool = False) -> Column:
    """Days from origin to the earlier of event and censoring, skipping whichever is unknown."""
    if ignore_censoring:
        return F.datediff(event, origin)
    return F.least(F.datediff(event, origin), F.datediff(censor, origin))
