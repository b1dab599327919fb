"""Rounding, percentages, suppression masks on single values, and number-to-text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(value * scale) / scale if digits else F.rint(value.cast("double"))


def round_to_base(value: Column, base: Column | float) -> Column:
    """Nearest multiple of ``base`` (halves to the even multiple)."""
    base = base if isinstance(base, Column) else F.lit(float(base))
    return F.rint(value / base) * base


def percent_of(part: Column, whole: Column, digits: int = 0) -> Column:
    return round_half_even(F.try_divide(part.cast("double"), whole.cast("double")) * 100.0, digits)


def mask_text(n: Column, below: int = 8) -> Column:
    """``<8`` for small numbers, the number itself otherwise."""
    return F.when(n < below, F.lit(f"<{below}")).otherwise(n.cast("string"))


def mask_between(n: Column, low: int = 0, high: int = 7) -> Column:
    return F.when(n.between(low, high), None).otherwise(n)


def number_text(value: Column, digits: int = 2) -> Column:
    """Plain decimal text without trailing zeros (``4.80`` prints as ``4.8``, ``149.0`` as ``149``)."""
    text = value.cast(f"decimal(28,{max(digits, 1)})").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def shown(text: Column, hidden: str = "[REDACTED]") -> Column:
    return F.coalesce(text, F.lit(hidden))


def count_cell(count: Column, person_years: Column, hidden: str = "[REDACTED]") -> Column:
    """``n (person-years)``."""
    return F.concat(shown(number_text(count), hidden), F.lit(" ("), shown(number_text(person_years), hidden), F.lit(")"))


def rate_cell(rate: Column, lower: Column, upper: Column, hidden: str = "[REDACTED]") -> Column:
    """``rate (lower-upper)``."""
    return F.concat(
        shown(number_text(rate), hidden), F.lit(" ("), shown(number_text(lower), hidden),
        F.lit("-"), shown(number_text(upper), hidden), F.lit(")"),
    )


def interval_cell(middle: Column, low: Column, high: Column) -> Column:
    """``median (q1-q3)``."""
    return F.concat(
        number_text(middle), F.lit(" ("), number_text(low), F.lit("-"), number_text(high), F.lit(")")
    )


def parse_count_cell(cell: Column) -> Column:
    """Number in front of the bracket of ``"1,234 (5.6%)"``; NULL when there is none."""
    head = F.split(cell, r"[(]").getItem(0)
    return F.regexp_replace(head, "[ ,]", "").try_cast("double")


def strata_label(text: Column) -> Column:
    """Drop everything up to the last ``=`` in ``variable=level``."""
    return F.regexp_replace(text, ".*=", "")
