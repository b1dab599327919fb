"""Disclosure control: small-number masks, secondary masks, rounding and rebuilt totals.

All windows here run over aggregated tables with one row per reported cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.numbers import mask_between, round_to_base


def suppress_mask(
    n: Column, by: Sequence[str | Column], order: Sequence[str | Column], threshold: int = 5, skip_zero: bool = False
) -> Column:
    """True for counts of 1…threshold; when these add up to no more than the threshold, also for the
    smallest other cell of the margin ``by`` (first in ``order`` on ties). Zeros are shown, but a zero may be
    that smallest cell unless ``skip_zero``."""
    margin = Window.partitionBy(*by)
    small = n.between(1, threshold)
    masked_sum = F.coalesce(F.sum(F.when(small, n)).over(margin), F.lit(0))
    any_small = F.coalesce(F.bool_or(small).over(margin), F.lit(False))
    last = small | (n == 0) if skip_zero else small
    rank = F.row_number().over(margin.orderBy(last.cast("int"), n, *order))
    secondary = any_small & (masked_sum <= threshold) & (rank == 1)
    if skip_zero:
        secondary = secondary & (n > 0)
    return small | secondary


def next_smallest(n: Column, by: Sequence[str], order: Sequence[str | Column], threshold: int = 5) -> Column:
    """True for the smallest cell above the threshold (or zero) in each margin."""
    small = n.between(1, threshold)
    return F.row_number().over(Window.partitionBy(*by).orderBy(small.cast("int"), n, *order)) == 1


def suppress_by(mask: Column, value: Column) -> Column:
    return F.when(~mask, value)


def checked_count(n: Column) -> Column:
    """The count itself; the query fails when it is missing or negative."""
    wrong = F.raise_error(F.lit("counts must be known and not negative")).cast("bigint")
    return F.when(n.isNull() | (n < 0), wrong).otherwise(n)


def suppress_two_way(
    df: DataFrame, n: str, rows: str, columns: str, threshold: int = 5,
    row_order: Sequence[str | Column] | None = None, column_order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Mask by the row margin or the column margin; the orders say which of equal cells is hidden."""
    count = F.col(n)
    by_row = suppress_mask(count, [rows], column_order or [columns], threshold)
    by_column = suppress_mask(count, [columns], row_order or [rows], threshold)
    return df.withColumn("redacted", by_row | by_column)


def suppress_small_rows(df: DataFrame, dependents: Mapping[str, Sequence[str]], threshold: int = 8) -> DataFrame:
    """Below the threshold the count and every statistic that rests on it become NULL."""
    hidden = {}
    for count, others in dependents.items():
        shown = F.col(count) >= threshold
        for name in (count, *others):
            hidden[name] = F.when(shown, F.col(name))
    return df.withColumns(hidden)


def suppress_small_percentages(df: DataFrame, percentages: Sequence[str], whole: str, threshold: int = 8) -> DataFrame:
    """Hide a percentage when the count computed back from it is below the threshold."""
    return df.withColumns({
        name: F.when(F.col(name) / 100.0 * F.col(whole) >= threshold, F.col(name)) for name in percentages
    })


def round_counts(df: DataFrame, columns: Sequence[str], base: float = 5.0) -> DataFrame:
    return df.withColumns({name: round_to_base(F.col(name), base) for name in columns})


def rebuild_totals(df: DataFrame, columns: Sequence[str], is_total: Column) -> DataFrame:
    """The total row becomes the sum of the visible rows."""
    everything = Window.partitionBy(F.lit(1))
    return df.withColumns({
        name: F.when(is_total, F.coalesce(F.sum(F.when(~is_total, F.col(name))).over(everything), F.lit(0.0)))
        .otherwise(F.col(name))
        for name in columns
    })


def mask_values(df: DataFrame, columns: Sequence[str], low: int = 0, high: int = 7) -> DataFrame:
    return df.withColumns({name: mask_between(F.col(name), low, high) for name in columns})
