"""Three-valued logic and category builders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_known(condition: Column, yes: Column, no: Column) -> Column:
    """``yes``/``no`` by a condition that may be NULL; an unknown condition gives NULL.

    SQL ``CASE`` would take the ``no`` branch for an unknown condition.
    """
    return F.when(condition.isNull(), None).when(condition, yes).otherwise(no)


def is_true(condition: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def first_label(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """Label of the first rule that holds; rules that are unknown are passed over."""
    chain = reduce(
        lambda built, rule: built.when(rule[0], F.lit(rule[1])) if built is not None else F.when(rule[0], F.lit(rule[1])),
        rules,
        None,
    )
    return chain.otherwise(F.lit(default).cast("string"))


def label_order(column: Column, labels: Sequence[str]) -> Column:
    """1-based position of a label in its declared order, NULL when it is not listed."""
    position = F.array_position(F.array(*[F.lit(label) for label in labels]), column)
    return F.nullif(position, F.lit(0).cast("bigint"))


def band(value: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bands ``[b0,b1) [b1,b2) …``; the last break may be ``inf``; outside gives NULL."""
    if len(breaks) != len(labels) + 1:
        raise ValueError("one label is needed between each pair of breaks")
    rules = []
    for low, high, label in zip(breaks, breaks[1:], labels):
        inside = value >= F.lit(low)
        if high != float("inf"):
            inside = inside & (value < F.lit(high))
        rules.append((inside, label))
    return first_label(*rules)


def row_min(*values: Column) -> Column:
    """Smallest of the known values."""
    return F.least(*values)


def row_max(*values: Column) -> Column:
    """Largest of the known values."""
    return F.greatest(*values)


def row_min_strict(*values: Column) -> Column:
    """Smallest value, NULL as soon as one value is unknown."""
    unknown = reduce(lambda a, b: a | b, [v.isNull() for v in values])
    return F.when(~unknown, F.least(*values))


def present(date: Column) -> Column:
    """1 when a date is recorded, else 0."""
    return date.isNotNull().cast("int")


def satisfying(all_of: Sequence[Column] = (), none_of: Sequence[Column] = ()) -> Column:
    """AND of flags with AND NOT of others; every operand counts as false when unknown."""
    terms = [is_true(c) for c in all_of] + [~is_true(c) for c in none_of]
    return reduce(lambda a, b: a & b, terms)
