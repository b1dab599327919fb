"""Reshaping, keyed joins and row sets used to assemble reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable", value: str = "value") -> DataFrame:
    """Wide to long. Columns of different types are brought to text first."""
    kinds = {df.schema[c].dataType for c in values}
    if len(kinds) > 1:
        df = df.select(*ids, *[F.col(c).cast("string").alias(c) for c in values])
    return df.unpivot(list(ids), list(values), variable, value)


def pivot_wide(df: DataFrame, ids: Sequence[str], names_from: str, names: Sequence[str], values_from: Sequence[str], glue: str = "{name}__{value}") -> DataFrame:
    """Long to wide with the column names known beforehand; no pass over the data to find them."""
    out = [
        F.first(F.when(F.col(names_from) == name, F.col(value)), ignorenulls=True).alias(glue.format(name=name, value=value))
        for value in values_from for name in names
    ]
    return df.groupBy(*ids).agg(*out)


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in set(right.columns)]
    return left.join(right, shared, "left")


def left_join_on(left: DataFrame, right: DataFrame, keys: Mapping[str, str | Column]) -> DataFrame:
    """Left join where the right-hand key has another name or is built from columns of the right side."""
    named = {f"_key_{i}": (F.col(k) if isinstance(k, str) else k) for i, k in enumerate(keys.values())}
    used = [k for k in keys.values() if isinstance(k, str)]
    keyed = right.withColumns(named).drop(*used)
    condition = [left[l] == keyed[r] for l, r in zip(keys, named)]
    return left.join(keyed, condition, "left").drop(*named)


def chain_left_joins(base: DataFrame, parts: Iterable[DataFrame], keys: Sequence[str]) -> DataFrame:
    return reduce(lambda left, right: left.join(right, list(keys), "left"), parts, base)


def union_rows(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def drop_pairs(df: DataFrame, variable: str, level: str, pairs: Iterable[tuple[str, str]]) -> DataFrame:
    """Remove (variable, level) combinations that a report does not show."""
    pairs = list(pairs)
    if not pairs:
        return df
    dropped = reduce(lambda a, b: a | b, [(F.col(variable) == v) & (F.col(level) == l) for v, l in pairs])
    return df.where(~F.coalesce(dropped, F.lit(False)))


def split_column(df: DataFrame, column: str, pattern: str, into: Sequence[str]) -> DataFrame:
    parts = F.split(F.col(column), pattern, len(into))
    return df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(into)}).drop(column)


def complete_levels(counts: DataFrame, column: str, levels: Sequence[str], by: Sequence[str] = (), fill: Sequence[str] = ("n",)) -> DataFrame:
    """Counts with a row for every declared level; levels without rows get 0.

    ``counts`` is an aggregated table; the missing levels of each ``by`` group are found from it.
    """
    declared = F.array(*[F.lit(level) for level in levels])
    if by:
        wanted = counts.select(*by).distinct().withColumn(column, F.explode(declared))
    else:
        wanted = counts.sparkSession.range(1).select(F.explode(declared).alias(column))
    joined = wanted.join(counts, [*by, column], "left")
    return joined.fillna(0, subset=list(fill))


def share(df: DataFrame, n: str, by: Sequence[str], name: str = "share") -> DataFrame:
    """Share of each aggregated row in its group."""
    return df.withColumn(name, F.try_divide(F.col(n).cast("double"), F.sum(n).over(Window.partitionBy(*by))))


def rename(df: DataFrame, new_names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(new_names))
