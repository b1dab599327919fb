"""Exact quantiles that never bring a whole column to one task.

Equal values are counted first. A coarse set of cut points splits the distinct values of each group into
slices; the slice totals (a few hundred rows per group) show which slices hold the wanted ranks. A wanted slice
with more distinct values than one task should sort is cut again in the same way, until every one is small
enough; only then its values are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.sources.snapshots import snapshot

#: Slices of a cut, distinct values that one task sorts at most, groups whose cut points are held as a local table.
SLICES, TARGET, HELD = 256, 500_000, 1000


def with_slice(cells: DataFrame) -> DataFrame:
    """Number of cut points below the value, by binary search: one compiled projection per halving."""
    cells, step = cells.withColumn("slice", F.lit(0)), SLICES // 2
    while step >= 1:
        below = F.get("cuts", F.col("slice") + (step - 1)) < F.col("value")
        cells = cells.withColumn("slice", F.col("slice") + F.when(below, step).otherwise(0))
        step //= 2
    return cells


def value_counts(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )


def join_groups(cells: DataFrame, per_group: DataFrame, by: Sequence[str], copies: int = 64) -> DataFrame:
    """Put a few columns per group beside its cells.

    The key is salted by the value and the group rows are copied once per salt, so a group with most of the cells is
    spread over ``copies`` tasks instead of one. Unknown groups are kept.
    """
    salts = per_group.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    right = salts.withColumnsRenamed({b: f"_{b}" for b in by})
    left = cells.withColumn("_bucket", F.pmod(F.hash("value"), F.lit(copies)))
    # null-safe on every key, so that no filter is inferred for one use of the cells only and they are computed once
    matches = [F.col("_bucket").eqNullSafe(F.col("_salt")), *[F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]]
    return left.join(right, matches).drop("_bucket", "_salt", *[f"_{b}" for b in by])


def ranks(total: Column, p: float, kind: str) -> list[Column]:
    """1-based ranks a quantile needs: one for ``step`` (inverse distribution), two for ``linear``."""
    n = total.cast("double")
    if kind == "step":
        return [F.greatest(F.ceil(F.round(n * p, 9)), F.lit(1)).cast("bigint")]
    low = F.floor((n - 1) * p) + 1
    return [low.cast("bigint"), F.least(low + 1, total).cast("bigint")]


def join_slices(cells: DataFrame, slices: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the cells of the wanted slices."""
    right = slices.withColumnsRenamed({k: f"_{k}" for k in keys})
    return cells.join(right, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def cut_points(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: number of rows and of distinct values, and the cut points between the slices of the latter."""
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count("value").alias("distinct"),
        F.percentile_approx("value", [i / SLICES for i in range(1, SLICES)], 10_000).alias("cuts"),
    )


def _beside(cells: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """The cells with a few columns per key, and the largest number of distinct values of a key.

    Few keys are held as a local table and broadcast; many are joined by salted shuffle.
    """
    rows = per_key.limit(HELD + 1).toArrow()
    if 0 < rows.num_rows <= HELD:
        return join_slices(cells, F.broadcast(cells.sparkSession.createDataFrame(rows)), keys), pc.max(rows["distinct"]).as_py()
    return join_groups(cells, per_key, keys), per_key.agg(F.max("distinct")).first()[0] or 0


def _in_question(given: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells of the slices that hold wanted ranks, with these and the number of the group's rows before the slice."""
    sliced = with_slice(given.drop("distinct")).drop("cuts")
    order = Window.partitionBy(*keys).orderBy("slice")
    slices = (
        sliced.groupBy(*keys, "slice").agg(F.sum("n").alias("slice_n"), *[F.first(c).alias(c) for c in ("total", "before", "wanted")])
        .withColumn("before", F.col("before") + F.coalesce(F.sum("slice_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("wanted", F.filter("wanted", lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("slice_n"))))
        .where(F.size("wanted") > 0)
        .select(*keys, "slice", "total", "before", "wanted")
    )
    return join_slices(sliced.select(*keys, "slice", "value", "n"), slices, [*keys, "slice"])


def quantiles(cells: DataFrame, by: Sequence[str], probs: Sequence[float], kind: str = "linear", target: int = TARGET) -> DataFrame:
    """Quantiles ``q0, q1, …`` per group from ``(by, value, n)`` cells, exact for any number of values.

    One short job per round finds the cut points; beyond ``target`` distinct values a slice, the cells that are still in
    question are stored and cut again.
    """
    by = list(by)
    keys = [*by, "part"]  # the part of its group that a cell lies in: one at first, then one for each wanted slice
    cells = cells.withColumn("part", F.lit(0).cast("long"))
    wanted = F.array_sort(F.array_distinct(F.array(*[r for p in probs for r in ranks(F.col("rows"), p, kind)])))
    per_part = cut_points(cells, keys).select(
        *keys, F.col("rows").alias("total"), F.lit(0).cast("long").alias("before"), wanted.alias("wanted"), "cuts", "distinct")
    given, largest = _beside(cells, per_part, keys)
    while 2 * largest > target * SLICES:  # a slice holds about 1/256 of the distinct values of its part
        rest = _in_question(given, keys).withColumn("part", F.col("part") * SLICES + F.col("slice")).drop("slice")
        rest = snapshot(rest, "quantile-cells")
        held = rest.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("total", "before", "wanted")])
        per_part = join_slices(cut_points(rest, keys).drop("rows"), held, keys)
        before, (given, largest) = largest, _beside(rest.select(*keys, "value", "n"), per_part, keys)
        if largest >= before:
            break
    inside = _in_question(given, keys)
    upto = Window.partitionBy(*keys, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        inside.withColumn("upto", F.col("before") + F.sum("n").over(upto))
        .withColumn("rank", F.explode(F.filter("wanted", lambda r: (r <= F.col("upto")) & (r > F.col("upto") - F.col("n")))))
        .groupBy(*by).agg(F.first("total").alias("total"), F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("at"))
    )
    out = []
    for i, p in enumerate(probs):
        at = [F.col("at")[r] for r in ranks(F.col("total"), p, kind)]
        if kind == "linear":
            h = (F.col("total").cast("double") - 1) * p
            part = h - F.floor(h)
            out.append((at[0] + (at[1] - at[0]) * part).alias(f"q{i}"))
        else:
            out.append(at[0].alias(f"q{i}"))
    return found.select(*by, *out)
