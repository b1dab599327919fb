"""Column summaries with redaction, from one table of value counts per column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.operators.disclosure import suppress_mask, suppress_two_way
from spanwise.operators.quantiles import join_groups, quantiles
from spanwise.operators.reshape import complete_levels
from spanwise.functions.logic import label_order
from spanwise.functions.numbers import round_to_base

MISSING = "(missing)"
STEP_PROBS = [0.1, 0.25, 0.5, 0.75, 0.9]
STEP_NAMES = ["p10", "p25", "p50", "p75", "p90"]


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, text, n)``: how often each value of each column occurs, in one pass for all columns."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "column", "text").groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))


def _as_number(kind: str) -> Column:
    if kind == "date":
        return F.unix_date(F.col("text").try_cast("date")).cast("double")
    if kind == "boolean":
        return F.col("text").try_cast("boolean").cast("int").cast("double")
    return F.col("text").try_cast("double")


def _moments(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts, mean, deviation and range per group; the deviation is taken around the mean."""
    known, n, v = F.col("value").isNotNull(), F.col("n"), F.col("value")
    basic = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, n)), F.lit(0)).alias("n_nonmiss"),
        F.count_if(known).alias("unique"), F.try_divide(F.sum(v * n), F.sum(F.when(known, n)).cast("double")).alias("mean"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    spread = (
        join_groups(cells, basic.select(*by, "mean"), by).groupBy(*by)
        .agg(F.sum((v - F.col("mean")) * (v - F.col("mean")) * n).alias("ss"))
    )
    return basic.join(spread, list(by), "left").withColumn(
        "sd", F.sqrt(F.try_divide(F.col("ss"), F.nullif(F.col("n_nonmiss") - 1, F.lit(0)).cast("double")))
    ).drop("ss")


def _numeric_summary(cells: DataFrame, by: Sequence[str], threshold: int, redacted: Column | None = None) -> DataFrame:
    """``redacted`` may replace the rule that hides groups of 1…threshold people; it sees one row per group."""
    by = list(by)
    points = quantiles(cells.where(F.col("value").isNotNull()), by, STEP_PROBS, "step")
    points = points.withColumnsRenamed({f"q{i}": name for i, name in enumerate(STEP_NAMES)})
    wide = _moments(cells, by).join(points, by, "left").withColumns({
        "pct_nonmiss": F.col("n_nonmiss") / F.col("n"),
        "n_miss": F.col("n") - F.col("n_nonmiss"),
        "pct_miss": (F.col("n") - F.col("n_nonmiss")) / F.col("n"),
        "redacted": F.col("n").between(1, threshold) if redacted is None else redacted,
    })
    names = ["n", "n_nonmiss", "pct_nonmiss", "n_miss", "pct_miss", "unique", "mean", "sd", "min", *STEP_NAMES, "max"]
    return wide.select(*by, *[F.when(~F.col("redacted"), F.col(c)).alias(c) for c in names], "redacted")


def properties(
    df: DataFrame, threshold: int = 5, id_suffix: str = "_id",
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
) -> DataFrame:
    """Redacted summary of every column by type: numbers and dates by position, text by level.

    Positions of dates are dates, in the columns ``mean_date`` to ``max_date``; their deviation is in days. Values are
    counted once for all columns; ``stage`` may store these counts, which several steps read.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if not f.name.endswith(id_suffix)}
    counts = stage(column_counts(df, list(kinds)), "counts")
    text = [c for c, k in kinds.items() if k in ("string", "boolean")]
    dates = [c for c, k in kinds.items() if k == "date"]
    number = F.when(F.col("column").isin(*dates), _as_number("date")).otherwise(_as_number("double"))
    numeric = _numeric_summary(
        counts.where(~F.col("column").isin(*text)).withColumn("value", number), ["column"], threshold)
    is_date = F.col("column").isin(*dates)
    for c in ["mean", "min", *STEP_NAMES, "max"]:
        numeric = numeric.withColumn(f"{c}_date", F.when(is_date, F.date_from_unix_date(F.floor(c).cast("int")))).withColumn(
            c, F.when(~is_date, F.col(c)))
    kind = F.when(is_date, "date").otherwise("number")
    levels = _level_summary(
        counts.where(F.col("column").isin(*text)).select("column", F.coalesce("text", F.lit(MISSING)).alias("level"), "n"), threshold, 1)
    return numeric.withColumn("kind", kind).unionByName(
        levels.withColumn("kind", F.lit("category")), allowMissingColumns=True)


def summary_numeric(df: DataFrame, columns: Sequence[str], threshold: int = 5) -> DataFrame:
    """Count, missing, distinct, moments, range and inverse-distribution quantiles of each column."""
    cells = column_counts(df, columns).withColumn("value", F.col("text").try_cast("double"))
    return _numeric_summary(cells, ["column"], threshold)


def summary_date(df: DataFrame, columns: Sequence[str], threshold: int = 5) -> DataFrame:
    """The same for dates; positions are returned as dates and the deviation in days."""
    cells = column_counts(df, columns).withColumn("value", _as_number("date"))
    dates = ["mean", "min", *STEP_NAMES, "max"]
    return _numeric_summary(cells, ["column"], threshold).withColumns({
        c: F.date_from_unix_date(F.floor(c).cast("int")) for c in dates
    })


def _declared(column: str | Column, levels: Sequence[str] | None) -> list[Column]:
    """How ties between levels are ordered: by declared position, then by name; unlisted and missing ones come last."""
    level = F.col(column) if isinstance(column, str) else column
    place = [label_order(level, levels).asc_nulls_last()] if levels else []
    return [(level == MISSING).cast("int"), *place, level]


def summary_by_category(df: DataFrame, category: str, number: str, threshold: int = 5, levels: Sequence[str] | None = None) -> DataFrame:
    """Numeric summary at each level of a category; unknown levels are ``(missing)``. ``levels`` orders ties in masking."""
    cells = df.groupBy(
        F.coalesce(F.col(category).cast("string"), F.lit(MISSING)).alias("level"), F.col(number).cast("double").alias("value")
    ).agg(F.count(F.lit(1)).alias("n"))
    # one vector over all levels: a level may also be hidden to protect a smaller one
    return _numeric_summary(cells, ["level"], threshold, suppress_mask(F.col("n"), [F.lit(1)], _declared("level", levels), threshold))


def _shares(n: str, level: str, by: Sequence[str], pct_of: str) -> dict[str, Column]:
    margin = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    known = F.when(F.col(level) == MISSING, F.lit(0)).otherwise(F.col(n))
    return {
        "pct": F.try_divide(F.col(pct_of).cast("double"), F.sum(pct_of).over(margin)),
        "pct_nonmiss": F.try_divide(known.cast("double"), F.sum(known).over(margin)),
    }


def summary_categorical(
    df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None,
    threshold: int = 5, accuracy: int = 1,
) -> DataFrame:
    """Count, share and share of known values per level; declared levels without rows are kept as 0."""
    flags = {f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)}
    texts = df.select(*[
        (F.when(F.col(c), "yes").when(~F.col(c), "no") if c in flags else F.col(c).cast("string")).alias(c) for c in columns
    ])
    counts = column_counts(texts, columns).select("column", F.coalesce("text", F.lit(MISSING)).alias("level"), "n")
    for column, declared in (levels or {}).items():
        own = complete_levels(counts.where(F.col("column") == column).drop("column"), "level", [*declared])
        extra = counts.where((F.col("column") == column) & ~F.col("level").isin(*declared)).drop("column")
        counts = counts.where(F.col("column") != column).unionByName(
            own.unionByName(extra).select(F.lit(column).alias("column"), "level", "n"))
    return _level_summary(counts, threshold, accuracy, levels or {})


def _level_summary(counts: DataFrame, threshold: int, accuracy: int, levels: Mapping[str, Sequence[str]] = {}) -> DataFrame:  # noqa: B006
    """Ties for the second hidden cell go to the first declared level of a column, and by name where none are declared."""
    rounded = counts.withColumn("n", round_to_base(F.col("n"), float(accuracy)).cast("bigint"))
    last, place = (F.col("level") == MISSING).cast("int"), F.lit(0)
    for column, declared in levels.items():
        place = F.when(F.col("column") == column, F.coalesce(label_order(F.col("level"), declared), F.lit(len(declared) + 1))).otherwise(place)
    full = rounded.withColumns(_shares("n", "level", ["column"], "n")).withColumn(
        "redacted", suppress_mask(F.col("n"), ["column"], [last, place, F.col("level")], threshold))
    return full.select("column", "level", *[F.when(~F.col("redacted"), F.col(c)).alias(c) for c in ("n", "pct", "pct_nonmiss")], "redacted")


def crosstab_long(
    df: DataFrame, level1: str, level2: str, threshold: int = 5, accuracy: int = 1,
    levels1: Sequence[str] | None = None, levels2: Sequence[str] | None = None, total: str | None = None,
) -> DataFrame:
    """Two categories in long form with shares inside ``level2`` and masks from both margins."""
    text1, text2 = (F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in (level1, level2))
    counts = df.groupBy(text1.alias("level1"), text2.alias("level2")).agg(F.count(F.lit(1)).alias("n"))

    def observed(column: str, declared: Sequence[str] | None) -> Column:
        seen = F.collect_set(column)
        return F.array_union(F.array(*[F.lit(x) for x in declared]), seen) if declared else seen

    # one row with the levels of both categories, then one row per pair of them
    pairs = (
        counts.agg(observed("level1", levels1).alias("a"), observed("level2", levels2).alias("b"))
        .select(F.explode("a").alias("level1"), "b").select("level1", F.explode("b").alias("level2"))
    )
    full = pairs.join(counts, ["level1", "level2"], "left").fillna(0, subset=["n"])
    full = full.withColumn("raw", F.col("n")).withColumn("n", round_to_base(F.col("n"), float(accuracy)).cast("bigint"))
    full = suppress_two_way(full.withColumns(_shares("n", "level1", ["level2"], "raw")), "n", "level1", "level2", threshold,
                            _declared("level1", levels1), _declared("level2", levels2))
    out = full.select(
        "level1", "level2", *[F.when(~F.col("redacted"), F.col(c)).alias(c) for c in ("n", "pct", "pct_nonmiss")], "redacted"
    )
    if total is not None:
        one_way = summary_categorical(df, [level1], {level1: levels1} if levels1 else None, threshold)
        out = out.unionByName(one_way.select(
            F.col("level").alias("level1"), F.lit(total).alias("level2"), "n", "pct", "pct_nonmiss", "redacted"))
    return out


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Two-way table with known column values; unknown values are left out."""
    known = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    return known.groupBy(rows).agg(*[F.count_if(F.col(columns) == v).alias(f"{columns}_{v}") for v in values])


def dataset_profile(df: DataFrame, columns: Sequence[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """Type, missing, distinct and moments of every column, one row per column.

    Exact distinct counts shuffle the distinct values of each column; ``exact_distinct=False`` replaces them by a
    fixed-size estimate and leaves out quantiles.
    """
    names = list(columns or df.columns)
    kinds = {c: df.schema[c].dataType.simpleString() for c in names}
    typed = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    if not exact_distinct:
        texts = df.select(*[F.col(c).cast("string").alias(c) for c in names])
        return texts.unpivot([], names, "column", "text").groupBy("column").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("text").isNull()).alias("n_missing"),
            F.approx_count_distinct("text").alias("n_unique"),
        ).withColumn("complete_rate", 1 - F.col("n_missing") / F.col("n")).withColumn("type", typed[F.col("column")])
    dates = [c for c in names if kinds[c] == "date"]
    text_only = [c for c in names if kinds[c] == "string"]
    number = F.when(F.col("column").isin(*dates), _as_number("date")).when(
        F.col("column").isin(*text_only), F.lit(None)).otherwise(_as_number("double"))
    counts = column_counts(df, names)
    cells = counts.withColumn("value", number)
    by_text = counts.groupBy("column").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("text").alias("n_unique"),
    )
    numbers = _moments(cells.where(F.col("value").isNotNull()), ["column"]).select("column", "mean", "sd", "min", "max")
    middle = quantiles(cells.where(F.col("value").isNotNull()), ["column"], [0.25, 0.5, 0.75]).withColumnsRenamed(
        {"q0": "p25", "q1": "p50", "q2": "p75"})
    return (
        by_text.join(numbers, "column", "left").join(middle, "column", "left")
        .withColumn("type", typed[F.col("column")])
        .withColumn("complete_rate", 1 - F.col("n_missing") / F.col("n"))
    )
