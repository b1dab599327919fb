"""Counts, person-time and incidence rates in one pass over the cohort."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.numbers import percent_of, round_half_even

DAYS_PER_YEAR = 365.25

# Outcomes in report order with their event and time columns.
OUTCOMES: dict[str, tuple[str, str]] = {
    "positive_test": ("covid_positive_test", "time_to_positive_test"),
    "hospitalised": ("covid_hospital_admission", "time_to_hospitalisation"),
    "critical_care": ("covid_hospitalisation_critical_care", "time_to_itu"),
    "death": ("covid_death", "time_to_covid_death"),
}
TESTS = ["test_0", "test_1", "test_2", "test_3"]
SUMS = [*TESTS, "test_over_3", "tests_any", "tests_positive"]


def rate(events: Column, days: Column, per: int = 1000) -> Column:
    """Events per ``per`` person-years: what an intercept-only Poisson model estimates."""
    return F.try_divide(events * (DAYS_PER_YEAR * per), days)


def rate_columns(events: Column, days: Column, suffix: str = "", per: int = 1000, z: float = 1.0, digits: int = 2) -> dict[str, Column]:
    """Person-years, rate and limits ``rate * exp(±z/sqrt(events))``. No events: lower 0, upper unknown."""
    n, t = events.cast("double"), days.cast("double")
    estimate, spread = rate(n, t, per), F.lit(z) / F.sqrt(F.nullif(n, F.lit(0.0)))
    return {
        f"py{suffix}": round_half_even(t / DAYS_PER_YEAR),
        f"rate{suffix}": round_half_even(estimate, digits),
        f"lower{suffix}": round_half_even(F.when(n == 0, F.lit(0.0)).otherwise(estimate * F.exp(-spread)), digits),
        f"upper{suffix}": round_half_even(estimate * F.exp(spread), digits),
    }


def test_counts() -> list[Column]:
    """People with 0, 1, 2, 3+ tests (no test is stored as unknown) and the number of tests."""
    any_tests, positive = F.col("tests_conducted_any"), F.col("tests_conducted_positive")
    return [
        F.count_if(any_tests.isNull()).alias("test_0"),
        F.count_if(any_tests == 1).alias("test_1"),
        F.count_if(any_tests == 2).alias("test_2"),
        F.count_if(any_tests > 2).alias("test_3"),
        F.count_if(any_tests > 3).alias("test_over_3"),
        F.coalesce(F.sum(any_tests), F.lit(0.0)).alias("tests_any"),
        F.coalesce(F.sum(positive), F.lit(0.0)).alias("tests_positive"),
    ]


def outcome_sums(min_time: int | None = None, outcomes: Mapping[str, tuple[str, str]] = OUTCOMES) -> list[Column]:
    """Events and person-days of every outcome; ``min_time`` leaves out times at or below it."""
    sums = []
    for name, (event, time) in outcomes.items():
        kept = F.lit(True) if min_time is None else F.col(time) > min_time
        sums.append(F.coalesce(F.sum(F.when(kept, F.col(event).cast("bigint"))), F.lit(0)).alias(f"events_{name}"))
        sums.append(F.coalesce(F.sum(F.when(kept, F.col(time).cast("bigint"))), F.lit(0)).alias(f"days_{name}"))
    return sums


def measure_cells(df: DataFrame, keys: Sequence[str], min_time: int | None = None) -> DataFrame:
    """All measures by key and day of follow-up.

    Days of follow-up are few, so quantiles can be taken from these cells with their counts as weights; the
    pass over people is a hash aggregation with map-side sums and no per-group value lists.
    """
    return df.groupBy(*keys, "follow_up_time").agg(
        F.count(F.lit(1)).alias("n"), *test_counts(), *outcome_sums(min_time)
    )


def measure_totals() -> list[Column]:
    """Aggregates that turn cells into one row per key, follow-up quartiles included."""
    names = [*SUMS, *[f"{kind}_{o}" for o in OUTCOMES for kind in ("events", "days")]]
    quartiles = F.percentile("follow_up_time", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return [F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names], quartiles.alias("quartiles")]


def finish_measures(df: DataFrame, per: int = 1000, z: float = 1.0) -> DataFrame:
    """Percentages, positivity, quartiles and rates from totals."""
    out = {
        "fu_q1": round_half_even(F.col("quartiles")[0]),
        "fu_median": round_half_even(F.col("quartiles")[1]),
        "fu_q3": round_half_even(F.col("quartiles")[2]),
        "positivity": percent_of(F.col("tests_positive"), F.col("tests_any"), 2),
        **{t: percent_of(F.col(t), F.col("n")) for t in TESTS},
    }
    for o in OUTCOMES:
        out |= rate_columns(F.col(f"events_{o}"), F.col(f"days_{o}"), f"_{o}", per, z)
    return df.withColumns(out).drop("quartiles", "test_over_3", "tests_any", "tests_positive", *[f"days_{o}" for o in OUTCOMES])


def crude_rate(
    df: DataFrame, event: str, time: str, variables: Sequence[str], per: int = 1000, z: float = 1.0, min_time: int | None = -1
) -> DataFrame:
    """Rates of one outcome at every level of several variables; unknown levels are ``Unknown``."""
    kept = df if min_time is None else df.where(F.col(time) > min_time)
    slim = kept.select(F.col(event).alias("_event"), F.col(time).alias("_time"), *[F.col(v).cast("string").alias(v) for v in variables])
    totals = (
        slim.unpivot(["_event", "_time"], list(variables), "variable", "level")
        .withColumn("level", F.coalesce(F.nullif("level", F.lit("")), F.lit("Unknown")))
        .groupBy("variable", "level")
        .agg(F.count_if(F.col("_event") == 1).alias("events"), F.sum(F.col("_time").cast("bigint")).alias("days"))
    )
    return totals.select("variable", "level", "events", *[
        c.alias(name) for name, c in rate_columns(F.col("events"), F.col("days"), "", per, z).items()
    ])
