"""Curves, flowchart, test histogram, outcome overlap and the segment matrix."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.numbers import mask_between, percent_of, round_to_base
from spanwise.operators.derive import group_label
from spanwise.operators.rates import OUTCOMES
from spanwise.operators.survival import cumulative_incidence, event_lag_bins, kaplan_meier, risk_table, survival_counts


def group_counts(grouped: DataFrame, time: str = "time_to_positive_test", event: str = "covid_positive_test") -> DataFrame:
    return survival_counts(grouped, time, event, group_label(F.col("group")))


def overall_counts(counts: DataFrame) -> DataFrame:
    """Counts of everyone, summed from the counts by group."""
    return counts.groupBy("time").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).select(
        F.lit("All").alias("group"), "time", "n", "d")


def curves(grouped: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overall curve, curves by group, and numbers at risk by group."""
    counts = group_counts(grouped)
    return (
        cumulative_incidence(kaplan_meier(overall_counts(counts))),
        cumulative_incidence(kaplan_meier(counts)),
        risk_table(counts),
    )


def flowchart(cohort_all: DataFrame, min_follow_up: int = 14, ages: tuple[int, int] = (16, 110)) -> DataFrame:
    """Attrition: nested inclusion steps counted in one aggregation."""
    c = F.col
    has_age = (c("age") >= ages[0]) & (c("age") < ages[1])
    steps: dict[str, Column] = {"c0_all": F.lit(True)}
    steps["c1_notmissing"] = has_age & c("sex").isNotNull()
    for i, outcome in enumerate(("positive_test", "hospitalisation", "death"), 1):
        early = c(f"covid_{outcome}_within_2_weeks_post_vax2") == 0
        previous = list(steps.values())[-1]
        steps[f"c{i + 1}_no_outcomes_within_2_weeks_post_vax2_{i}"] = previous & early
    counted = cohort_all.where(c("follow_up_time_vax2") >= min_follow_up).agg(
        *[F.count_if(condition).alias(name) for name, condition in steps.items()]
    )
    order = Window.partitionBy(F.lit(1)).orderBy("criteria")
    n, previous, first = c("n").cast("double"), F.lag("n").over(order), F.first("n").over(order)
    # five rows, one per step
    return counted.unpivot([], list(steps), "criteria", "n").select(
        "criteria", "n", (previous - c("n")).alias("n_exclude"),
        F.try_divide(previous - n, previous).alias("pct_exclude"),
        F.try_divide(n, first).alias("pct_all"), F.try_divide(n, previous).alias("pct_step"),
    )


def test_histogram(grouped: DataFrame, cap: int | None = None, threshold: int = 8, base: float = 5.0) -> DataFrame:
    """Share of people by number of tests, for everyone (group 0) and each group, suppressed and rounded."""
    tests = F.coalesce(F.col("tests_conducted_any"), F.lit(0.0)).cast("int")
    tests = F.least(tests, F.lit(cap)) if cap else tests
    counts = grouped.groupBy("group", tests.alias("tests")).agg(F.count(F.lit(1)).alias("n"))
    both = counts.groupingSets([["tests"], ["group", "tests"]], "group", "tests").agg(F.sum("n").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("group"))
    return both.withColumn("group", F.coalesce("group", F.lit(0))).withColumn("whole", whole).select(
        "group", "tests",
        round_to_base(F.when(F.col("n") >= threshold, F.col("n")), base).alias("n"),
        round_to_base(F.col("whole"), base).alias("population"),
    ).withColumn("perc", percent_of(F.col("n"), F.col("population"), 1))


def time_quartiles(grouped: DataFrame) -> DataFrame:
    """Quartiles of time to each outcome among people who had it, overall (group 0) and by group."""
    times = F.explode(F.array(*[
        F.struct(F.lit(name).alias("outcome"), F.when(F.col(event) == 1, F.col(time)).alias("time"))
        for name, (event, time) in OUTCOMES.items()
    ]))
    cells = grouped.select("group", times.alias("t")).select("group", "t.*").where(F.col("time").isNotNull()).groupBy(
        "group", "outcome", "time").agg(F.count(F.lit(1)).alias("n"))
    quartiles = F.percentile("time", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    rolled = cells.groupingSets([["outcome"], ["group", "outcome"]], "group", "outcome").agg(
        F.sum("n").alias("n"), quartiles.alias("q"))
    return rolled.select(
        F.coalesce("group", F.lit(0)).alias("group"), "outcome", "n",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
    )


def outcome_overlap(grouped: DataFrame) -> DataFrame:
    """Counts of outcomes, their unions, overlaps and order: one aggregation, one row per figure."""
    pos, adm, death = F.col("covid_positive_test") == 1, F.col("covid_hospital_admission") == 1, F.col("covid_death") == 1
    either = pos | adm | death
    certificate = F.col("death_with_covid_on_the_death_certificate") == 1
    near = F.col("death_with_28_days_of_covid_positive_test") == 1
    both = pos & adm
    lag = F.when(both, F.col("time_to_positive_test"))
    figures = {
        "total positive tests": F.count_if(either & pos),
        "total admissions": F.count_if(either & adm),
        "total deaths": F.count_if(either & death),
        "people with a positive test": F.count_if(pos),
        "people with a positive test or admission": F.count_if(pos | adm),
        "people with any outcome": F.count_if(either),
    }
    for x, sx in ((pos, "positive"), (~pos, "not positive")):
        figures[f"{sx}, admitted"] = F.count_if(x & adm)
        figures[f"{sx}, not admitted"] = F.count_if(x & ~adm)
        figures[f"{sx}, died"] = F.count_if(x & death)
        figures[f"{sx}, did not die"] = F.count_if(x & ~death)
    figures |= {
        "died, certificate and 28 days": F.count_if(death & certificate & near),
        "died, certificate only": F.count_if(death & certificate & ~near),
        "died, 28 days only": F.count_if(death & ~certificate & near),
    }
    order = event_lag_bins(grouped, "_lag_from", "time_to_hospitalisation")
    names = ["before admission", "on or after admission", "0-2 days after", "3-29 days after", "30+ days after"]
    figures |= dict(zip([f"positive test {n}" for n in names], order))
    row = grouped.withColumn("_lag_from", lag).agg(*[f.alias(name) for name, f in figures.items()])
    return row.unpivot([], list(figures), "figure", "n")


def segment_matrix(cohort: DataFrame, segments: Mapping[str, Column], subsets: Mapping[str, Column]) -> DataFrame:
    """People in each segment, in the whole cohort and in each subset, counted in one aggregation."""
    counts = {
        (s, t): F.count_if(condition & within)
        for s, condition in segments.items() for t, within in subsets.items()
    }
    flat = cohort.agg(*[c.alias(f"c{i}") for i, c in enumerate(counts.values())])
    position = {key: i for i, key in enumerate(counts)}
    rows = F.explode(F.array(*[
        F.struct(F.lit(s).alias("segment"), *[F.col(f"c{position[(s, t)]}").alias(t) for t in subsets]) for s in segments
    ]))
    return flat.select(rows.alias("r")).select("r.*")


def cohort_segments() -> dict[str, Column]:
    """Segments of the old characteristics table."""
    # Labels and bounds of the segments.
    c = F.col
    weeks = c("follow_up_time_vax2")
    regions = ["London", "East of England", "East Midlands", "North East", "North West", "South East", "South West",
               "West Midlands", "Yorkshire and the Humber"]
    out: dict[str, Column] = {
        "All": F.lit(True),
        "Immunocompromised": c("immunosuppression") == 1,
        "Time since 2nd dose (2-4 weeks)": (weeks >= 14) & (weeks < 24),
        "Time since 2nd dose (4-6 weeks)": (weeks >= 24) & (weeks < 42),
        "Time since 2nd dose (6-8 weeks)": (weeks >= 42) & (weeks < 56),
        "Time since 2nd dose (8+ weeks)": weeks >= 56,
    }
    out |= {f"Region - {r}": c("region") == r for r in regions}
    out |= {f"Ethnicity - {e}": c("ethnicity") == e for e in ("White", "Asian or Asian British", "Black or Black British")}
    out |= {
        "Ethnicity - Mixed/Other ethnic groups/Unknown": c("ethnicity").isin("Mixed", "Other ethnic groups", "Unknown"),
        "Learning disability": c("learning_disability") == 1,
        "Organ transplant": c("transplant").isNotNull(),
        "Dialysis / Kidney disease": c("dialysis").isNotNull() | c("chronic_kidney_disease").isin("Stage 3a", "Stage 3b", "Stage 4", "Stage 5"),
    }
    for label, level in (("<80", "16-79"), ("80 - 84", "80-84"), ("85 - 89", "85-89"), ("90 - 94", "90-94"), ("95+", "95+")):
        out[f"Age - {label}"] = (c("care_home_65plus") != 1) & (c("ageband2") == level)
    return out


def cohort_subsets() -> dict[str, Column]:
    return {"fully_vaccinated": F.lit(True)} | {name: F.col(event) == 1 for name, (event, _) in OUTCOMES.items()}


def segment_report(cohort: DataFrame) -> DataFrame:
    """The segment matrix with counts of 0-7 hidden and the others rounded to 5."""
    table = segment_matrix(cohort, cohort_segments(), cohort_subsets())
    return table.withColumns({t: round_to_base(mask_between(F.col(t)), 5.0) for t in cohort_subsets()})
