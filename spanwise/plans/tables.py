"""Report tables: priority groups, characteristics and kidney disease."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.logic import band, first_label, label_order
from spanwise.functions.numbers import count_cell, interval_cell, number_text, rate_cell, shown
from spanwise.operators.cox import Outcome, cox_ph
from spanwise.operators.derive import ETHNICITY_LABELS, IMD_LABELS, REGION_LABELS
from spanwise.operators.disclosure import (
    rebuild_totals, round_counts, suppress_small_percentages, suppress_small_rows,
)
from spanwise.operators.poisson import RATE_COLUMNS, age_adjusted_rates
from spanwise.operators.rates import OUTCOMES, TESTS, crude_rate, finish_measures, measure_cells, measure_totals
from spanwise.operators.reshape import chain_left_joins, drop_pairs, left_join_on

# Row labels of the priority-group table.
TABLE_GROUPS = [
    "All",
    "Care home (priority group 1)",
    "80+ (priority group 2)",
    "Health / care workers (priority groups 1-2)",
    "70-79 (priority groups 3-4)",
    "Shielding (age 16-69) (priority group 4)",
    "50-69 (priority groups 5-9)",
    "Others not in the above groups",
]
# The redacted table writes two of these labels in another way.
REDACTED_GROUPS = {3: "Health / care workers (priority group 1-2)", 4: "70-79 (priority group 3-4)"}

# Variables of the characteristics table in order.
CATEGORIES = [
    "ageband3", "sex", "bmi", "smoking_status", "ethnicity", "imd", "region", "bpcat", "chronic_kidney_disease",
    "dialysis", "transplant", "time_since_fully_vaccinated", "time_between_vaccinations", "prior_covid_cat",
]
CONDITIONS = [
    "asplenia", "asthma", "cancer", "diabetes", "chd", "haem_cancer", "immunosuppression", "learning_disability",
    "cld", "chronic_neuro_dis_inc_sig_learn_dis", "chronic_resp_dis", "sev_mental_ill",
]
# Row order of the characteristics table and of the levels of its variables.
TABLE_ORDER = [
    "ageband3", "sex", "bmi", "smoking_status", "ethnicity", "imd", "region", "asplenia", "asthma", "bpcat", "cancer",
    "chronic_kidney_disease", "diabetes", "dialysis", "chd", "haem_cancer", "immunosuppression", "learning_disability",
    "cld", "chronic_neuro_dis_inc_sig_learn_dis", "chronic_resp_dis", "sev_mental_ill", "transplant",
    "time_since_fully_vaccinated", "time_between_vaccinations", "prior_covid_cat",
]
# Levels the table leaves out.
HIDDEN_LEVELS = [
    ("prior_covid_cat", "Unknown"), ("chronic_kidney_disease", "No CKD"), ("chronic_kidney_disease", "Unknown"),
    ("dialysis", "Unknown"), ("transplant", "Unknown"),
]
# Bands of age, follow-up and dose interval.
AGE3 = ([16, 30, 40, 50, 60, 70, 80, float("inf")], ["16-29", "30-39", "40-49", "50-59", "60-69", "70-79", "80+"])
SINCE = ([0, 28, 56, 84, float("inf")], ["0-4 weeks", "4-8 weeks", "8-12 weeks", "12+ weeks"])
BETWEEN = ([0, 42, 84, float("inf")], ["6 weeks or less", "6-12 weeks", "12 weeks or more"])
CKD_LEVELS = ["No CKD", "Stage 3a", "Stage 3b", "Stage 4", "Stage 5"]
# The label of unknown smoking.
UNKNOWN_LABELS = {"smoking_status": "N&M"}

# Order of the levels in the table.
LEVEL_ORDER = [
    *AGE3[1], "Female", "Male", "Not obese", "Obese", "N&M", "S&E", *ETHNICITY_LABELS.values(), *IMD_LABELS.values(),
    *REGION_LABELS.values(), "Normal", "Elevated/high", *CKD_LEVELS, "Previous kidney transplant",
    "No previous kidney transplant", "Previous dialysis", "No previous dialysis", "Other", *SINCE[1], *BETWEEN[1],
    "Between first and second dose", "Prior to first dose",
]


def in_table_order(table: DataFrame) -> DataFrame:
    """Aggregated rows in the order of variables and levels; ``Unknown`` and unlisted levels come last."""
    listed = [level for level in dict.fromkeys(LEVEL_ORDER) if level != "Unknown"]
    return table.orderBy(label_order(F.col("variable"), TABLE_ORDER), label_order(F.col("level"), listed).asc_nulls_last())


COUNTS = ["n", *[f"events_{o}" for o in OUTCOMES]]


def _statistics(outcome: str, adjusted: bool = False) -> list[str]:
    names = [f"{kind}_{outcome}" for kind in ("py", "rate", "lower", "upper")]
    if adjusted:
        names += [f"{kind}_adj_{outcome}" for kind in ("rate", "lower", "upper")]
    return names + (["positivity"] if outcome == "positive_test" else [])


def redact(table: DataFrame, threshold: int = 8, base: float = 5.0, is_total: Column | None = None, adjusted: bool = False) -> DataFrame:
    """Small-number suppression, rounding of counts, and a rebuilt total row where there is one."""
    dependents = {"n": ["fu_q1", "fu_median", "fu_q3", *TESTS]}
    dependents |= {f"events_{o}": _statistics(o, adjusted) for o in OUTCOMES}
    hidden = suppress_small_percentages(suppress_small_rows(table, dependents, threshold), TESTS, "n", threshold)
    rounded = round_counts(hidden, COUNTS, base)
    return rounded if is_total is None else rebuild_totals(rounded, COUNTS, is_total)


def format_table(table: DataFrame, keys: Sequence[str], hidden: str = "[REDACTED]", adjusted: bool = False) -> DataFrame:
    """Text cells ``n (py)``, ``rate (low-high)`` and ``median (q1-q3)``."""
    cells = [
        shown(number_text(F.col("n")), hidden).alias("fully_vaccinated"),
        shown(interval_cell(F.col("fu_median"), F.col("fu_q1"), F.col("fu_q3")), hidden).alias("follow_up"),
        *[shown(number_text(F.col(t)), hidden).alias(t) for t in TESTS],
        shown(number_text(F.col("positivity")), hidden).alias("positivity"),
    ]
    for o in OUTCOMES:
        cells.append(count_cell(F.col(f"events_{o}"), F.col(f"py_{o}"), hidden).alias(f"{o}_count"))
        cells.append(rate_cell(F.col(f"rate_{o}"), F.col(f"lower_{o}"), F.col(f"upper_{o}"), hidden).alias(f"{o}_rate"))
        if adjusted:
            cells.append(rate_cell(F.col(f"rate_adj_{o}"), F.col(f"lower_adj_{o}"), F.col(f"upper_adj_{o}"), hidden)
                         .alias(f"{o}_rate_adj"))
    return table.select(*keys, *cells)


def priority_groups(grouped: DataFrame, overall_counts_over_three: bool = False) -> DataFrame:
    """Everyone and the seven groups: counts, follow-up, tests and four outcomes with rates.

    ``overall_counts_over_three`` makes the overall row count "more than 3" tests instead of "more than 2".
    """
    cells = measure_cells(grouped, ["group"])
    totals = cells.groupingSets([[], ["group"]], "group").agg(*measure_totals())
    totals = totals.withColumn("group", F.coalesce("group", F.lit(0)))
    if overall_counts_over_three:
        totals = totals.withColumn("test_3", F.when(F.col("group") == 0, F.col("test_over_3")).otherwise(F.col("test_3")))
    label = first_label(*[(F.col("group") == i, text) for i, text in enumerate(TABLE_GROUPS)])
    return finish_measures(totals).withColumn("label", label)


def priority_groups_redacted(grouped: DataFrame, threshold: int = 8) -> DataFrame:
    table = redact(priority_groups(grouped), threshold, is_total=F.col("group") == 0)
    label = first_label(*[(F.col("group") == i, text) for i, text in REDACTED_GROUPS.items()], default=F.col("label"))
    return format_table(table.withColumn("label", label), ["group", "label"])


def report_levels(grouped: DataFrame) -> DataFrame:
    """Levels as the characteristics table shows them; a condition shows one level named after itself."""
    c = F.col
    levels = {
        "ageband3": band(c("age"), *AGE3),
        "time_since_fully_vaccinated": band(c("follow_up_time"), *SINCE),
        "time_between_vaccinations": band(c("tbv"), *BETWEEN),
        "bpcat": first_label((c("bpcat") == "Normal", "Normal"), (c("bpcat").isin("Elevated", "High"), "Elevated/high"), default="Unknown"),
    }
    categories = {v: F.coalesce(levels.get(v, c(v)), F.lit(UNKNOWN_LABELS.get(v, "Unknown"))) for v in CATEGORIES}
    return grouped.withColumns(categories | {v: F.when(c(v) == 1, F.lit(v)) for v in CONDITIONS})


def long_levels(levels: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per person, variable and level, with the measure columns beside it."""
    carried = ["follow_up_time", "tests_conducted_any", "tests_conducted_positive", *[c for pair in OUTCOMES.values() for c in pair]]
    return levels.select(*carried, *variables).unpivot(carried, list(variables), "variable", "level").where(F.col("level").isNotNull())


def characteristics(
    grouped: DataFrame, variables: Sequence[str] = (*CATEGORIES, *CONDITIONS), hidden_levels: Iterable[tuple[str, str]] = tuple(HIDDEN_LEVELS),
    per: int = 1000,
) -> DataFrame:
    """All measures at every level of all variables: one pass over people, one row per level out."""
    cells = measure_cells(long_levels(report_levels(grouped), variables), ["variable", "level"], min_time=-1)
    totals = cells.groupBy("variable", "level").agg(*measure_totals())
    return drop_pairs(finish_measures(totals, per), "variable", "level", hidden_levels)


def characteristics_redacted(grouped: DataFrame, threshold: int = 8, **options) -> DataFrame:
    return format_table(redact(characteristics(grouped, **options), threshold), ["variable", "level"])


CKD_OPTIONS = {"variables": ["chronic_kidney_disease"], "hidden_levels": [("chronic_kidney_disease", "Unknown")]}


def events_by_level(cohort: DataFrame, factor: str) -> DataFrame:
    """Events of the four outcomes per level, one row per level and outcome."""
    events = [event for event, _ in OUTCOMES.values()]
    return cohort.groupBy(factor).agg(*[F.sum(F.col(e).cast("bigint")).alias(e) for e in events]).unpivot(
        [factor], events, "outcome_name", "events")


def ckd_hazards(cohort: DataFrame, levels: Sequence[str] = tuple(CKD_LEVELS), redacted: bool = True, threshold: int = 8) -> DataFrame:
    """Hazard ratios by kidney-disease stage with the number of events, unadjusted and age adjusted."""
    factor = "chronic_kidney_disease"
    fitted = cox_ph(cohort, [Outcome(event, event, time) for event, time in OUTCOMES.values()], factor, levels)
    events = events_by_level(cohort, factor)
    table = left_join_on(fitted, events, {"outcome": "outcome_name", "term": F.concat(F.lit(factor), F.col(factor))}).drop(factor)
    if redacted:
        shown_columns = ["estimate", "conf_low", "conf_high", "p_value"]
        table = table.withColumns({c: F.when(F.col("events") >= threshold, F.col(c)) for c in shown_columns})
        table = round_counts(table, ["events"])
    return table.select("outcome", "model", "term", "events", "estimate", "conf_low", "conf_high", "p_value")


def adjusted_rates(
    grouped: DataFrame, levels: Sequence[str] = (*CKD_LEVELS, "Unknown"), per: int = 10000,
    critical_care_time: str = "time_to_hospitalisation",
) -> DataFrame:
    """Crude and age-adjusted rates of the four outcomes by kidney-disease stage."""
    factor = "chronic_kidney_disease"
    base = characteristics(grouped, [factor], [], per)
    parts = []
    for name, (event, time) in OUTCOMES.items():
        time = critical_care_time if name == "critical_care" else time
        rates = age_adjusted_rates(grouped, event, time, [factor], levels, per)
        parts.append(rates.select("variable", "level", *[F.round(c, 2).alias(f"{c}_{name}") for c in RATE_COLUMNS]))
        if time != OUTCOMES[name][1]:
            swapped = crude_rate(grouped, event, time, [factor], per)
            base = base.drop(*[f"{k}_{name}" for k in ("events", "py", "rate", "lower", "upper")]).join(
                swapped.withColumnsRenamed({k: f"{k}_{name}" for k in ("events", "py", "rate", "lower", "upper")}),
                ["variable", "level"], "left")
    return chain_left_joins(base, parts, ["variable", "level"])


def adjusted_rates_redacted(grouped: DataFrame, **options) -> DataFrame:
    return format_table(redact(adjusted_rates(grouped, **options), adjusted=True), ["variable", "level"], adjusted=True)
