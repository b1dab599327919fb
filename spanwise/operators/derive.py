"""Derived clinical and follow-up variables of the cohort."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.dates import time_to_event
from spanwise.functions.logic import band, first_label, if_known, present, row_max, row_min

# Labels by code, in level order.
ETHNICITY_LABELS = {
    "1": "White", "2": "Mixed", "3": "Asian or Asian British", "4": "Black or Black British",
    "5": "Other ethnic groups", "6": "Unknown",
}
IMD_LABELS = {"1": "1 most deprived", "2": "2", "3": "3", "4": "4", "5": "5 least deprived"}
REGION_LABELS = {
    "London": "London", "East": "East of England", "East Midlands": "East Midlands", "North East": "North East",
    "North West": "North West", "South East": "South East", "South West": "South West",
    "West Midlands": "West Midlands", "Yorkshire and The Humber": "Yorkshire and the Humber",
}
SEX_LABELS = {"F": "Female", "M": "Male"}

# Age bands.
AGE_BREAKS, AGE_BANDS = [16, 70, 80, float("inf")], ["16-69", "70-79", "80+"]
OLD_AGE_BREAKS = [16, 80, 85, 90, 95, float("inf")]
OLD_AGE_BANDS = ["16-79", "80-84", "85-89", "90-94", "95+"]

# Conditions reported as a 0/1 flag of a recorded date.
FLAGGED_CONDITIONS = [
    "asthma", "asplenia", "cancer", "diabetes", "chd", "haem_cancer", "learning_disability", "cld",
    "chronic_neuro_dis_inc_sig_learn_dis", "chronic_resp_dis", "sev_mental_ill",
]

# Constants of the creatinine equation for kidney function, by sex.
EGFR = {"Male": {"kappa": 0.9, "alpha": -0.411}, "Female": {"kappa": 0.7, "alpha": -0.329}}
UMOL_PER_MG = 88.4
CREATININE_RANGE = (20, 3000)

# Priority groups in order of precedence.
PRIORITY_GROUPS = [
    "Care home (priority group 1)",
    "80+ (priority group 2)",
    "Health/care workers (priority groups 1-2)",
    "70-79 (priority groups 3-4)",
    "Shielding (age 16-69) (priority group 4)",
    "50-69 (priority groups 5-9)",
    "Others not in the above groups (under 50)",
]


def relabel(column: Column, labels: dict[str, str]) -> Column:
    return first_label(*[(column == code, label) for code, label in labels.items()])


def positive_test_outcome(date: Column, study_end: Column) -> dict[str, Column]:
    """The positive-test date is dropped when it lies after the end of the study."""
    kept = if_known(date > study_end, F.lit(None).cast("date"), date)
    return {"covid_positive_test_date": kept, "covid_positive_test": present(kept)}


def admission_outcome(admitted: Column, date: Column, critical_days: Column) -> dict[str, Column]:
    """Admission date only with the flag; critical care stays unknown when the day count is unknown."""
    kept = if_known(admitted == 1, date, F.lit(None).cast("date"))
    critical = if_known((critical_days > 0) & (admitted == 1), F.lit(1), F.lit(0))
    return {
        "covid_hospital_admission_date": kept,
        "covid_hospitalisation_critical_care": critical,
        "covid_hospitalisation_critical_care_date": if_known(critical == 1, kept, F.lit(None).cast("date")),
    }


def death_outcome(certificate: Column, within_28_days: Column, date: Column) -> dict[str, Column]:
    either = (certificate == 1) | (within_28_days == 1)
    return {
        "covid_death": if_known(either, F.lit(1), F.lit(0)),
        "covid_death_date": if_known(either, date, F.lit(None).cast("date")),
    }


def censor_date(death: Column, left: Column, study_end: Column) -> Column:
    return row_min(death, left, study_end)


def strict_event(event: Column, event_date: Column, censor: Column) -> Column:
    """Option: an event after the end of follow-up does not count."""
    return F.when(event_date > censor, F.lit(0)).otherwise(event)


def care_home_65plus(care_home: Column, age: Column) -> Column:
    return if_known((care_home == 1) & (age >= 65), F.lit(1), F.lit(0))


def shielded_16_69(shielded: Column, age: Column) -> Column:
    return if_known((shielded == 1) & (age >= 16) & (age < 70), F.lit(1), F.lit(0))


def community_age_band(age: Column, care_home: Column) -> Column:
    """Age band of people outside care homes; unknown for care-home residents."""
    return if_known(care_home == 1, F.lit(None).cast("string"), band(age, AGE_BREAKS, AGE_BANDS))


def blood_pressure_class(systolic: Column, diastolic: Column) -> Column:
    """Four classes; readings between the classes and missing readings are ``Unknown``."""
    return first_label(
        ((systolic < 120) & (diastolic < 80), "Normal"),
        ((systolic >= 120) & (systolic < 130) & (diastolic < 80), "Elevated"),
        ((systolic >= 130) & (diastolic >= 90), "High"),
        default="Unknown",
    )


def plausible_creatinine(creatinine: Column) -> Column:
    low, high = CREATININE_RANGE
    return F.when((creatinine >= low) & (creatinine <= high), creatinine)


def egfr(creatinine: Column, age: Column, sex: Column, require_creatinine: bool = False) -> Column:
    """Estimated kidney function from creatinine in umol/l.

    A missing creatinine leaves both factors at 1 unless ``require_creatinine`` is set.
    """
    serum = plausible_creatinine(creatinine) / UMOL_PER_MG

    def factors(s: str) -> Column:
        ratio = serum / EGFR[s]["kappa"]
        low = F.pow(row_min(ratio, F.lit(1.0)), F.lit(EGFR[s]["alpha"]))
        return low * F.pow(row_max(ratio, F.lit(1.0)), F.lit(-1.209))

    base = F.when(sex == "Male", factors("Male")).when(sex == "Female", factors("Female"))
    value = base * 141.0 * F.pow(F.lit(0.993), age)
    value = F.when(sex == "Female", value * 1.018).otherwise(value)
    return F.when(plausible_creatinine(creatinine).isNotNull(), value) if require_creatinine else value


def ckd_stage(value: Column, dialysis: Column, kidney_transplant: Column) -> Column:
    """Stage by kidney function, unknown for people on dialysis or with a transplant."""
    stage = first_label(
        (value < 15, "Stage 5"), (value < 30, "Stage 4"), (value < 45, "Stage 3b"),
        (value < 60, "Stage 3a"), (value >= 60, "No CKD"),
    )
    return F.when(dialysis.isNull() & kidney_transplant.isNull(), stage)


def dialysis_history(dialysis: Column, kidney_transplant: Column) -> Column:
    return first_label(
        (dialysis.isNotNull() & kidney_transplant.isNull(), "No previous kidney transplant"),
        (dialysis > kidney_transplant, "Previous kidney transplant"),
    )


def transplant_history(kidney_transplant: Column, dialysis: Column, other: Column) -> Column:
    return first_label(
        (other.isNotNull(), "Other"),
        (kidney_transplant.isNotNull() & dialysis.isNull(), "No previous dialysis"),
        (kidney_transplant > dialysis, "Previous dialysis"),
    )


def prior_infection(dates: list[Column], dose_1: Column, dose_2: Column) -> Column:
    first = row_min(*dates)
    return first_label(
        (first < dose_1, "Prior to first dose"),
        ((first < dose_2) & (first >= dose_1), "Between first and second dose"),
    )


def priority_group() -> Column:
    """Group 1-7: the first rule that holds; unknown rules are passed over."""
    age = F.col("age")
    return (
        F.when(F.col("care_home_65plus") == 1, 1)
        .when(F.col("ageband") == "80+", 2)
        .when(F.col("hscworker") == 1, 3)
        .when(F.col("ageband") == "70-79", 4)
        .when(F.col("shielded") == 1, 5)
        .when((age >= 50) & (age < 70), 6)
        .otherwise(7)
    )


def group_label(group: Column) -> Column:
    return first_label(*[(group == i, label) for i, label in enumerate(PRIORITY_GROUPS, 1)])


def with_priority_group(cohort: DataFrame) -> DataFrame:
    return cohort.withColumn("group", priority_group()).withColumn("follow_up_time", F.col("follow_up_time_vax2") - 14)


def derived_end_dates(extract: DataFrame, min_count: int = 5) -> DataFrame:
    """Per outcome, the latest date on which more than ``min_count`` people had it."""
    dated = ["covid_positive_test_date", "covid_hospital_admission_date", "death_date"]
    clean = extract.where(
        ~F.col("covid_positive_test_within_2_weeks_post_vax2")
        & ~F.col("covid_hospitalisation_within_2_weeks_post_vax2")
        & ~F.col("covid_death_within_2_weeks_post_vax2")
    )
    return (
        clean.unpivot([], dated, "variable", "value").where(F.col("value").isNotNull())
        .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_count)
        .groupBy("variable").agg(F.max("value").alias("end_date"), F.max_by("n", "value").alias("n"))
    )


def follow_up_times(study_end: Column) -> dict[str, Column]:
    """Follow-up and time-to-event columns from dose, outcome and censoring dates."""
    day_14 = F.date_add("covid_vax_2_date", 14)
    one, two = F.col("censor_date_1"), F.col("censor_date_2")
    return {
        "follow_up_time_vax1": time_to_event(F.col("covid_vax_1_date"), study_end, one),
        "follow_up_time_vax2": time_to_event(F.col("covid_vax_2_date"), study_end, one),
        "time_to_positive_test": time_to_event(day_14, F.col("covid_positive_test_date"), one),
        "time_to_hospitalisation": time_to_event(day_14, F.col("covid_hospital_admission_date"), two),
        "time_to_itu": time_to_event(day_14, F.col("covid_hospitalisation_critical_care_date"), two),
        "time_to_covid_death": time_to_event(day_14, F.col("covid_death_date"), one),
    }
