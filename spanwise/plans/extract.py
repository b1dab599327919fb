"""Full extraction: record tables in, one wide row per eligible person out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.functions.dates import as_date, completed_years, days_after, years_after, years_before
from spanwise.functions.logic import first_label, is_true, satisfying
from spanwise.functions.numbers import round_to_base
from spanwise.operators import features as ft
from spanwise.operators import spells
from spanwise.operators.features import PERSON, Feature
from spanwise.session import broadcast_if_small, dealt, hold_small, tasks_for
from spanwise.sources import codelists as cl

#: Areas ranked for deprivation; fifths are cut at multiples of a fifth of it.
DEPRIVATION_RANKS = 32844

# Conditions whose last recorded date on or before the second dose is returned.
DATED_CONDITIONS = [
    "asthma", "asplenia", "cancer", "haem_cancer", "diabetes", "dialysis", "chd",
    "immunosuppression_diagnosis_date", "learning_disability", "cld",
    "chronic_neuro_dis_inc_sig_learn_dis", "chronic_resp_dis", "sev_mental_ill",
    "kidney_transplant", "other_organ_transplant",
]


# Coding system, code column and category column of each code file of the study.
CODE_FILES: dict[str, tuple[str, str, str | None]] = {
    "covid_vaccine": ("snomed", "code", None),
    "covid_identification": ("icd10", "icd10_code", None),
    "care_home": ("snomed", "code", None),
    "ethnicity": ("snomed", "code", "grouping_6_id"),
    "smoking": ("ctv3", "CTV3Code", "Category"),
    "asthma": ("snomed", "code", None),
    "asplenia": ("snomed", "code", None),
    "lung_cancer": ("ctv3", "CTV3ID", None),
    "haem_cancer": ("ctv3", "CTV3ID", None),
    "other_cancer": ("ctv3", "CTV3ID", None),
    "chd": ("snomed", "code", None),
    "chronic_neuro_dis_inc_sig_learn_dis": ("snomed", "code", None),
    "chronic_resp_dis": ("snomed", "code", None),
    "dialysis": ("ctv3", "CTV3ID", None),
    "diabetes": ("snomed", "code", None),
    "immunosuppression_diagnosis_date": ("snomed", "code", None),
    "immunosuppression_medication": ("snomed", "code", None),
    "learning_disability": ("snomed", "code", None),
    "cld": ("snomed", "code", None),
    "sev_mental_ill": ("snomed", "code", None),
    "kidney_transplant": ("ctv3", "CTV3ID", None),
    "other_organ_transplant": ("ctv3", "CTV3ID", None),
    "covid_case": ("ctv3", "CTV3ID", None),
    "covid_case_test": ("ctv3", "CTV3ID", None),
    "covid_case_sequelae": ("ctv3", "CTV3ID", None),
}
# Lists of a few codes.
SHORT_LISTS: dict[str, tuple[str, list[str]]] = {
    "high_risk": ("snomed", ["1300561000000107"]),
    "lower_risk": ("snomed", ["1300591000000101", "1300571000000100"]),
    "bp_sys": ("ctv3", ["2469."]),
    "bp_dias": ("ctv3", ["246A."]),
    "creatinine": ("ctv3", ["XE2q5"]),
}
#: Lists put together from others.
COMBINED_LISTS = {
    "cancer": ["lung_cancer", "other_cancer"],
    "prior_covid": ["covid_case", "covid_case_test", "covid_case_sequelae"],
}


def with_combined_lists(base: DataFrame) -> DataFrame:
    parts = [cl.combine(base, name, names) for name, names in COMBINED_LISTS.items()]
    return reduce(DataFrame.unionByName, [base, *parts, cl.filter_category(base, "smoking", ["S", "E"], "smoking_ever")])


def study_codelists(spark: SparkSession, paths: Mapping[str, str], bmi_codes: Sequence[str], bmi_system: str = "snomed") -> DataFrame:
    """All lists of the study from code files (name -> path); fails when a list has no code."""
    files = [cl.CodelistFile(name, paths[name], *CODE_FILES[name]) for name in CODE_FILES if name in paths]
    short = cl.inline(spark, SHORT_LISTS | {"bmi": (bmi_system, list(bmi_codes))})
    full = hold_small(with_combined_lists(cl.load(spark, files).unionByName(short)))
    absent = sorted(row.codelist for row in cl.missing(full, [*CODE_FILES, *SHORT_LISTS, "bmi"]).collect())
    if absent:
        raise ValueError(f"code lists without codes: {', '.join(absent)}")
    return full


@dataclass(frozen=True)
class Records:
    """Record tables. Event tables carry ``patient_id event_date event_id system code value``."""

    people: DataFrame            # patient_id, sex, birth_date
    vaccinations: DataFrame      # event table + health_worker flag
    clinical: DataFrame          # event table
    medications: DataFrame       # event table
    tests: DataFrame             # patient_id, event_date, event_id, positive
    admissions: DataFrame        # event table; value = days in critical care
    deaths: DataFrame            # patient_id, event_date, event_id, system, code
    registrations: DataFrame     # patient_id, spell_id, start_date, end_date, region
    addresses: DataFrame         # patient_id, spell_id, start_date, end_date, deprivation_rank
    hospital_ethnicity: DataFrame  # patient_id, ethnic_group


@dataclass(frozen=True)
class StudyDates:
    campaign_start: str
    end: str
    age_on: str
    dose_gap_days: int = 15
    immune_days: int = 14


def dose_index(records: Records, codelists: DataFrame, dates: StudyDates) -> DataFrame:
    """People with their first and second dose."""
    given = ft.matching(records.vaccinations, codelists, "covid_vaccine")
    first = ft.first_dose(given, as_date(dates.campaign_start), as_date(dates.end))
    return ft.next_dose(given, first, dates.dose_gap_days, as_date(dates.end))


def deprivation_fifth(rank: Column) -> Column:
    fifth = [DEPRIVATION_RANKS * k / 5 for k in range(1, 5)]
    return first_label(
        ((rank >= 1) & (rank < fifth[0]), "1"),
        ((rank >= fifth[0]) & (rank < fifth[1]), "2"),
        ((rank >= fifth[1]) & (rank < fifth[2]), "3"),
        ((rank >= fifth[2]) & (rank < fifth[3]), "4"),
        (rank >= fifth[3], "5"),
        default="0",
    )


def bmi_class(value: Column) -> Column:
    return first_label(
        ((value >= 30) & (value < 35), "Obese I (30-34.9)"),
        ((value >= 35) & (value < 40), "Obese II (35-39.9)"),
        ((value >= 40) & (value < 100), "Obese III (40+)"),
        default="Not obese",
    )


def smoking_class(latest: Column, ever: Column) -> Column:
    ever = is_true(ever)
    return first_label(
        (latest == "S", "S"),
        ((latest == "E") | ((latest == "N") & ever), "E"),
        ((latest == "N") & ~ever, "N"),
        default="M",
    )


def bmi_lower_bound(second_dose: Column, birth: Column) -> Column:
    """Measured in the five years before the second dose (no later limit) and at age 16 or more."""
    return F.when(birth.isNotNull(), F.greatest(years_before(second_dose, 5), years_after(birth, 16)))


def clinical_feature_list(d2: Column, birth: Column, immune: Column) -> list[Feature]:
    feats = [Feature(c, c, "last_date", upper=d2) for c in DATED_CONDITIONS]
    year_before = years_before(d2, 1)
    feats += [
        Feature("care_home", "care_home", "flag", upper=d2),
        Feature("high_risk_date", "high_risk", "last_date"),
        Feature("lower_risk_date", "lower_risk", "last_date"),
        Feature("bmi_value", "bmi", "last_value", lower=bmi_lower_bound(d2, birth)),
        Feature("smoking_code", "smoking", "last_category", upper=d2),
        Feature("ever_smoked", "smoking_ever", "flag", upper=d2),
        Feature("ethnicity_6", "ethnicity", "last_category"),
        Feature("bp_sys", "bp_sys", "latest_day_mean", upper=d2),
        Feature("bp_sys_date", "bp_sys", "latest_day", upper=d2),
        Feature("bp_dias", "bp_dias", "latest_day_mean", upper=d2),
        Feature("bp_dias_date", "bp_dias", "latest_day", upper=d2),
        Feature("creatinine", "creatinine", "last_value", lower=year_before, upper=d2),
        Feature("creatinine_date", "creatinine", "last_date", lower=year_before, upper=d2),
        Feature("prior_primary_care_covid_case_date", "prior_covid", "first_date", upper=immune),
    ]
    return feats


def death_features(index: DataFrame, deaths: DataFrame, codelists: DataFrame, dates: StudyDates) -> DataFrame:
    d2, immune, end = F.col("dose_2"), days_after(F.col("dose_2"), dates.immune_days), as_date(dates.end)
    codes = codelists.where(F.col("codelist") == "covid_identification").select("system", "code")
    marked = deaths.join(broadcast_if_small(codes.withColumn("covid", F.lit(True))), ["system", "code"], "left")
    rules = {"any": F.lit(True), "covid": is_true(F.col("covid"))}
    return ft.rule_features(index, marked, rules, [
        Feature("death_date", "any", "first_date", d2, end),
        Feature("death_date_post_vax", "any", "first_date", immune, end),
        Feature("death_date_post_vax2", "any", "first_date", d2, immune),
        Feature("certificate_date", "covid", "first_date", immune, end),
        Feature("certificate_date_early", "covid", "first_date", d2, immune),
    ])


def test_feature_list(d2: Column, immune: Column, end: Column) -> list[Feature]:
    """Needs the death dates in the index, around which positive tests are looked for."""
    late, early = F.col("death_date_post_vax"), F.col("death_date_post_vax2")
    return [
        Feature("covid_positive_test_date", "test_positive", "first_date", immune, end),
        Feature("covid_positive_test_within_2_weeks_post_vax2", "test_positive", "flag", d2, immune),
        Feature("positive_before_death", "test_positive", "flag", F.date_sub(late, 28), late),
        Feature("positive_before_early_death", "test_positive", "flag", F.date_sub(early, 28), early),
        Feature("prior_positive_test_date", "test_positive", "first_date", upper=immune),
        Feature("tests_conducted_any", "test_any", "count", immune, end),
        Feature("tests_conducted_positive", "test_positive", "count", immune, end),
    ]


def admission_feature_list(d2: Column, immune: Column, end: Column) -> list[Feature]:
    tag = "admission_covid_identification"
    return [
        Feature("covid_hospital_admission_date", tag, "first_date", immune, end),
        Feature("covid_hospitalisation_within_2_weeks_post_vax2", tag, "flag", d2, immune),
        Feature("covid_hospitalisation_critical_care", tag, "first_value", immune, end),
        Feature("prior_covidadmitted_date", tag, "first_date", upper=immune),
    ]


def record_tasks(records: Records) -> int | None:
    """Tasks for steps over the records, from counts of the tables that are read without a join as a rule."""
    kinds = (records.vaccinations, records.clinical, records.registrations, records.addresses)
    return tasks_for(records.people.sparkSession, sum(df.count() for df in kinds))


def record_features(index: DataFrame, records: Records, codelists: DataFrame, dates: StudyDates, tasks: int | None = None) -> DataFrame:
    """Features of tests, admissions, clinical records and medications in one join and one aggregation."""
    d2, immune, end = F.col("dose_2"), days_after(F.col("dose_2"), dates.immune_days), as_date(dates.end)
    tests = test_feature_list(d2, immune, end)
    admissions = admission_feature_list(d2, immune, end)
    clinical = clinical_feature_list(d2, F.col("birth_date"), immune)
    medications = [Feature("immunosuppression_medication_date", "immunosuppression_medication", "last_date", upper=d2)]
    labels = ft.category_labels(codelists, clinical)
    clinical_lists = sorted({f.tag for f in clinical})
    near = ft.reach(index, clinical, *[[f for f in tests if f.tag == tag] for tag in ("test_any", "test_positive")], admissions, medications)
    # each rule has windows of its own: of the tests before all follow-up only the positive ones are looked at
    test_rules = {"test_any": near.on(1), "test_positive": near.on(2) & F.col("positive")}

    def kept(events: DataFrame, group: int, wanted: Column | None = None) -> DataFrame:
        """What the windows can hold, dealt by person and day before a record is repeated for each of its lists."""
        return dealt(near.cut(events, group, wanted), tasks, PERSON, "event_date")

    days = ft.pool(
        ft.fold_days(ft.tag_by_codelist(kept(records.clinical, 0), codelists, clinical_lists, labels=labels), clinical),
        ft.fold_rules(kept(records.tests, 1, test_rules["test_any"] | test_rules["test_positive"]), test_rules),
        ft.fold_days(ft.tag_by_codelist(kept(records.admissions, 3), codelists, ["covid_identification"], "admission_"), admissions),
        ft.fold_days(ft.tag_by_codelist(kept(records.medications, 4), codelists, ["immunosuppression_medication"]), medications),
    )
    return ft.found(index, days, [*tests, *admissions, *clinical, *medications], labels, tasks)


def cohort_extract(
    records: Records,
    codelists: DataFrame,
    dates: StudyDates,
    stage: Callable[[DataFrame, str], DataFrame] = lambda df, label: df,
    tasks: int | None = None,
) -> DataFrame:
    """The wide extract. ``stage`` may store the frames that several joins start from, best in buckets of the person.

    Doses and registrations are read once, each for several answers. What depends on the doses alone comes with the
    index; what needs the death dates follows in the last stage. ``tasks`` (see ``record_tasks``) keeps the records of a
    task bounded; ``stage`` should store as many buckets.
    """
    doses = ft.dose_answers(records.vaccinations, codelists, "covid_vaccine", as_date(dates.campaign_start), as_date(dates.end),
                            dates.dose_gap_days, "health_worker", tasks).where(F.col("dose_2").isNotNull()).withColumnRenamed("health_worker", "hscworker")
    if tasks is not None:  # a stage of its own: every sort and aggregation of a task holds memory until the task ends
        doses = stage(doses, "doses")
    d2, immune, end = F.col("dose_2"), days_after(F.col("dose_2"), dates.immune_days), as_date(dates.end)
    eligible = spells.registration_answers(doses, records.registrations, immune, d2, "region", d2, end, "dereg_date", tasks)
    index = stage(eligible.join(records.people, PERSON, "left"), "index")
    known = stage(ft.join_all(
        index, death_features(index, records.deaths, codelists, dates),
        spells.attribute_as_of(index, records.addresses, d2, "deprivation_rank", "deprivation_rank", tasks)), "known")

    wide = ft.join_all(
        known,
        record_features(known, records, codelists, dates, tasks),
        ft.most_frequent_code(records.hospital_ethnicity, "ethnic_group", "ethnicity_6_sus", tasks),
    )
    wide = ft.with_defaults(
        wide, [*test_feature_list(d2, immune, end), *admission_feature_list(d2, immune, end),
               *clinical_feature_list(d2, F.col("birth_date"), immune)])
    early_positive = F.col("covid_positive_test_within_2_weeks_post_vax2")
    early_admission = F.col("covid_hospitalisation_within_2_weeks_post_vax2")
    rank = round_to_base(F.col("deprivation_rank").cast("double"), 100.0)
    return wide.select(
        PERSON,
        "covid_positive_test_date",
        early_positive,
        satisfying([F.col("covid_positive_test_date").isNotNull()], [early_positive]).alias("covid_positive_test"),
        satisfying([F.col("covid_hospital_admission_date").isNotNull()], [early_positive, early_admission])
        .alias("covid_hospital_admission"),
        "covid_hospital_admission_date",
        early_admission,
        F.coalesce(F.col("covid_hospitalisation_critical_care"), F.lit(0.0)).cast("int")
        .alias("covid_hospitalisation_critical_care"),
        satisfying([F.col("certificate_date").isNotNull()], [early_positive, early_admission])
        .alias("death_with_covid_on_the_death_certificate"),
        satisfying([F.col("death_date_post_vax").isNotNull(), F.col("positive_before_death")],
                   [early_positive, early_admission]).alias("death_with_28_days_of_covid_positive_test"),
        satisfying([F.col("certificate_date_early").isNotNull(), F.col("positive_before_early_death")])
        .alias("covid_death_within_2_weeks_post_vax2"),
        "dereg_date", "death_date", "care_home",
        satisfying([F.col("high_risk_date").isNotNull()], [F.col("lower_risk_date") >= F.col("high_risk_date")])
        .alias("shielded"),
        is_true(F.col("hscworker")).alias("hscworker"),
        completed_years(F.col("birth_date"), as_date(dates.age_on)).alias("age"),
        "sex",
        bmi_class(F.col("bmi_value")).alias("bmi"),
        smoking_class(F.col("smoking_code"), F.col("ever_smoked")).alias("smoking_status"),
        "ethnicity_6", "ethnicity_6_sus",
        deprivation_fifth(rank).alias("imd"),
        "region",
        *DATED_CONDITIONS,
        "immunosuppression_medication_date",
        "bp_sys", "bp_dias", F.date_format("bp_sys_date", "yyyy-MM").alias("bp_sys_month"),
        F.date_format("bp_dias_date", "yyyy-MM").alias("bp_dias_month"),
        "creatinine", "creatinine_date",
        F.col("dose_1").alias("covid_vax_1_date"), F.col("dose_2").alias("covid_vax_2_date"),
        "prior_positive_test_date", "prior_primary_care_covid_case_date", "prior_covidadmitted_date",
        F.col("tests_conducted_any").cast("double").alias("tests_conducted_any"),
        F.col("tests_conducted_positive").cast("double").alias("tests_conducted_positive"),
    )
