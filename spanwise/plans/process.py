"""From the wide extract to the analysis cohort: one chain of projections and filters, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.functions.dates import as_date, days_between
from spanwise.functions.logic import band, if_known, present, row_max
from spanwise.operators import derive as d
from spanwise.sources.extract import flags_to_int, normalise_missing

# Columns of the full cohort.
COHORT_COLUMNS = [
    "patient_id", "covid_positive_test_date", "covid_hospital_admission_date", "death_date",
    "censor_date_1", "censor_date_2", "covid_vax_1_date", "covid_vax_2_date", "follow_up_time_vax1",
    "time_to_positive_test", "time_to_hospitalisation", "time_to_itu", "time_to_covid_death",
    "covid_positive_test", "covid_positive_test_within_2_weeks_post_vax2", "covid_hospital_admission",
    "covid_hospitalisation_critical_care", "covid_hospitalisation_within_2_weeks_post_vax2", "covid_death",
    "death_with_covid_on_the_death_certificate", "death_with_28_days_of_covid_positive_test",
    "covid_death_within_2_weeks_post_vax2", "care_home", "care_home_65plus", "shielded", "hscworker",
    "age", "ageband", "ageband2", "sex", "bmi", "smoking_status", "ethnicity", "imd", "region", "asthma",
    "asplenia", "bpcat", "cancer", "chronic_kidney_disease", "diabetes", "dialysis", "chd", "haem_cancer",
    "immunosuppression", "learning_disability", "cld", "chronic_neuro_dis_inc_sig_learn_dis",
    "chronic_resp_dis", "sev_mental_ill", "transplant", "follow_up_time_vax2", "tbv", "prior_covid_cat",
    "tests_conducted_any", "tests_conducted_positive",
]
# Columns that only the full cohort keeps.
DROPPED_AFTER_EXCLUSION = [
    "covid_positive_test_within_2_weeks_post_vax2", "covid_hospitalisation_within_2_weeks_post_vax2",
    "covid_death_within_2_weeks_post_vax2", "covid_positive_test_date", "covid_hospital_admission_date",
    "death_date", "censor_date_1",
]


def derive_cohort(
    extract: DataFrame, study_end: str, strict_censoring: bool = False, require_creatinine: bool = False
) -> DataFrame:
    """Full cohort (before exclusions): people with two doses in order.

    ``strict_censoring`` stops counting events dated after the end of a person's follow-up.
    """
    c = F.col
    end = as_date(study_end)
    base = flags_to_int(normalise_missing(extract))
    outcomes = base.withColumns(
        d.positive_test_outcome(c("covid_positive_test_date"), end)
        | d.admission_outcome(c("covid_hospital_admission"), c("covid_hospital_admission_date"),
                              c("covid_hospitalisation_critical_care"))
        | d.death_outcome(c("death_with_covid_on_the_death_certificate"),
                          c("death_with_28_days_of_covid_positive_test"), c("death_date"))
        | {
            "censor_date_1": d.censor_date(c("death_date"), c("dereg_date"), end),
            "censor_date_2": d.censor_date(c("death_date"), c("dereg_date"), end),
        }
    )
    timed = outcomes.withColumns(d.follow_up_times(end))
    if strict_censoring:
        timed = timed.withColumns({
            "covid_positive_test": d.strict_event(c("covid_positive_test"), c("covid_positive_test_date"), c("censor_date_1")),
            "covid_hospital_admission": d.strict_event(
                c("covid_hospital_admission"), c("covid_hospital_admission_date"), c("censor_date_2")),
            "covid_hospitalisation_critical_care": d.strict_event(
                c("covid_hospitalisation_critical_care"), c("covid_hospitalisation_critical_care_date"), c("censor_date_2")),
            "covid_death": d.strict_event(c("covid_death"), c("covid_death_date"), c("censor_date_1")),
        })
    coded = timed.withColumns({
        "care_home_65plus": d.care_home_65plus(c("care_home"), c("age")),
        "shielded": d.shielded_16_69(c("shielded"), c("age")),
        "ageband": d.community_age_band(c("age"), c("care_home")),
        "ageband2": band(c("age"), d.OLD_AGE_BREAKS, d.OLD_AGE_BANDS),
        "sex": d.relabel(c("sex"), d.SEX_LABELS),
        "bmi": if_known(c("bmi") == "Not obese", F.lit("Not obese"), F.lit("Obese")),
        "smoking_status": if_known(c("smoking_status").isin("S", "E"), F.lit("S&E"), F.lit("N&M")),
        "ethnicity": d.relabel(F.coalesce("ethnicity_6", "ethnicity_6_sus", F.lit("6")), d.ETHNICITY_LABELS),
        "imd": d.relabel(F.nullif(c("imd"), F.lit("0")), d.IMD_LABELS),
        "region": d.relabel(c("region"), d.REGION_LABELS),
        "bpcat": d.blood_pressure_class(c("bp_sys"), c("bp_dias")),
    })
    staged = coded.withColumn("egfr", d.egfr(c("creatinine"), c("age"), c("sex"), require_creatinine)).withColumns({
        "chronic_kidney_disease": d.ckd_stage(c("egfr"), c("dialysis"), c("kidney_transplant")),
        "dialysis": d.dialysis_history(c("dialysis"), c("kidney_transplant")),
        "transplant": d.transplant_history(c("kidney_transplant"), c("dialysis"), c("other_organ_transplant")),
        "immunosuppression": present(row_max(c("immunosuppression_diagnosis_date"), c("immunosuppression_medication_date"))),
        "tbv": days_between(c("covid_vax_1_date"), c("covid_vax_2_date")),
        "prior_covid_cat": d.prior_infection(
            [c("prior_positive_test_date"), c("prior_primary_care_covid_case_date"), c("prior_covidadmitted_date")],
            c("covid_vax_1_date"), c("covid_vax_2_date")),
        **{name: present(c(name)) for name in d.FLAGGED_CONDITIONS},
    })
    return eligible(staged.select(*COHORT_COLUMNS))


def eligible(cohort: DataFrame) -> DataFrame:
    """Both doses known and in order."""
    return cohort.where(F.col("covid_vax_2_date") > F.col("covid_vax_1_date"))


def exclude(cohort: DataFrame, min_follow_up: int = 14, ages: tuple[int, int] = (16, 110)) -> DataFrame:
    """Final cohort: enough follow-up, known age and sex, no outcome in the first two weeks."""
    kept = cohort.where(
        (F.col("follow_up_time_vax2") >= min_follow_up)
        & (F.col("age") >= ages[0]) & (F.col("age") < ages[1]) & F.col("sex").isNotNull()
        & (F.col("covid_positive_test_within_2_weeks_post_vax2") == 0)
        & (F.col("covid_hospitalisation_within_2_weeks_post_vax2") == 0)
        & (F.col("covid_death_within_2_weeks_post_vax2") == 0)
    )
    return kept.drop(*DROPPED_AFTER_EXCLUSION)
