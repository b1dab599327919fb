"""Derivations, predicates and eligibility."""

from pyspark.sql import functions as F

from registry import records as rec
from registry.base import add, r
from registry.q_sources import GROUP_CASE
from registry.sql import half_even, on_cohort, on_extract, on_records, relabel, text
from spanwise.functions.dates import as_date, days_between, time_to_event
from spanwise.functions.logic import band, if_known, label_order, present, row_max, row_min, row_min_strict
from spanwise.functions.numbers import count_cell, parse_count_cell, percent_of, rate_cell, strata_label
from spanwise.operators import derive as d
from spanwise.operators.rates import rate_columns
from spanwise.operators.reshape import drop_pairs, melt, rename
from spanwise.plans.process import COHORT_COLUMNS, DROPPED_AFTER_EXCLUSION, derive_cohort, eligible, exclude
from spanwise.plans.tables import BETWEEN, SINCE, report_levels
from spanwise.sources.extract import FLAG_COLUMNS, flags_to_int



def C(name):
    return F.col(name)


def end():
    return as_date(rec.STUDY_END)


_END = f"DATE '{rec.STUDY_END}'"
add(
    "r_ifelse",
    lambda st: st.cleaned.select("patient_id", if_known(C("covid_hospitalisation_critical_care") > 2, F.lit("long"), F.lit("short")).alias("stay"),
                                 if_known((C("covid_hospitalisation_critical_care") > 0) & (C("covid_hospital_admission") == 1), F.lit(1), F.lit(0)).alias("critical")),
    on_cohort("""SELECT patient_id, CASE WHEN covid_hospitalisation_critical_care IS NULL THEN NULL
    WHEN covid_hospitalisation_critical_care > 2 THEN 'long' ELSE 'short' END AS stay,
    CASE WHEN covid_hospital_admission = 0 THEN 0 WHEN covid_hospitalisation_critical_care IS NULL THEN NULL ELSE 1 END AS critical FROM cleaned"""),
)


def _ordered(st):
    labels = list(d.ETHNICITY_LABELS.values())
    named = st.cleaned.select(d.relabel(F.coalesce("ethnicity_6", "ethnicity_6_sus", F.lit("6")), d.ETHNICITY_LABELS).alias("ethnicity"))
    counts = named.groupBy("ethnicity").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("level_order", label_order(C("ethnicity"), labels))


add("ordered_case_when", _ordered, on_extract(f"""SELECT e AS ethnicity, count(*) AS n,
CAST(list_position([{', '.join(f"'{x}'" for x in d.ETHNICITY_LABELS.values())}], e) AS BIGINT) AS level_order
FROM (SELECT {relabel("coalesce(ethnicity_6, ethnicity_6_sus, '6')", d.ETHNICITY_LABELS)} AS e FROM extract) GROUP BY 1"""))
add(
    "band",
    lambda st: st.cohort_all.select("patient_id", band(C("age"), d.AGE_BREAKS, d.AGE_BANDS).alias("ageband"),
                                    band(C("age"), d.OLD_AGE_BREAKS, d.OLD_AGE_BANDS).alias("ageband2"),
                                    band(C("follow_up_time_vax2") - 14, *SINCE).alias("since"), band(C("tbv"), *BETWEEN).alias("between_doses")),
    on_cohort("""SELECT patient_id, CASE WHEN age < 16 THEN NULL WHEN age < 70 THEN '16-69' WHEN age < 80 THEN '70-79' ELSE '80+' END AS ageband, ageband2,
    CASE WHEN f < 0 THEN NULL WHEN f < 28 THEN '0-4 weeks' WHEN f < 56 THEN '4-8 weeks' WHEN f < 84 THEN '8-12 weeks' ELSE '12+ weeks' END AS since,
    CASE WHEN tbv < 42 THEN '6 weeks or less' WHEN tbv < 84 THEN '6-12 weeks' ELSE '12 weeks or more' END AS between_doses
    FROM (SELECT *, follow_up_time_vax2 - 14 AS f FROM cohort_all)"""),
)
add(
    "time_to_event",
    lambda st: st.cleaned.select(
        "patient_id", time_to_event(C("covid_vax_2_date"), C("covid_positive_test_date"), C("dereg_date")).cast("bigint").alias("time"),
        time_to_event(C("covid_vax_2_date"), C("covid_positive_test_date"), C("dereg_date"), True).cast("bigint").alias("time_uncensored")),
    on_extract("""SELECT patient_id, least(covid_positive_test_date - covid_vax_2_date, dereg_date - covid_vax_2_date) AS time,
    covid_positive_test_date - covid_vax_2_date AS time_uncensored FROM extract"""),
)
_TIMES = ["follow_up_time_vax1", "follow_up_time_vax2", "time_to_positive_test", "time_to_hospitalisation", "time_to_itu", "time_to_covid_death"]
add("follow_up_times", lambda st: st.cohort_all.select("patient_id", *[C(t).cast("bigint").alias(t) for t in _TIMES]),
    on_cohort(f"SELECT patient_id, {', '.join(_TIMES)} FROM cohort_all"))
add(
    "row_min_max",
    lambda st: st.cleaned.select(
        "patient_id", row_min(C("prior_positive_test_date"), C("prior_primary_care_covid_case_date"), C("prior_covidadmitted_date")).alias("first"),
        row_max(C("immunosuppression_diagnosis_date"), C("immunosuppression_medication_date")).alias("last")),
    on_extract("""SELECT patient_id, least(prior_positive_test_date, prior_primary_care_covid_case_date, prior_covidadmitted_date) AS first,
    greatest(immunosuppression_diagnosis_date, immunosuppression_medication_date) AS last FROM extract"""),
)
add(
    "row_min_strict",
    lambda st: st.cleaned.select("patient_id", row_min_strict(C("death_date"), C("dereg_date"), C("covid_positive_test_date")).alias("first_of_all"),
                                 row_min_strict(C("covid_vax_1_date"), C("covid_vax_2_date")).alias("first_dose")),
    on_extract("""SELECT patient_id, CASE WHEN death_date IS NOT NULL AND dereg_date IS NOT NULL AND covid_positive_test_date IS NOT NULL
    THEN least(death_date, dereg_date, covid_positive_test_date) END AS first_of_all, covid_vax_1_date AS first_dose FROM extract"""),
)
add(
    "first_of_follow_up",
    lambda st: st.grouped.select("patient_id", row_min_strict(C("follow_up_time"), C("time_to_positive_test"), C("time_to_hospitalisation"),
                                                                    C("time_to_covid_death")).cast("bigint").alias("time")),
    on_cohort("SELECT patient_id, least(follow_up_time, time_to_positive_test, time_to_hospitalisation, time_to_covid_death) AS time FROM grouped"),
)
_PCT_SQL = half_even("CAST(t AS DOUBLE) / n * 100.0")
add(
    "percent_of_denominator",
    lambda st: st.grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("covid_positive_test") == 1).alias("t"))
    .select("group", percent_of(C("t"), C("n")).alias("pct"), percent_of(C("t"), F.lit(0)).alias("none")),
    on_cohort(f"""SELECT "group", {_PCT_SQL} AS pct, CAST(NULL AS DOUBLE) AS none FROM
    (SELECT "group", count(*) AS n, sum(covid_positive_test) AS t FROM grouped GROUP BY 1)"""),
)


def _levels(st):
    return melt(st.cohort.select("chronic_kidney_disease", "prior_covid_cat", "sex").fillna("Unknown"), [], ["chronic_kidney_disease", "prior_covid_cat", "sex"])


add(
    "drop_report_levels",
    lambda st: drop_pairs(_levels(st), "variable", "value", [("chronic_kidney_disease", "No CKD"), ("chronic_kidney_disease", "Unknown"), ("prior_covid_cat", "Unknown")])
    .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")),
    on_cohort("""SELECT variable, value, count(*) AS n FROM (SELECT 'chronic_kidney_disease' AS variable, chronic_kidney_disease AS value FROM cohort
    WHERE chronic_kidney_disease <> 'No CKD' UNION ALL SELECT 'prior_covid_cat', prior_covid_cat FROM cohort WHERE prior_covid_cat IS NOT NULL
    UNION ALL SELECT 'sex', sex FROM cohort) GROUP BY ALL"""),
)
add("bool_to_int", lambda st: flags_to_int(st.extract.select("patient_id", *FLAG_COLUMNS[:1], "covid_positive_test", "care_home", "shielded", "hscworker")),
    on_extract(f"SELECT patient_id, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in [FLAG_COLUMNS[0], 'covid_positive_test', 'care_home', 'shielded', 'hscworker'])} FROM extract"))


def _outcomes(st):
    out = d.positive_test_outcome(C("covid_positive_test_date"), end()) | d.admission_outcome(
        C("covid_hospital_admission"), C("covid_hospital_admission_date"), C("covid_hospitalisation_critical_care")
    ) | d.death_outcome(C("death_with_covid_on_the_death_certificate"), C("death_with_28_days_of_covid_positive_test"), C("death_date"))
    return st.cleaned.select("patient_id", *[c.alias(n) for n, c in out.items()])


add("outcome_dates", _outcomes, on_cohort("""SELECT patient_id, covid_positive_test_date, covid_positive_test, covid_hospital_admission_date,
covid_hospitalisation_critical_care, CASE WHEN covid_hospitalisation_critical_care = 1 THEN covid_hospital_admission_date END AS covid_hospitalisation_critical_care_date,
covid_death, CASE WHEN covid_death = 1 THEN death_date END AS covid_death_date FROM outcome"""))
add("admin_censor", lambda st: st.cleaned.select("patient_id", d.censor_date(C("death_date"), C("dereg_date"), end()).alias("censor_date")),
    on_extract(f"SELECT patient_id, least(death_date, dereg_date, {_END}) AS censor_date FROM extract"))
add(
    "strict_censoring",
    lambda st: derive_cohort(st.extract, rec.STUDY_END, strict_censoring=True).select("patient_id", "covid_positive_test", "covid_hospital_admission", "covid_death"),
    on_cohort("""SELECT patient_id, CASE WHEN covid_positive_test_date > censor_date_1 THEN 0 ELSE covid_positive_test END AS covid_positive_test,
    CASE WHEN covid_hospital_admission_date > censor_date_2 THEN 0 ELSE covid_hospital_admission END AS covid_hospital_admission,
    CASE WHEN covid_death = 1 AND death_date > censor_date_1 THEN 0 ELSE covid_death END AS covid_death FROM cohort_all"""),
)
_CLEAN = """NOT covid_positive_test_within_2_weeks_post_vax2 AND NOT covid_hospitalisation_within_2_weeks_post_vax2
AND NOT covid_death_within_2_weeks_post_vax2"""
_DATED = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS value FROM extract WHERE {_CLEAN}"
                            for c in ("covid_positive_test_date", "covid_hospital_admission_date", "death_date"))
add(
    "derived_end_date",
    lambda st: d.derived_end_dates(st.extract, 1),
    on_extract(f"""SELECT variable, max(value) AS end_date, arg_max(n, value) AS n FROM (SELECT variable, value, count(*) AS n FROM ({_DATED})
    WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY 1"""),
)
add("flag_from_date", lambda st: st.cleaned.select("patient_id", *[present(C(c)).alias(c) for c in d.FLAGGED_CONDITIONS]),
    on_extract(f"SELECT patient_id, {', '.join(f'CAST({c} IS NOT NULL AS INTEGER) AS {c}' for c in d.FLAGGED_CONDITIONS)} FROM extract"))
add(
    "age_limited_flags",
    lambda st: st.cleaned.select("patient_id", d.care_home_65plus(C("care_home"), C("age")).alias("care_home_65plus"),
                                 d.shielded_16_69(C("shielded"), C("age")).alias("shielded")),
    on_extract("""SELECT patient_id, CASE WHEN care_home AND age >= 65 THEN 1 ELSE 0 END AS care_home_65plus,
    CASE WHEN shielded AND age BETWEEN 16 AND 69 THEN 1 ELSE 0 END AS shielded FROM extract"""),
)
add("recode_demographics", lambda st: st.cohort_all.select("patient_id", "sex", "bmi", "smoking_status", "ethnicity", "imd", "region"),
    on_cohort("SELECT patient_id, sex, bmi, smoking_status, ethnicity, imd, region FROM cohort_all"))
add(
    "recode_report_levels",
    lambda st: report_levels(st.grouped).select("patient_id", "imd", "region", "bpcat", "ageband3"),
    on_cohort("""SELECT patient_id, coalesce(imd, 'Unknown') AS imd, coalesce(region, 'Unknown') AS region,
    CASE WHEN bpcat IN ('Elevated', 'High') THEN 'Elevated/high' ELSE bpcat END AS bpcat,
    CASE WHEN age < 30 THEN '16-29' WHEN age < 40 THEN '30-39' WHEN age < 50 THEN '40-49' WHEN age < 60 THEN '50-59' WHEN age < 70 THEN '60-69'
    WHEN age < 80 THEN '70-79' ELSE '80+' END AS ageband3 FROM grouped"""),
)
add("bp_category", lambda st: st.cleaned.select("patient_id", d.blood_pressure_class(C("bp_sys"), C("bp_dias")).alias("bpcat")),
    on_cohort("SELECT patient_id, bpcat FROM cohort_all"))
add(
    "egfr",
    lambda st: st.cleaned.withColumn("sex", d.relabel(C("sex"), d.SEX_LABELS)).select(
        "patient_id", r(d.egfr(C("creatinine"), C("age"), C("sex"))).alias("egfr"),
        r(d.egfr(C("creatinine"), C("age"), C("sex"), True)).alias("egfr_measured")),
    on_cohort("""SELECT patient_id, round(egfr, 6) AS egfr, CASE WHEN creatinine BETWEEN 20 AND 3000 THEN round(egfr, 6) END AS egfr_measured FROM kidney"""),
)
add("ckd_stage", lambda st: st.cohort_all.select("patient_id", "chronic_kidney_disease"), on_cohort("SELECT patient_id, chronic_kidney_disease FROM cohort_all"))
add("event_order_category", lambda st: st.cohort_all.select("patient_id", "dialysis", "transplant"), on_cohort("SELECT patient_id, dialysis, transplant FROM cohort_all"))
add("prior_event_category", lambda st: st.cohort_all.select("patient_id", "prior_covid_cat"), on_cohort("SELECT patient_id, prior_covid_cat FROM cohort_all"))
add("days_between", lambda st: st.index.select("patient_id", days_between(C("dose_1"), C("dose_2")).cast("bigint").alias("tbv")),
    on_records("SELECT patient_id, dose_2 - dose_1 AS tbv FROM doses"))
add("priority_cascade", lambda st: st.grouped.select("patient_id", "group", d.group_label(C("group")).alias("label")),
    on_cohort(f'SELECT patient_id, "group", {GROUP_CASE} AS label FROM grouped'))
_KEPT = [c for c in COHORT_COLUMNS if c not in DROPPED_AFTER_EXCLUSION]
add("column_select", lambda st: st.cohort_all.drop(*DROPPED_AFTER_EXCLUSION).select(*_KEPT), on_cohort(f"SELECT {', '.join(_KEPT)} FROM cohort_all"))
add(
    "rename",
    lambda st: rename(st.cohort_all.select("patient_id", "covid_positive_test", C("tbv").alias("days"), "ageband2"), {"covid_positive_test": "event", "ageband2": "level"}),
    on_cohort("SELECT patient_id, covid_positive_test AS event, tbv AS days, ageband2 AS level FROM cohort_all"),
)


def _pairs(st):
    return st.doses.select("patient_id", C("dose_1").alias("covid_vax_1_date"), C("dose_2").alias("covid_vax_2_date"))


add("eligibility_filter", lambda st: eligible(_pairs(st)),
    on_records("SELECT patient_id, dose_1 AS covid_vax_1_date, dose_2 AS covid_vax_2_date FROM all_doses WHERE dose_2 IS NOT NULL AND dose_2 > dose_1"))
add("exclusion_filter", lambda st: exclude(st.cohort_all).select("patient_id", "age", "sex"), on_cohort("SELECT patient_id, age, sex FROM cohort"))


def _cells(st):
    totals = st.grouped.groupBy("group").agg(F.sum(C("covid_positive_test").cast("bigint")).alias("events"), F.sum(C("time_to_positive_test").cast("bigint")).alias("days"))
    done = totals.withColumns(rate_columns(C("events"), C("days")))
    return done.select("group", count_cell(F.when(C("events") >= 20, C("events")), C("py")).alias("count"),
                       rate_cell(C("rate"), C("lower"), F.when(C("events") >= 20, C("upper"))).alias("rate"))


_RATE = "e * 365250.0 / t"
RATE_SQL = {"py": half_even("t / 365.25"), "rate": half_even(_RATE, 2),
            "lower": half_even(f"({_RATE}) * exp(-1.0 / sqrt(e))", 2), "upper": half_even(f"({_RATE}) * exp(1.0 / sqrt(e))", 2)}
add("format_cells", _cells, on_cohort(f"""SELECT "group", coalesce(CASE WHEN e >= 20 THEN CAST(CAST(e AS BIGINT) AS VARCHAR) END, '[REDACTED]') || ' (' || {text(RATE_SQL['py'])} || ')' AS count,
{text(RATE_SQL['rate'])} || ' (' || {text(RATE_SQL['lower'])} || '-' || coalesce(CASE WHEN e >= 20 THEN {text(RATE_SQL['upper'])} END, '[REDACTED]') || ')' AS rate
FROM (SELECT "group", CAST(sum(covid_positive_test) AS DOUBLE) AS e, CAST(sum(time_to_positive_test) AS DOUBLE) AS t FROM grouped GROUP BY 1)"""))
add(
    "parse_count_cell",
    lambda st: st.grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("covid_positive_test") == 1).alias("k"))
    .select("group", F.concat(F.format_number("n", 0), F.lit(" ("), F.format_number(C("k") / C("n") * 100, 1), F.lit("%)")).alias("cell"))
    .select("group", parse_count_cell(C("cell")).alias("n"), parse_count_cell(F.lit("Unknown")).alias("none")),
    on_cohort('SELECT "group", CAST(count(*) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS none FROM grouped GROUP BY 1'),
)
add(
    "strata_label",
    lambda st: st.grouped.groupBy(F.concat(F.lit("group="), d.group_label(C("group"))).alias("strata")).agg(F.count(F.lit(1)).alias("n"))
    .select(strata_label(C("strata")).alias("group"), "n"),
    on_cohort(f'SELECT {GROUP_CASE} AS "group", count(*) AS n FROM grouped GROUP BY 1'),
)
