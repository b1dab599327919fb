"""Per-person extraction relative to index dates."""

from pyspark.sql import functions as F

from registry import records as rec
from registry.base import add, rounded
from registry.sql import END, category_case, codes, on_extract, on_records, to_base
from spanwise.functions.dates import as_date, completed_years, days_after, years_before
from spanwise.functions.numbers import round_to_base
from spanwise.operators import features as ft
from spanwise.operators import spells
from spanwise.operators.features import Feature
from spanwise.plans.extract import (
    DATED_CONDITIONS, bmi_class, bmi_lower_bound, deprivation_fifth, smoking_class,
)


def d2():
    return F.col("dose_2")


def d2_14():
    return days_after(d2(), 14)


def stop():
    return as_date(rec.DATES.end)


def _clinical(st, *features):
    return ft.coded_features(st.index, st.records("clinical"), st.codelists, list(features))


def _tests(st, *features, index=None):
    rules = {"any": F.lit(True), "positive": F.col("positive")}
    return ft.rule_features(index if index is not None else st.index, st.records("tests"), rules, list(features))


def per_person(table: str, **columns: str) -> str:
    """SQL with one aggregate per output column over the records of each person with both doses."""
    out = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return on_records(f"SELECT d.patient_id, {out} FROM doses d LEFT JOIN {table} e ON e.patient_id = d.patient_id GROUP BY d.patient_id")


# index dates -----------------------------------------------------------------------------------------------
add(
    "vaccination_first",
    lambda st: ft.first_dose(ft.matching(st.records("vaccinations"), st.codelists, "covid_vaccine"),
                             as_date(rec.DATES.campaign_start), stop()),
    on_records("SELECT patient_id, dose_1 FROM dose1"),
)


def _next(st):
    given = ft.matching(st.records("vaccinations"), st.codelists, "covid_vaccine")
    first = ft.first_dose(given, as_date(rec.DATES.campaign_start), stop())
    return ft.next_dose(given, first, 15, stop())


add("vaccination_next_chained", _next, on_records("SELECT * FROM all_doses"))
add(
    "record_flag",
    lambda st: ft.record_flag(st.records("vaccinations"), F.col("health_worker"), "hscworker"),
    on_records("SELECT patient_id, bool_or(health_worker) AS hscworker FROM vaccination GROUP BY 1"),
)

# windows -----------------------------------------------------------------------------------------------------
def _windows():
    return {
        "on_or_before": (None, d2()), "on_or_after": (d2(), None), "after_14_days": (d2_14(), stop()),
        "before_28_days": (F.date_sub(d2(), 28), d2()), "last_year": (years_before(d2(), 1), d2()),
        "last_5_years": (years_before(d2(), 5), None), "to_14_days": (None, d2_14()),
    }


_in = {
    "on_or_before": "e.event_date <= dose_2", "on_or_after": "e.event_date >= dose_2",
    "after_14_days": f"e.event_date BETWEEN dose_2 + 14 AND {END}", "before_28_days": "e.event_date BETWEEN dose_2 - 28 AND dose_2",
    "last_year": "e.event_date BETWEEN CAST(dose_2 - INTERVAL 1 YEAR AS DATE) AND dose_2",
    "last_5_years": "e.event_date >= CAST(dose_2 - INTERVAL 5 YEAR AS DATE)", "to_14_days": "e.event_date <= dose_2 + 14",
}
add(
    "relative_window_filter",
    lambda st: _clinical(st, *[Feature(name, "asthma", "count", *w) for name, w in _windows().items()]),
    per_person("clinical", **{n: f"count(*) FILTER (e.code IN {codes('asthma')} AND {w})" for n, w in _in.items()}),
)

# tests --------------------------------------------------------------------------------------------------------
add(
    "test_first_date",
    lambda st: _tests(st, Feature("covid_positive_test_date", "positive", "first_date", d2_14(), stop()),
                      Feature("prior_positive_test_date", "positive", "first_date", None, d2_14())),
    per_person("test", covid_positive_test_date=f"min(e.event_date) FILTER (positive AND e.event_date BETWEEN dose_2 + 14 AND {END})",
               prior_positive_test_date="min(e.event_date) FILTER (positive AND e.event_date <= dose_2 + 14)"),
)


def _with_death(st):
    died = st.records("deaths").groupBy("patient_id").agg(F.min("event_date").alias("died"))
    return st.index.join(died, "patient_id", "left")


add(
    "test_flag_in_window",
    lambda st: _tests(st, Feature("early", "positive", "flag", d2(), d2_14()),
                      Feature("before_death", "positive", "flag", F.date_sub(F.col("died"), 28), F.col("died")), index=_with_death(st)),
    on_records("""SELECT d.patient_id, coalesce(bool_or(positive AND t.event_date BETWEEN dose_2 AND dose_2 + 14), false) AS early,
    coalesce(bool_or(positive AND t.event_date BETWEEN x.event_date - 28 AND x.event_date), false) AS before_death
    FROM doses d LEFT JOIN death x ON x.patient_id = d.patient_id LEFT JOIN test t ON t.patient_id = d.patient_id GROUP BY 1"""),
)
add(
    "test_count_in_window",
    lambda st: _tests(st, Feature("tests_any", "any", "count", d2_14(), stop()), Feature("tests_positive", "positive", "count", d2_14(), stop())),
    per_person("test", tests_any=f"count(*) FILTER (e.event_date BETWEEN dose_2 + 14 AND {END})",
               tests_positive=f"count(*) FILTER (positive AND e.event_date BETWEEN dose_2 + 14 AND {END})"),
)

# admissions and deaths ---------------------------------------------------------------------------------------
_COVID = "covid_identification"
_IS_COVID = f"e.code IN {codes(_COVID)}"


def _admissions(st, *features):
    return ft.coded_features(st.index, st.records("admissions"), st.codelists, list(features))


add(
    "admission_first_date",
    lambda st: _admissions(st, Feature("admitted", _COVID, "first_date", d2_14(), stop()), Feature("admitted_before", _COVID, "first_date", None, d2_14())),
    per_person("admission", admitted=f"min(e.event_date) FILTER ({_IS_COVID} AND e.event_date BETWEEN dose_2 + 14 AND {END})",
               admitted_before=f"min(e.event_date) FILTER ({_IS_COVID} AND e.event_date <= dose_2 + 14)"),
)
add(
    "admission_flag",
    lambda st: _admissions(st, Feature("early", _COVID, "flag", d2(), d2_14())),
    per_person("admission", early=f"coalesce(bool_or({_IS_COVID} AND e.event_date BETWEEN dose_2 AND dose_2 + 14), false)"),
)
add(
    "admission_critical_care_days",
    lambda st: _admissions(st, Feature("days", _COVID, "first_value", d2_14(), stop())),
    per_person("admission", days=f"arg_min(e.value, e.seq) FILTER ({_IS_COVID} AND e.event_date BETWEEN dose_2 + 14 AND {END})"),
)
add(
    "death_certificate_date",
    lambda st: ft.coded_features(st.index, st.records("deaths"), st.codelists, [Feature("died", _COVID, "first_date", d2_14(), stop())]),
    per_person("death", died=f"min(e.event_date) FILTER ({_IS_COVID} AND e.event_date BETWEEN dose_2 + 14 AND {END})"),
)
add(
    "death_any_cause_date",
    lambda st: ft.rule_features(st.index, st.records("deaths"), {"any": F.lit(True)}, [
        Feature("died", "any", "first_date", d2(), stop()), Feature("died_early", "any", "first_date", d2(), d2_14())]),
    per_person("death", died=f"min(e.event_date) FILTER (e.event_date BETWEEN dose_2 AND {END})",
               died_early="min(e.event_date) FILTER (e.event_date BETWEEN dose_2 AND dose_2 + 14)"),
)

# spells ---------------------------------------------------------------------------------------------------------


def _everyone(st, part):
    return ft.join_all(st.index.select("patient_id"), part)


_HELD = "r.start_date <= dose_2{plus} AND (r.end_date IS NULL OR r.end_date > dose_2{plus})"
add(
    "deregistration_date",
    lambda st: _everyone(st, spells.deregistration_date(st.index, st.records("registrations"), d2(), stop(), "dereg_date")),
    on_records(f"""SELECT d.patient_id, CASE WHEN NOT bool_or(r.end_date IS NULL) AND max(r.end_date) BETWEEN any_value(dose_2) AND {END}
    THEN max(r.end_date) END AS dereg_date FROM doses d LEFT JOIN registration r ON r.patient_id = d.patient_id GROUP BY 1"""),
)
add(
    "registered_as_of",
    lambda st: spells.registered_as_of(st.index, st.records("registrations"), d2_14()).select("patient_id", "dose_2"),
    on_records(f"""SELECT patient_id, dose_2 FROM doses d WHERE EXISTS
    (SELECT 1 FROM registration r WHERE r.patient_id = d.patient_id AND {_HELD.format(plus=' + 14')})"""),
)


def _as_of(table: str, attribute: str, held: str) -> str:
    return f"""SELECT d.patient_id, v.{attribute} FROM doses d LEFT JOIN (SELECT * FROM (SELECT d.patient_id, r.{attribute},
    row_number() OVER (PARTITION BY d.patient_id ORDER BY r.start_date DESC, r.spell_id DESC) AS k FROM doses d
    JOIN {table} r ON r.patient_id = d.patient_id AND {held}) WHERE k = 1) v ON v.patient_id = d.patient_id"""


add(
    "practice_attr_as_of",
    lambda st: _everyone(st, spells.attribute_as_of(st.index, st.records("registrations"), d2(), "region", "region")),
    on_records(_as_of("registration", "region", _HELD.format(plus=""))),
)
add(
    "address_attr_as_of",
    lambda st: _everyone(st, spells.attribute_as_of(st.index, st.records("addresses"), d2(), "deprivation_rank", "deprivation_rank"))
    .withColumn("deprivation_rank", round_to_base(F.col("deprivation_rank").cast("double"), 100.0)),
    on_records(f"""SELECT patient_id, {to_base('CAST(deprivation_rank AS DOUBLE)', '100.0')} AS deprivation_rank
    FROM ({_as_of('address', 'deprivation_rank', 'r.start_date <= dose_2')})"""),
)

# coded events ---------------------------------------------------------------------------------------------------
add(
    "event_flag",
    lambda st: _clinical(st, Feature("care_home", "care_home", "flag", None, d2()), Feature("high_risk_ever", "high_risk", "flag"),
                         Feature("lower_risk_after", "lower_risk", "flag", d2(), None)),
    per_person("clinical", care_home=f"coalesce(bool_or(e.code IN {codes('care_home')} AND e.event_date <= dose_2), false)",
               high_risk_ever=f"coalesce(bool_or(e.code IN {codes('high_risk')}), false)",
               lower_risk_after=f"coalesce(bool_or(e.code IN {codes('lower_risk')} AND e.event_date >= dose_2), false)"),
)
add(
    "event_last_date",
    lambda st: _clinical(st, *[Feature(c, c, "last_date", None, d2()) for c in DATED_CONDITIONS]),
    per_person("clinical", **{c: f"max(e.event_date) FILTER (e.code IN {codes(c)} AND e.event_date <= dose_2)" for c in DATED_CONDITIONS}),
)
add(
    "event_first_date",
    lambda st: _clinical(st, Feature("first_case", "prior_covid", "first_date", None, d2_14())),
    per_person("clinical", first_case=f"min(e.event_date) FILTER (e.code IN {codes('prior_covid')} AND e.event_date <= dose_2 + 14)"),
)
_SMOKING = f"arg_max({category_case('smoking', 'e.code')}, e.seq) FILTER (e.code IN {codes('smoking')} AND e.event_date <= dose_2)"
_EVER = f"coalesce(bool_or(e.code IN {codes('smoking', ['S', 'E'])} AND e.event_date <= dose_2), false)"
add(
    "event_last_category",
    lambda st: _clinical(st, Feature("smoking", "smoking", "last_category", None, d2()), Feature("ethnicity", "ethnicity", "last_category")),
    per_person("clinical", smoking=_SMOKING,
               ethnicity=f"arg_max({category_case('ethnicity', 'e.code')}, e.seq) FILTER (e.code IN {codes('ethnicity')})"),
)
_YEAR = "e.event_date BETWEEN CAST(dose_2 - INTERVAL 1 YEAR AS DATE) AND dose_2"
_SCR = f"arg_max(e.value, e.seq) FILTER (e.code IN {codes('creatinine')} AND {_YEAR})"
_SCR_DATE = f"max(e.event_date) FILTER (e.code IN {codes('creatinine')} AND {_YEAR})"
add(
    "event_last_value",
    lambda st: rounded(_clinical(st, Feature("creatinine", "creatinine", "last_value", years_before(d2(), 1), d2())), "creatinine"),
    per_person("clinical", creatinine=f"round({_SCR}, 6)"),
)
add(
    "date_of",
    lambda st: rounded(_clinical(st, Feature("creatinine", "creatinine", "last_value", years_before(d2(), 1), d2()),
                                 Feature("creatinine_date", "creatinine", "last_date", years_before(d2(), 1), d2())), "creatinine"),
    per_person("clinical", creatinine=f"round({_SCR}, 6)", creatinine_date=_SCR_DATE),
)


def _after_date_of(st):
    found = _clinical(st, Feature("high_risk_date", "high_risk", "last_date"))
    index = st.index.join(found, "patient_id", "left")
    later = ft.coded_features(index, st.records("clinical"), st.codelists, [Feature("less_vulnerable", "lower_risk", "flag", F.col("high_risk_date"), None)])
    return found.join(later, "patient_id")


add(
    "date_of_as_bound",
    _after_date_of,
    on_records(f"""SELECT patient_id, hr AS high_risk_date, coalesce(lr >= hr, false) AS less_vulnerable FROM (SELECT d.patient_id,
    max(e.event_date) FILTER (e.code IN {codes('high_risk')}) AS hr, max(e.event_date) FILTER (e.code IN {codes('lower_risk')}) AS lr
    FROM doses d LEFT JOIN clinical e ON e.patient_id = d.patient_id GROUP BY 1)"""),
)
add(
    "medication_last_date",
    lambda st: ft.coded_features(st.index, st.records("medications"), st.codelists, [
        Feature("last_prescribed", "immunosuppression_medication", "last_date", None, d2())]),
    per_person("medication", last_prescribed=f"max(e.event_date) FILTER (e.code IN {codes('immunosuppression_medication')} AND e.event_date <= dose_2)"),
)


def _pressure(st):
    found = _clinical(st, Feature("bp_sys", "bp_sys", "latest_day_mean", None, d2()), Feature("bp_day", "bp_sys", "latest_day", None, d2()))
    return rounded(found, "bp_sys").withColumn("bp_month", F.date_format("bp_day", "yyyy-MM"))


add(
    "latest_day_mean",
    _pressure,
    on_records(f"""SELECT d.patient_id, round(arg_max(m, day), 6) AS bp_sys, max(day) AS bp_day, strftime(max(day), '%Y-%m') AS bp_month
    FROM doses d LEFT JOIN (SELECT e.patient_id, e.event_date AS day, avg(e.value) AS m FROM clinical e JOIN doses x ON x.patient_id = e.patient_id
    WHERE e.code IN {codes('bp_sys')} AND e.event_date <= dose_2 GROUP BY 1, 2) v ON v.patient_id = d.patient_id GROUP BY 1"""),
)


def _bmi(st):
    index = st.index.join(st.records("people"), "patient_id", "left")
    feature = Feature("bmi", "bmi", "last_value", bmi_lower_bound(d2(), F.col("birth_date")))
    return ft.coded_features(index, st.records("clinical"), st.codelists, [feature])


_BMI = f"""(SELECT d.patient_id, arg_max(e.value, e.seq) FILTER (e.code IN {codes('bmi')}
    AND e.event_date >= CAST(dose_2 - INTERVAL 5 YEAR AS DATE) AND e.event_date >= CAST(birth_date + INTERVAL 16 YEAR AS DATE)) AS bmi
    FROM doses d LEFT JOIN person p ON p.patient_id = d.patient_id LEFT JOIN clinical e ON e.patient_id = d.patient_id GROUP BY 1)"""
add("most_recent_bmi", lambda st: rounded(_bmi(st), "bmi"), on_records(f"SELECT patient_id, round(bmi, 6) AS bmi FROM {_BMI}"))
add(
    "most_frequent_code",
    lambda st: ft.most_frequent_code(st.records("hospital_ethnicity"), "ethnic_group", "ethnic_group"),
    on_records("""SELECT patient_id, ethnic_group FROM (SELECT patient_id, ethnic_group, row_number() OVER (PARTITION BY patient_id
    ORDER BY count(*) DESC, ethnic_group DESC) AS k FROM hospital_ethnicity GROUP BY patient_id, ethnic_group) WHERE k = 1"""),
)
add(
    "age_as_of",
    lambda st: st.records("people").select("patient_id", completed_years(F.col("birth_date"), as_date(rec.DATES.age_on)).alias("age")),
    on_records(f"SELECT patient_id, CAST(date_sub('year', birth_date, DATE '{rec.DATES.age_on}') AS INTEGER) AS age FROM person"),
)
add(
    "sex_lookup",
    lambda st: st.index.join(st.records("people").select("patient_id", "sex"), "patient_id", "left").select("patient_id", "sex"),
    on_records("SELECT d.patient_id, p.sex FROM doses d LEFT JOIN person p ON p.patient_id = d.patient_id"),
)
_SATISFIED = ["covid_positive_test", "covid_hospital_admission", "death_with_covid_on_the_death_certificate",
              "death_with_28_days_of_covid_positive_test", "covid_death_within_2_weeks_post_vax2", "shielded"]
add("satisfying", lambda st: st.extract.select("patient_id", *_SATISFIED), on_extract(f"SELECT patient_id, {', '.join(_SATISFIED)} FROM extract"))


def _categorised(st):
    smoking = _clinical(st, Feature("latest", "smoking", "last_category", None, d2()), Feature("ever", "smoking_ever", "flag", None, d2()))
    rank = spells.attribute_as_of(st.index, st.records("addresses"), d2(), "deprivation_rank", "rank")
    return ft.join_all(_bmi(st), smoking, rank).select(
        "patient_id", bmi_class(F.col("bmi")).alias("bmi"), smoking_class(F.col("latest"), F.col("ever")).alias("smoking_status"),
        deprivation_fifth(round_to_base(F.col("rank").cast("double"), 100.0)).alias("imd"),
    )


add(
    "categorised_as",
    _categorised,
    on_records(f"""SELECT b.patient_id, CASE WHEN bmi >= 30 AND bmi < 35 THEN 'Obese I (30-34.9)' WHEN bmi >= 35 AND bmi < 40 THEN 'Obese II (35-39.9)'
    WHEN bmi >= 40 AND bmi < 100 THEN 'Obese III (40+)' ELSE 'Not obese' END AS bmi,
    CASE WHEN latest = 'S' THEN 'S' WHEN latest = 'E' OR (latest = 'N' AND ever) THEN 'E' WHEN latest = 'N' THEN 'N' ELSE 'M' END AS smoking_status,
    CASE WHEN rank IS NULL OR rank < 1 THEN '0' ELSE CAST(least(floor(rank / (32844 / 5.0)), 4) + 1 AS INTEGER)::VARCHAR END AS imd
    FROM {_BMI} b JOIN (SELECT d.patient_id, {_SMOKING} AS latest, {_EVER} AS ever FROM doses d
    LEFT JOIN clinical e ON e.patient_id = d.patient_id GROUP BY 1) s ON s.patient_id = b.patient_id
    JOIN (SELECT patient_id, {to_base('CAST(deprivation_rank AS DOUBLE)', '100.0')} AS rank
    FROM ({_as_of('address', 'deprivation_rank', 'r.start_date <= dose_2')})) a ON a.patient_id = b.patient_id"""),
)
