from datetime import date

from pyspark.sql import functions as F

from spanwise.operators import derive as d
from spanwise.plans.process import exclude

C = lambda name: F.col(name)
A, B = date(2020, 1, 1), date(2021, 1, 1)


def test_kidney_function_reference_points(values):
    rows = [(88.4 * 0.9, 50, "Male"), (88.4 * 0.7, 50, "Female"), (None, 50, "Male"), (10.0, 50, "Male"), (88.4 * 1.8, 50, "Male"), (80.0, 50, None)]
    got = values(rows, "c double, a int, s string", lambda: d.egfr(C("c"), C("a"), C("s")))
    base = 141 * 0.993 ** 50
    for value, wanted in zip(got, [base, base * 1.018, base, base, base * 2 ** -1.209, None]):
        assert value is wanted or abs(value - wanted) < 1e-9
    strict = values(rows, "c double, a int, s string", lambda: d.egfr(C("c"), C("a"), C("s"), require_creatinine=True))
    assert strict[2] is None and strict[3] is None


def test_kidney_stages(values):
    rows = [(14.9, None, None), (15.0, None, None), (30.0, None, None), (45.0, None, None), (60.0, None, None), (None, None, None), (20.0, A, None), (20.0, None, A)]
    assert values(rows, "e double, d date, k date", lambda: d.ckd_stage(C("e"), C("d"), C("k"))) == [
        "Stage 5", "Stage 4", "Stage 3b", "Stage 3a", "No CKD", None, None, None]


def test_order_of_dialysis_and_transplant(values):
    rows = [(A, None, None), (B, A, None), (A, B, None), (A, A, None), (None, A, None), (None, None, A), (None, None, None)]
    schema = "d date, k date, o date"
    assert values(rows, schema, lambda: d.dialysis_history(C("d"), C("k"))) == [
        "No previous kidney transplant", "Previous kidney transplant", None, None, None, None, None]
    assert values(rows, schema, lambda: d.transplant_history(C("k"), C("d"), C("o"))) == [
        None, None, "Previous dialysis", None, "No previous dialysis", "Other", None]


def test_blood_pressure_gaps_are_unknown(values):
    rows = [(119.0, 79.0), (125.0, 79.0), (130.0, 90.0), (150.0, 85.0), (125.0, 85.0), (None, 70.0)]
    assert values(rows, "s double, d double", lambda: d.blood_pressure_class(C("s"), C("d"))) == ["Normal", "Elevated", "High", "Unknown", "Unknown", "Unknown"]


def test_critical_care_of_unknown_length_stays_unknown(values):
    rows = [(0, A, None), (1, A, None), (1, A, 3), (0, A, 3)]
    got = values(rows, "h int, dt date, days int", lambda: d.admission_outcome(C("h"), C("dt"), C("days"))["covid_hospitalisation_critical_care"])
    assert got == [0, None, 1, 0]


def test_positive_after_study_end_is_dropped(values):
    rows = [(A,), (B,), (None,)]
    out = lambda k: values(rows, "p date", lambda: d.positive_test_outcome(C("p"), F.lit(A))[k])
    assert out("covid_positive_test_date") == [A, None, None] and out("covid_positive_test") == [1, 0, 0]


def test_prior_infection(values):
    rows = [(date(2019, 1, 1), None), (A, None), (date(2020, 6, 1), None), (B, None), (None, None), (date(2020, 6, 1), date(2019, 1, 1))]
    got = values(rows, "p date, q date", lambda: d.prior_infection([C("p"), C("q")], F.lit(A), F.lit(B)))
    between = "Between first and second dose"
    assert got == ["Prior to first dose", between, between, None, None, "Prior to first dose"]


def test_priority_groups(values):
    rows = [(1, None, 1, 90, 0), (0, "80+", 1, 90, 0), (0, "70-79", 1, 75, 0), (0, "70-79", 0, 75, 1), (0, "16-69", 0, 40, 1), (0, "16-69", 0, 69, 0), (0, None, 0, 40, 0), (0, None, 0, 90, 0)]
    assert values(rows, "care_home_65plus int, ageband string, hscworker int, age int, shielded int", d.priority_group) == [1, 2, 3, 4, 5, 6, 7, 7]


def test_care_home_residents_have_no_age_band(values):
    assert values([(90, 1), (90, 0), (15, 0)], "a int, c int", lambda: d.community_age_band(C("a"), C("c"))) == [None, "80+", None]


def test_exclusions(spark):
    flags = "covid_positive_test_within_2_weeks_post_vax2 int, covid_hospitalisation_within_2_weeks_post_vax2 int, covid_death_within_2_weeks_post_vax2 int"
    dates = "covid_positive_test_date date, covid_hospital_admission_date date, death_date date, censor_date_1 date, censor_date_2 date"
    base = dict(follow_up_time_vax2=14, age=16, sex="Male")
    cases = [({}, True), ({"follow_up_time_vax2": 13}, False), ({"age": 15}, False), ({"age": 109}, True), ({"age": 110}, False), ({"age": None}, False), ({"sex": None}, False), ({"early": 1}, False)]
    rows = []
    for i, (change, _) in enumerate(cases):
        row = base | change
        rows.append((i, row["follow_up_time_vax2"], row["age"], row["sex"], row.get("early", 0), 0, 0, None, None, None, None, A))
    df = spark.createDataFrame(rows, f"patient_id long, follow_up_time_vax2 int, age int, sex string, {flags}, {dates}")
    out = exclude(df)
    assert {r.patient_id for r in out.collect()} == {i for i, (_, kept) in enumerate(cases) if kept}
    assert "censor_date_2" in out.columns and "censor_date_1" not in out.columns


def test_strict_censoring(values):
    assert values([(1, A, B), (1, B, A), (0, None, A)], "e int, d date, c date", lambda: d.strict_event(C("e"), C("d"), C("c"))) == [1, 0, 0]
