import csv
import glob

import pytest

from registry import records as rec
from registry.study import study
from spanwise.plans import steps
from spanwise.plans import tables as tb


def rows(path):
    (part,) = glob.glob(f"{path}/*.csv")
    with open(part, newline="") as f:
        return list(csv.DictReader(f))


@pytest.fixture(scope="module")
def out(spark, sf_dir, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("study"))
    extract = steps.extract(rec.records(spark, sf_dir), rec.codelists(spark), rec.DATES, folder)
    steps.process(spark, extract, folder, rec.STUDY_END)
    return folder


def test_cohort_from_csv_equals_cohort_from_tables(spark, sf_dir, out):
    stored = spark.read.parquet(f"{out}/{steps.FINAL}")
    direct = study(spark, sf_dir).cohort
    assert stored.columns == direct.columns
    assert stored.exceptAll(direct).count() == 0 and direct.exceptAll(stored).count() == 0


def test_flowchart_file(spark, out):
    table = rows(steps.flow_chart(spark, out))
    assert [r["criteria"][:2] for r in table] == ["c0", "c1", "c2", "c3", "c4"]
    assert int(table[-1]["n"]) == spark.read.parquet(f"{out}/{steps.FINAL}").count()
    assert table[0]["n_exclude"] == "" and int(table[1]["n_exclude"]) == int(table[0]["n"]) - int(table[1]["n"])


def test_tables_are_written_raw_and_redacted_in_order(spark, out):
    raw, redacted = (rows(p) for p in steps.priority_table(spark, out))
    assert [r["group"] for r in raw] == sorted(r["group"] for r in raw) and raw[0]["label"] == "All"
    small = [r["group"] for r in raw if int(r["events_death"]) < 8 and r["group"] != "0"]
    assert small and all(r["death_count"].startswith("[REDACTED]") for r in redacted if r["group"] in small)
    raw, redacted = (rows(p) for p in steps.characteristics_table(spark, out))
    variables = list(dict.fromkeys(r["variable"] for r in raw))
    assert variables == [v for v in tb.TABLE_ORDER if v in variables]
    bands = [r["level"] for r in raw if r["variable"] == "ageband3"]
    assert bands == [b for b in tb.AGE3[1] if b in bands]
    assert len(raw) == len(redacted)


def test_curves_and_other_results(spark, out):
    overall, groups, risk = (rows(p) for p in steps.curve_data(spark, out))
    values = [float(r["cum_in"]) for r in overall]
    assert values == sorted(values) and all(float(r["lci"]) <= float(r["cum_in"]) <= float(r["uci"]) for r in groups)
    assert any(r["n_risk"] == "<8" for r in risk)
    assert len(rows(steps.histogram_data(spark, out, cap=4))) > 0
    assert len(rows(steps.segment_table(spark, out))) == 27
    overlap, times = (rows(p) for p in steps.summaries(spark, out))
    assert {r["outcome"] for r in times} >= {"positive_test", "hospitalised"} and len(overlap) == 22
    tabulated, profile = (rows(p) for p in steps.data_properties(spark, out))
    assert {r["kind"] for r in tabulated} == {"number", "date", "category"} and "patient_id" not in {r["column"] for r in profile}


def test_overall_row_can_count_more_than_three_tests(spark, sf_dir):
    grouped = study(spark, sf_dir).grouped
    usual = {r.group: r.test_3 for r in tb.priority_groups(grouped).collect()}
    other = {r.group: r.test_3 for r in tb.priority_groups(grouped, overall_counts_over_three=True).collect()}
    assert other[0] <= usual[0] and all(other[g] == usual[g] for g in usual if g != 0)
