from datetime import date

import pytest

from spanwise.plans.extract import CODE_FILES, study_codelists
from spanwise.session import scratch_path
from spanwise.sources import codelists as cl
from spanwise.sources.extract import flags_to_int, normalise_missing, read_typed_csv
from spanwise.sources.snapshots import read_curve, write_csv


def test_columns_are_read_by_name_and_bad_cells_are_unknown(spark, tmp_path):
    path = tmp_path / "input.csv"
    path.write_text("sex,extra,patient_id,age,when,flag,bp\nF,1,7,40,2021-02-30,1,120.5\n,x,8,abc,2021-02-03,0,\n")
    df = read_typed_csv(spark, str(path), {"patient_id": "bigint", "age": "int", "when": "date", "flag": "boolean", "bp": "double", "sex": "string"})
    assert df.columns == ["patient_id", "age", "when", "flag", "bp", "sex"]
    rows = sorted(df.collect(), key=lambda r: r.patient_id)
    assert tuple(rows[0]) == (7, 40, None, True, 120.5, "F")
    assert tuple(rows[1])[:4] == (8, None, date(2021, 2, 3), False)


def test_empty_text_and_zero_become_unknown_except_ids(spark):
    df = spark.createDataFrame([(0, 0, 0.0, "", False)], "patient_id long, n int, x double, s string, b boolean")
    assert tuple(flags_to_int(normalise_missing(df)).first()) == (0, None, None, None, 0)


def test_code_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('code,term\n999000000000000107,"one, quoted"\n2469.,two\n2469.,two again\n')
    (tmp_path / "b.csv").write_text("CTV3Code,Description,Category\nX1.,x,S\nX2.,y,N\n")
    df = cl.load(spark, [cl.CodelistFile("a", str(tmp_path / "a.csv"), "snomed", "code"),
                         cl.CodelistFile("b", str(tmp_path / "b.csv"), "ctv3", "CTV3Code", "Category")])
    assert sorted((r.codelist, r.system, r.code, r.category) for r in df.collect()) == [
        ("a", "snomed", "2469.", None), ("a", "snomed", "999000000000000107", None), ("b", "ctv3", "X1.", "S"), ("b", "ctv3", "X2.", "N")]
    assert [r.code for r in cl.filter_category(df, "b", ["S"]).collect()] == ["X1."]


def test_combined_lists_hold_each_code_once(spark):
    base = cl.inline(spark, {"p": ("s", ["1", "2"]), "q": ("s", ["2", "3"]), "r": ("s", ["9"])})
    assert sorted(r.code for r in cl.combine(base, "pq", ["p", "q"]).collect()) == ["1", "2", "3"]


def test_curve_reading(spark):
    df = spark.createDataFrame([("old", 0, 0.0), ("old", 25, 0.1), ("b", 300, 0.2)], "group string, time int, cum_in double")
    path = write_csv(df, scratch_path(spark, "curve"), files=1)
    back = read_curve(spark, path, before_time=290, relabel={"old": "new"}, drop_times=[25]).collect()
    assert [tuple(r) for r in back] == [("new", 0, 0.0)]


def test_study_lists_must_all_have_codes(spark, tmp_path):
    paths = {}
    for name, (_, column, category) in CODE_FILES.items():
        path = tmp_path / f"{name}.csv"
        path.write_text(f"{column},{category or 'term'}\n{name}-1,S\n{name}-1,S\n")
        paths[name] = str(path)
    full = study_codelists(spark, paths, ["bmi-1"]).collect()
    by_name = {}
    for r in full:
        by_name.setdefault(r.codelist, []).append(r.code)
    assert by_name["asthma"] == ["asthma-1"] and sorted(by_name["cancer"]) == ["lung_cancer-1", "other_cancer-1"]
    assert by_name["smoking_ever"] == ["smoking-1"] and by_name["bp_sys"] == ["2469."]
    del paths["chd"]
    with pytest.raises(ValueError, match="chd"):
        study_codelists(spark, paths, ["bmi-1"])
