"""The study steps with stored inputs and outputs: process the extract, then write each report.

Every step starts from a stored snapshot, so steps can run in any order and on different clusters. Result files hold
aggregated tables of at most a few thousand rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.operators.derive import PRIORITY_GROUPS, with_priority_group
from spanwise.operators.features import PERSON
from spanwise.operators.summaries import dataset_profile, properties
from spanwise.plans import curves as cv
from spanwise.plans import tables as tb
from spanwise.plans.extract import Records, StudyDates, cohort_extract
from spanwise.plans.process import derive_cohort, exclude
from spanwise.sources.extract import read_typed_csv
from spanwise.sources.snapshots import read_snapshot, snapshot, snapshot_by, write_csv, write_snapshot

FULL, FINAL = "data/data_all", "data/data_processed"


def extract(records: Records, codelists: DataFrame, dates: StudyDates, out: str) -> str:
    """Full extraction from record tables to the wide CSV that ``process`` reads."""
    return write_csv(cohort_extract(records, codelists, dates, stage=lambda df, label: snapshot_by(df, label, PERSON)), f"{out}/input")


def process(spark: SparkSession, extract_csv: str, out: str, study_end: str, **options) -> None:
    """Typed read of the wide extract, derivation, exclusions; stores the full and the final cohort."""
    cohort = derive_cohort(read_typed_csv(spark, extract_csv), study_end, **options)
    write_snapshot(cohort, f"{out}/{FULL}")
    write_snapshot(exclude(read_snapshot(spark, f"{out}/{FULL}")), f"{out}/{FINAL}")


def _final(spark: SparkSession, out: str) -> DataFrame:
    return read_snapshot(spark, f"{out}/{FINAL}")


def _grouped(spark: SparkSession, out: str) -> DataFrame:
    return with_priority_group(_final(spark, out))


def _result(df: DataFrame, out: str, name: str) -> str:
    return write_csv(df, f"{out}/{name}", files=1)


def flow_chart(spark: SparkSession, out: str) -> str:
    return _result(cv.flowchart(read_snapshot(spark, f"{out}/{FULL}")).orderBy("criteria"), out, "data/flowchart")


def data_properties(spark: SparkSession, out: str, which: str = FINAL) -> list[str]:
    data = read_snapshot(spark, f"{out}/{which}")
    people_columns = [c for c in data.columns if not c.endswith("_id")]
    return [
        _result(properties(data, stage=snapshot).orderBy("kind", "column", "level"), out, "data_properties/tabulate"),
        _result(dataset_profile(data, people_columns).orderBy("column"), out, "data_properties/profile"),
    ]


def priority_table(spark: SparkSession, out: str) -> list[str]:
    grouped = _grouped(spark, out)
    return [
        _result(tb.priority_groups(grouped).orderBy("group"), out, "tables/table1"),
        _result(tb.priority_groups_redacted(grouped).orderBy("group"), out, "tables/table1_redacted"),
    ]


def characteristics_table(spark: SparkSession, out: str) -> list[str]:
    grouped = _grouped(spark, out)
    return [
        _result(tb.in_table_order(tb.characteristics(grouped)), out, "tables/table2"),
        _result(tb.in_table_order(tb.characteristics_redacted(grouped)), out, "tables/table2_redacted"),
    ]


def kidney_tables(spark: SparkSession, out: str) -> list[str]:
    grouped = _grouped(spark, out)
    order = ["outcome", F.desc("model"), "term"]
    return [
        _result(tb.ckd_hazards(grouped, redacted=False).orderBy(*order), out, "tables/table_ckd"),
        _result(tb.ckd_hazards(grouped).orderBy(*order), out, "tables/table_ckd_redacted"),
        _result(tb.in_table_order(tb.characteristics(grouped, **tb.CKD_OPTIONS)), out, "tables/table2_ckd"),
        _result(tb.in_table_order(tb.characteristics_redacted(grouped, **tb.CKD_OPTIONS)), out, "tables/table2_ckd_redacted"),
    ]


def adjusted_table(spark: SparkSession, out: str) -> list[str]:
    grouped = _grouped(spark, out)
    raw = snapshot(tb.adjusted_rates(grouped), "adjusted")
    redacted = tb.format_table(tb.redact(raw, adjusted=True), ["variable", "level"], adjusted=True)
    return [_result(tb.in_table_order(raw), out, "tables/table2_adj"), _result(tb.in_table_order(redacted), out, "tables/table2_adj_redacted")]


def curve_data(spark: SparkSession, out: str) -> list[str]:
    overall, groups, risk = cv.curves(_grouped(spark, out))
    order = F.array_position(F.array(*[F.lit(g) for g in PRIORITY_GROUPS]), F.col("group"))
    shown = risk.select("group", "time", F.col("n_risk_shown").alias("n_risk"))
    return [
        _result(overall.orderBy("time"), out, "data/surv_data_all"),
        _result(groups.orderBy(order, "time"), out, "data/surv_data_groups"),
        _result(shown.orderBy(order, "time"), out, "data/surv_data_risk_table"),
    ]


def histogram_data(spark: SparkSession, out: str, cap: int | None = None) -> str:
    return _result(cv.test_histogram(_grouped(spark, out), cap).orderBy("group", "tests"), out, "data/test_histogram")


def summaries(spark: SparkSession, out: str) -> list[str]:
    grouped = _grouped(spark, out)
    return [
        _result(cv.outcome_overlap(grouped), out, "data/outcome_overlap"),
        _result(cv.time_quartiles(grouped).orderBy("outcome", "group"), out, "data/time_to_event"),
    ]


def segment_table(spark: SparkSession, out: str) -> str:
    return _result(cv.segment_report(read_snapshot(spark, f"{out}/{FULL}")), out, "tables/segments_redacted")
