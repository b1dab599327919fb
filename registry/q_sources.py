"""Sources and sinks."""

from pyspark.sql import functions as F

from registry.base import add, rounded
from registry.sql import COHORT, on_cohort, on_extract, on_records, half_even, to_base, with_steps
from spanwise.operators.derive import PRIORITY_GROUPS
from spanwise.plans.curves import group_counts
from spanwise.operators.survival import cumulative_incidence, kaplan_meier
from spanwise.session import scratch_path
from spanwise.sources import codelists as cl
from spanwise.sources.extract import EXTRACT_TYPES, NUMBER_COLUMNS, normalise_missing, read_typed_csv
from spanwise.sources.snapshots import read_curve, read_snapshot, value_at, write_csv, write_snapshot

MEASURES = ["bp_sys", "bp_dias", "creatinine"]


def _typed_extract(st):
    path = write_csv(st.extract, scratch_path(st.spark, "extract-csv"))
    return rounded(read_typed_csv(st.spark, path), *MEASURES)


_COLUMNS = ", ".join(f"round({c}, 6) AS {c}" if c in MEASURES else c for c in EXTRACT_TYPES)
add("typed_extract_read", _typed_extract, on_extract(f"SELECT {_COLUMNS} FROM extract"))

_NUMERIC = ["covid_hospitalisation_critical_care", "age", *NUMBER_COLUMNS]
add(
    "normalise_missing",
    lambda st: rounded(normalise_missing(st.extract.select(*EXTRACT_TYPES)), *MEASURES),
    on_extract("SELECT " + ", ".join(
        f"round(nullif({c}, 0), 6) AS {c}" if c in MEASURES else f"nullif({c}, 0) AS {c}" if c in _NUMERIC else c
        for c in EXTRACT_TYPES) + " FROM extract"),
)


def _product_codes(st):
    """Code files written from the product table, then read back as code lists."""
    path = write_csv(
        st.table("part").select(F.col("p_brand").alias("code"), F.col("p_name").alias("term"), F.col("p_type").alias("category")),
        scratch_path(st.spark, "codes"),
    )
    return cl.load(st.spark, [
        cl.CodelistFile("brands", path, "medication", "code", "category"),
        cl.CodelistFile("terms", path, "product", "term"),
    ])


_LISTS = """SELECT DISTINCT 'brands' AS codelist, 'medication' AS system, p_brand AS code, p_type AS category FROM part
UNION ALL SELECT DISTINCT 'terms', 'product', p_name, CAST(NULL AS VARCHAR) FROM part"""
add("codelist_load", _product_codes, _LISTS)


def _by_type(st):
    return st.table("part").select(
        F.col("p_type").alias("codelist"), F.lit("medication").alias("system"), F.col("p_brand").alias("code"),
        F.lit(None).cast("string").alias("category"),
    ).distinct()


add(
    "codelist_combine",
    lambda st: cl.combine(_by_type(st), "economy_or_promo", ["ECONOMY", "PROMO"]),
    """SELECT DISTINCT 'economy_or_promo' AS codelist, 'medication' AS system, p_brand AS code, CAST(NULL AS VARCHAR) AS category
    FROM part WHERE p_type IN ('ECONOMY', 'PROMO')""",
)
add(
    "codelist_filter_category",
    lambda st: cl.filter_category(_product_codes(st), "brands", ["SMALL", "LARGE"]),
    f"SELECT * FROM ({_LISTS}) WHERE codelist = 'brands' AND category IN ('SMALL', 'LARGE')",
)
_CLINICAL = on_records("SELECT patient_id, event_date, event_id, 'gp' AS system, code, value FROM clinical")
add("snapshot_write", lambda st: st.spark.read.parquet(write_snapshot(st.records("clinical"), scratch_path(st.spark, "clinical"))), _CLINICAL)
add("snapshot_read", lambda st: read_snapshot(st.spark, write_snapshot(st.cohort_all, scratch_path(st.spark, "cohort"))), on_cohort("SELECT * FROM cohort_all"))


def _csv_result(st):
    counts = st.grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    path = write_csv(counts, scratch_path(st.spark, "group-counts"), files=1)
    return st.spark.read.option("header", True).csv(path).select(F.col("group").cast("int"), F.col("n").cast("bigint"))


add("csv_result_write", _csv_result, on_cohort('SELECT "group", count(*) AS n FROM grouped GROUP BY 1'))

SHIELDED, RENAMED = PRIORITY_GROUPS[4], "CEV (age 16-69) (priority group 4)"
GROUP_CASE = 'CASE "group" ' + " ".join(f"WHEN {i} THEN '{g}'" for i, g in enumerate(PRIORITY_GROUPS, 1)) + " END"


def km_steps(source: str = "grouped", group: str = GROUP_CASE) -> list[str]:
    """Kaplan-Meier as CTEs over people: ``km`` raw, ``curve`` rounded."""
    return [
        f"""sc AS (SELECT {group} AS g, time_to_positive_test AS t, count(*) AS n, sum(covid_positive_test) AS d FROM {source}
        WHERE time_to_positive_test >= 0 AND covid_positive_test IS NOT NULL GROUP BY ALL)""",
        """nr AS (SELECT g, t, d, sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS n_risk FROM sc)""",
        """km AS (SELECT g, t, n_risk, d, exp(sum(ln(1.0 - CAST(d AS DOUBLE) / n_risk)) FILTER (d < n_risk) OVER w) AS s,
        sqrt(sum(CAST(d AS DOUBLE) / (CAST(n_risk AS DOUBLE) * (n_risk - d))) FILTER (d < n_risk) OVER w) AS se,
        coalesce(bool_or(d = n_risk) OVER w, false) AS gone
        FROM nr WINDOW w AS (PARTITION BY g ORDER BY t ROWS UNBOUNDED PRECEDING))""",
        f"""curve AS (SELECT g AS "group", t AS time, {half_even('1.0 - s2', 4)} AS cum_in, {half_even('1.0 - hi', 4)} AS lci,
        {half_even('1.0 - lo', 4)} AS uci FROM (SELECT g, t, least(1.0, {to_base('s', 'base')}) AS s2,
        least(1.0, {to_base('exp(ln(s) - 1.959963984540054 * se)', 'base')}) AS lo,
        least(1.0, {to_base('least(1.0, exp(ln(s) + 1.959963984540054 * se))', 'base')}) AS hi
        FROM (SELECT *, 7.0 / max(n_risk) OVER () AS base FROM km WHERE NOT gone)))""",
    ]


def _released(st):
    curve = cumulative_incidence(kaplan_meier(group_counts(st.grouped)))
    path = write_csv(curve, scratch_path(st.spark, "curves"), files=1)
    return read_curve(st.spark, path, before_time=1500, relabel={SHIELDED: RENAMED}, drop_times=[25, 75, 125])


_RELEASED = f"""SELECT * REPLACE (CASE WHEN "group" = '{SHIELDED}' THEN '{RENAMED}' ELSE "group" END AS "group")
FROM curve WHERE time < 1500 AND time NOT IN (25, 75, 125)"""
add("released_curve_read", _released, with_steps(COHORT, *km_steps(), query=_RELEASED))
add("released_curve_value_at", lambda st: value_at(_released(st), 275),
    with_steps(COHORT, *km_steps(), query=f"SELECT * FROM ({_RELEASED}) WHERE time = 275"))
