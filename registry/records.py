"""Study records derived from the star-schema tables.

Whole tables are read; what counts as a record of a kind (an admission is an order of status F, say) is part of the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.plans.extract import Records, StudyDates, with_combined_lists
from spanwise.session import dealt, hold_small, tasks_for
from spanwise.sources import codelists as cl

DATES = StudyDates(campaign_start="1995-06-01", end="2001-08-01", age_on="1998-03-31")
#: Administrative end of follow-up, earlier than the end of the extract.
STUDY_END = "2001-03-01"

# Study parameters: the codes of each list, by coding system.
CODELISTS: dict[str, tuple[str, list]] = {
    "covid_vaccine": ("vaccine", ["1-URGENT", "3-MEDIUM", "5-LOW"]),
    "covid_identification": ("icd10", ["1-URGENT", "2-HIGH"]),
    "care_home": ("gp", ["1-URGENT.F"]),
    "high_risk": ("gp", ["2-HIGH.F"]),
    "lower_risk": ("gp", ["2-HIGH.O", "3-MEDIUM.O"]),
    "smoking": ("gp", [("5-LOW.F", "S"), ("5-LOW.O", "E"), ("5-LOW.P", "N"), ("4-NOT SPECIFIED.F", "N")]),
    "ethnicity": ("gp", [("4-NOT SPECIFIED.O", "1"), ("4-NOT SPECIFIED.P", "2"), ("2-HIGH.O", "3"),
                         ("2-HIGH.P", "4"), ("1-URGENT.P", "5")]),
    "asthma": ("gp", ["1-URGENT.O"]),
    "asplenia": ("gp", ["1-URGENT.P"]),
    "lung_cancer": ("gp", ["2-HIGH.F"]),
    "other_cancer": ("gp", ["2-HIGH.O", "2-HIGH.F"]),
    "haem_cancer": ("gp", ["2-HIGH.P"]),
    "creatinine": ("gp", ["3-MEDIUM.F", "3-MEDIUM.O"]),
    "diabetes": ("gp", ["3-MEDIUM.P"]),
    "dialysis": ("gp", ["4-NOT SPECIFIED.F", "4-NOT SPECIFIED.F"]),
    "chd": ("gp", ["4-NOT SPECIFIED.O"]),
    "immunosuppression_diagnosis_date": ("gp", ["4-NOT SPECIFIED.P"]),
    "learning_disability": ("gp", ["5-LOW.F"]),
    "cld": ("gp", ["5-LOW.O"]),
    "chronic_neuro_dis_inc_sig_learn_dis": ("gp", ["5-LOW.P", "1-URGENT.F"]),
    "chronic_resp_dis": ("gp", ["1-URGENT.F"]),
    "sev_mental_ill": ("gp", ["1-URGENT.O", "5-LOW.F"]),
    "kidney_transplant": ("gp", ["4-NOT SPECIFIED.P"]),
    "other_organ_transplant": ("gp", ["2-HIGH.P"]),
    "bp_sys": ("gp", ["1-URGENT.F", "1-URGENT.P", "5-LOW.O"]),
    "bp_dias": ("gp", ["1-URGENT.F", "5-LOW.P", "5-LOW.O"]),
    "bmi": ("gp", ["5-LOW.F", "5-LOW.O", "5-LOW.P", "2-HIGH.P"]),
    "covid_case": ("gp", ["3-MEDIUM.P"]),
    "covid_case_test": ("gp", ["2-HIGH.O", "3-MEDIUM.P"]),
    "covid_case_sequelae": ("gp", ["1-URGENT.P"]),
    "immunosuppression_medication": ("medication", ["Brand#12", "Brand#7", "Brand#7"]),
}

# Practice regions by status group and priority (a missing entry stays unknown).
REGIONS = {
    "1-URGENT": ("London", "East Midlands"),
    "2-HIGH": ("East", "West Midlands"),
    "3-MEDIUM": ("Yorkshire and The Humber", "South East"),
    "4-NOT SPECIFIED": ("South West", "North West"),
    "5-LOW": ("North East", None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("event_id"),
        F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
    )


def cents() -> Column:
    return F.round(F.col("c_acctbal") * 100.0).cast("bigint")


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, with sex and birth date derived from the account balance."""
    c = cents()
    sex = (
        F.when(F.pmod(c, F.lit(97)) == 0, None).when(F.pmod(c, F.lit(89)) == 0, "U")
        .when(F.pmod(c, F.lit(2)) == 0, "M").otherwise("F")
    )
    age_days = (F.lit(3650) + F.pmod(c * 37, F.lit(37500))).cast("int")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("patient_id"), sex.alias("sex"),
        F.date_sub(F.lit(DATES.age_on).cast("date"), age_days).alias("birth_date"),
    )


def vaccinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select(
        "patient_id", "event_date", "event_id", F.lit("vaccine").alias("system"), F.col("priority").alias("code"),
        (F.col("price") > 470000).alias("health_worker"),
    )


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("priority") == "3-MEDIUM", F.col("price") / 1000.0).otherwise(F.col("price") / 2500.0)
    return _orders(spark, sf_dir).select(
        "patient_id", "event_date", "event_id", F.lit("gp").alias("system"),
        F.concat("priority", F.lit("."), "status").alias("code"), value.alias("value"),
    )


def _with_orders(spark: SparkSession, sf_dir: str, lines: DataFrame, *names: str) -> DataFrame:
    """Order lines with columns of their order; many are dealt to tasks of a bounded number of lines."""
    tasks = tasks_for(spark, table(spark, sf_dir, "lineitem").count())
    orders = _orders(spark, sf_dir).select(*names, F.col("event_id").alias("l_orderkey"))
    return dealt(lines, tasks, "l_orderkey").join(dealt(orders, tasks, "l_orderkey"), "l_orderkey")


def medications(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))
    brands = dealt(brands, tasks_for(spark, table(spark, sf_dir, "lineitem").count()), "l_partkey")
    return (
        _with_orders(spark, sf_dir, lines.join(brands, "l_partkey"), "patient_id", "event_date")
        .select("patient_id", "event_date", F.col("l_orderkey").alias("event_id"),
                F.lit("medication").alias("system"), "code", F.lit(None).cast("double").alias("value"))
    )


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.to_date("l_shipdate").alias("event_date"),
        ((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 48)).alias("positive"),
    )
    return _with_orders(spark, sf_dir, lines, "patient_id").select(
        "patient_id", "event_date", F.col("l_orderkey").alias("event_id"), "positive"
    )


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).where(F.col("status") == "F").select(
        "patient_id", "event_date", "event_id", F.lit("icd10").alias("system"), F.col("priority").alias("code"),
        F.floor(F.col("price") / 100000.0).cast("double").alias("value"),
    )


def deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deaths ten days after the last order of one well-to-do customer segment."""
    died = table(spark, sf_dir, "customer").where(
        (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 3000)
    ).select(F.col("c_custkey").alias("patient_id"))
    tasks = tasks_for(spark, table(spark, sf_dir, "orders").count())
    last = dealt(_orders(spark, sf_dir), tasks, "patient_id").groupBy("patient_id").agg(
        F.max("event_date").alias("last_date"),
        F.max_by("priority", F.struct("event_date", "event_id")).alias("code"),
        F.max(F.struct("event_date", "event_id")).getField("event_id").alias("event_id"),
    )
    return last.join(died, "patient_id", "left_semi").select(
        "patient_id", F.date_add("last_date", 10).alias("event_date"), "event_id",
        F.lit("icd10").alias("system"), "code",
    )


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, other = F.lit(None).cast("string"), F.lit(None).cast("string")
    for priority, (when_final, otherwise) in REGIONS.items():
        first = F.when(F.col("priority") == priority, F.lit(when_final)).otherwise(first)
        other = F.when(F.col("priority") == priority, F.lit(otherwise).cast("string")).otherwise(other)
    start = F.date_add("event_date", 20)
    length = (F.lit(100) + F.floor(F.col("price") / 500.0)).cast("int")
    open_ended = (F.col("status") == "P") & (F.col("priority") == "5-LOW")
    return _orders(spark, sf_dir).select(
        "patient_id", F.col("event_id").alias("spell_id"), start.alias("start_date"),
        F.when(~open_ended, F.date_add(start, length)).alias("end_date"),
        F.when(F.col("status") == "F", first).otherwise(other).alias("region"),
    )


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("price") >= 20000, F.floor(F.col("price") / 500000.0 * 32844.0).cast("int"))
    return _orders(spark, sf_dir).select(
        "patient_id", F.col("event_id").alias("spell_id"), F.col("event_date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"), rank.alias("deprivation_rank"),
    )


def hospital_ethnicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = (F.floor(F.col("price") / 100000.0) + 1).cast("int").cast("string")
    return _orders(spark, sf_dir).where(F.col("status") == "O").select("patient_id", group.alias("ethnic_group"))


def records(spark: SparkSession, sf_dir: str) -> Records:
    return Records(*[
        build(spark, sf_dir)
        for build in (people, vaccinations, clinical, medications, tests, admissions, deaths,
                      registrations, addresses, hospital_ethnicity)
    ])


_CODELISTS: dict[str, DataFrame] = {}


def codelists(spark: SparkSession) -> DataFrame:
    """All lists of the study, combined lists included; held once per application."""
    key = spark.sparkContext.applicationId
    if key not in _CODELISTS:
        _CODELISTS[key] = hold_small(with_combined_lists(cl.inline(spark, CODELISTS)))
    return _CODELISTS[key]
