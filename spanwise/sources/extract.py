"""The one-row-per-person extract: typed reading by column name and missing-value rules."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the person extract by type.
INTEGER_COLUMNS = ["patient_id", "covid_hospitalisation_critical_care", "age"]
FLAG_COLUMNS = [
    "covid_positive_test_within_2_weeks_post_vax2", "covid_positive_test", "covid_hospital_admission",
    "covid_hospitalisation_within_2_weeks_post_vax2", "death_with_covid_on_the_death_certificate",
    "death_with_28_days_of_covid_positive_test", "covid_death_within_2_weeks_post_vax2",
    "care_home", "shielded", "hscworker",
]
DATE_COLUMNS = [
    "covid_positive_test_date", "covid_hospital_admission_date", "dereg_date", "death_date",
    "asthma", "asplenia", "cancer", "chd", "chronic_neuro_dis_inc_sig_learn_dis", "chronic_resp_dis",
    "creatinine_date", "diabetes", "dialysis", "cld", "haem_cancer", "immunosuppression_diagnosis_date",
    "immunosuppression_medication_date", "learning_disability", "sev_mental_ill", "kidney_transplant",
    "other_organ_transplant", "covid_vax_1_date", "covid_vax_2_date", "prior_positive_test_date",
    "prior_primary_care_covid_case_date", "prior_covidadmitted_date",
]
TEXT_COLUMNS = ["sex", "bmi", "smoking_status", "ethnicity_6", "ethnicity_6_sus", "imd", "region"]
NUMBER_COLUMNS = ["bp_sys", "bp_dias", "creatinine", "tests_conducted_any", "tests_conducted_positive"]

EXTRACT_TYPES: dict[str, str] = (
    {name: "bigint" if name == "patient_id" else "int" for name in INTEGER_COLUMNS}
    | {name: "boolean" for name in FLAG_COLUMNS}
    | {name: "date" for name in DATE_COLUMNS}
    | {name: "string" for name in TEXT_COLUMNS}
    | {name: "double" for name in NUMBER_COLUMNS}
)


def _typed(name: str, kind: str) -> Column:
    raw = F.col(name)
    if kind == "date":
        return F.try_to_date(raw, "yyyy-MM-dd").alias(name)
    return raw.try_cast(kind).alias(name)


def read_typed_csv(spark: SparkSession, path: str, types: Mapping[str, str] = EXTRACT_TYPES) -> DataFrame:
    """Read only the listed columns, matched by header name; cells of the wrong form become NULL."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return raw.select(*[_typed(name, kind) for name, kind in types.items()])


def normalise_missing(df: DataFrame, id_suffix: str = "_id") -> DataFrame:
    """Empty text and zero numbers become NULL, except in identifier columns; column order is kept."""
    cleaned = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            column = F.nullif(column, F.lit(""))
        elif isinstance(field.dataType, T.NumericType) and not field.name.endswith(id_suffix):
            column = F.nullif(column, F.lit(0).cast(field.dataType))
        cleaned.append(column.alias(field.name))
    return df.select(*cleaned)


def flags_to_int(df: DataFrame) -> DataFrame:
    """Every true/false column as 1/0."""
    return df.select(*[
        F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name)
        for f in df.schema.fields
    ])
