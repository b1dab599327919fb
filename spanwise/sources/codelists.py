"""Code lists as one long DataFrame ``(codelist, system, code, category)``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW = pa.schema([(name, pa.string()) for name in ("codelist", "system", "code", "category")])


@dataclass(frozen=True)
class CodelistFile:
    name: str
    path: str
    system: str
    column: str
    category_column: str | None = None


def load(spark: SparkSession, files: Iterable[CodelistFile]) -> DataFrame:
    """Read code files as text (codes may have 18 digits or dots) and drop repeated codes."""
    parts = []
    for f in files:
        raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(f.path)
        category = F.col(f.category_column) if f.category_column else F.lit(None).cast("string")
        parts.append(raw.select(
            F.lit(f.name).alias("codelist"), F.lit(f.system).alias("system"),
            F.col(f.column).alias("code"), category.alias("category"),
        ))
    return reduce(DataFrame.unionByName, parts).where(F.col("code").isNotNull()).distinct()


def inline(spark: SparkSession, lists: Mapping[str, tuple[str, Sequence[str | tuple[str, str]]]]) -> DataFrame:
    """Lists written in code: ``{name: (system, [code | (code, category), …])}``."""
    rows = []
    for name, (system, codes) in lists.items():
        for entry in codes:
            code, category = entry if isinstance(entry, tuple) else (entry, None)
            rows.append((name, system, code, category))
    unique = sorted(set(rows), key=lambda row: tuple(part or "" for part in row))
    return spark.createDataFrame(pa.table(dict(zip(["codelist", "system", "code", "category"], zip(*unique))), schema=ARROW))


def combine(codelists: DataFrame, name: str, parts: Sequence[str]) -> DataFrame:
    """Union of lists of one coding system under a new name; a code in several parts appears once."""
    return (
        codelists.where(F.col("codelist").isin(*parts))
        .groupBy("system", "code")
        .agg(F.min("category").alias("category"))
        .select(F.lit(name).alias("codelist"), "system", "code", "category")
    )


def filter_category(codelists: DataFrame, name: str, include: Sequence[str], new_name: str | None = None) -> DataFrame:
    """Codes of one list that carry one of the given categories."""
    return codelists.where((F.col("codelist") == name) & F.col("category").isin(*include)).select(
        F.lit(new_name or name).alias("codelist"), "system", "code", "category"
    )


def missing(codelists: DataFrame, names: Sequence[str]) -> DataFrame:
    """Names of wanted lists that hold no code (an anti join; a study should stop when there are any)."""
    wanted = codelists.sparkSession.createDataFrame(pa.table({"codelist": list(names)}))
    return wanted.join(codelists.select("codelist").distinct(), "codelist", "left_anti")
