"""Snapshots between steps, result files, and re-reading of released curves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.session import scratch_path


def write_snapshot(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snapshot(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, so that later steps start from a stored table."""
    spark = df.sparkSession
    return read_snapshot(spark, write_snapshot(df, scratch_path(spark, label)))


def snapshot_by(df: DataFrame, label: str, key: str, buckets: int | None = None) -> DataFrame:
    """Like ``snapshot``, laid out in sorted buckets of ``key``: later joins and aggregations on the key leave this side in place.

    There are as many buckets as shuffle partitions unless ``buckets`` says more, so that the other side of a join is dealt to match.
    """
    spark = df.sparkSession
    path, buckets = scratch_path(spark, label), buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def write_csv(df: DataFrame, path: str, files: int | None = None) -> str:
    """Result file with a header. ``files=1`` is meant for aggregated results only."""
    out = df.coalesce(files) if files else df
    out.write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)
    return path


def read_curve(
    spark: SparkSession,
    path: str,
    before_time: int | None = None,
    relabel: Mapping[str, str] | None = None,
    drop_times: Sequence[int] = (),
) -> DataFrame:
    """Released curve or risk table: cut at a time, rename groups, leave out some times."""
    df = spark.read.option("header", True).csv(path)
    numeric = {"time": "int", "cum_in": "double", "lci": "double", "uci": "double"}
    df = df.withColumns({c: F.col(c).try_cast(t) for c, t in numeric.items() if c in df.columns})
    if before_time is not None:
        df = df.where(F.col("time") < before_time)
    if drop_times:
        df = df.where(~F.col("time").isin(*drop_times))
    for old, new in (relabel or {}).items():
        df = df.withColumn("group", F.when(F.col("group") == old, new).otherwise(F.col("group")))
    return df


def value_at(curve: DataFrame, time: int) -> DataFrame:
    return curve.where(F.col("time") == time)
