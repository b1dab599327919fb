"""Session settings, shared scratch storage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when it is known to hold at most this many rows and MB.
BROADCAST_ROW_LIMIT, BROADCAST_MB_LIMIT = 200_000, 64
#: Records of a task beyond which a step is dealt to a fixed number of tasks.
TASK_ROWS = 1 << 20
#: Tasks for each core that such a step is dealt to at most where its records need no more.
CORE_TASKS = 8


def local_session(name: str = "spanwise", cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master, where one machine is the cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spanwise-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; never reused, so no earlier result is overwritten."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks for a step over ``rows``: None, left to Spark, where its cores hold at most ``TASK_ROWS`` each.

    Beyond, as many as the session's shuffles have, but ``CORE_TASKS`` a core at most, and more where these would hold above
    ``TASK_ROWS``. Every task of a shuffle opens a file for each task of the next, so many small ones cost more than their rows.
    """
    cores, parts = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = -(-rows // TASK_ROWS)
    return None if few <= min(parts, cores) else max(few, min(parts, CORE_TASKS * cores))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to ``tasks`` tasks, which Spark does not put together again; None leaves it to Spark.

    Shuffles of Spark's own are put together by their compressed bytes, into about as many tasks as there are cores
    however many partitions the session names; short rows then fill a task's memory as the tables grow.
    """
    return df if tasks is None else df.repartition(tasks, *keys)


def is_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, mb: int = BROADCAST_MB_LIMIT) -> bool:
    """Whether ``df`` has at most ``limit`` rows and ``mb`` MB of text; counting stops at ``limit + 1`` rows."""
    row = df.limit(limit + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))).alias("size")).first()
    return row["n"] <= limit and (row["size"] or 0) <= mb << 20


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Distinct rows of ``df``, broadcast when it is counted as small; otherwise left to Spark."""
    small = is_small(df, limit)
    return F.broadcast(df.distinct()) if small else df.distinct()


def hold_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """A small table (a set of code lists, say) read once and kept as a local relation.

    Larger tables are returned unchanged, so nothing unbounded reaches the driver.
    """
    return df.sparkSession.createDataFrame(df.toArrow()) if is_small(df, limit) else df
