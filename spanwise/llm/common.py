"""Helpers that the operators of this subpackage share: stored intermediate tables, reading, token splitting."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.session import scratch_path

#: Bytes of text that are split into words at a time, so that a very long text never becomes one huge word list.
BLOCK_BYTES = 1 << 20
_BLANKS = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: it survives lost executors and is computed once."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores behind it as it takes not to be a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def word_blocks(data: bytes, size: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Words (maximal runs of other than ASCII white space) of ``data`` in order, a block of about ``size`` bytes at a time."""
    start = 0
    while start < len(data):
        end = start + size
        if end < len(data):
            while end < len(data) and data[end] not in _BLANKS:
                end += 1
        yield data[start:end].split()
        start = end


def small_enough(df: DataFrame, rows: int = 50_000, mb: int = 32) -> bool:
    """Whether a stored table is proven to hold at most ``rows`` rows and ``mb`` MB; counting stops beyond ``rows``."""
    counted = df.limit(rows + 1).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("size")).first()
    return counted.n <= rows and (counted.size or 0) <= mb << 20


def broadcast_checked(df: DataFrame, rows: int = 50_000, mb: int = 32) -> DataFrame:
    """A stored table with a broadcast hint when it is proven small; otherwise Spark joins it by shuffle."""
    return F.broadcast(df) if small_enough(df, rows, mb) else df
