"""The training-text pipeline over ``documents``: stages are applied in order, each stored as Parquet for the next.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All but the last return the
columns of ``docs``; the last adds the shard and the slot of every row. Models are fitted on the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanwise.llm import decontaminate, language, mixing, sharding, simhash
from spanwise.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language that is told with a probability of at least one half go."""
    return language.identified(docs, *language.fit(docs.where(language.in_training())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles) the document with the smallest id stays."""
    return simhash.keep_one(docs)


def decontaminate_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item is found go."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with their shard and slot along the Hilbert curve."""
    return sharding.hilbert_shards(docs, carry=True)


STAGES = [
    ("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate_benchmarks),
    ("mixing", mix_sources), ("sharding", shard),
]
#: The stages before the mix rest on trained models and fingerprints, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
