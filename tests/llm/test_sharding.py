"""Sharding along the Hilbert curve: the curve itself, the law of near equal bytes, slots, groups of copies."""

import zlib

import pytest
from pyspark.sql import functions as F

from spanwise.llm import sharding
from spanwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, shard string, _shard int, size int"


@pytest.mark.parametrize("n,bits", [(2, 3), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_steps_of_one(spark, n, bits):
    dims = [(F.col("id").bitwiseAND(F.lit(((1 << bits) - 1) << bits * i)) / (1 << bits * i)).cast("int") for i in range(n)]
    rows = spark.range(1 << n * bits).select(*(d.alias(f"d{i}") for i, d in enumerate(dims)),
                                              sharding.hilbert_index(dims, bits).alias("h")).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << n * bits))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def check_law(rows, found, shards):
    assert len(found) == len(rows)
    size, slots = {}, {}
    for r in found:
        size[r.shard] = size.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < shards for s in slots)
    even = sum(size.values()) / shards
    slack = 2 * max(r.size for r in found) + 2 * sharding.SLACK * even
    assert all(abs(b - even) <= slack for b in size.values())


def test_query_obeys_the_law(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op9_sharding"](spark, sf_dir).collect()
    check_law(docs, found, 40)
    for r in found:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)


def test_copies_share_a_shard_and_files_are_narrow(spark):
    rows = [(i, f"t{i // 4} " * (5 + i // 4 % 50), ["de", "en"][i % 2], f"s{i % 16:02d}", "x", 1, 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sharding.hilbert_shards(docs, shards=10).collect()
    check_law(rows, found, 10)
    where = {}
    for r in found:
        where.setdefault(r.doc_id // 4, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    singles = docs.where("doc_id % 4 = 0")
    kept = sharding.hilbert_shards(singles, shards=16, carry=True).collect()
    for column in (3, 1):
        spans = {}
        for r in kept:
            spans.setdefault(r[-2], []).append(r[column] if column == 3 else len(r.text))
        values = sorted({v for s in spans.values() for v in s})
        touched = sum(min(s) <= v <= max(s) for v in values for s in spans.values()) / len(values) / len(spans)
        assert touched < 0.75


def test_odd_rows(spark):
    rows = [(1, None, None, None, "x", 1, 1), (None, "", "en", "a", "x", 1, 1), (None, "", "en", "a", "x", 1, 1),
            (2, "é" * 100_000, "fr", None, "x", 1, 1), (2, "ab", None, "a", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sharding.hilbert_shards(docs, shards=3).collect()
    check_law(rows, found, 3)
    assert sorted(r.size for r in found) == [16, 16, 16, 18, 200_016]
    assert sharding.hilbert_shards(spark.createDataFrame([], SCHEMA)).collect() == []
    carried = sharding.hilbert_shards(docs, shards=3, carry=True)
    assert carried.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"] and carried.drop("shard").count() == 5


def test_one_group_of_copies_may_span_shards(spark):
    rows = [(i, "same words " * 20, "en", "a", "x", 1, 1) for i in range(2000)]
    check_law(rows, sharding.hilbert_shards(spark.createDataFrame(rows, SCHEMA), shards=7).collect(), 7)


def test_written_files_hold_their_shard(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"s{i % 3}", "x", 1, 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).drop("shard")
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 300 and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
