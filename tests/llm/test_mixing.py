"""Mixing: targets by repeated resharing, documents by sorting each source, both in plain Python."""

import hashlib
import math

from check import compare, connect
from spanwise.llm import mixing
from spanwise.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, source string, _mix int, size string, bucket int"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, budget = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def check_rows(rows, found):
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    target, taken = plain_targets(sizes), {}
    assert len(found) == len(rows)
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert t == math.floor(target[s] + 1e-9)


def test_query_matches_sql(spark, sf_dir):
    assert compare(QUERIES["op2_mixing"](spark, sf_dir), connect(sf_dir), ORACLES["op2_mixing"]) == ""


def test_every_source_gives_its_target_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i % 7 if i % 3 else 0}", i, "x", i) for i in range(3000)]
    rows += [(i, " ".join(["w"] * 50), None, i, "x", i) for i in range(3000, 3005)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs).collect()
    check_rows(rows, found)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)


def test_documents_follow_their_keys(spark):
    rows = [(i, "a b c" if i % 2 else "## 1 %%", "s", 1, "x", 1) for i in range(2000)]
    found = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, SCHEMA), share=0.5).collect()}

    def key(i, text):
        u = (int(hashlib.md5(f"mix:{i}:3".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / (0.05 + 0.95 * sum(c not in mixing.NOISE for c in text) / len(text))

    order = sorted(rows, key=lambda r: key(r[0], r[1]))
    assert [found[r[0]].taken for r in order] == [3] * 1000 + [0] * 1000
    assert sum(found[i].taken for i in range(1, 2000, 2)) > 2 * sum(found[i].taken for i in range(0, 2000, 2))


def test_odd_rows(spark):
    rows = [(1, None, "a", 1, "", 1), (2, "", "a", 1, "", 1), (None, "x y", None, 1, "", 1), (None, "x y", None, 1, "", 1),
            (3, "p q r", "b", None, None, None), (3, "p q r", "b", None, None, None), (4, "  \t", None, 1, "", 1)]
    check_rows(rows, mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = mixing.mix(spark.createDataFrame(rows[:2], SCHEMA)).collect()
    assert [(r.taken, r.target) for r in blank] == [(0, 0.0)] * 2


def test_repeated_documents_keep_their_columns(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 5}", i, "x", i) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed, taken = mixing.repeated(docs), {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert mixed.columns == docs.columns
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    for i, r in taken.items():
        assert times.get(i, 0) == math.floor(r.taken / r.size + 0.5)
