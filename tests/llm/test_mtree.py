"""Top-k inner products against SQL and brute force, with pruning that really happens."""

import math

import numpy as np

from check import compare, connect
from spanwise.llm import mtree
from spanwise.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank int, leaf int"


def plain(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in dict(good).items():
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 1, 1) for i, v in rows], SCHEMA)


def test_query_matches_sql(spark, sf_dir):
    assert compare(QUERIES["op8_mtree"](spark, sf_dir), connect(sf_dir), ORACLES["op8_mtree"]) == ""


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [9.0, 9.0]), (8, [3.0]), (9, []),
            (100, [-0.0004, 0.0])]
    assert sorted(map(tuple, mtree.top_k(frame(spark, rows)).collect())) == plain(rows)
    assert mtree.top_k(frame(spark, [])).count() == 0
    assert mtree.top_k(frame(spark, [(0, None)])).count() == 0
    assert mtree.top_k(frame(spark, [(0, [1.0])])).count() == 0


def test_groups_of_copies_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE", 50)
    monkeypatch.setattr(mtree, "QUERIES", 7)
    rng = np.random.default_rng(0)
    one = [float(x) for x in np.float32(rng.normal(size=8))]
    rows = [(i, one if i % 3 == 0 else [float(x) for x in np.float32(rng.normal(size=8))]) for i in range(1500)]
    assert sorted(map(tuple, mtree.top_k(frame(spark, rows), every=50).collect())) == plain(rows, every=50)


def test_clusters_are_excluded_by_stored_distances():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 10)) * 8000
    x = np.floor(centres[rng.integers(0, 12, 4000)] + rng.normal(size=(4000, 10)) * 300)
    tree = mtree.Tree(np.arange(4000), x, float((x * x).sum(1).max()))
    apart = tree.distances(tree.lift(x), tree.leaves)
    leaf = apart.argmin(1)
    tree.cover({i: (apart[leaf == i, i].min(), apart[leaf == i, i].max()) for i in set(leaf.tolist())})
    seen = 0
    for q in range(0, 4000, 400):
        found = dict(tree.search(x[q], tree.first_bound(x[q], q, 10)))
        best = np.argsort(-(x @ x[q]))[:11]
        assert set(leaf[[b for b in best if b != q][:10]].tolist()) <= set(found)
        seen += len(found)
    assert seen < 0.6 * 10 * len(set(leaf.tolist()))
