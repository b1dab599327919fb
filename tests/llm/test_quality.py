"""The quality network: gradients, context vectors by hand, calibration, held-out results and odd rows."""

import math
import zlib
from collections import Counter

import numpy as np

from spanwise.llm import quality
from spanwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, predicted int, quality int"


def test_gradients():
    rng = np.random.default_rng(0)
    x, y, weight = rng.normal(size=(20, quality.FEATURES)), rng.integers(0, 2, 20).astype(float), rng.uniform(1, 3, 20)
    net = quality.Network(x.mean(0), x.std(0))
    loss = lambda: float((weight * np.logaddexp(0, np.where(y > 0.5, -1, 1) * net.logit(x))).sum() / weight.sum())
    for i, g in enumerate(net.gradient(x, y, weight)):
        at = tuple(rng.integers(0, s) for s in net.w[i].shape)
        net.w[i][at] += 1e-5
        above = loss()
        net.w[i][at] -= 2e-5
        below = loss()
        net.w[i][at] += 1e-5
        assert math.isclose((above - below) / 2e-5, g[at], abs_tol=1e-6)


def test_context_vectors_by_hand(spark):
    texts = ["a b c a", "c b", None, "", "b"]
    found = quality.context_vectors(spark.createDataFrame([(i, t, "", 1, 1) for i, t in enumerate(texts)], SCHEMA))
    places, signs = quality.index_vectors()
    of, want = quality._BucketOf(), np.zeros((quality.BUCKETS, quality.WIDTH))
    for t in texts:
        ids = [of[w.encode()] for w in (t or "").split()]
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= quality.REACH:
                    for k in range(quality.NONZERO):
                        want[a, places[b, k]] += signs[b, k]
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(found, want / (length + 1e-9), atol=1e-6)


def test_temperature_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, quality.FEATURES))
    p = 1 / (1 + np.exp(-1.5 * x[:, 0]))
    y = (rng.random(3000) < p).astype(float)
    net = quality.train(x[:2000], y[:2000], np.ones(2000), epochs=25)
    found = net.probability(x[2000:])
    for low in (0.0, 0.25, 0.5, 0.75):
        part = (found >= low) & (found < low + 0.25)
        assert abs(found[part].mean() - p[2000:][part].mean()) < 0.12


def test_query_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    found = QUERIES["op6_quality"](spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    pairs = Counter((labels[r.doc_id], r.predicted) for r in found if r.held_out and r.doc_id in labels)
    assert pairs[1, 1] / (pairs[1, 1] + pairs[1, 0]) > 0.95 and pairs[0, 0] / (pairs[0, 0] + pairs[0, 1]) > 0.75


def test_odd_rows(spark):
    rows = [(i, "good plain words here" if i % 2 else "### $$$ %%% ###", "", 1, 1) for i in range(60)]
    rows += [(100, None, "", 1, 1), (101, "", "", 1, 1), (None, "good words " * 100_000, None, None, None), (7, "good plain words here", "", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(60)] + [(None, 1, 0, "x"), (5, None, 0, "x"), (999, 1, 0, "x"), (8, 7, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    found = quality.score(docs, labels).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and by[7].predicted == 1 and by[8].predicted == 0 and 0 <= by[100].score == by[101].score <= 1
    assert quality.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
