"""Centroid clustering against SQL and a plain loop, curve order, box bounds, and blocks that never look at their vectors."""

import hashlib
import itertools
import math

import numpy as np
import pytest

from check import compare, connect
from spanwise.llm import zone_maps
from spanwise.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, h int, row int"


def plain(rows, width, scale=64, k=16, rounds=3):
    """The contract, value by value, in Python integers."""
    kept = [(i, [max(-zone_maps.REACH, min(zone_maps.REACH, math.floor(scale * float(np.float32(x))))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            at[c] = [sum(x) // len(mine) for x in zip(*mine)] if mine else at[c]
    found = [(i, near(v)) for i, v in kept]
    spent = {c: sum(d for _, (d, o) in found if o == c) for c in range(len(at))}
    return sorted(((i, c, d, spent[c], sum(spent.values())) for i, (d, c) in found), key=str), at


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], SCHEMA)


def same(spark, rows, width, **options):
    wanted, centroids = plain(rows, width)
    found, at = zone_maps.cluster(frame(spark, rows), width=width, **options)
    assert sorted(map(tuple, found.collect()), key=str) == wanted and at == centroids


def test_query_matches_sql(spark, sf_dir):
    assert compare(QUERIES["op11_zone_maps"](spark, sf_dir), connect(sf_dir), ORACLES["op11_zone_maps"]) == ""


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, [1.0, 2.0]), (7, [3.0]), (8, []), (None, [9.0, -9.0]), (None, [0.0, 0.0]),
            (9, [3e38, -3e38]), (10, [-0.001, 0.0])]
    same(spark, rows, 2)
    assert zone_maps.cluster(frame(spark, []), width=2)[0].count() == 0
    assert zone_maps.cluster(frame(spark, [(1, None)]), width=2)[1] == []
    same(spark, [(1, [1.0, 1.0])], 2)


def test_copies_ties_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(zone_maps, "BLOCK", 7)
    rng = np.random.default_rng(0)
    one = [1.0, -1.0, 0.5]
    rows = [(i, one if i % 3 == 0 else [float(x) for x in rng.integers(-2, 3, 3) / 4]) for i in range(600)]
    same(spark, rows, 3)


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = zone_maps.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[keys.argsort()], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("spread", [3, 40, 400])
def test_no_nearest_centroid_is_left_out(spread):
    rng = np.random.default_rng(spread)
    for _ in range(40):
        x, centroids = rng.integers(-spread, spread, (30, 5)), rng.integers(-200, 200, (16, 5))
        apart = ((x[:, None] - centroids) ** 2).sum(2)
        inside = set(zone_maps.candidates(x.min(0), x.max(0), centroids).tolist())
        assert set(np.flatnonzero((apart == apart.min(1)[:, None]).any(0)).tolist()) <= inside


def test_boxes_decide_on_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(16, 64)) * 60
    x = np.floor(centres[np.repeat(np.arange(16), 500)] + rng.normal(size=(8000, 64)) * 3).astype(np.int64)
    alone = [len(zone_maps.candidates(x[s:s + 500].min(0), x[s:s + 500].max(0), np.floor(centres).astype(np.int64))) for s in range(0, 8000, 500)]
    assert alone == [1] * 16


def test_integers_beyond_doubles_are_exact():
    x = np.array([[zone_maps.REACH, -zone_maps.REACH], [zone_maps.REACH - 1, 5]], np.int64)
    own, apart = zone_maps.nearest(x, np.array([[-zone_maps.REACH, zone_maps.REACH], [zone_maps.REACH, 4]], np.int64))
    assert own.tolist() == [1, 1] and apart.tolist() == [(zone_maps.REACH + 4) ** 2, 2]
