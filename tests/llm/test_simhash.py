"""SimHash groups against brute force over all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from spanwise.llm import simhash
from spanwise.llm.components import components, thinned
from spanwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, fp string, anchor int"


def plain_fingerprint(text, n=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
    words = [w for w in words.replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(ids, prints, threshold=4):
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= threshold:
            root[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(ids))]


def test_query_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    prints = [plain_fingerprint(d.text) for d in docs]
    groups = plain_groups([d.doc_id for d in docs], prints)
    assert len(found) == len(docs)
    for d, p, g in zip(docs, prints, groups):
        assert (found[d.doc_id].fingerprint, found[d.doc_id].component_id) == (f"{p:016x}", g)


def test_odd_rows(spark):
    rows = [(5, None, "x", 1), (3, "", "x", 1), (9, "  \t\n", None, None), (None, "a b c d e", "x", 1), (7, "A B C D E", "x", 1),
            (7, "A B C D E", "x", 1), (1, "one two", "x", 1), (2, "ONE  two", "x", 1), (4, "éa b", "x", 1), (6, "Éa b", "x", 1)]
    found = sorted(simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect(), key=str)
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found}
    assert {by[i].component_id for i in (5, 3, 9)} == {3} and by[5].fingerprint == "0" * 16
    assert by[None].component_id == by[7].component_id == 7 and by[7].n_exact == 3
    assert by[1].component_id == by[2].component_id == 1
    assert by[4].component_id == 4 and by[6].component_id == 6


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_text_is_read_in_blocks():
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("blocks", [1, 2, 3])
@pytest.mark.parametrize("threshold", [3, 4])
def test_every_pair_in_reach_meets_at_an_anchor(blocks, threshold):
    rng = np.random.default_rng(blocks)
    a = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    b = a ^ np.array([sum(1 << int(i) for i in rng.choice(64, threshold, replace=False)) for _ in a], np.uint64)
    anchors = simhash.Anchors(blocks, (threshold + 1) // 2)
    sets = []
    for fps in (a, b):
        rows, keys = anchors.near(fps)
        sets.append(set(zip(rows.tolist(), keys.tolist())))
        assert len(sets[-1]) == len(rows)
    assert {row for row, _ in sets[0] & sets[1]} == set(range(len(a)))


@pytest.mark.parametrize("hot_rows", [1 << 16, 20])
def test_crowded_ball(spark, hot_rows):
    """Many fingerprints within a few bits of each other, in pieces and in one bucket."""
    rng = random.Random(1)
    prints = {0x123456789ABCDEF}
    while len(prints) < 700:
        prints.add(0x123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(46, 64) if rng.random() < 0.8 else range(64), rng.randint(1, 6))))
    prints |= {rng.getrandbits(62) for _ in range(200)}
    values = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    found = {r.node: r.root for r in components(simhash.links(df, 4, hot_rows)).collect()}
    expected = plain_groups(values, [v & (1 << 64) - 1 for v in values])
    assert [found.get(v, v) for v in values] == expected


def test_long_bucket():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 9, 600, dtype=np.uint64) << np.uint64(3)) | np.uint64(1 << 40)
    fps = np.concatenate([fps, rng.integers(0, 1 << 63, 400, dtype=np.uint64)])
    a, b = simhash.bucket_links(np.zeros(len(fps), int), fps, 4)
    assert len(a) == len(fps) - 400 - 1


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_links_do_not_grow_with_tasks(spark):
    """Trees over the same nodes from many tasks are brought down to about one link for each node."""
    rng = random.Random(5)
    links = [(100, 101), (7, 7), (None, 3)]
    for _ in range(40):
        order = rng.sample(range(300, 600), 300)
        for part in (order[i:i + 30] for i in range(0, 300, 30)):
            links += [(min(part), x) for x in part if x != min(part)]
    df = spark.createDataFrame(links, "a long, b long")
    few = thinned(df).collect()
    assert len(set(links)) > 5000 and len(few) < 2 * 302
    found = {r.node: r.root for r in components(df).collect()}
    assert found == {**{i: 300 for i in range(300, 600)}, 100: 100, 101: 100}
