"""The pipeline: each stage against what its operator promises, on the smallest tables and on odd rows."""

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline as cp
from spanwise.llm import decontaminate, language, mixing, near_copies, simhash


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in cp.STAGES:
        out.append((docs, docs := stage(spark, docs, sf_dir).cache()))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    for before, after in steps[:-1]:
        assert after.schema.simpleString() == before.schema.simpleString()
    assert steps[-1][1].columns == [*steps[-1][0].columns, "shard", "slot"]


def test_language_stage(steps):
    before, after = steps[0]
    found = language.predict(before, *language.fit(before.where(language.in_training()))).collect()
    assert ids(after) == sorted(r.doc_id for r in found if r.score >= 0.5)
    assert after.count() > 0.98 * before.count()


def jaccard_groups(docs):
    """Each document's smallest fellow, by brute force over the sets of five-word shingles, and the linked pairs of different sets."""
    sets = {}
    for r in docs.collect():
        words = (r.text or "").lower().split()
        sets[r.doc_id] = {" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    order, root, near = sorted(sets, key=lambda d: len(sets[d])), {d: d for d in sets}, []

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if len(sets[a]) < 0.8 * len(sets[b]):
                break
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                if sets[a] != sets[b]:
                    near.append((a, b))
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d in sets}, near


def test_near_duplicate_stage(steps):
    before, after = steps[1]
    assert ids(after) == sorted(set(jaccard_groups(before)[0].values())) and after.count() < before.count()


def test_decontamination_stage(spark, sf_dir, steps):
    before, after = steps[2]
    hit = {r.doc_id for r in decontaminate.matches(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert hit and ids(after) == [d for d in ids(before) if d not in hit]


def test_mixing_stage(steps):
    before, after = steps[3]
    taken = {r.doc_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mixing.mix(before).collect()}
    assert ids(after) == sorted(d for d, n in taken.items() for _ in range(n))


def test_sharding_stage(steps):
    before, after = steps[4]
    assert ids(after) == ids(before)
    slots = {}
    for r in after.select("shard", "slot").collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (None, "the river and the house", "en", "a", 1),
            (3, "the river and the house", "en", None, 1), (3, "the river and the house", "en", None, 1), (4, "12", "de", "b", 2)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, sf_dir).cache()
        assert docs.where("doc_id IN (1, 2, 4)").count() == 0 and docs.where("text IS NULL").count() == 0


def test_near_copies_go(spark):
    """Against all pairs: every link at 0.8 or more is found (recall 1), and the groups are those that the links make."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 1500 OR doc_id IN (7743, 9710)")
    groups, near = jaccard_groups(docs)
    assert len(near) > 5 and groups[596] == groups[917] and groups[7743] == groups[9710]
    found = {r.doc_id: r.component for r in near_copies.near_copies(docs).collect()}
    assert all(found[a] == found[b] for a, b in near)
    assert ids(simhash.keep_one(docs)) == sorted(set(groups.values()))


def crowd(spark, shared, n=150):
    """Texts that have the same passage of ``shared`` words and 60 of their own, and copies of some with one word changed."""
    rows = []
    for i in range(n):
        words = [f"s{j}" for j in range(shared)] + [f"o{i}x{j}" for j in range(60)]
        rows.append((i, " ".join(words), "en", "a", 1))
        if i % 10 == 0:
            rows.append((1000 + i, " ".join([*words[:-1], "changed"]), "en", "a", 1))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")


@pytest.mark.parametrize("shared", [70, 280])
def test_crowded_buckets_make_few_pairs(spark, monkeypatch, shared):
    """Texts that share a long passage meet in many buckets, at 280 words with a similarity of 0.7; only links leave the tasks."""
    pairs, across = [], near_copies._across
    monkeypatch.setattr(near_copies, "CHUNK", 8)
    monkeypatch.setattr(near_copies, "_across", lambda now, *rest: pairs.append((now.count(), across(now, *rest))) or pairs[-1][1])
    monkeypatch.setattr(near_copies, "CHUNK_BYTES", 1 << 14)
    docs = crowd(spark, shared)
    assert ids(simhash.keep_one(docs)) == list(range(150))
    (rows, out), = pairs
    assert rows > 200 and out.count() <= 30


@pytest.mark.parametrize("stars", [0, 2])
def test_chunks_lose_no_link(spark, monkeypatch, stars):
    monkeypatch.setattr(near_copies, "STARS", stars)
    monkeypatch.setattr(near_copies, "CHUNK", 4)
    monkeypatch.setattr(near_copies, "CHUNK_BYTES", 1 << 12)
    monkeypatch.setattr(near_copies, "CELLS", 1 << 10)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").unionByName(crowd(spark, 20, 30).withColumn("doc_id", F.col("doc_id") + 100_000))
    groups, near = jaccard_groups(docs)
    assert near and ids(simhash.keep_one(docs)) == sorted(set(groups.values()))


def test_similarities_of_chunks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 30, rng.integers(0, 40)).astype(np.uint64)) for _ in range(40)]
    got = near_copies._similar(sets[:15], sets[15:], 0.5)
    assert got.tolist() == [[near_copies.jaccard(a, b) >= 0.5 for b in sets[15:]] for a in sets[:15]]


HELPERS = ["_mix", "_plan", "_bucket", "_extra", "target", "edge", "of", "epochs", "bucket", "extra", "taken", "size", "room", "key", "_node", "_id",
           "node", "component", "place", "root", "_place", "same", "shard", "slot"]


def test_columns_with_the_names_of_helpers_stay(spark):
    rows = [(i, f"word{i % 7} " * (3 + i % 5), "en", "ab"[i % 2], 5, *range(i, i + len(HELPERS))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{h}` int" for h in HELPERS))
    given = {tuple(r) for r in docs.collect()}
    for out in (mixing.repeated(docs), simhash.keep_one(docs)):
        assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= given and out.count()


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:7 + i % 280] + [f"x{i}"] + base[7 + i % 280:]), "en", "a", 1) for i in range(400)]
    rows += [(1000 + i, " ".join(f"y{i}z{j}" for j in range(40)), "en", "a", 1) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert ids(simhash.keep_one(docs)) == [0, *range(1000, 1050)]


def test_a_key_on_different_texts(spark):
    one, two, other = (" ".join(f"{c}{i}" for i in range(20)) for c in "abc")
    rows = [(t[0], t[1], "en", "a", 1) for t in ((2, one), (5, one), (5, two), (5, two), (7, two), (2, other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()) == [(2, one), (2, other), (5, two)]


def test_fingerprints_link_what_no_band_does(spark, monkeypatch):
    """The stage rests on SimHash links as well: with bands that no two texts share, close texts still go, and only those."""
    rng = np.random.default_rng(3)
    long = [f"w{i}" for i in rng.integers(0, 5000, 900)]
    changed = [*long[:450], "other", *long[451:]]
    rows = [(5, " ".join(long)), (2, " ".join(changed)), (7, " ".join(f"v{i}" for i in rng.integers(0, 5000, 900))), (9, "of two words"), (8, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = near_copies.sketches

    def apart(*args):
        found = whole(*args)
        return found.withColumns({c: F.xxhash64("node", F.lit(c)) for c in found.columns if c.startswith("b")})

    monkeypatch.setattr(near_copies, "sketches", apart)
    assert ids(simhash.keep_one(docs)) == [2, 4, 7, 9]


def test_text_links(spark):
    """Against all pairs: texts are joined as steps of four bits join them; distant ones share no link."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("node", near_copies.text_number("text"))
    prints = {r.node: r.fp & (2**64 - 1) for r in simhash.fingerprints(docs, "node", "text", 5).collect()}

    def groups(pairs):
        root = {n: n for n in prints}

        def top(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in pairs:
            x, y = sorted((top(a), top(b)))
            root[y] = x
        return {n: top(n) for n in prints}

    nodes = sorted(prints)
    near = [(a, b) for i, a in enumerate(nodes) for b in nodes[i + 1:] if (prints[a] ^ prints[b]).bit_count() <= 4]
    found = [(r.a, r.b) for r in simhash.text_links(docs).collect()]
    assert near and all(a < b for a, b in found) and groups(found) == groups(near)
