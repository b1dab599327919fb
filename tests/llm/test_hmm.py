"""The hidden Markov model: likelihoods by enumeration, expected counts by enumeration, counts and base scores in plain Python."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.llm import hmm
from spanwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, block int, n_tokens int"


@pytest.fixture
def tiny(monkeypatch):
    monkeypatch.setattr(hmm, "STATES", 2)
    monkeypatch.setattr(hmm, "CLASSES", 3)
    return hmm.Model.random(3)


def joint(model, path, seq):
    p = model.start[path[0]] * model.emit[seq[0], path[0]]
    for (a, b), x in zip(zip(path, path[1:]), seq[1:]):
        p *= model.move[a, b] * model.emit[x, b]
    return p


def test_likelihood_sums_over_all_paths(tiny):
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 4, n) for n in (1, 5, 3, 5, 2)]
    found = tiny.log_likelihoods(seqs)
    for s, f in zip(seqs, found):
        assert math.isclose(f, math.log(sum(joint(tiny, p, s) for p in itertools.product(range(2), repeat=len(s)))), rel_tol=1e-9)


@pytest.mark.parametrize("held, long, run", [(1, 100, 100), (3, 100, 100), (100, 100, 100), (100, 2, 2), (2, 3, 2), (100, 2, 1), (3, 4, 3)])
def test_expected_counts_average_over_all_paths(tiny, monkeypatch, held, long, run):
    """Whole sequences, whatever number of tokens is held at a time and whether long ones are cut into runs."""
    for name, value in (("HELD", held), ("LONG", long), ("RUN", run)):
        monkeypatch.setattr(hmm, name, value)
    seqs = [np.array([0, 2, 1, 3]), np.array([1, 3]), np.array([2, 2, 0, 1, 1, 0, 3]), np.array([3]), np.array([0, 3])]
    (found, logs), want = tiny.expected(seqs), np.zeros((1 + 2 + 4, 2))
    assert math.isclose(logs, tiny.log_likelihoods(seqs).sum(), rel_tol=1e-9)
    for s in seqs:
        paths = list(itertools.product(range(2), repeat=len(s)))
        weight = np.array([joint(tiny, p, s) for p in paths])
        for p, w in zip(paths, weight / weight.sum()):
            want[0, p[0]] += w
            for a, b in zip(p, p[1:]):
                want[1 + a, b] += w
            for k, x in zip(p, s):
                want[3 + x, k] += w
    assert np.allclose(found, want)


def test_training_sees_the_ends_of_long_texts_and_settles(spark, monkeypatch):
    """A word class that stands only at the end of long texts is learnt; more rounds would gain less than the limit a token."""
    texts = [f"{'aa bb ' * 700}{'zz ' * 200}" for _ in range(6)]
    docs = spark.createDataFrame([(i, t, "", 1, 1) for i, t in enumerate(texts)], SCHEMA)
    model, seqs = hmm.fit(docs), hmm.sequences_of([t.encode() for t in texts])
    assert model.emit[hmm.class_of(b"zz")].max() > 0.5
    counts, logs = model.expected(seqs)
    more = hmm.Model.estimated(counts).log_likelihoods(seqs).sum()
    assert (more - logs) / sum(map(len, seqs)) < hmm.SETTLED


def test_rows_that_stand_often_are_scored_once(spark):
    rows = [(7, "a b a", "", 1, 1)] * 200 + [(None, "c", "", 1, 1)] * 100 + [(7, "a b", "", 1, 1), (8, "a b a", "", 1, 1)] + [(9, None, "", 1, 1)] * 70
    docs = spark.createDataFrame(rows, SCHEMA)
    found = hmm.score(docs, docs, blocks=5)
    plain = Counter((r.doc_id, r.n_tokens) for r in found.collect())
    assert plain == {(7, 4): 200, (None, 2): 100, (7, 3): 1, (8, 4): 1, (9, 1): 70}
    score = {r.doc_id: r.score for r in found.where("n_tokens = 4").collect()}
    assert math.isclose(score[7], score[8], rel_tol=1e-12)


def test_query_against_plain_counts(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    tokens = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), None]
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    count = Counter(w for d, t in docs.items() if not held[d] for w in tokens(t))
    n, v = sum(count.values()), len(count)
    found = QUERIES["op5_hmm"](spark, sf_dir).collect()
    assert len(found) == len(docs)
    for r in found:
        own = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), n)
        assert r.n_known == sum(count[w] > 0 for w in own)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_classes_of_texts_are_those_of_their_words():
    texts = [b"", b" ", b"A bc\tdefgh\nThe ", b"x", "É naïve  ".encode(), b"longer-word," * 50]
    flat, size = hmm.class_ids(texts)
    assert size.tolist() == [len(t.split()) + 1 for t in texts]
    assert flat.tolist() == [c for t in texts for c in [*map(hmm.class_of, t.lower().split()), hmm.CLASSES]]
    assert [len(s) for s in hmm.sequences_of(texts)] == size.tolist()


def test_odd_rows(spark):
    rows = [(1, None, "x", 1, 1), (2, "", "x", 1, 1), (3, "a b", "x", 1, 1), (3, "a b", "x", 1, 1), (None, "A  b\tnew", None, None, None),
            (4, "c d " * 120_000, "x", 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = sorted(hmm.score(docs, docs.where("doc_id = 3"), blocks=2).collect(), key=str)
    by = {r.doc_id: r for r in found}
    assert len(found) == 6 and [by[i].n_tokens for i in (1, 2, 3, None, 4)] == [1, 1, 3, 4, 240_001]
    assert by[None].n_known == 3 and by[3].train_tokens == 6 and by[4].score < by[3].score < 0
    assert hmm.score(spark.createDataFrame([], SCHEMA), docs, blocks=2).count() == 0
    none = hmm.score(docs, docs.where("doc_id = 77"), blocks=2).where("doc_id = 3").first()
    assert (none.n_known, none.train_tokens, none.base_score) == (0, 0, 0.0)


def test_words_of_a_class_share_its_probability(spark):
    """Over all words of the training texts and one unknown word per class, the probabilities of a token sum to one."""
    docs = spark.createDataFrame([(i, f"aa bb cc dd{i % 5} {'ee ' * (i % 3)}", "", 1, 1) for i in range(30)], SCHEMA)
    known = hmm.word_counts(docs).collect()
    inside, size = Counter(), Counter()
    for r in known:
        inside[r["class"]] += r.c
        size[r["class"]] += 1
    share = Counter()
    for r in known:
        share[r["class"]] += (r.c + 1) / (inside[r["class"]] + size[r["class"]] + 1)
    for k, s in share.items():
        assert math.isclose(s + 1 / (inside[k] + size[k] + 1), 1)
    model = hmm.fit(docs)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and math.isclose(model.start.sum(), 1)


def test_blocks_get_a_task_each(spark):
    for n in (1, 2, 7, 60):
        numbers = hmm._apart(spark, n)
        assert len(set(numbers)) == n
        parts = spark.createDataFrame([(i,) for i in numbers], "block int").repartition(n, "block").select(F.spark_partition_id().alias("p"))
        assert sorted(r.p for r in parts.collect()) == list(range(n))


def test_texts_are_shuffled_once(spark):
    """The blocks' words and the scores read one shuffle of the texts."""
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string")
    found = hmm.score(docs, docs, blocks=3)
    assert len(found.collect()) == 40
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan") + final.count("Scan ExistingRDD") <= 2 and "ReusedExchange" in final
