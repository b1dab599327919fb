"""Benchmark items in texts: against a brute-force search, paraphrases, near misses and odd rows."""

import random
from collections import Counter

import pytest

from spanwise.llm import decontaminate as de
from spanwise.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, share int, item_id string"
BENCH = "item_id long, text string"


def plain_matches(docs, items, least=0.8):
    """Pairs in which some window of a text holds an item's words in order, by sliding over every word."""
    out = set()
    for d, text in docs:
        words = de.words_of(text or "")
        have = Counter(words)
        for i, item in items:
            if sum((Counter(item) & have).values()) < least * len(item):
                continue
            if any(de.common_subsequence(item, words[s:s + len(item) + 6]) >= least * len(item) for s in range(max(1, len(words) - 4))):
                out.add((d, i))
    return out


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
        assert de.common_subsequence(a, b) == row[-1]


@pytest.fixture(scope="module")
def found(spark):
    return QUERIES["op10_decontamination"](spark, "/root/testdata/sf0.01").collect()


def test_query_matches_brute_force(spark, found):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    items = [(r.item_id, de.words_of(r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    truth = plain_matches(docs, items)
    assert truth and {(r.doc_id, r.item_id) for r in found} == truth
    words = {d: de.words_of(t) for d, t in docs}
    for r in found:
        item = dict(items)[r.item_id]
        assert r.share >= 0.6 and set(item[-3:]) & set(words[r.doc_id][r.first_word:r.first_word + 2 * len(item) + 12])


def _vocabulary():
    rng = random.Random(5)
    return [f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdfgklmnprst')}{i}".replace("0", "o").replace("1", "i")
            for i in range(3000)], rng


@pytest.fixture(scope="module")
def world(spark):
    vocabulary, rng = _vocabulary()
    common = vocabulary[:30]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]
    items = [say(30) for _ in range(40)]
    rows, truth = [], set()
    for d in range(600):
        words = say(rng.randint(5, 300))
        kind, item = d % 6, items[d % 40]
        if kind == 0:  # a copy
            words[3:3] = item
            truth.add((d, d % 40))
        elif kind == 1:  # a paraphrase: six words changed or left out, the answer kept
            changed = item[:-8]
            for p in rng.sample(range(len(changed)), 6):
                changed[p] = rng.choice(vocabulary)
            words[2:2] = changed + item[-8:]
            truth.add((d, d % 40))
        elif kind == 2:  # a short quotation is no leak
            words[2:2] = item[5:14]
        rows.append((d, " ".join(words).upper() if d % 4 == 0 else ", ".join(words), 1, "x"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], BENCH)
    return spark.createDataFrame(rows, SCHEMA), bench, truth


def test_copies_and_paraphrases_are_found(world):
    docs, bench, truth = world
    got = {(r.doc_id, r.item_id) for r in de.matches(docs, bench).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and got <= truth


def test_clean_documents_stay_as_they_are(world):
    docs, bench, truth = world
    kept = de.without_matches(docs, bench)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone <= {d for d, _ in truth} and len(gone) >= 0.97 * len(truth)


def plain_paraphrases(docs, items, paraphrase=0.6, verbatim=0.8, answer=0.75):
    """Pairs in which some window of the item's length and twelve words holds a copy or a paraphrase, by sliding over every word."""
    out = set()
    for d, text in docs:
        words = de.words_of(text or "")
        have = Counter(words)
        for i, item in items:
            if sum((Counter(item) & have).values()) < paraphrase * len(item):
                continue
            if any(de.match(item, words[s:s + len(item) + 12], verbatim, paraphrase, answer) for s in range(max(1, len(words) - 4))):
                out.add((d, i))
    return out


def test_latent_neighbours_find_paraphrases(spark, world):
    """Paraphrases with a third of the words changed, rare ones first: the latent search finds them, seeds alone do not."""
    _, bench, _ = world
    vocabulary, _ = _vocabulary()
    rng = random.Random(11)
    items = [(r.item_id, r.text.split()) for r in bench.collect()]
    rows = []
    for d in range(200):
        i, changed = items[d % 40][0], list(items[d % 40][1])
        for p in sorted(range(len(changed) - 7), key=lambda p: changed[p] in vocabulary[:30])[:10]:
            changed[p] = rng.choice(vocabulary)
        around = [rng.choice(vocabulary) for _ in range(60)]
        rows.append((d, " ".join(around[:30] + changed + around[30:]), 1, "x"))
    rows += [(d, " ".join(rng.choice(vocabulary) for _ in range(90)), 1, "x") for d in range(200, 800)]
    docs = spark.createDataFrame(rows, SCHEMA)
    truth = plain_paraphrases([r[:2] for r in rows], [(i, [w.encode() for w in ws]) for i, ws in items])
    assert len(truth) >= 190
    found = {(r.doc_id, r.item_id) for r in de.matches(docs, bench).collect()}
    blind = {(r.doc_id, r.item_id) for r in de.matches(docs, bench, cosine=9.0).collect()}
    assert found <= truth and len(found) >= 0.9 * len(truth)
    assert len(blind) <= 0.1 * len(truth)


def test_copies_need_no_latent_neighbour(world):
    """Seeds find every copy of at least four fifths of an item's words, whatever the latent space says."""
    docs, bench, _ = world
    items = [(r.item_id, de.words_of(r.text)) for r in bench.collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id % 3 < 2 and r.doc_id < 240]
    truth = plain_matches(rows, items)
    blind = {(r.doc_id, r.item_id) for r in de.matches(docs, bench, cosine=9.0).collect()}
    assert truth and truth <= blind


def test_odd_rows(spark, world):
    _, bench, _ = world
    item = bench.where("item_id = 3").first().text
    rows = [(1, None, 1, ""), (2, "", 1, ""), (3, item, 1, ""), (3, item, 1, ""), (None, "x " * 40_000 + item, None, None), (4, "a b", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    more = bench.unionByName(spark.createDataFrame([(90, None), (91, ""), (92, "..."), (None, item)], BENCH))
    got = sorted((str(r.doc_id), str(r.item_id), r.share) for r in de.matches(docs, more).collect())
    assert got == sorted([(d, i, 1.0) for d in ("3", "3", "None") for i in ("3", "None")])
    assert de.without_matches(docs, more).count() == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert de.matches(empty, bench).count() == 0 and de.without_matches(empty, bench).count() == 0
    assert de.matches(docs, bench.limit(0)).count() == 0 and de.without_matches(docs, bench.limit(0)).count() == 6


def test_short_items_are_found_word_for_word(spark):
    docs = spark.createDataFrame([(1, "so A, b it is", 1, ""), (2, "a c b", 1, ""), (3, "a", 1, ""), (4, "one two three four!", 1, ""), (5, "one two four three", 1, "")], SCHEMA)
    bench = spark.createDataFrame([(1, "a b"), (2, "One two three four"), (3, "A-B"), (4, "zebra")], BENCH)
    got = sorted((r.doc_id, r.item_id, r.share, r.first_word) for r in de.matches(docs, bench).collect())
    assert got == [(1, 1, 1.0, 1), (1, 3, 1.0, 1), (4, 2, 1.0, 0)]
    assert sorted(r.doc_id for r in de.without_matches(docs, bench).collect()) == [2, 3, 5]


def test_keys_of_other_types_and_clashing_names(spark, world):
    docs, bench, truth = world
    few = docs.where("doc_id < 60").selectExpr("CAST(doc_id AS int) AS share", "text AS columns", "'x' AS seen", "doc_id AS _key", "1L AS answer_share", "share AS first_word")
    items = bench.selectExpr("CAST(item_id AS int) AS share", "text", "1 AS item")
    got = de.matches(few, items, key="share", text="columns", item="share")
    assert got.columns == ["share", "share_", "share__", "answer_share", "first_word"]
    assert [f.dataType.simpleString() for f in got.schema][:2] == ["int", "int"]
    want = {(d, i) for d, i in truth if d < 60}
    assert len({(r[0], r[1]) for r in got.collect()} & want) >= 0.95 * len(want)
    kept = de.without_matches(few, items, key="share", text="columns", item="share")
    assert kept.columns == few.columns and 40 <= kept.count() <= 41


def test_many_items_are_searched_in_turns(world, monkeypatch):
    docs, bench, truth = world
    monkeypatch.setattr(de, "ITEMS_AT_ONCE", 25)
    got = {(r.doc_id, r.item_id) for r in de.matches(docs, bench).collect()}
    assert len(got & truth) >= 0.95 * len(truth) and got <= truth


def test_copies_of_common_words_among_rare_ones(spark):
    """An item that stands in a third of all rows, in other documents among rare words of other items."""
    rng = random.Random(3)
    say = lambda kind, n: [f"{kind}{i}" for i in rng.sample(range(400), n)]
    plain, items = say("c", 24), [say("r", 24) for _ in range(12)]
    rows = [(d, " ".join(plain), 1, "x") for d in range(400)]
    rows += [(d, " ".join(say("n", 60)), 1, "x") for d in range(400, 1200)]
    for d in range(1200, 1230):
        rare = [w for i in rng.sample(items, 8) for w in i[:2]]
        rows.append((d, " ".join(say("n", 16) + rare[:8] + plain + rare[8:] + say("n", 16)), 1, "x"))
    docs, bench = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([plain, *items])], BENCH)
    truth = plain_matches([(r[0], r[1]) for r in rows if r[0] % 40 == 0 or r[0] >= 1200], [(i, [x.encode() for x in w]) for i, w in enumerate([plain, *items])])
    got = {(r.doc_id, r.item_id) for r in de.matches(docs, bench).collect()}
    assert {(d, 0) for d in range(1200, 1230)} <= truth <= got and got == {(d, 0) for d in [*range(400), *range(1200, 1230)]}
    assert {r.doc_id for r in de.without_matches(docs, bench).collect()} == set(range(400, 1200))
