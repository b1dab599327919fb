"""Exact copies against SQL and a plain loop; digits of every length, ends of texts, hot groups, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from spanwise.llm import radix
from spanwise.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, row long, `group` string, last int, group_size string, own int, digit int, whole string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "g", 2, "s", 3, 4, "w", "k") for i, t in rows], SCHEMA)


def plain(rows):
    """(doc_id, keep_id, group_size) of every row, and how many stay of each text."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    largest = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, largest[t or ""], len(groups[t or ""])) for i, t in rows), key=str), len(groups)


def agrees(spark, rows):
    found = radix.exact_copies(frame(spark, rows), own=[F.col("text").alias("t")]).collect()
    wanted, kept = plain(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in found), key=str) == wanted
    stay = [r for r in found if r.kept]
    assert len(stay) == kept == len({r.t or "" for r in stay}) and all(r.doc_id == r.keep_id for r in stay)


def test_query_matches_sql(spark, sf_dir):
    assert compare(QUERIES["op12_radix"](spark, sf_dir), connect(sf_dir), ORACLES["op12_radix"]) == ""


def test_digits_cover_all_bytes_once():
    for longest in (0, 1, 64, 65, 4672, 4673, 10_000_000):
        places = radix.digits(longest)
        assert places[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(places, places[1:]))
        assert sum(places[-1]) >= longest > places[-1][0] - (longest == 0)


@pytest.mark.parametrize("first, times, widest", [(1, 1, 1), (1, 2, 4), (64, 8, 1 << 20)])
def test_odd_rows_at_every_digit(spark, monkeypatch, first, times, widest):
    for name, value in zip(("FIRST", "TIMES", "WIDEST"), (first, times, widest)):
        monkeypatch.setattr(radix, name, value)
    rows = [(1, ""), (2, None), (3, "a"), (4, "a"), (5, "ab"), (6, "ab "), (7, "ab"), (8, "é"), (9, "é"), (10, "é"),
            (None, "ab"), (None, "z"), (None, "z"), (11, "A"), (11, "A"), (12, "ab\x00"), (12, "ab"), (13, "\x00")]
    agrees(spark, rows)


def test_ends_beside_digit_edges_and_long_texts(spark):
    edges = [63, 64, 65, 575, 576, 577, 4672, 5000, 40_000, 300_001]
    rows = [(i * 3 + j, "x" * n + ("" if j < 2 else "y")) for i, n in enumerate(edges) for j in range(3)]
    rows += [(100 + i, "p" * 299_999 + c) for i, c in enumerate("abca")]
    agrees(spark, rows)


def test_a_group_with_a_third_of_all_rows(spark):
    agrees(spark, [(i, "the same words again and again " * 40 if i % 3 == 0 else f"text {i // 5}") for i in range(900)])


def test_empty_table(spark):
    assert radix.exact_copies(frame(spark, [])).count() == 0
    assert radix.without_copies(frame(spark, [])).columns == frame(spark, []).columns


def test_one_row_of_each_text_stays_with_all_columns(spark):
    given = frame(spark, [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (5, "b")])
    stay = radix.without_copies(given)
    assert stay.schema.names == given.schema.names
    assert sorted((r.doc_id, r.text) for r in stay.collect()) == [(2, "a"), (4, ""), (5, "b")]


def test_no_digest_decides(spark, sf_dir):
    """The groups are those of the texts themselves."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in QUERIES["op12_radix"](spark, sf_dir).collect()}
    assert [(i, found[i].keep_id, found[i].group_size) for i, *_ in plain(rows)[0]] == plain(rows)[0]
    assert all(found[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows)
