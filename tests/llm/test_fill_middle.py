"""Fill-in-the-middle against SQL and a plain loop, exact round trips, and the tree's cuts at every unit."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, connect
from spanwise.llm import fill_middle
from spanwise.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id long, text string, form string, output int, key string, n string, one int, whole int"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(i, text):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    one, two, three, four = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or three % 100 >= 50:
        return i, len(units), "plain", None, None, text
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if four % 100 < 80:
        return i, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_query_matches_sql(spark, sf_dir):
    assert compare(QUERIES["op13_fill_middle"](spark, sf_dir), connect(sf_dir), ORACLES["op13_fill_middle"]) == ""


def test_odd_rows_and_round_trip(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", "a b", "a b c", "<P>", "x <S> y", "x<M", "<<P", "ends <", "a <S", ">M> <",
             "äö é́ \U0001f600\U0001f600 z", "\x00 \x1f \x85  ", "one two\n\nthree  "] + ["word " * n for n in range(1, 12)]
    rows = [(i * 97 + j, t) for i, t in enumerate(texts) for j in range(8)] + [(None, "a b c d")] * 2
    made = fill_middle.fill_middle(spark.createDataFrame([(i, t, "f", 1, "k", "n", 2, 3) for i, t in rows], SCHEMA))
    found = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == sorted((plain(i, t) for i, t in rows), key=str)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t in rows)
    assert {r.form for r in found} == {"plain", "spm", "psm"}
    assert fill_middle.fill_middle(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block, run", [(1, 4), (3, 12), (8, 8), (64, 1 << 20)])
def test_every_cut_of_the_tree(monkeypatch, block, run):
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    monkeypatch.setattr(fill_middle, "RUN", run)
    rng = np.random.default_rng(block)
    for size in (0, 1, 2, 7, 60, 400):
        text = "".join(rng.choice(list("ab \n\tüß€😀"), size))
        units = UNITS.findall(text)
        tree = fill_middle.TextTree(text.encode())
        assert (tree.units, tree.points) == (len(units), len(text))
        for m in range(len(units) + 1):
            head = "".join(units[:m])
            assert tree.cut(m) == (len(head.encode()), len(head))


def test_a_very_long_text(spark):
    text = "".join(f"word{i} éé{'   ' * (i % 3)}\n" for i in range(300_000))
    rows = [(i, text) for i in range(6)]
    found = fill_middle.fill_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found)) == sorted(plain(i, t) for i, t in rows)
