"""Temporal list join against SQL, plain Python and odd rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from check import compare, connect
from spanwise.llm import url_lists
from spanwise.llm.queries import ORACLES, QUERIES

CAPTURES = "page_id long, url string, fetched timestamp_ntz, list string, hits int, name string, kind int"
ENTRIES = "list string, kind string, value string, at timestamp_ntz, action string, url string"
DAY = [dt.datetime(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]


def test_query_matches_sql(spark, sf_dir):
    df = QUERIES["op7_url_lists"](spark, sf_dir)
    assert compare(df, connect(sf_dir), ORACLES["op7_url_lists"]) == ""
    assert df.where("NOT allowed").count() > 0 and df.where("allowed").count() > 0


@pytest.mark.parametrize("url,names", [
    ("http://u:p@WWW.A.example:80/x/y?q#f", {"www.a.example/", "www.a.example/x", "www.a.example/x/y", "www.a.example", "a.example", "example"}),
    ("https://a.example", {"a.example/", "a.example", "example"}),
    ("//nothing", None), ("", None), (None, None), ("mailto:x", None),
])
def test_names(spark, url, names):
    row = spark.createDataFrame([(url,)], "url string").select(url_lists.url_names(F.col("url")).alias("n")).first()
    assert (row.n and {n.name for n in row.n}) == names


def plain(captures, entries):
    out = {}
    for i, url, at in captures:
        host, _, path = url.partition("://")[2].partition("/")
        steps, labels, hits = [s for s in path.split("/") if s], host.split("."), 0
        names = {("host", host)} | {("domain", ".".join(labels[n:])) for n in range(len(labels))}
        names |= {("prefix", "/".join([host, *steps[:n]]) + ("/" if n == 0 else "")) for n in range(len(steps) + 1)}
        for source in {e[0] for e in entries}:
            for kind, name in names:
                past = [(e[3], e[4] == "add") for e in entries if (e[0], e[1], e[2]) == (source, kind, name) and e[3] <= at]
                if past:
                    last = max(p[0] for p in past)
                    hits += all(add for t, add in past if t == last)
        out[i] = hits
    return out


def test_against_every_entry(spark):
    rng = random.Random(0)
    hosts = ["a.b.example", "b.example", "c.example"]
    values = [("host", h) for h in hosts] + [("domain", "b.example"), ("domain", "example")] + [("prefix", f"{h}/x") for h in hosts] + [("prefix", "b.example/")]
    entries = [(rng.choice("st"), *rng.choice(values), rng.choice(DAY), rng.choice(["add", "remove"])) for _ in range(90)]
    captures = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['', 'x', 'x/y', 'z'])}", rng.choice(DAY)) for i in range(300)]
    found = url_lists.judge(spark.createDataFrame([(*c, "", 1, "", 1) for c in captures], CAPTURES),
                            spark.createDataFrame([(*e, "u") for e in entries], ENTRIES)).collect()
    assert {r.page_id: r.hits for r in found} == plain(captures, entries)
    assert all(r.allowed == (r.hits == 0) == (r.name is None) for r in found)


def test_intervals(spark):
    rows = [("s", "host", "A.example", DAY[1], "add", ""), ("s", "host", "a.example ", DAY[3], "add", ""), ("s", "host", "a.example", DAY[5], "remove", ""),
            ("s", "host", "a.example", DAY[5], "add", ""), ("s", "host", "a.example", DAY[7], "remove", ""), ("s", "host", "a.example", DAY[9], "add", "")]
    found = sorted((r.valid_from, r.valid_to) for r in url_lists.validity(spark.createDataFrame(rows, ENTRIES)).collect())
    assert found == [(DAY[1], DAY[5]), (DAY[9], dt.datetime(9999, 12, 31))]


def test_odd_rows(spark):
    entries = [("s", "host", "a.example", DAY[2], "add", ""), ("s", "host", None, DAY[2], "add", ""), ("s", "host", "a.example", None, "remove", ""),
               (None, "domain", "b.example", DAY[2], "add", ""), ("s", "odd", "a.example", DAY[1], "add", ""), ("s", "host", "a.example", DAY[4], None, ""),
               ("s", None, "a.example", DAY[2], "add", ""), ("s", "host", " ", DAY[1], "add", "")]
    captures = [(1, None, DAY[3]), (2, "", DAY[3]), (3, "http://a.example", None), (4, "http://a.example/", DAY[2]), (4, "http://a.example/", DAY[2]),
                (None, "http://x.b.example/" + "p/" * 500, DAY[30]), (5, "http://a.example", DAY[1])]
    frame = spark.createDataFrame([(*c, "", 1, "", 1) for c in captures], CAPTURES)
    found = sorted(((r.page_id, r.allowed, r.kind) for r in url_lists.judge(frame, spark.createDataFrame(entries, ENTRIES)).collect()), key=str)
    assert found == sorted([(1, True, None), (2, True, None), (3, True, None), (4, False, "host"), (4, False, "host"), (None, False, "domain"), (5, True, None)], key=str)
    assert url_lists.judge(frame.limit(0), spark.createDataFrame(entries, ENTRIES)).count() == 0
    assert url_lists.judge(frame, spark.createDataFrame([], ENTRIES)).where("allowed").count() == len(captures)
