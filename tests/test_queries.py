"""Every registered query against its SQL counterpart on the smallest data."""

import pytest

import __spark_entry__ as entry_point
from check import compare, connect
from registry import ORACLES, QUERIES



@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


def test_every_kidney_stage_has_an_adjusted_rate(spark):
    levels = {r.level for r in QUERIES["age_adjusted_rate"](spark, "/root/testdata/sf0.01").collect()}
    assert {"No CKD", "Stage 3a", "Stage 3b", "Stage 4", "Stage 5"} <= levels


def test_entry_gives_the_redacted_table(spark):
    rows = {r.group: r for r in entry_point.entry(spark).collect()}
    assert set(rows) <= set(range(8)) and rows[0].label == "All"
    assert any("[REDACTED]" in r.death_count for r in rows.values())
