import pytest
from pyspark.sql import functions as F

from spanwise.operators import disclosure as dc


def masked(spark, counts, **options):
    df = spark.createDataFrame(list(enumerate(counts)), "i int, n int")
    out = df.withColumn("m", dc.suppress_mask(F.col("n"), [F.lit(1)], ["i"], **options)).orderBy("i").collect()
    return [r.m for r in out]


def test_small_counts_are_masked_and_zeros_shown(spark):
    assert masked(spark, [3, 4, 0, 20]) == [True, True, False, False]


def test_next_smallest_is_masked_when_the_hidden_sum_is_small(spark):
    assert masked(spark, [2, 9, 20]) == [True, True, False]
    assert masked(spark, [2, 9, 9]) == [True, True, False]


def test_a_zero_may_be_the_next_smallest_unless_skipped(spark):
    assert masked(spark, [2, 0, 20]) == [True, True, False]
    assert masked(spark, [2, 0, 20], skip_zero=True) == [True, False, True]


def test_nothing_to_mask_and_all_masked(spark):
    assert masked(spark, [0, 6, 7]) == [False, False, False]
    assert masked(spark, [1, 2]) == [True, True]
    assert masked(spark, [5]) == [True]


def test_missing_and_negative_counts_fail(spark):
    for bad in (None, -1):
        df = spark.createDataFrame([(bad,)], "n long")
        with pytest.raises(Exception, match="counts must be known"):
            df.select(dc.checked_count(F.col("n"))).collect()


def test_dependent_columns_follow_the_original_count(spark):
    df = spark.createDataFrame([(7, 1.0), (8, 2.0), (None, 3.0)], "n int, rate double")
    assert [tuple(r) for r in dc.suppress_small_rows(df, {"n": ["rate"]}).collect()] == [(None, None), (8, 2.0), (None, None)]


def test_percentages_are_checked_by_the_count_behind_them(spark):
    df = spark.createDataFrame([(100, 7.0), (100, 8.0), (1000, 0.0)], "n int, p double")
    assert [r.p for r in dc.suppress_small_percentages(df, ["p"], "n").collect()] == [None, 8.0, None]


def test_totals_are_rebuilt_from_visible_rows(spark):
    published = [98402, 1073144, 555819, 1990756, 725043, 4730157, 6328232]
    rows = [(0, sum(published))] + list(enumerate(published, 1)) + [(8, None)]
    df = dc.round_counts(spark.createDataFrame(rows, "g int, n long"), ["n"])
    out = {r.g: r.n for r in dc.rebuild_totals(df, ["n"], F.col("g") == 0).collect()}
    assert out[0] == 15501550 and out[1] == 98400 and out[8] is None


def test_two_way(spark):
    rows = [("a", "x", 3), ("a", "y", 30), ("b", "x", 40), ("b", "y", 50), ("c", "x", 60), ("c", "y", 70)]
    out = {(r.r, r.c): r.redacted for r in dc.suppress_two_way(spark.createDataFrame(rows, "r string, c string, n int"), "n", "r", "c").collect()}
    assert out == {("a", "x"): True, ("a", "y"): True, ("b", "x"): True, ("b", "y"): False, ("c", "x"): False, ("c", "y"): False}


def test_ties_for_the_second_cell_follow_the_declared_order(spark):
    """Normal and Elevated have equal counts: by name Elevated would be hidden, the declared order hides Normal."""
    from spanwise.operators.summaries import crosstab_long, summary_by_category, summary_categorical

    counts = {"Normal": 7, "Elevated": 7, "High": 3, "Unknown": 90}
    df = spark.createDataFrame([(level, "x", 1.0) for level, n in counts.items() for _ in range(n)], "bp string, other string, v double")
    hidden = lambda rows, name: {r[name] for r in rows.collect() if r.redacted}
    declared = ["Normal", "Elevated", "High", "Unknown"]
    assert hidden(summary_categorical(df, ["bp"], {"bp": declared}), "level") == {"Normal", "High"}
    assert hidden(summary_categorical(df, ["bp"]), "level") == {"Elevated", "High"}
    assert hidden(summary_by_category(df, "bp", "v", levels=declared), "level") == {"Normal", "High"}
    assert "Normal" in hidden(crosstab_long(df, "bp", "other", levels1=declared), "level1")
