from pyspark.sql import functions as F

from spanwise.operators import reshape as rs


def test_complete_levels_fills_missing_levels(spark):
    counts = spark.createDataFrame([("g", "a", 3), ("h", "b", 2)], "grp string, lvl string, n long")
    out = {(r.grp, r.lvl): r.n for r in rs.complete_levels(counts, "lvl", ["a", "b", "c"], ["grp"]).collect()}
    assert out == {("g", "a"): 3, ("g", "b"): 0, ("g", "c"): 0, ("h", "a"): 0, ("h", "b"): 2, ("h", "c"): 0}
    alone = rs.complete_levels(counts.select("lvl", "n"), "lvl", ["a", "z"]).collect()
    assert {r.lvl: r.n for r in alone} == {"a": 3, "z": 0}


def test_join_with_built_key(spark):
    left = spark.createDataFrame([("stage1", 1), ("stage2", 2)], "term string, x int")
    right = spark.createDataFrame([("1", 10)], "level string, y int")
    out = rs.left_join_on(left, right, {"term": F.concat(F.lit("stage"), F.col("level"))})
    assert sorted((r.term, r.y) for r in out.collect()) == [("stage1", 10), ("stage2", None)]


def test_melt_and_pivot(spark):
    df = spark.createDataFrame([(1, "a", 2, None), (2, None, 3, 1.5)], "id int, s string, i int, x double")
    long = rs.melt(df, ["id"], ["s", "i", "x"])
    assert sorted((r.id, r.variable, r.value) for r in long.collect() if r.value) == [(1, "i", "2"), (1, "s", "a"), (2, "i", "3"), (2, "x", "1.5")]
    wide = rs.pivot_wide(long, ["id"], "variable", ["s", "i"], ["value"]).orderBy("id").collect()
    assert [tuple(r) for r in wide] == [(1, "a", "2"), (2, None, "3")]


def test_drop_pairs_split_and_union(spark):
    df = spark.createDataFrame([("v", "x", 1), ("v", None, 2), ("w", "x", 3)], "variable string, level string, n int")
    assert sorted(r.n for r in rs.drop_pairs(df, "variable", "level", [("v", "x")]).collect()) == [2, 3]
    parts = rs.split_column(spark.createDataFrame([("1 (2)",), ("3",)], "c string"), "c", r" [(]", ["a", "b"]).collect()
    assert [tuple(r) for r in parts] == [("1", "2)"), ("3", None)]
    both = rs.union_rows(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "a int, b int"))
    assert sorted(tuple(r) for r in both.collect()) == [(1, None), (2, 3)]


def test_natural_join_and_share(spark):
    a = spark.createDataFrame([("x", 1, 3), ("x", 2, 1)], "k string, j int, n int")
    b = spark.createDataFrame([("x", 1, 9)], "k string, j int, m int")
    assert sorted((r.j, r.m) for r in rs.natural_left_join(a, b).collect()) == [(1, 9), (2, None)]
    assert sorted(r.share for r in rs.share(a, "n", ["k"]).collect()) == [0.25, 0.75]
