import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from registry import records as rec
from spanwise import session
from spanwise.functions.dates import days_after
from spanwise.operators import features as ft
from spanwise.operators import spells
from spanwise.operators.features import Feature
from spanwise.plans.extract import bmi_lower_bound, cohort_extract, deprivation_fifth, record_tasks, smoking_class
from spanwise.session import broadcast_if_small
from spanwise.sources import codelists as cl
from spanwise.sources.snapshots import snapshot_by

EVENTS = "patient_id long, event_date date, event_id long, system string, code string, value double"
D0 = date(2021, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


def lists(spark):
    return cl.inline(spark, {"a": ("gp", ["A.", "A.", "AB"]), "b": ("gp", [("B1", "x"), ("B2", "y")]), "other": ("icd10", ["A."])})


def test_features_by_hand(spark):
    events = spark.createDataFrame([
        (1, day(0), 1, "gp", "A.", 10.0), (1, day(5), 2, "gp", "A.", 20.0), (1, day(5), 3, "gp", "AB", 40.0),
        (1, day(30), 4, "gp", "A.", 99.0), (1, day(2), 5, "icd10", "A.", 7.0),
        (2, day(3), 6, "gp", "B1", None), (2, day(3), 7, "gp", "B2", None), (2, day(4), 8, "gp", "zzz", 1.0),
    ], EVENTS)
    index = spark.createDataFrame([(1, day(10)), (2, day(10)), (3, day(10)), (4, None)], "patient_id long, d date")
    out = ft.coded_features(index, events, lists(spark), [
        Feature("first", "a", "first_date"), Feature("last", "a", "last_date", None, F.col("d")),
        Feature("any", "a", "flag", F.col("d"), None), Feature("n", "a", "count", None, F.col("d")),
        Feature("last_value", "a", "last_value", None, F.col("d")), Feature("first_value", "a", "first_value"),
        Feature("mean", "a", "latest_day_mean", None, F.col("d")), Feature("day", "a", "latest_day", None, F.col("d")),
        Feature("category", "b", "last_category"),
    ])
    rows = {r.patient_id: r.asDict() for r in out.collect()}
    one = rows[1]
    assert (one["first"], one["last"], one["any"], one["n"]) == (day(0), day(5), True, 3)
    assert (one["last_value"], one["first_value"], one["mean"], one["day"]) == (40.0, 10.0, 30.0, day(5))
    assert rows[2]["category"] == "y" and rows[2]["n"] == 0 and rows[2]["any"] is False
    assert rows[3]["last"] is None and rows[3]["any"] is False and len(rows) == 4


def test_unknown_index_date_matches_nothing(spark):
    events = spark.createDataFrame([(4, day(1), 1, "gp", "A.", 1.0)], EVENTS)
    index = spark.createDataFrame([(4, None)], "patient_id long, d date")
    out = ft.coded_features(index, events, lists(spark), [
        Feature("n", "a", "count", None, F.col("d")), Feature("hit", "a", "flag", F.col("d"), None)]).collect()
    assert [(r.n, r.hit) for r in out] == [(0, False)]


def test_one_person_with_a_third_of_all_records_matches_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(6000):
        person = 0 if rng.random() < 0.34 else rng.randrange(1, 300)
        rows.append((person, day(rng.randrange(120)), i, "gp", rng.choice(["A.", "AB", "B1", "q"]), float(rng.randrange(100))))
    index_rows = [(p, day(rng.randrange(20, 100))) for p in range(320)]
    index = spark.createDataFrame(index_rows, "patient_id long, d date")
    out = ft.coded_features(index, spark.createDataFrame(rows, EVENTS), lists(spark), [
        Feature("n", "a", "count", None, F.col("d")), Feature("value", "a", "last_value", days_after(F.col("d"), -30), F.col("d")),
        Feature("first", "a", "first_date", F.col("d"), None), Feature("mean", "a", "latest_day_mean", None, F.col("d")),
    ]).collect()
    assert len(out) == 320
    bounds = dict(index_rows)
    for r in out:
        own = [e for e in rows if e[0] == r.patient_id and e[4] in ("A.", "AB")]
        d = bounds[r.patient_id]
        before = [e for e in own if e[1] <= d]
        recent = sorted((e[1], e[2], e[5]) for e in before if e[1] >= d - timedelta(days=30))
        assert r.n == len(before)
        assert r.value == (recent[-1][2] if recent else None)
        assert r["first"] == min((e[1] for e in own if e[1] >= d), default=None)
        last_day = max((e[1] for e in before), default=None)
        on_day = [e[5] for e in before if e[1] == last_day]
        assert (r["mean"] is None) == (not on_day)
        if on_day:
            assert abs(r["mean"] - sum(on_day) / len(on_day)) < 1e-9


def test_folding_keeps_one_row_per_day_and_tag(spark):
    rows = [(1, day(0), i, "gp", "A.", 1.0) for i in range(500)]
    tagged = ft.tag_by_codelist(spark.createDataFrame(rows, EVENTS), lists(spark), ["a"])
    folded = ft.fold_days(tagged, [Feature("n", "a", "count")]).collect()
    assert len(folded) == 1 and folded[0].n == 500


def test_code_listed_under_two_categories_counts_once(spark):
    codes = cl.inline(spark, {"c": ("gp", [("A.", "y"), ("A.", "x")])})
    events = spark.createDataFrame([(1, day(0), 1, "gp", "A.", 1.0)], EVENTS)
    index = spark.createDataFrame([(1, day(9))], "patient_id long, d date")
    out = ft.coded_features(index, events, codes, [Feature("n", "c", "count"), Feature("k", "c", "last_category")]).first()
    assert (out.n, out.k) == (1, "x")


def test_doses_chain(spark):
    rows = [(1, day(0)), (1, day(14)), (1, day(15)), (1, day(40)), (2, day(3)), (3, day(-9)), (3, day(1))]
    doses = spark.createDataFrame(rows, "patient_id long, event_date date")
    first = ft.first_dose(doses, F.lit(day(0)), F.lit(day(60)))
    out = {r.patient_id: (r.dose_1, r.dose_2) for r in ft.next_dose(doses, first, 15, F.lit(day(60))).collect()}
    assert out == {1: (day(0), day(15)), 2: (day(3), None), 3: (day(1), None)}


def test_dose_answers_equal_the_single_operators(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(30), day(rng.randrange(-20, 90)), i, "s", rng.choice(["A.", "b", "c"]), rng.random() < 0.1) for i in range(400)]
    records = spark.createDataFrame(rows, "patient_id long, event_date date, event_id long, system string, code string, worker boolean")
    codes = cl.inline(spark, {"v": ("s", ["A.", "b"])})
    start, end = F.lit(day(0)), F.lit(day(70))
    given = ft.matching(records, codes, "v")
    first = ft.next_dose(given, ft.first_dose(given, start, end), 15, end).join(ft.record_flag(records, F.col("worker"), "worker"), "patient_id")
    found = ft.dose_answers(records, codes, "v", start, end, 15, "worker")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, first.collect()))


def test_registration_answers_equal_the_single_operators(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        start = rng.randrange(0, 60)
        rows.append((rng.randrange(40), i, day(start), day(start + rng.randrange(1, 30)) if rng.random() < 0.8 else None, rng.choice(["x", "y", None])))
    spell = spark.createDataFrame(rows, "patient_id long, spell_id long, start_date date, end_date date, region string")
    index = spark.createDataFrame([(p, day(rng.randrange(5, 80))) for p in range(45)], "patient_id long, d date")
    later, end = days_after(F.col("d"), 3), F.lit(day(200))
    single = ft.join_all(
        spells.registered_as_of(index, spell, later), spells.attribute_as_of(index, spell, F.col("d"), "region", "region"),
        spells.deregistration_date(index, spell, F.col("d"), end, "left"))
    found = spells.registration_answers(index, spell, later, F.col("d"), "region", F.col("d"), end, "left")
    assert sorted(map(str, found.select(single.columns).collect())) == sorted(map(str, single.collect())) and found.count() > 10


def test_reach_cuts_records_without_changing_features(spark, tmp_path, capsys):
    """The widest window becomes constants in the scan, a semi join stands before the fold; unknown bounds reach nothing."""
    path = str(tmp_path / "events")
    rows = [(p, day(n), 100 * p + n, "gp", "A.", float(n)) for p in range(6) for n in range(0, 90, 7)]
    spark.createDataFrame(rows, EVENTS).write.parquet(path)
    index = spark.createDataFrame([(1, day(30)), (2, day(50)), (3, None)], "patient_id long, d date")
    wanted = [Feature("n", "a", "count", lower=days_after(F.col("d"), -20), upper=F.col("d")), Feature("last", "a", "last_date", days_after(F.col("d"), -9), F.col("d"))]
    codes = cl.inline(spark, {"a": ("gp", ["A."])})
    out = ft.coded_features(index, spark.read.parquet(path), codes, wanted)
    assert {r.patient_id: (r.n, r["last"]) for r in out.collect()} == {1: (3, day(28)), 2: (3, day(49)), 3: (0, None)}
    capsys.readouterr()
    ft.coded_features(index, spark.read.parquet(path), codes, wanted).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(event_date,2021-01-11)" in plan and "LessThanOrEqual(event_date,2021-02-20)" in plan and "LeftSemi" in plan
    assert ft.reach(index, wanted, [Feature("x", "a", "flag", upper=F.col("d"))], [Feature("y", "a", "flag")]).days == [
        (day(10), day(50)), (None, day(50)), (None, None)]
    assert ft.coded_features(index.where("d is null"), spark.read.parquet(path), codes, wanted).first().n == 0


def test_long_lists_of_texts_are_numbered_by_a_stored_sort(spark, monkeypatch):
    monkeypatch.setattr(ft, "SHORT_LIST", 2)
    rows = [(1, c) for c in "aabbc"] + [(2, None), (2, "é"), (2, "z"), (3, None)]
    df = spark.createDataFrame(rows, "patient_id long, code string")
    assert {r.patient_id: r["mode"] for r in ft.most_frequent_code(df, "code", "mode").collect()} == {1: "b", 2: "é"}
    plan = ft.most_frequent_code(df, "code", "mode")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_tables_in_buckets_of_the_person_join_without_an_exchange(spark):
    from spanwise.sources.snapshots import snapshot_by

    one, two = (snapshot_by(spark.range(200).withColumnRenamed("id", "patient_id").withColumn(c, F.lit(1)), c, "patient_id") for c in "ab")
    joined = one.hint("merge").join(two, "patient_id")
    assert joined.count() == 200 and "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()


def test_most_frequent_code_breaks_ties_by_larger_code(spark):
    rows = [(1, "2"), (1, "2"), (1, "3"), (1, "3"), (1, "1"), (2, None), (2, "1")]
    out = ft.most_frequent_code(spark.createDataFrame(rows, "patient_id long, code string"), "code", "mode").collect()
    assert {r.patient_id: r["mode"] for r in out} == {1: "3", 2: "1"}


def test_spells(spark):
    rows = [(1, 1, day(0), day(10), "x"), (1, 2, day(5), None, "y"), (1, 3, day(5), day(20), "z"), (2, 4, day(0), day(10), "x"), (3, 5, day(0), None, "w")]
    spell = spark.createDataFrame(rows, "patient_id long, spell_id long, start_date date, end_date date, region string")
    index = spark.createDataFrame([(1, day(7)), (2, day(10)), (3, day(0)), (4, day(1))], "patient_id long, d date")
    assert {r.patient_id for r in spells.registered_as_of(index, spell, F.col("d")).collect()} == {1, 3}
    got = {r.patient_id: r.region for r in spells.attribute_as_of(index, spell, F.col("d"), "region", "region").collect()}
    assert got == {1: "z", 3: "w"}
    left = {r.patient_id: r.left for r in spells.deregistration_date(index, spell, F.col("d"), F.lit(day(99)), "left").collect()}
    assert left == {1: None, 2: day(10), 3: None}


def test_semi_and_anti_join_split_the_records(spark):
    events = spark.createDataFrame([(1, day(0), 1, "gp", "A.", 1.0), (1, day(0), 2, "gp", "zz", 1.0), (1, day(0), 3, "icd10", "A.", 1.0)], EVENTS)
    assert [r.event_id for r in ft.matching(events, lists(spark), "a").collect()] == [1]
    assert sorted(r.event_id for r in ft.unmatched(events, lists(spark), "a").collect()) == [2, 3]


def test_large_sides_are_not_broadcast(spark):
    side = spark.range(100)
    assert "ResolvedHint" in side.join(broadcast_if_small(side, 200), "id")._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in side.join(broadcast_if_small(side, 50), "id")._jdf.queryExecution().analyzed().toString()


def test_categories(values):
    assert values([("S", False), ("E", False), ("N", True), ("N", False), (None, True)], "c string, e boolean",
                  lambda: smoking_class(F.col("c"), F.col("e"))) == ["S", "E", "E", "N", "M"]
    assert values([(None,), (0.0,), (100.0,), (6500.0,), (6600.0,), (32800.0,)], "r double", lambda: deprivation_fifth(F.col("r"))) == [
        "0", "0", "1", "1", "2", "5"]
    got = values([(date(2020, 6, 1), date(2003, 1, 1)), (date(2020, 6, 1), date(1950, 1, 1)), (date(2020, 6, 1), None)], "d date, b date",
                 lambda: bmi_lower_bound(F.col("d"), F.col("b")))
    assert got == [date(2019, 1, 1), date(2015, 6, 1), None]


def test_date_windows_reach_the_scan(spark, tmp_path, capsys):
    """Bounds on the record date are plain comparisons in the scan's pushed filters."""
    from spanwise.operators.features import first_dose

    path = str(tmp_path / "doses")
    spark.createDataFrame([(1, date(2021, 1, 5))], "patient_id long, event_date date").write.parquet(path)
    first_dose(spark.read.parquet(path), F.lit("2021-01-01").cast("date"), F.lit("2021-12-31").cast("date")).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(event_date,2021-01-01)" in plan and "LessThanOrEqual(event_date,2021-12-31)" in plan


def test_many_records_get_more_tasks(spark, sf_dir, monkeypatch):
    """The records of a task are bounded, whatever the session's number of shuffle partitions; the rows are the same."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    records, lists = rec.records(spark, sf_dir), rec.codelists(spark)
    tasks = record_tasks(records)
    assert tasks >= 4 * records.clinical.count() / 500 and tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = cohort_extract(records, lists, rec.DATES, lambda df, label: snapshot_by(df, label, "patient_id", tasks), tasks)
    plan = many._jdf.queryExecution().toString()
    assert f", {tasks})" in plan and "SelectedBucketsCount: " in plan

    def rows(df):
        return [[round(v, 6) if isinstance(v, float) else v for v in r] for r in df.orderBy("patient_id").collect()]

    assert rows(many) == rows(cohort_extract(records, lists, rec.DATES))


def test_tasks_of_many_records_are_not_put_together(spark, monkeypatch):
    """Where the session names more partitions than the records need, a step over many of them keeps them all."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        people = spark.range(1000).withColumnRenamed("id", "patient_id")
        days = session.dealt(people, session.tasks_for(spark, 1000), "patient_id").groupBy("patient_id").count()
        assert days.select(F.spark_partition_id()).distinct().count() == 32
        assert session.tasks_for(spark, 100) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Many partitions of the session do not cut a step into many more tasks than cores; more records do."""
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    before, cores = spark.conf.get("spark.sql.shuffle.partitions"), spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(100 * cores))
    try:
        assert session.tasks_for(spark, 1000) == session.CORE_TASKS * cores
        assert session.tasks_for(spark, 100 * 50 * cores) == 50 * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tests_outside_all_windows_are_left_out(spark):
    """Each rule keeps the records of its own windows: an early test counts only if it is positive."""
    index = spark.createDataFrame([(1, day(100))], "patient_id long, dose_2 date")
    late, until = F.col("dose_2"), F.date_add("dose_2", 50)
    near = ft.reach(index, [Feature("n", "any", "count", late, until)], [Feature("d", "positive", "first_date", upper=until)])
    records = spark.createDataFrame(
        [(1, day(10), False), (1, day(20), True), (1, day(30), None), (1, day(100), False), (1, day(150), None), (1, day(151), True), (1, None, True)],
        "patient_id long, event_date date, positive boolean")
    rules = {"any": near.on(0), "positive": near.on(1) & F.col("positive")}
    kept = near.cut(records, wanted=rules["any"] | rules["positive"])
    assert sorted(r.event_date for r in kept.collect()) == [day(20), day(100), day(150)]
    assert sorted(tuple(r) for r in ft.fold_rules(records, rules).collect()) == [
        (1, day(20), "positive", 1), (1, day(100), "any", 1), (1, day(150), "any", 1)]


def test_stages_hold_few_sorts_and_aggregates(spark, sf_dir, monkeypatch):
    """Doses are stored before registrations are joined, so that their sorts and aggregations are not held by the same tasks."""
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    records, plans = rec.records(spark, sf_dir), {}
    tasks = record_tasks(records)

    def stage(df, label):
        plans[label] = df._jdf.queryExecution().toString()
        return snapshot_by(df, label, "patient_id", tasks)

    cohort_extract(records, rec.codelists(spark), rec.DATES, stage, tasks)
    assert list(plans) == ["doses", "index", "known"]
    assert "Window" in plans["doses"] and "Window" not in plans["index"]


def test_most_frequent_code_of_many_records_is_dealt(spark):
    """Counts of a person's codes are spread over the named tasks, like the people."""
    records = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "c"), (3, None), (None, "c")], "patient_id long, code string")
    found = ft.most_frequent_code(records, "code", "top", 7)
    assert sorted((r.patient_id or 0, r.top) for r in found.collect()) == [(0, "c"), (1, "b"), (2, "c")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 7)") == plan.count("hashpartitioning(")


def test_listed_codes_go_below_joins(spark, sf_dir):
    """Only the parts with a listed code are joined to the order lines."""
    tagged = ft.tag_by_codelist(rec.medications(spark, sf_dir), rec.codelists(spark), ["immunosuppression_medication"])
    assert "In(p_brand" in tagged._jdf.queryExecution().toString() and tagged.count() > 0
