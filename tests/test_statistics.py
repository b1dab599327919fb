import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanwise.operators import cox, quantiles, rates, summaries, survival
from spanwise.operators.poisson import poisson_rates
from spanwise.operators.wald import wald


def test_rates_reproduce_published_values(spark):
    rows = [(579780, 5912498), (28580, 5993535), (14, 2638)]
    df = spark.createDataFrame([(e, round(py * 365.25)) for e, py in rows], "e long, t long")
    out = [tuple(r) for r in df.select(*rates.rate_columns(F.col("e"), F.col("t")).values()).collect()]
    assert [r[1:] for r in out] == [(98.06, 97.93, 98.19), (4.77, 4.74, 4.8), (5.31, 4.06, 6.93)]
    assert [r[0] for r in out] == [py for _, py in rows]


def test_rate_without_events_or_time(spark):
    df = spark.createDataFrame([(0, 1000), (3, 0)], "e long, t long")
    none, timeless = df.select(*rates.rate_columns(F.col("e"), F.col("t")).values()).collect()
    assert tuple(none)[1:] == (0.0, 0.0, None) and tuple(timeless)[1:] == (None, None, None)


@pytest.mark.parametrize("hot, target", [(False, quantiles.TARGET), (True, quantiles.TARGET), (False, 2), (True, 2), (False, 1), (True, 8)])
def test_quantiles_match_brute_force(spark, monkeypatch, hot, target):
    """Small targets: the first slice of a group exceeds them, and is cut again."""
    monkeypatch.setattr(quantiles, "SLICES", 256 if target > 8 else 4)
    rng = random.Random(3)
    rows = []
    for _ in range(5000):
        value = 42.5 if hot and rng.random() < 0.4 else rng.lognormvariate(0, 2)
        rows.append((rng.choice("aab"), value))
    rows.append(("single", 3.0))
    cells = quantiles.value_counts(spark.createDataFrame(rows, "g string, v double"), ["g"], "v")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for kind in ("linear", "step"):
        out = {r.g: list(r)[1:] for r in quantiles.quantiles(cells, ["g"], probs, kind, target).collect()}
        for g in ("a", "b", "single"):
            own = np.sort([v for k, v in rows if k == g])
            if kind == "linear":
                wanted = np.quantile(own, probs)
            else:
                wanted = [own[max(math.ceil(round(len(own) * p, 9)), 1) - 1] for p in probs]
            assert np.allclose(out[g], wanted, rtol=1e-12), (kind, g)


def test_no_task_sorts_more_values_than_the_target(spark, monkeypatch):
    """A group whose first slice holds far more distinct values than the target."""
    monkeypatch.setattr(quantiles, "SLICES", 4)
    cells = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 20_000).cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    cuts = []
    cut_points = quantiles.cut_points
    monkeypatch.setattr(quantiles, "cut_points", lambda cells, keys: cuts.append(cells) or cut_points(cells, keys))
    out = quantiles.quantiles(cells, ["g"], [0.25, 0.5], "step", target=50).first()
    assert (out.q0, out.q1) == (4999.0, 9999.0)
    sizes = [max(r["count"] for r in c.groupBy("g", "part").count().collect()) for c in cuts]
    assert sizes[0] == 20_000 and sizes[-1] <= 100 and sizes == sorted(sizes, reverse=True)


def test_quantiles_of_more_groups_than_are_held_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 3)
    cells = quantiles.value_counts(spark.createDataFrame([(i % 9 or None, float(i)) for i in range(900)], "g int, v double"), ["g"], "v")
    out = {r.g: r.q0 for r in quantiles.quantiles(cells, ["g"], [0.5], "step").collect()}
    assert out == {g or None: sorted(float(i) for i in range(900) if i % 9 == g)[49] for g in range(9)}
    assert quantiles.quantiles(cells.where("g > 99"), ["g"], [0.5]).count() == 0


def km_brute(times, events):
    out, s, v, n = {}, 1.0, 0.0, len(times)
    for t in sorted(set(times)):
        d = sum(e for x, e in zip(times, events) if x == t)
        if d < n:
            s, v = s * (1 - d / n), v + d / (n * (n - d))
        else:
            s = 0.0
        out[t] = (n, s, v)
        n -= sum(x == t for x in times)
    return out


def test_kaplan_meier_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xxy"), rng.randrange(40), int(rng.random() < 0.3)) for _ in range(400)] + [("z", 3, 1), ("z", 5, 1)]
    rows += [("x", None, 1), ("x", -1, 1), ("x", 4, None)]
    df = spark.createDataFrame(rows, "g string, t int, e int")
    counts = survival.survival_counts(df, "t", "e", F.col("g"))
    got = {(r.group, r.time): r for r in survival.kaplan_meier(counts).collect()}
    for g in "xyz":
        own = [(t, e) for k, t, e in rows if k == g and t is not None and t >= 0 and e is not None]
        for t, (n, s, v) in km_brute(*zip(*own)).items():
            row = got[g, t]
            assert row.n_risk == n and abs(row.estimate - s) < 1e-12
            if s > 0:
                assert abs(row.conf_low - s * math.exp(-1.959963984540054 * math.sqrt(v))) < 1e-12
                assert row.conf_high <= 1
    curve = survival.cumulative_incidence(survival.kaplan_meier(counts))
    assert curve.where("group = 'z'").count() == 1  # survival of 0 is left out
    risk = {(r.group, r.time): r for r in survival.risk_table(counts, step=10).collect()}
    assert max(t for _, t in risk) == 40
    assert risk["z", 0].n_risk == 2 and risk["z", 0].n_risk_shown == "<8" and risk["z", 40].n_risk == 0
    assert risk["x", 10].n_risk == sum(1 for k, t, e in rows if k == "x" and t is not None and t >= 10 and e is not None)


def efron(beta, x, t, e):
    ll, u, info = 0.0, np.zeros(len(beta)), np.zeros((len(beta), len(beta)))
    w = np.exp(x @ beta)
    for day in np.unique(t[e == 1]):
        risk, dead = t >= day, (t == day) & (e == 1)
        d = dead.sum()
        ll += (x[dead] @ beta).sum()
        u += x[dead].sum(axis=0)
        for l in range(d):
            weight = w * risk - (l / d) * w * dead
            s0, s1 = weight.sum(), weight @ x
            s2 = (x * weight[:, None]).T @ x
            ll -= math.log(s0)
            u -= s1 / s0
            info += s2 / s0 - np.outer(s1, s1) / s0**2
    return ll, u, info


def survival_rows(n=300, seed=11):
    rng = np.random.default_rng(seed)
    level = rng.integers(0, 3, n)
    age = rng.integers(20, 90, n)
    hazard = np.exp(0.4 * (level == 1) - 0.3 * (level == 2) + 0.02 * (age - 50)) / 15
    time = np.minimum(np.floor(rng.exponential(1 / hazard)), 25).astype(int)
    event = (time < 25).astype(int)
    return level, age, time, event


def test_cox_likelihood_and_fit_match_brute_force(spark):
    level, age, time, event = survival_rows()
    names = ["none", "mild", "severe"]
    rows = [(names[a], int(b), int(c), int(d)) for a, b, c, d in zip(level, age, time, event)] + [("mild", None, 3, 1), (None, 50, 3, 1), ("mild", 50, None, 1)]
    df = spark.createDataFrame(rows, "factor string, age int, t int, e int")
    x = np.column_stack([level == 1, level == 2, (age - 50) / 10]).astype(float)
    outcome = [cox.Outcome("o", "e", "t")]
    counted = cox.model_cells(cox.outcome_cells(df.where("factor is not null"), outcome, ["factor", "age"]),
                              [(F.col("factor") == "mild").cast("double"), (F.col("factor") == "severe").cast("double"), (F.col("age") - 50) / 10], "m")
    beta = np.array([0.2, -0.1, 0.3])
    row = cox.partial_likelihood(counted, cox._betas(spark, {("o", "m"): beta}, 3), 3).first()
    ll, u, info = efron(beta, x, time, event)
    assert abs(row.ll - ll) < 1e-8 and np.allclose([row[f"u{j}"] for j in range(3)], u, atol=1e-8)
    assert np.allclose([[row[f"i{min(j, k)}_{max(j, k)}"] for k in range(3)] for j in range(3)], info, atol=1e-8)
    fitted = cox.fit(counted, 3)["o", "m"]
    _, u, info = efron(fitted["beta"], x, time, event)
    assert np.abs(u).max() < 1e-4 and np.allclose(fitted["se"], np.sqrt(np.diag(np.linalg.inv(info))), rtol=1e-6)
    table = {(r.model, r.term): r for r in cox.cox_ph(df, outcome, "factor", names).collect()}
    assert abs(table["age adjusted", "factormild"].estimate - math.exp(fitted["beta"][0])) < 1e-6
    assert set(m for m, _ in table) == {"unadjusted", "age adjusted"} and len(table) == 4


def test_cox_sums_tied_events_in_blocks_dealt_over_tasks(spark, monkeypatch):
    """Days with 1 to 400 events, cut into blocks of seven, give the sums of the whole day."""
    rng = np.random.default_rng(5)
    time = np.repeat([1, 2, 3, 4], [400, 7, 1, 60])
    x, event = rng.normal(size=(len(time), 2)).round(1), (rng.random(len(time)) < 0.9).astype(int)
    df = spark.createDataFrame([(*map(float, a), int(t), int(e)) for a, t, e in zip(x, time, event)], "a double, b double, t int, e int")
    counted = cox.model_cells(cox.outcome_cells(df, [cox.Outcome("o", "e", "t")], ["a", "b"]), [F.col("a"), F.col("b")], "m")
    ll, u, info = efron(np.array([0.3, -0.2]), x, time, event)
    for block in (7, 1 << 16):
        monkeypatch.setattr(cox, "TIED", block)
        step = cox.partial_likelihood(counted, cox._betas(spark, {("o", "m"): np.array([0.3, -0.2])}, 2), 2)
        row = step.first()
        assert row.events == event.sum() and abs(row.ll - ll) < 1e-8 and np.allclose([row.u0, row.u1], u, atol=1e-8)
        assert np.allclose([[row.i0_0, row.i0_1], [row.i0_1, row.i1_1]], info, atol=1e-8)
    plan = step._jdf.queryExecution().sparkPlan().toString().splitlines()
    window, events = (next(i for i, line in enumerate(plan) if what in line) for what in ("Window", "Generate explode(sequence((block"))
    assert any("Exchange" in line or "Repartition" in line for line in plan[events:window])


def test_cox_with_a_level_nobody_has(spark):
    level, age, time, event = survival_rows(120)
    rows = [("none" if a == 0 else "mild", int(b), int(c), int(d)) for a, b, c, d in zip(level, age, time, event)]
    df = spark.createDataFrame(rows, "factor string, age int, t int, e int")
    out = cox.cox_ph(df, [cox.Outcome("o", "e", "t")], "factor", ["none", "mild", "absent"]).collect()
    assert all((r.estimate is None) == (r.p_value is None) == (r.term == "factorabsent") and r.converged for r in out)


def test_cox_without_the_base_level(spark):
    """The indicators sum to one, so the last of them is aliased; the others are relative to it."""
    level, age, time, event = survival_rows(120)
    df = spark.createDataFrame([("mild" if a == 0 else "severe", int(b), int(c), int(d)) for a, b, c, d in zip(level, age, time, event)],
                               "factor string, age int, t int, e int")
    out = {(r.model, r.term): r for r in cox.cox_ph(df, [cox.Outcome("o", "e", "t")], "factor", ["none", "mild", "severe"]).collect()}
    other = {r.model: r for r in cox.cox_ph(df, [cox.Outcome("o", "e", "t")], "factor", ["severe", "mild"]).collect()}
    for model, r in other.items():
        assert out[model, "factorsevere"].estimate is None
        assert abs(out[model, "factormild"].estimate - r.estimate) < 1e-6


def test_cox_with_a_log_likelihood_of_zero(spark):
    df = spark.createDataFrame([("none", 50, 1, 0), ("mild", 60, 2, 0), ("mild", 55, 3, 1)], "factor string, age int, t int, e int")
    out = cox.cox_ph(df, [cox.Outcome("o", "e", "t")], "factor", ["none", "mild"]).collect()
    assert len(out) == 2 and all(r.estimate is None and r.converged for r in out)


def test_cox_says_when_it_has_not_converged(spark):
    level, age, time, event = survival_rows(120)
    df = spark.createDataFrame([(int(b), int(c), int(d)) for b, c, d in zip(age, time, event)], "age int, t int, e int")
    counted = cox.model_cells(cox.outcome_cells(df, [cox.Outcome("o", "e", "t")], ["age"]), [(F.col("age") - 50) / 10], "m")
    early, done = cox.fit(counted, 1, max_steps=1)["o", "m"], cox.fit(counted, 1)["o", "m"]
    assert not early["converged"] and done["converged"] and 1 < done["steps"] < 20


def test_wald_limits_may_be_infinite():
    assert wald(0.0, 400.0)[:3] == (1.0, math.exp(-400.0 * 1.959963984540054), math.inf)
    assert wald(800.0, 1.0)[0] == math.inf


def test_wald_reproduces_published_p_value():
    ratio, low, high = 0.7517462, 0.6576689, 0.8592809
    se = math.log(high / low) / (2 * 1.959963984540054)
    estimate, lower, upper, p = wald(math.log(ratio), se)
    assert abs(estimate - ratio) < 1e-12 and abs(lower - low) < 1e-6 and abs(upper - high) < 1e-6
    assert abs(p - 2.8737e-05) < 1e-8


def poisson_irls(x, y, offset):
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(y.sum() / np.exp(offset).sum())
    for _ in range(50):
        mu = np.exp(x @ beta + offset)
        beta = beta + np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu))
    mu = np.exp(x @ beta + offset)
    return beta, np.sqrt(np.diag(np.linalg.inv((x * mu[:, None]).T @ x)))


def test_age_adjusted_rates_match_direct_fit(spark):
    rng = np.random.default_rng(2)
    rows = [(level, float(age), int(rng.poisson(6 * (1 + i))), int(rng.integers(20000, 60000))) for i, level in enumerate(["none", "mild", "severe"]) for age in range(40, 80, 2)]
    rows = [(*r[:2], 0 if r[0] == "never" else r[2], r[3]) for r in rows + [("never", 50.0, 0, 40000)]]
    cells = spark.createDataFrame([("v", *r) for r in rows], "variable string, level string, age double, events long, days long")
    rows = [r for r in rows if r[0] != "never"]
    levels = ["none", "mild", "absent", "severe"]
    out = {r.level: r for r in poisson_rates(cells, levels).collect()}
    x = np.array([[1, r[0] == "mild", r[0] == "severe", r[1]] for r in rows], float)
    beta, se = poisson_irls(x, np.array([r[2] for r in rows], float), np.log([r[3] / 365250 for r in rows]))
    for name, estimate, error in (("none", beta[0], se[0]), ("mild", beta[0] + beta[1], se[1]), ("severe", beta[0] + beta[2], se[2])):
        assert np.allclose([out[name].rate_adj, out[name].lower_adj, out[name].upper_adj], np.exp([estimate, estimate - error, estimate + error]), rtol=1e-5)
    assert set(out) == {"none", "mild", "severe", "never"}  # a level that is not listed stays
    assert (out["never"].rate_adj, out["never"].lower_adj, out["never"].upper_adj) == (0.0, 0.0, math.inf)
    plain = {r.level: r for r in poisson_rates(cells, levels, with_age=False).collect()}
    for name in ("none", "mild", "severe"):
        own = [r for r in rows if r[0] == name]
        assert abs(plain[name].rate_adj / (sum(r[2] for r in own) * 365250 / sum(r[3] for r in own)) - 1) < 1e-6


@pytest.fixture(scope="module")
def frame(spark):
    """Random frame with a rare level that must be hidden."""
    rng = random.Random(1)
    pick = lambda options: None if rng.random() < 0.1 else rng.choice(options)
    rows = [(pick("abc"), pick("xyz"), None if rng.random() < 0.1 else rng.gauss(0, 1)) for _ in range(1000)]
    rows += [("d", "w", 0.0)] * 5
    return spark.createDataFrame(rows, "a string, b string, c double").cache()


def test_rare_levels_are_hidden_and_unused_levels_kept(frame):
    out = {r.level: r for r in summaries.summary_categorical(frame, ["a"], {"a": ["a", "b", "c", "d", "never"]}).collect()}
    assert out["d"].redacted and out["d"].n is None
    # the five hidden people are no more than the threshold, so the smallest other cell (a zero) goes too
    assert out["never"].redacted
    assert not out["(missing)"].redacted and out["(missing)"].pct_nonmiss == 0
    assert abs(out["a"].pct - out["a"].n / 1005) < 1e-12


def test_rounded_counts(frame):
    out = summaries.summary_categorical(frame, ["a"], accuracy=10).collect()
    assert all(r.n is None or r.n % 10 == 0 for r in out)


def test_crosstab_hides_by_both_margins(frame):
    out = {(r.level1, r.level2): r for r in summaries.crosstab_long(frame, "a", "b", total="Total").collect()}
    assert out["d", "w"].redacted and out["d", "w"].n is None
    assert out["a", "x"].n > 0 and abs(sum(out[l, "x"].pct or 0 for l in ("a", "b", "c", "(missing)")) - 1) < 1e-9
    assert ("d", "Total") in out and out["d", "Total"].redacted
    assert any(r.redacted for (l1, l2), r in out.items() if l2 == "w" and l1 != "d")


def test_numeric_summary(frame):
    row = summaries.summary_numeric(frame, ["c"]).first()
    known = np.array([r.c for r in frame.select("c").dropna().collect()])
    assert row.n == 1005 and row.n_nonmiss == len(known) and row.unique == len(set(known))
    assert abs(row["mean"] - known.mean()) < 1e-12 and abs(row["sd"] - known.std(ddof=1)) < 1e-12
    assert row.p50 == np.sort(known)[math.ceil(len(known) * 0.5) - 1] and (row["min"], row["max"]) == (known.min(), known.max())


def test_small_categories_hide_their_numbers(frame):
    out = {r.level: r for r in summaries.summary_by_category(frame, "a", "c").collect()}
    assert out["d"].n is None and out["d"]["mean"] is None and out["d"].redacted
    assert sum(r.redacted for r in out.values()) == 2  # one more level is hidden to protect it


def test_unknown_dates_only(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(None,)] * 9, "d date")
    row = summaries.summary_date(df, ["d"]).first()
    assert row.n_miss == 12 and row["mean"] is None and row.p50 is None


def test_profile_without_exact_distinct(frame):
    out = {r.column: r for r in summaries.dataset_profile(frame, exact_distinct=False).collect()}
    assert out["a"].n_unique == 4 and out["a"].type == "string" and out["c"].n == 1005
