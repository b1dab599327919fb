"""Cox proportional hazards with Efron ties, fitted for many outcomes and models together.

People are counted once into cells (model, day, covariate pattern). Each Newton step is one Spark job over the
cells: sums per day, a running total from the last day backwards, and one row of likelihood, score and information
per model. Only those rows reach the driver, which solves systems of a few unknowns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.operators.wald import wald

#: Tied events of a day that one row of a block stands for.
TIED = 1 << 16


@dataclass(frozen=True)
class Outcome:
    name: str
    event: str
    time: str


def outcome_rows(df: DataFrame, outcomes: Sequence[Outcome], keep: Sequence[str]) -> DataFrame:
    """One row per person and outcome with known time and event, in one pass."""
    stacked = F.explode(F.array(*[
        F.struct(F.lit(o.name).alias("outcome"), F.col(o.time).cast("int").alias("time"), F.col(o.event).cast("int").alias("event"))
        for o in outcomes
    ]))
    return df.select(*keep, stacked.alias("s")).select(*keep, "s.*").where(
        F.col("time").isNotNull() & F.col("event").isNotNull()
    )


def outcome_cells(df: DataFrame, outcomes: Sequence[Outcome], covariates: Sequence[str]) -> DataFrame:
    """People and events by outcome, day and covariate values; unknown covariates are dropped."""
    rows = outcome_rows(df, outcomes, covariates).dropna(subset=list(covariates))
    return rows.groupBy("outcome", "time", *covariates).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("event").cast("bigint")).alias("d")
    )


def model_cells(counted: DataFrame, terms: Sequence[Column], model: str) -> DataFrame:
    """The cells of one model with its covariates as ``x0, x1, …``."""
    xs = [c.cast("double").alias(f"x{i}") for i, c in enumerate(terms)]
    return counted.select("outcome", "time", "n", "d", *xs).groupBy("outcome", "time", *[f"x{i}" for i in range(len(xs))]).agg(
        F.sum("n").alias("n"), F.sum("d").alias("d")
    ).withColumn("model", F.lit(model))


def partial_likelihood(counted: DataFrame, betas: DataFrame, p: int) -> DataFrame:
    """Log likelihood ``ll``, score ``u*`` and information ``i*_*`` per outcome and model at given coefficients.

    ``betas`` has one row per outcome and model with columns ``b0 … b(p-1)``. Expressions are SQL text: a Newton
    step builds the same plan again, and text is far quicker to assemble than nested Column objects.
    """
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    moments = {"0": "1D"} | {f"{j}_": f"x{j}" for j in range(p)} | {f"{j}_{k}": f"x{j} * x{k}" for j, k in pairs}
    linear = " + ".join(f"x{j} * b{j}" for j in range(p))
    weighted = counted.join(F.broadcast(betas), ["outcome", "model"]).selectExpr("*", f"{linear} AS xb").selectExpr(
        "*", "n * exp(xb) AS nw", "d * exp(xb) AS dw")
    sums = ["cast(sum(d) as double) AS d", "sum(d * xb) AS dxb", *[f"sum(d * x{j}) AS dx{j}" for j in range(p)]]
    sums += [f"sum(nw * {x}) AS s{m}" for m, x in moments.items()] + [f"sum(dw * {x}) AS e{m}" for m, x in moments.items()]
    daily = weighted.groupBy("outcome", "model", "time").agg(*[F.expr(e) for e in sums])
    # at most one row per model and day from here on
    back = "OVER (PARTITION BY outcome, model ORDER BY time DESC ROWS UNBOUNDED PRECEDING)"
    at_risk = daily.selectExpr(
        "outcome", "model", "time", "d", "dxb", *[f"dx{j}" for j in range(p)], *[f"e{m}" for m in moments],
        *[f"sum(s{m}) {back} AS s{m}" for m in moments],
    ).where("d > 0")
    # a day's tied events l = 0 .. d-1 are cut into blocks, which are dealt out; the sums over f_l = s0 - l/d * e0 are
    # plain sums for any number of events on a day, and what belongs to the day as a whole counts in its first block
    keys = ["outcome", "model", "time", "block"]
    blocks = at_risk.selectExpr("*", f"explode(sequence(0L, cast(ceil(d / {TIED}) as bigint) - 1)) AS block").repartition(*keys)
    kept = [f"first({c}) AS {c}" for c in blocks.columns if c not in keys]
    each = blocks.selectExpr(
        "*", f"explode(sequence(block * {TIED}, least(cast(d as bigint), (block + 1) * {TIED}) - 1)) AS l").selectExpr("*", "s0 - l / d * e0 AS f")
    tied = each.groupBy(*keys).agg(*map(F.expr, [*kept, "sum(ln(f)) AS r0", "sum(1D / f) AS c1", "sum(1D / (f * f)) AS c2"])).selectExpr(
        "*", "if(block = 0, 1D, 0D) AS own", *[f"e{j}_ / e0 AS r_{j}" for j in range(p)]).selectExpr("*", *[f"s{j}_ - r_{j} * s0 AS u_{j}" for j in range(p)])
    out = ["sum(own * dxb - r0) AS ll", "cast(sum(own * d) as bigint) AS events"]
    out += [f"sum(own * (dx{j} - d * r_{j}) - u_{j} * c1) AS u{j}" for j in range(p)]
    out += [
        f"sum(own * d * e{j}_{k} / e0 + (s{j}_{k} - e{j}_{k} / e0 * s0) * c1"
        f" - own * d * r_{j} * r_{k} - (r_{j} * u_{k} + u_{j} * r_{k}) * c1 - u_{j} * u_{k} * c2) AS i{j}_{k}"
        for j, k in pairs
    ]
    return tied.groupBy("outcome", "model").agg(*[F.expr(e) for e in out])


def _betas(spark, state: dict[tuple[str, str], np.ndarray], p: int) -> DataFrame:
    keys = list(state)
    columns = {"outcome": [k[0] for k in keys], "model": [k[1] for k in keys]}
    columns |= {f"b{j}": [float(state[k][j]) for k in keys] for j in range(p)}
    return spark.createDataFrame(pa.table(columns))


def free_terms(info: np.ndarray, tolerance: float = 1e-8) -> np.ndarray:
    """Which terms carry information of their own: a term that earlier ones explain, or that never varies, is aliased."""
    left, free = info.astype(float).copy(), np.zeros(len(info), bool)
    for j in range(len(info)):
        free[j] = left[j, j] > tolerance * max(info[j, j], 0.0) and info[j, j] > 1e-10
        if free[j]:
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return free


def fit(counted: DataFrame, p: int, max_steps: int = 20, tolerance: float = 1e-9) -> dict[tuple[str, str], dict]:
    """Newton-Raphson with step halving for every outcome and model at once.

    Coefficients of aliased covariates (absent levels, levels that sum to one) stay at 0 and get no standard error. Each
    result says whether it ``converged`` and after how many ``steps``.
    """
    spark = counted.sparkSession
    counted = counted.persist()
    try:
        keys = [(r.outcome, r.model) for r in counted.select("outcome", "model").distinct().collect()]
        beta = {k: np.zeros(p) for k in keys}
        best: dict[tuple[str, str], dict] = {}
        open_keys = set(keys)
        for number in range(max_steps + 1):
            trial = {k: beta[k] for k in open_keys}
            for row in partial_likelihood(counted, _betas(spark, trial, p), p).collect():
                key = (row["outcome"], row["model"])
                score = np.array([row[f"u{j}"] for j in range(p)])
                info = np.array([[row[f"i{min(j, k)}_{max(j, k)}"] for k in range(p)] for j in range(p)])
                last = best.get(key)
                if last is not None and row["ll"] < last["ll"] - abs(last["ll"]) * 1e-12:
                    beta[key] = (beta[key] + last["beta"]) / 2
                    continue
                used = free_terms(info)
                close = last is not None and abs(row["ll"] - last["ll"]) <= tolerance * (abs(row["ll"]) + tolerance)
                best[key] = {"beta": beta[key], "ll": row["ll"], "info": info, "used": used, "events": row["events"],
                             "score": score, "converged": close or not used.any(), "steps": number}
                if best[key]["converged"]:
                    open_keys.discard(key)
                    continue
                step = np.zeros(p)
                step[used] = np.linalg.solve(info[np.ix_(used, used)], score[used])
                beta[key] = beta[key] + step
            open_keys &= set(best)
            if not open_keys:
                break
        for result in best.values():
            used, se = result["used"], np.full(p, np.nan)
            se[used] = np.sqrt(np.diag(np.linalg.inv(result["info"][np.ix_(used, used)])))
            result["se"] = se
        return best
    finally:
        counted.unpersist()


def tidy(spark, fits: dict[tuple[str, str], dict], terms: Mapping[str, Sequence[str | None]], level: float = 0.95) -> DataFrame:
    """Hazard ratios with Wald limits; ``terms`` names the coefficients of each model (None leaves one out).

    Aliased terms have NULL estimates. ``converged`` and ``steps`` belong to the fit.
    """
    rows = []
    for (outcome, model), result in sorted(fits.items()):
        for j, term in enumerate(terms[model]):
            if term is not None:
                found = wald(result["beta"][j], result["se"][j], level) if result["used"][j] else (None,) * 4
                rows.append((outcome, model, term, *found, bool(result["converged"]), int(result["steps"])))
    names = ["outcome", "model", "term", "estimate", "conf_low", "conf_high", "p_value", "converged", "steps"]
    kinds = [pa.string()] * 3 + [pa.float64()] * 4 + [pa.bool_(), pa.int32()]
    columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))]
    return spark.createDataFrame(pa.table(columns, names=names))


def cox_ph(
    df: DataFrame, outcomes: Sequence[Outcome], factor: str, levels: Sequence[str], age: str = "age",
    models: Sequence[str] = ("unadjusted", "age adjusted"), age_center: float = 50.0,
) -> DataFrame:
    """Hazard ratios of each level against the first, without and with age, for every outcome."""
    known = df.where(F.col(factor).isin(*levels))
    base = outcome_cells(known, outcomes, [factor, age]).persist()
    dummies = {f"{factor}{level}": (F.col(factor) == level).cast("double") for level in levels[1:]}
    years = {"unadjusted": F.lit(0.0), "age adjusted": (F.col(age) - age_center) / 10.0}
    parts = [model_cells(base, [*dummies.values(), years[m]], m) for m in models]
    try:
        fits = fit(reduce(DataFrame.unionByName, parts), len(dummies) + 1)
    finally:
        base.unpersist()
    return tidy(df.sparkSession, fits, {m: [*dummies, None] for m in models})
