"""Age-adjusted incidence rates from a Poisson model on (level, age) cells of any number of variables.

``log(events) ~ level + age + log(person-time)``: at a given age slope the intercept of a level is
``log(events / sum(person-time * exp(slope * age)))``, so the fit is a Newton search in one unknown per variable, over
counted cells, and the standard errors follow from the Schur complement of the information.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.operators.rates import DAYS_PER_YEAR
from spanwise.operators.wald import exp_or_infinity

RATE_COLUMNS = ["rate_adj", "lower_adj", "upper_adj"]


def rate_cells(
    df: DataFrame, event: str, time: str, variables: Sequence[str], age: str = "age", min_time: int | None = -1,
    labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Events and person-days by variable, level and age, in one pass; unknown levels are ``Unknown`` or the variable's label."""
    kept = df if min_time is None else df.where(F.col(time) > min_time)
    unknown = labels or {}
    texts = [F.coalesce(F.nullif(F.col(v).cast("string"), F.lit("")), F.lit(unknown.get(v, "Unknown"))).alias(f"_{i}") for i, v in enumerate(variables)]
    slim = kept.select(F.col(event).alias("_event"), F.col(time).alias("_time"), F.col(age).cast("double").alias("_age"), *texts)
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"_{i}").alias("level")) for i, v in enumerate(variables)]))
    return slim.select("_event", "_time", "_age", stacked.alias("s")).groupBy("s.variable", "s.level", F.col("_age").alias("age")).agg(
        F.count_if(F.col("_event") == 1).alias("events"), F.sum(F.col("_time").cast("bigint")).alias("days")
    )


def fit_levels(level: np.ndarray, age: np.ndarray, events: np.ndarray, time: np.ndarray, with_age: bool = True, steps: int = 50):
    """Log rate at age 0 of each level number, its error, and the errors relative to level 0.

    A level without events has a log rate of minus infinity and an infinite error. Without variation in age the slope is 0.
    """
    n = np.bincount(level, events)
    slope, inverse = 0.0, 0.0
    middle = float(np.average(age, weights=time)) if with_age else 0.0
    x = age - middle
    for _ in range(steps if with_age else 1):
        weight = time * np.exp(slope * x)
        s0, s1, s2 = (np.bincount(level, weight * x**k) for k in range(3))
        mean = s1 / s0
        spread = float((n * (s2 / s0 - mean**2)).sum())
        if not with_age or spread <= 1e-12:
            slope = 0.0
            break
        inverse = 1 / spread
        step = float((events * x).sum() - (n * mean).sum()) * inverse
        slope += max(-1.0, min(1.0, step))
        if abs(step) <= 1e-13:
            break
    s0, s1 = (np.bincount(level, time * np.exp(slope * x) * x**k) for k in range(2))
    with np.errstate(divide="ignore"):
        intercept = np.log(n / s0) - slope * middle
        own = 1 / n
    mean = s1 / s0 + middle if inverse else np.zeros(len(n))
    error = np.sqrt(own + mean**2 * inverse)
    relative = np.sqrt(own + own[0] + (mean - mean[0]) ** 2 * inverse)
    return intercept, slope, error, relative


def poisson_rates(
    cells: DataFrame, levels: Sequence[str] = (), per: int = 1000, at_age: float = 0.0, z: float = 1.0, with_age: bool = True
) -> DataFrame:
    """``(variable, level, rate_adj, lower_adj, upper_adj)``: rate of every observed level at ``at_age``.

    ``levels`` gives an order; levels that it does not list follow by name. Limits use the standard error of the level's
    own coefficient: of the intercept for a variable's first level, of the difference to it for the others. A level
    without events has rate 0, lower limit 0 and an infinite upper limit. Cells without person-time or age are left out.
    """
    place = {level: i for i, level in enumerate(levels)}

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        """One variable: as many rows as it has levels and ages."""
        names = sorted(set(pdf["level"]), key=lambda v: (place.get(v, len(place)), v))
        number = pdf["level"].map({v: i for i, v in enumerate(names)}).to_numpy()
        intercept, slope, error, relative = fit_levels(
            number, pdf["age"].to_numpy(float), pdf["events"].to_numpy(float), pdf["days"].to_numpy(float) / (DAYS_PER_YEAR * per), with_age)
        rows = []
        for i, name in enumerate(names):
            estimate, se = intercept[i] + slope * at_age, z * float(relative[i] if i else error[0])
            upper = math.inf if math.isinf(se) else exp_or_infinity(estimate + se)
            rows.append((pdf["variable"].iloc[0], name, exp_or_infinity(estimate), exp_or_infinity(estimate - se), upper))
        return pd.DataFrame(rows, columns=["variable", "level", *RATE_COLUMNS])

    usable = cells.where((F.col("days") > 0) & F.col("age").isNotNull())
    schema = "variable string, level string, " + ", ".join(f"{c} double" for c in RATE_COLUMNS)
    return usable.groupBy("variable").applyInPandas(fitted, schema)


def age_adjusted_rates(
    df: DataFrame, event: str, time: str, variables: Sequence[str], levels: Sequence[str] = (), per: int = 1000,
    at_age: float = 0.0, z: float = 1.0, labels: Mapping[str, str] | None = None,
) -> DataFrame:
    """Age-adjusted rates of one outcome at every level of several variables, from one pass over people."""
    return poisson_rates(rate_cells(df, event, time, variables, labels=labels), levels, per, at_age, z)


def age_adjusted_rate(
    df: DataFrame, event: str, time: str, factor: str, levels: Sequence[str] = (), per: int = 1000, at_age: float = 0.0, z: float = 1.0
) -> DataFrame:
    return age_adjusted_rates(df, event, time, [factor], levels, per, at_age, z).drop("variable")
