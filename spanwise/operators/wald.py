"""Wald summaries of fitted coefficients (a handful of numbers per model)."""

from __future__ import annotations

import math
from statistics import NormalDist


def exp_or_infinity(value: float) -> float:
    try:
        return math.exp(value)
    except OverflowError:
        return math.inf


def wald(estimate: float, se: float, level: float = 0.95, exponentiate: bool = True) -> tuple[float, float, float, float]:
    """Estimate, lower and upper limit, and two-sided p-value. Limits beyond the largest number are infinite."""
    z = NormalDist().inv_cdf(0.5 + level / 2)
    low, high = estimate - z * se, estimate + z * se
    p = math.erfc(abs(estimate / se) / math.sqrt(2)) if se > 0 else float("nan")
    if exponentiate:
        return tuple(exp_or_infinity(v) for v in (estimate, low, high)) + (p,)
    return estimate, low, high, p
