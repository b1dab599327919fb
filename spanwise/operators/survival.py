"""Kaplan-Meier curves, cumulative incidence and numbers at risk.

People are first counted by group and day; every window runs over these counts (at most one row per group and day
of follow-up), so one very large group is no larger than a small one once counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.numbers import mask_text, round_half_even, round_to_base

Z_95 = 1.959963984540054


def survival_counts(df: DataFrame, time: str, event: str, group: Column, min_time: int | None = 0) -> DataFrame:
    """``(group, time, n, d)``: people whose time ends on each day and how many of them had the event."""
    known = df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    if min_time is not None:
        known = known.where(F.col(time) >= min_time)
    return known.groupBy(group.alias("group"), F.col(time).alias("time")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("bigint")).alias("d")
    )


def kaplan_meier(counts: DataFrame, z: float = Z_95) -> DataFrame:
    """Survival with log-type limits at every observed time of each group."""
    whole = Window.partitionBy("group")
    so_far = whole.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    before = whole.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    at_risk = counts.withColumn(
        "n_risk", F.sum("n").over(whole) - F.coalesce(F.sum("n").over(before), F.lit(0))
    )
    d, n = F.col("d").cast("double"), F.col("n_risk").cast("double")
    steps = at_risk.withColumns({
        "log_step": F.when(d < n, F.ln(1.0 - d / n)),
        "var_step": F.when(d < n, d / (n * (n - d))),
        "all_gone": d == n,
    })
    log_s, var, gone = F.sum("log_step").over(so_far), F.sum("var_step").over(so_far), F.bool_or("all_gone").over(so_far)
    curve = steps.select("group", "time", "n_risk", "d", log_s.alias("log_s"), var.alias("var"), gone.alias("gone"))
    spread = F.lit(z) * F.sqrt("var")
    alive = ~F.col("gone")
    return curve.select(
        "group", "time", "n_risk", F.col("d").alias("n_event"),
        F.when(alive, F.exp("log_s")).otherwise(F.lit(0.0)).alias("estimate"),
        F.when(alive, F.exp(F.col("log_s") - spread)).alias("conf_low"),
        F.when(alive, F.least(F.lit(1.0), F.exp(F.col("log_s") + spread))).alias("conf_high"),
    )


def cumulative_incidence(curve: DataFrame, threshold: int = 7, digits: int = 4) -> DataFrame:
    """``1 - survival`` with survival rounded to multiples of ``threshold / largest risk set`` of all groups."""
    kept = curve.where(F.col("estimate") > 0)
    base = F.lit(float(threshold)) / F.max("n_risk").over(Window.partitionBy(F.lit(1)))
    coarse = kept.withColumn("base", base).withColumns({
        c: F.least(F.lit(1.0), round_to_base(F.col(c), F.col("base"))) for c in ("estimate", "conf_low", "conf_high")
    })
    return coarse.select(
        "group", "time",
        round_half_even(1.0 - F.col("estimate"), digits).alias("cum_in"),
        round_half_even(1.0 - F.col("conf_high"), digits).alias("lci"),
        round_half_even(1.0 - F.col("conf_low"), digits).alias("uci"),
    )


def risk_table(counts: DataFrame, step: int = 25, below: int = 8) -> DataFrame:
    """People still at risk at 0, step, 2·step, … up to the first grid point past the longest time."""
    slots = counts.groupBy("group", F.floor(F.col("time") / step).cast("int").alias("slot")).agg(
        F.sum("n").alias("n"), F.max("time").alias("longest")
    )
    longest = F.max("longest").over(Window.partitionBy(F.lit(1)))
    groups = slots.withColumn("last", F.ceil(longest / step).cast("int")).groupBy("group", "last").agg(
        F.collect_list(F.struct("slot", "n")).alias("slots")
    )
    later = F.aggregate(
        F.filter("slots", lambda s: s["slot"] >= F.col("k")), F.lit(0).cast("bigint"), lambda acc, s: acc + s["n"]
    )
    grid = groups.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("n_risk", later)
    return grid.select("group", (F.col("k") * step).alias("time"), "n_risk", mask_text(F.col("n_risk"), below).alias("n_risk_shown"))


def event_lag_bins(df: DataFrame, first: str, second: str, edges: Sequence[int] = (2, 29)) -> list[Column]:
    """People whose ``first`` comes before ``second``, and day bins of the lag for the others."""
    lag = F.col(first) - F.col(second)
    low, high = edges
    return [
        F.count_if(lag < 0).alias("before"), F.count_if(lag >= 0).alias("on_or_after"),
        F.count_if((lag >= 0) & (lag <= low)).alias(f"lag_to_{low}"),
        F.count_if((lag > low) & (lag <= high)).alias(f"lag_to_{high}"),
        F.count_if(lag > high).alias(f"lag_over_{high}"),
    ]
