"""Disclosure control on aggregated tables."""

from pyspark.sql import functions as F

from registry.base import add
from registry.q_counts import MASK, n
from registry.q_derive import C
from registry.sql import COHORT, on_cohort, with_steps
from spanwise.functions.numbers import mask_text, round_to_base
from spanwise.operators import disclosure as dc
from spanwise.operators.rates import OUTCOMES, rate_columns


def _cells(st):
    """Small cells: people by group, ethnicity and kidney-disease stage."""
    return st.grouped.where("chronic_kidney_disease IS NOT NULL").groupBy("group", "chronic_kidney_disease", "ethnicity").agg(n())


_CELLS = """SELECT "group", chronic_kidney_disease, ethnicity, count(*) AS n FROM grouped WHERE chronic_kidney_disease IS NOT NULL GROUP BY 1, 2, 3"""
_MARGIN = f"""counted AS (SELECT *, "group" || '|' || chronic_kidney_disease AS margin, 0 AS ord, ethnicity AS lvl FROM ({_CELLS}))"""


def _mask(**options):
    return dc.suppress_mask(C("n"), ["group", "chronic_kidney_disease"], ["ethnicity"], **options)


add("suppress_mask", lambda st: _cells(st).withColumn("redacted", _mask()),
    with_steps(COHORT, _MARGIN, MASK, query='SELECT "group", chronic_kidney_disease, ethnicity, n, mask AS redacted FROM mk'))


def _suppressed_by(st):
    cells = st.grouped.where("chronic_kidney_disease IS NOT NULL").groupBy("group", "chronic_kidney_disease", "ethnicity").agg(
        n(), F.sum(C("time_to_positive_test").cast("bigint")).alias("days"))
    checked = cells.withColumn("n", dc.checked_count(C("n")))
    return checked.select("group", "chronic_kidney_disease", "ethnicity", dc.suppress_by(_mask(), C("days")).alias("days"))


_DAYS = _MARGIN.replace("count(*) AS n", "count(*) AS n, CAST(sum(time_to_positive_test) AS BIGINT) AS days")
add("suppress_by", _suppressed_by,
    with_steps(COHORT, _DAYS, MASK, query='SELECT "group", chronic_kidney_disease, ethnicity, CASE WHEN NOT mask THEN days END AS days FROM mk'))


def _two_way(st):
    cells = st.grouped.groupBy("group", "ethnicity").agg(n())
    return dc.suppress_two_way(cells, "n", "group", "ethnicity", threshold=8)


add("suppress_two_way", _two_way, with_steps(
    COHORT, 'w AS (SELECT "group" AS a, ethnicity AS b, count(*) AS n, count(*) BETWEEN 1 AND 8 AS low FROM grouped GROUP BY 1, 2)',
    query="""SELECT a AS "group", b AS ethnicity, n, low OR (bool_or(low) OVER x AND coalesce(sum(n) FILTER (low) OVER x, 0) <= 8
    AND row_number() OVER (PARTITION BY a ORDER BY low, n, b) = 1) OR (bool_or(low) OVER y AND coalesce(sum(n) FILTER (low) OVER y, 0) <= 8
    AND row_number() OVER (PARTITION BY b ORDER BY low, n, a) = 1) AS redacted FROM w WINDOW x AS (PARTITION BY a), y AS (PARTITION BY b)"""))


def _events(st):
    totals = st.grouped.groupBy("group").agg(
        *[F.coalesce(F.sum(C(e).cast("bigint")), F.lit(0)).alias(f"events_{o}") for o, (e, _) in OUTCOMES.items()],
        *[F.sum(C(t).cast("bigint")).alias(f"days_{o}") for o, (_, t) in OUTCOMES.items()])
    out = totals
    for o in OUTCOMES:
        out = out.withColumns(rate_columns(C(f"events_{o}"), C(f"days_{o}"), f"_{o}"))
    return out.drop(*[f"days_{o}" for o in OUTCOMES])


_STATS = {f"events_{o}": [f"{k}_{o}" for k in ("py", "rate", "lower", "upper")] for o in OUTCOMES}


def _events_sql() -> str:
    from registry.q_counts import rate_select
    inner = ", ".join(f"CAST(coalesce(sum({e}), 0) AS DOUBLE) AS e_{o}, CAST(sum({t}) AS DOUBLE) AS t_{o}" for o, (e, t) in OUTCOMES.items())
    cols = ", ".join(f"CAST(e_{o} AS BIGINT) AS events_{o}, {rate_select(f'e_{o}', f't_{o}', suffix=f'_{o}')}" for o in OUTCOMES)
    return f'ev AS (SELECT "group", {cols} FROM (SELECT "group", {inner} FROM grouped GROUP BY 1))'


EVENTS_SQL = _events_sql()
add("suppress_small_rows", lambda st: dc.suppress_small_rows(_events(st), _STATS, 8), with_steps(COHORT, EVENTS_SQL, query='SELECT "group", ' + ", ".join(
    f"CASE WHEN {e} >= 8 THEN {c} END AS {c}" for e, cols in _STATS.items() for c in (e, *cols)) + " FROM ev"))
add("round_to_base", lambda st: st.grouped.groupBy("group").agg(n()).select("group", round_to_base(C("n"), 5.0).alias("to_5"), round_to_base(C("n") / 7.0, 0.25).alias("to_quarter")),
    on_cohort('SELECT "group", round_even(n / 5.0::DOUBLE, 0) * 5.0 AS to_5, round_even(n / 7.0::DOUBLE / 0.25::DOUBLE, 0) * 0.25 AS to_quarter FROM (SELECT "group", count(*) AS n FROM grouped GROUP BY 1)'))


def _totals(st):
    rolled = st.grouped.groupingSets([[], ["group"]], "group").agg(n(), F.sum(C("covid_death").cast("bigint")).alias("deaths"))
    named = rolled.withColumn("group", F.coalesce("group", F.lit(0)))
    hidden = named.withColumn("deaths", F.when(C("deaths") >= 8, C("deaths")))
    return dc.rebuild_totals(dc.round_counts(hidden, ["n", "deaths"]), ["n", "deaths"], C("group") == 0)


add("rebuild_totals", _totals, with_steps(
    COHORT, """g AS (SELECT "group", round_even(count(*) / 5.0::DOUBLE, 0) * 5.0 AS n, CASE WHEN sum(covid_death) >= 8
    THEN round_even(CAST(sum(covid_death) AS DOUBLE) / 5.0, 0) * 5.0 END AS deaths FROM grouped GROUP BY 1)""",
    query='SELECT * FROM g UNION ALL SELECT 0, sum(n), coalesce(sum(deaths), 0.0) FROM g'))
add("mask_text", lambda st: _cells(st).withColumn("n", mask_text(C("n"))),
    on_cohort(f"SELECT * REPLACE (CASE WHEN n < 8 THEN '<8' ELSE CAST(n AS VARCHAR) END AS n) FROM ({_CELLS})"))


def _masked(st):
    cells = st.grouped.groupBy("group", "ethnicity").agg(*[F.count_if(C(e) == 1).alias(o) for o, (e, _) in OUTCOMES.items()])
    return dc.mask_values(cells, list(OUTCOMES))


add("mask_values", _masked, on_cohort('SELECT "group", ethnicity, ' + ", ".join(
    f"CASE WHEN count(*) FILTER ({e} = 1) > 7 THEN count(*) FILTER ({e} = 1) END AS {o}" for o, (e, _) in OUTCOMES.items()) + " FROM grouped GROUP BY 1, 2"))
