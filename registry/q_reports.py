"""Survival analysis, models and composite reports."""

from pyspark.sql import functions as F

from registry import records as rec
from registry.base import add, rounded
from registry.cox_sql import newton_steps, tidy_steps
from registry.q_counts import ALL_VARIABLES, BOTH, HIDDEN_SQL, _TESTS_SQL, cont, long_sql, numeric_sql, rate_select
from registry.q_derive import C
from registry.q_sources import km_steps
from registry.sql import COHORT, half_even, on_cohort, on_extract, text, to_base, with_steps
from spanwise.operators import cox
from spanwise.operators.poisson import RATE_COLUMNS, age_adjusted_rate, age_adjusted_rates
from spanwise.operators.rates import OUTCOMES, TESTS
from spanwise.operators.summaries import STEP_NAMES, properties
from spanwise.operators.survival import cumulative_incidence, kaplan_meier, risk_table
from spanwise.operators.wald import wald
from spanwise.plans import curves as cv
from spanwise.plans import tables as tb
from spanwise.plans.process import COHORT_COLUMNS, DROPPED_AFTER_EXCLUSION, derive_cohort, exclude
from spanwise.session import scratch_path
from spanwise.sources.snapshots import snapshot, write_csv

# survival -------------------------------------------------------------------------------------------------------
_KM = """SELECT g AS "group", t AS time, CAST(n_risk AS BIGINT) AS n_risk, CAST(d AS BIGINT) AS n_event, CASE WHEN gone THEN 0.0 ELSE round(s, 6) END AS estimate,
CASE WHEN NOT gone THEN round(exp(ln(s) - 1.959963984540054 * se), 6) END AS conf_low,
CASE WHEN NOT gone THEN round(least(1.0, exp(ln(s) + 1.959963984540054 * se)), 6) END AS conf_high FROM km"""


def _km(st):
    return rounded(kaplan_meier(cv.group_counts(st.grouped)), "estimate", "conf_low", "conf_high").withColumn("time", C("time").cast("bigint"))


add("kaplan_meier", _km, with_steps(COHORT, *km_steps(), query=_KM))
add("cumulative_incidence", lambda st: cumulative_incidence(kaplan_meier(cv.group_counts(st.grouped))),
    with_steps(COHORT, *km_steps(), query="SELECT * FROM curve"))


def _at_risk(st):
    return kaplan_meier(cv.group_counts(st.grouped)).select("group", C("time").cast("bigint").alias("time"), "n_risk")


add("cumulative_risk_set", _at_risk, with_steps(COHORT, *km_steps(), query='SELECT g AS "group", t AS time, CAST(n_risk AS BIGINT) AS n_risk FROM km'))
_GRID = """grid AS (SELECT g, unnest(range(0, CAST(ceil((SELECT max(t) FROM sc) / 25.0) * 25 AS INTEGER) + 1, 25)) AS k FROM (SELECT DISTINCT g FROM sc))"""
RISK = """SELECT grid.g AS "group", CAST(k AS INTEGER) AS time, n_risk, CASE WHEN n_risk < 8 THEN '<8' ELSE CAST(n_risk AS VARCHAR) END AS n_risk_shown
FROM (SELECT grid.g, k, CAST(coalesce(sum(n) FILTER (t >= k), 0) AS BIGINT) AS n_risk FROM grid JOIN sc ON sc.g = grid.g GROUP BY 1, 2) grid"""
add("risk_table", lambda st: risk_table(cv.group_counts(st.grouped)), with_steps(COHORT, *km_steps(), _GRID, query=RISK))

# Cox and Poisson models --------------------------------------------------------------------------------------------
_COX = [cox.Outcome(e, e, t) for e, t in OUTCOMES.values()]
_ROWS = " UNION ALL ".join(f"SELECT '{e}' AS outcome, {t} AS t, {e} AS e, chronic_kidney_disease AS ckd, age FROM cohort WHERE {t} IS NOT NULL AND {e} IS NOT NULL"
                           for e, t in OUTCOMES.values())
_LEVELS = tb.CKD_LEVELS


def _likelihood(st):
    """Likelihood, score and information of the age-adjusted kidney model at fixed coefficients."""
    factor = "chronic_kidney_disease"
    counted = cox.outcome_cells(st.cohort.where(C(factor).isNotNull()), _COX, [factor, "age"])
    terms = [*[(C(factor) == level).cast("double") for level in _LEVELS[1:]], (C("age") - 50.0) / 10.0]
    fixed = [0.1, -0.2, 0.3, -0.1, 0.05]
    betas = st.spark.createDataFrame([(o.name, "fixed", *fixed) for o in _COX], "outcome string, model string, " + ", ".join(f"b{j} double" for j in range(5)))
    out = cox.partial_likelihood(cox.model_cells(counted, terms, "fixed"), betas, 5)
    return rounded(out, *[c for c in out.columns if c not in ("outcome", "model", "events")], digits=4)


def _efron_sql(xs: list[str], betas: list[float], source: str) -> str:
    """Efron partial likelihood with one term per tied event, straight from people."""
    p = len(xs)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    xb = " + ".join(f"({b}) * x{j}" for j, b in enumerate(betas))
    moments = ["1.0", *[f"x{j}" for j in range(p)], *[f"x{j} * x{k}" for j, k in pairs]]
    day = ", ".join(f"sum(exp(xb) * {m}) AS s{i}, sum(e * exp(xb) * {m}) AS e{i}" for i, m in enumerate(moments))
    cum = ", ".join(f"sum(s{i}) OVER w AS s{i}, e{i}" for i in range(len(moments)))
    phi = ", ".join(f"s{i} - l / d * e{i} AS f{i}" for i in range(len(moments)))
    where = {pair: 1 + p + i for i, pair in enumerate(pairs)}
    tied = ", ".join(["sum(ln(f0)) AS t0", *[f"sum(f{1 + j} / f0) AS t{1 + j}" for j in range(p)],
                      *[f"sum(f{where[j, k]} / f0 - f{1 + j} * f{1 + k} / (f0 * f0)) AS i{j}_{k}" for j, k in pairs]])
    return f"""px AS (SELECT outcome, t, CAST(e AS DOUBLE) AS e, {", ".join(f"CAST({x} AS DOUBLE) AS x{j}" for j, x in enumerate(xs))} FROM ({source})),
pb AS (SELECT *, {xb} AS xb FROM px),
day AS (SELECT outcome, t, sum(e) AS d, sum(e * xb) AS dxb, {", ".join(f"sum(e * x{j}) AS dx{j}" for j in range(p))}, {day} FROM pb GROUP BY 1, 2),
cum AS (SELECT outcome, t, d, dxb, {", ".join(f"dx{j}" for j in range(p))}, {cum} FROM day WINDOW w AS (PARTITION BY outcome ORDER BY t DESC)),
phi AS (SELECT outcome, {phi} FROM (SELECT *, unnest(range(0, CAST(d AS BIGINT))) AS l FROM cum WHERE d > 0)),
tied AS (SELECT outcome, {tied} FROM phi GROUP BY 1),
plain AS (SELECT outcome, sum(d) AS events, sum(dxb) AS dxb, {", ".join(f"sum(dx{j}) AS dx{j}" for j in range(p))} FROM cum GROUP BY 1)"""


_XS = [*[f"ckd = '{level}'" for level in _LEVELS[1:]], "(age - 50.0) / 10.0"]
_PAIRS = [(j, k) for j in range(5) for k in range(j, 5)]
add("cox_partial_likelihood", _likelihood, with_steps(
    COHORT, _efron_sql(_XS, [0.1, -0.2, 0.3, -0.1, 0.05], f"SELECT * FROM ({_ROWS}) WHERE ckd IS NOT NULL"),
    query=f"""SELECT outcome, 'fixed' AS model, CAST(events AS BIGINT) AS events, round(dxb - t0, 4) AS ll, {", ".join(f"round(dx{j} - t{1 + j}, 4) AS u{j}" for j in range(5))},
    {", ".join(f"round(i{j}_{k}, 4) AS i{j}_{k}" for j, k in _PAIRS)} FROM plain JOIN tied USING (outcome)"""))


def _one_covariate(st):
    """Hazard ratio per ten years of age for each outcome."""
    counted = cox.model_cells(cox.outcome_cells(st.cohort, _COX, ["age"]), [(C("age") - 50.0) / 10.0], "age")
    fits = cox.fit(counted, 1)
    return rounded(cox.tidy(st.spark, fits, {"age": ["per_10_years"]}), "estimate", "conf_low", "conf_high", digits=5).drop("p_value", "converged", "steps")


def _newton_sql(steps: int = 8) -> str:
    """Newton-Raphson for one covariate, unrolled: each step is a block of CTEs."""
    parts = [f"px AS (SELECT outcome, t, CAST(e AS DOUBLE) AS e, (age - 50.0) / 10.0 AS x FROM ({_ROWS}))", "b0 AS (SELECT DISTINCT outcome, CAST(0.0 AS DOUBLE) AS b FROM px)"]
    for i in range(steps):
        parts.append(f"""n{i} AS (SELECT outcome, any_value(b) AS b, sum(dx) - sum(u) AS u, sum(v) AS v FROM (
        SELECT outcome, b, dx, list_sum([(s1 - l / d * e1) / (s0 - l / d * e0) FOR l IN range(0, CAST(d AS BIGINT))]) AS u,
        list_sum([(s2 - l / d * e2) / (s0 - l / d * e0) - pow((s1 - l / d * e1) / (s0 - l / d * e0), 2) FOR l IN range(0, CAST(d AS BIGINT))]) AS v FROM (
        SELECT outcome, b, d, dx, e0, e1, e2, sum(s0) OVER w AS s0, sum(s1) OVER w AS s1, sum(s2) OVER w AS s2 FROM (
        SELECT px.outcome, t, any_value(b) AS b, sum(e) AS d, sum(e * x) AS dx, sum(exp(b * x)) AS s0, sum(x * exp(b * x)) AS s1, sum(x * x * exp(b * x)) AS s2,
        sum(e * exp(b * x)) AS e0, sum(e * x * exp(b * x)) AS e1, sum(e * x * x * exp(b * x)) AS e2 FROM px JOIN b{i} ON b{i}.outcome = px.outcome GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY outcome ORDER BY t DESC)) WHERE d > 0) GROUP BY 1)""")
        parts.append(f"b{i + 1} AS (SELECT outcome, b + u / v AS b FROM n{i})")
    return ", ".join(parts)


_NEWTON = 8
add("cox_ph_age", _one_covariate, with_steps(COHORT, _newton_sql(_NEWTON), query=f"""SELECT outcome, 'age' AS model, 'per_10_years' AS term, round(exp(b), 5) AS estimate,
round(exp(b - 1.959963984540054 / sqrt(v)), 5) AS conf_low, round(exp(b + 1.959963984540054 / sqrt(v)), 5) AS conf_high FROM n{_NEWTON - 1}"""))


def _cox(st):
    return cox.cox_ph(st.cohort, _COX, "chronic_kidney_disease", _LEVELS)




def _wald(st):
    """Wald limits of log rate ratios by kidney-disease stage, from the age-only model coefficients."""
    counted = cox.model_cells(cox.outcome_cells(st.cohort, _COX, ["age"]), [(C("age") - 50.0) / 10.0], "age")
    fits = cox.fit(counted, 1)
    rows = [(o, float(f["beta"][0]), float(f["se"][0]), *map(float, wald(f["beta"][0], f["se"][0], 0.9, False)[1:])) for (o, _), f in sorted(fits.items())]
    return st.spark.createDataFrame(rows, "outcome string, estimate double, se double, low_90 double, high_90 double, p_value double")


# twice the normal tail, by Simpson's rule from 0 to |z|
_P = """greatest(0.0, 1.0 - 2.0 * list_sum([(CASE WHEN k IN (0, 400) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END) * exp(-pow(k * z / 400.0, 2) / 2.0)
    FOR k IN range(0, 401)]) * z / 1200.0 / sqrt(2.0 * pi()))"""
_HAZARDS = [COHORT, *newton_steps(
    f"SELECT * FROM ({_ROWS}) WHERE age IS NOT NULL AND ckd IN ({', '.join(repr(level) for level in _LEVELS)})",
    _XS, {"unadjusted": [0, 1, 2, 3], "age adjusted": [0, 1, 2, 3, 4]}),
    tidy_steps({j: f"chronic_kidney_disease{level}" for j, level in enumerate(_LEVELS[1:])}, _P)]
add("cox_ph", lambda st: rounded(_cox(st), "estimate", "conf_low", "conf_high", "p_value"), with_steps(*_HAZARDS, query="SELECT * FROM tidy"))
add("wald_tidy", lambda st: rounded(_wald(st), "estimate", "se", "low_90", "high_90", "p_value", digits=5), with_steps(
    COHORT, _newton_sql(_NEWTON), f"wf AS (SELECT outcome, b, 1.0 / sqrt(v) AS se, least(abs(b * sqrt(v)), 12.0) AS z FROM n{_NEWTON - 1})",
    query=f"""SELECT outcome, round(b, 5) AS estimate, round(se, 5) AS se, round(b - 1.6448536269514722 * se, 5) AS low_90,
    round(b + 1.6448536269514722 * se, 5) AS high_90, round({_P}, 5) AS p_value FROM wf"""))


def age_rate_steps(event: str, time: str, variables: dict[str, str], per: int, name: str = "a", source: str = "grouped", steps: int = 12) -> list[str]:
    """Age-adjusted rates as CTE ``<name>``: Newton in the age slope alone, unrolled, over cells of each variable's levels."""
    cells = " UNION ALL ".join(f"SELECT '{v}' AS variable, {x} AS level, CAST(age AS DOUBLE) AS age, {event} AS e, {time} AS d FROM {source}" for v, x in variables.items())
    out = [
        f"""{name}c AS (SELECT variable, level, age, CAST(count(*) FILTER (e = 1) AS DOUBLE) AS n, sum(d) / {365.25 * per} AS t
        FROM ({cells}) WHERE d > -1 AND age IS NOT NULL GROUP BY 1, 2, 3 HAVING sum(d) > 0)""",
        f"{name}x AS (SELECT *, age - sum(t * age) OVER w / sum(t) OVER w AS x, sum(t * age) OVER w / sum(t) OVER w AS c FROM {name}c WINDOW w AS (PARTITION BY variable))",
        f"{name}b0 AS (SELECT DISTINCT variable, CAST(0.0 AS DOUBLE) AS b FROM {name}c)",
    ]
    for i in range(steps + 1):
        out.append(f"""{name}s{i} AS (SELECT variable, level, any_value(b) AS b, any_value(c) AS c, sum(n) AS n, sum(n * x) AS nx, sum(t * exp(b * x)) AS s0,
        sum(t * x * exp(b * x)) AS s1, sum(t * x * x * exp(b * x)) AS s2 FROM {name}x JOIN {name}b{i} USING (variable) GROUP BY 1, 2)""")
        out.append(f"""{name}b{i + 1} AS (SELECT variable, any_value(b) + (sum(nx) - sum(n * s1 / s0)) / sum(n * (s2 / s0 - pow(s1 / s0, 2))) AS b FROM {name}s{i} GROUP BY 1)""")
    infinite = "CAST('Infinity' AS DOUBLE)"
    out.append(f"""{name}f AS (SELECT *, s1 / s0 AS m, 1.0 / sum(n * (s2 / s0 - pow(s1 / s0, 2))) OVER (PARTITION BY variable) AS v,
        row_number() OVER w AS place, first_value(n) OVER w AS n1, first_value(s1 / s0) OVER w AS m1 FROM {name}s{steps} WINDOW w AS (PARTITION BY variable ORDER BY level))""")
    out.append(f"""{name}e AS (SELECT variable, level, n, CASE WHEN n > 0 THEN n / s0 * exp(-b * c) END AS rate, CASE WHEN n = 0 OR (place > 1 AND n1 = 0) THEN NULL
        WHEN place = 1 THEN sqrt(1.0 / n + pow(m + c, 2) * v) ELSE sqrt(1.0 / n + 1.0 / n1 + pow(m - m1, 2) * v) END AS se FROM {name}f)""")
    out.append(f"""{name} AS (SELECT variable, level, coalesce(rate, 0.0) AS rate_adj, coalesce(rate * exp(-se), 0.0) AS lower_adj,
        coalesce(rate * exp(se), {infinite}) AS upper_adj FROM {name}e)""")
    return out


_STAGE = {"chronic_kidney_disease": "coalesce(chronic_kidney_disease, 'Unknown')"}
_ADJUSTED = {v: f"coalesce({v}, '{tb.UNKNOWN_LABELS.get(v, 'Unknown')}')" for v in ("sex", "bmi", "smoking_status", "ethnicity", "imd", "region", "chronic_kidney_disease")}
_ADJ_COLUMNS = ", ".join(f"round({c}, 4) AS {c}" for c in RATE_COLUMNS)
add("age_adjusted_rate", lambda st: rounded(age_adjusted_rate(
    st.cohort, "covid_positive_test", "time_to_positive_test", "chronic_kidney_disease", _LEVELS), *RATE_COLUMNS, digits=4),
    with_steps(COHORT, *age_rate_steps("covid_positive_test", "time_to_positive_test", _STAGE, 1000, source="cohort"), query=f"SELECT level, {_ADJ_COLUMNS} FROM a"))
add("age_adjusted_rates", lambda st: rounded(age_adjusted_rates(
    st.cohort, "covid_positive_test", "time_to_positive_test", list(_ADJUSTED), labels=tb.UNKNOWN_LABELS), *RATE_COLUMNS, digits=4),
    with_steps(COHORT, *age_rate_steps("covid_positive_test", "time_to_positive_test", _ADJUSTED, 1000, source="cohort"), query=f"SELECT variable, level, {_ADJ_COLUMNS} FROM a"))

# report tables ------------------------------------------------------------------------------------------------------


def measures(source: str, keys: list[str], min_time: int | None = None, per: float = 1000.0, outcomes: dict = OUTCOMES) -> str:
    """All measures of a table in two CTEs: ``tot`` and ``fin``."""
    kept = {o: "true" if min_time is None else f"{t} > {min_time}" for o, (_, t) in outcomes.items()}
    sums = ", ".join(f"CAST(coalesce(sum({e}) FILTER ({kept[o]}), 0) AS DOUBLE) AS e_{o}, CAST(coalesce(sum({t}) FILTER ({kept[o]}), 0) AS DOUBLE) AS t_{o}"
                     for o, (e, t) in outcomes.items())
    k = ", ".join(keys)
    pct = ", ".join(f"{half_even(f'CAST({t} AS DOUBLE) / n * 100.0')} AS {t}" for t in TESTS)
    cols = ", ".join(f"CAST(e_{o} AS BIGINT) AS events_{o}, {rate_select(f'e_{o}', f't_{o}', per, f'_{o}')}" for o in OUTCOMES)
    return f"""tot AS (SELECT {k}, count(*) AS n, {_TESTS_SQL}, {sums}, {half_even(cont('follow_up_time', 0.25))} AS fu_q1,
    {half_even(cont('follow_up_time', 0.5))} AS fu_median, {half_even(cont('follow_up_time', 0.75))} AS fu_q3 FROM {source} GROUP BY {k}),
fin AS (SELECT {k}, n, fu_q1, fu_median, fu_q3, {pct}, {half_even('tests_positive / nullif(tests_any, 0) * 100.0', 2)} AS positivity, {cols} FROM tot)"""


def redact_sql(keys: list[str], total: str | None = None, source: str = "fin", more: tuple[str, ...] = ()) -> str:
    """``red``: suppressed and rounded; with ``total`` the total row is rebuilt. ``more`` statistics hang on each outcome's events."""
    k = ", ".join(keys)
    cols = ["CASE WHEN n >= 8 THEN round_even(n / 5.0::DOUBLE, 0) * 5.0 END AS n"]
    cols += [f"CASE WHEN n >= 8 THEN {c} END AS {c}" for c in ("fu_q1", "fu_median", "fu_q3")]
    cols += [f"CASE WHEN n >= 8 AND {t} / 100.0 * n >= 8 THEN {t} END AS {t}" for t in TESTS]
    cols.append("CASE WHEN events_positive_test >= 8 THEN positivity END AS positivity")
    for o in OUTCOMES:
        cols.append(f"CASE WHEN events_{o} >= 8 THEN round_even(events_{o} / 5.0::DOUBLE, 0) * 5.0 END AS events_{o}")
        cols += [f"CASE WHEN events_{o} >= 8 THEN {s}_{o} END AS {s}_{o}" for s in ("py", "rate", "lower", "upper", *more)]
    base = f"red0 AS (SELECT {k}, {', '.join(cols)} FROM {source})"
    if total is None:
        return base + ", red AS (SELECT * FROM red0)"
    rebuilt = ", ".join(f"CASE WHEN {total} THEN coalesce(sum({c}) FILTER (NOT ({total})) OVER (), 0.0) ELSE {c} END AS {c}" for c in tb.COUNTS)
    return base + f", red AS (SELECT * REPLACE ({rebuilt}) FROM red0)"


def format_sql(keys: list[str], adjusted: bool = False) -> str:
    def cell(x: str) -> str:
        return f"coalesce({text(x)}, '[REDACTED]')"

    cols = [f"{cell('n')} AS fully_vaccinated", f"coalesce({text('fu_median')} || ' (' || {text('fu_q1')} || '-' || {text('fu_q3')} || ')', '[REDACTED]') AS follow_up"]
    cols += [f"{cell(t)} AS {t}" for t in TESTS] + [f"{cell('positivity')} AS positivity"]
    for o in OUTCOMES:
        cols.append(f"{cell(f'events_{o}')} || ' (' || {cell(f'py_{o}')} || ')' AS {o}_count")
        cols.append(f"{cell(f'rate_{o}')} || ' (' || {cell(f'lower_{o}')} || '-' || {cell(f'upper_{o}')} || ')' AS {o}_rate")
        if adjusted:
            cols.append(f"{cell(f'rate_adj_{o}')} || ' (' || {cell(f'lower_adj_{o}')} || '-' || {cell(f'upper_adj_{o}')} || ')' AS {o}_rate_adj")
    return f"SELECT {', '.join(keys)}, {', '.join(cols)} FROM red"


_LABEL = "CASE g " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(tb.TABLE_GROUPS)) + " END"
_T1 = [BOTH, measures("both_rows", ["g"])]
_T1_KEYS = ['g AS "group"', f"{_LABEL.replace(tb.TABLE_GROUPS[3], tb.REDACTED_GROUPS[3]).replace(tb.TABLE_GROUPS[4], tb.REDACTED_GROUPS[4])} AS label"]
add("report_priority_groups", lambda st: tb.priority_groups_redacted(st.grouped),
    with_steps(COHORT, *_T1, redact_sql(["g"], "g = 0"), query=format_sql(_T1_KEYS)))
add("report_priority_groups_raw", lambda st: tb.priority_groups(st.grouped),
    with_steps(COHORT, *_T1, query=f'SELECT * EXCLUDE (g), g AS "group", {_LABEL} AS label FROM fin'))


def _report_file(st):
    path = write_csv(tb.priority_groups_redacted(st.grouped), scratch_path(st.spark, "table1"), files=1)
    return st.spark.read.option("header", True).csv(path).withColumn("group", C("group").cast("int"))


add("report_table_write", _report_file, with_steps(COHORT, *_T1, redact_sql(["g"], "g = 0"), query=format_sql(_T1_KEYS)))

_T2 = [long_sql(ALL_VARIABLES), measures("long", ["variable", "level"], -1)]
_T2_KEYS = ["variable", "level"]
add("report_characteristics", lambda st: tb.characteristics_redacted(st.grouped),
    with_steps(COHORT, *_T2, redact_sql(_T2_KEYS), query=f"{format_sql(_T2_KEYS)} WHERE {HIDDEN_SQL}"))
add("report_characteristics_raw", lambda st: tb.characteristics(st.grouped), with_steps(COHORT, *_T2, query=f"SELECT * FROM fin WHERE {HIDDEN_SQL}"))
_T3 = [long_sql(["chronic_kidney_disease"]), measures("long", ["variable", "level"], -1)]
add("report_ckd_rates", lambda st: tb.characteristics_redacted(st.grouped, **tb.CKD_OPTIONS),
    with_steps(COHORT, *_T3, redact_sql(_T2_KEYS), query=f"{format_sql(_T2_KEYS)} WHERE level <> 'Unknown'"))
_EVENTS = "events AS (" + " UNION ALL ".join(
    f"SELECT '{e}' AS outcome, 'chronic_kidney_disease' || chronic_kidney_disease AS term, CAST(sum({e}) AS BIGINT) AS events FROM cohort GROUP BY 2"
    for e, _ in OUTCOMES.values()) + ")"
_SHOWN = ", ".join(f"CASE WHEN events >= 8 THEN {c} END AS {c}" for c in ("estimate", "conf_low", "conf_high", "p_value"))
add("report_ckd_hazards", lambda st: rounded(tb.ckd_hazards(st.cohort), "estimate", "conf_low", "conf_high", "p_value"), with_steps(
    *_HAZARDS, _EVENTS, query=f"SELECT outcome, model, term, {to_base('events', '5.0')} AS events, {_SHOWN} FROM tidy LEFT JOIN events USING (outcome, term)"))
_T4_OUTCOMES = OUTCOMES | {"critical_care": (OUTCOMES["critical_care"][0], "time_to_hospitalisation")}
_T4_ADJUSTED = [step for o, (e, t) in _T4_OUTCOMES.items() for step in age_rate_steps(e, t, _STAGE, 10000, f"a_{o}")]
_T4_JOINED = "adjusted AS (SELECT fin.*, " + ", ".join(f"round(a_{o}.{c}, 2) AS {c}_{o}" for o in OUTCOMES for c in RATE_COLUMNS) + " FROM fin " + " ".join(
    f"LEFT JOIN a_{o} ON a_{o}.level = fin.level" for o in OUTCOMES) + ")"
add("report_adjusted_rates", lambda st: tb.adjusted_rates_redacted(st.grouped), with_steps(
    COHORT, *_T3[:1], measures("long", _T2_KEYS, -1, 10000.0, _T4_OUTCOMES), *_T4_ADJUSTED, _T4_JOINED,
    redact_sql(_T2_KEYS, source="adjusted", more=tuple(RATE_COLUMNS)), query=format_sql(_T2_KEYS, adjusted=True)))

# curves, flowchart, histogram, overlap ----------------------------------------------------------------------------


def _curves(st):
    overall, groups, risk = cv.curves(st.grouped)
    return overall.unionByName(groups).unionByName(risk.select("group", "time", C("n_risk_shown").alias("n_risk")), allowMissingColumns=True)


_ALL_KM = [step.replace("sc AS", "sc_a AS").replace("nr AS", "nr_a AS").replace("km AS", "km_a AS").replace("curve AS", "curve_a AS")
           .replace("FROM sc)", "FROM sc_a)").replace("FROM nr WINDOW", "FROM nr_a WINDOW").replace("FROM km WHERE", "FROM km_a WHERE")
           for step in km_steps(group="'All'")]
add("report_curves", _curves, with_steps(COHORT, *km_steps(), *_ALL_KM, _GRID, query=f"""SELECT *, NULL AS n_risk FROM curve UNION ALL SELECT *, NULL FROM curve_a
UNION ALL SELECT "group", time, NULL, NULL, NULL, n_risk_shown FROM ({RISK})"""))

_STEPS = ["age BETWEEN 16 AND 109 AND sex IS NOT NULL"] + [f"covid_{o}_within_2_weeks_post_vax2 = 0" for o in ("positive_test", "hospitalisation", "death")]
_NAMES = ["c0_all", "c1_notmissing", *[f"c{i + 1}_no_outcomes_within_2_weeks_post_vax2_{i}" for i in (1, 2, 3)]]
_FLOW = "flow AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS criteria, count(*) AS n FROM cohort_all WHERE follow_up_time_vax2 >= 14" + "".join(f" AND {c}" for c in _STEPS[:i])
    for i, name in enumerate(_NAMES)) + ")"
_FLOWCHART = """SELECT criteria, n, lag(n) OVER w - n AS n_exclude, round((lag(n) OVER w - n) / CAST(lag(n) OVER w AS DOUBLE), 6) AS pct_exclude,
round(n / CAST(first_value(n) OVER w AS DOUBLE), 6) AS pct_all, round(n / CAST(lag(n) OVER w AS DOUBLE), 6) AS pct_step FROM flow WINDOW w AS (ORDER BY criteria)"""


def _flow(st):
    return rounded(cv.flowchart(st.cohort_all), "pct_exclude", "pct_all", "pct_step")


def _flow_file(st):
    path = write_csv(cv.flowchart(st.cohort_all), scratch_path(st.spark, "flowchart"), files=1)
    kinds = {"n": "bigint", "n_exclude": "bigint", "pct_exclude": "double", "pct_all": "double", "pct_step": "double"}
    back = st.spark.read.option("header", True).csv(path).withColumns({c: C(c).cast(t) for c, t in kinds.items()})
    return rounded(back, "pct_exclude", "pct_all", "pct_step")


add("attrition_flowchart", _flow, with_steps(COHORT, _FLOW, query=_FLOWCHART))
add("report_flowchart", _flow_file, with_steps(COHORT, _FLOW, query=_FLOWCHART))


def _histogram_sql(tests: str) -> str:
    return f"""SELECT g AS "group", tests, {to_base('CASE WHEN n >= 8 THEN n END', '5.0')} AS n, {to_base('whole', '5.0')} AS population,
    {half_even(f"{to_base('CASE WHEN n >= 8 THEN n END', '5.0')} / {to_base('whole', '5.0')} * 100.0", 1)} AS perc FROM (
    SELECT g, CAST({tests} AS INTEGER) AS tests, CAST(count(*) AS DOUBLE) AS n, CAST(sum(count(*)) OVER (PARTITION BY g) AS DOUBLE) AS whole FROM both_rows GROUP BY 1, 2)"""


_T = "coalesce(tests_conducted_any, 0)"
add("test_histogram", lambda st: cv.test_histogram(st.grouped), with_steps(COHORT, BOTH, query=_histogram_sql(_T)))
add("report_test_histogram", lambda st: cv.test_histogram(st.grouped), with_steps(COHORT, BOTH, query=_histogram_sql(_T)))
add("test_histogram_pooled", lambda st: cv.test_histogram(st.grouped, cap=4), with_steps(COHORT, BOTH, query=_histogram_sql(f"least({_T}, 4)")))


def _overlap(st):
    figures = cv.outcome_overlap(st.grouped).select("figure", F.lit(None).cast("int").alias("group"), "n")
    times = cv.time_quartiles(st.grouped).withColumnRenamed("outcome", "figure")
    return figures.unionByName(times, allowMissingColumns=True)


_P, _A, _D = "covid_positive_test = 1", "covid_hospital_admission = 1", "covid_death = 1"
_ANY = f"({_P} OR {_A} OR {_D})"
_BOTH_PA = f"{_P} AND {_A}"
_LAG = "time_to_positive_test - time_to_hospitalisation"
_CERT, _NEAR = "death_with_covid_on_the_death_certificate = 1", "death_with_28_days_of_covid_positive_test = 1"
_FIGURES = {
    "total positive tests": f"{_ANY} AND {_P}", "total admissions": f"{_ANY} AND {_A}", "total deaths": f"{_ANY} AND {_D}",
    "people with a positive test": _P, "people with a positive test or admission": f"({_P} OR {_A})", "people with any outcome": _ANY,
    "positive, admitted": _BOTH_PA, "positive, not admitted": f"{_P} AND NOT {_A}", "positive, died": f"{_P} AND {_D}", "positive, did not die": f"{_P} AND NOT {_D}",
    "not positive, admitted": f"NOT {_P} AND {_A}", "not positive, not admitted": f"NOT {_P} AND NOT {_A}",
    "not positive, died": f"NOT {_P} AND {_D}", "not positive, did not die": f"NOT {_P} AND NOT {_D}",
    "died, certificate and 28 days": f"{_D} AND {_CERT} AND {_NEAR}", "died, certificate only": f"{_D} AND {_CERT} AND NOT {_NEAR}", "died, 28 days only": f"{_D} AND NOT {_CERT} AND {_NEAR}",
    "positive test before admission": f"{_BOTH_PA} AND {_LAG} < 0", "positive test on or after admission": f"{_BOTH_PA} AND {_LAG} >= 0",
    "positive test 0-2 days after": f"{_BOTH_PA} AND {_LAG} BETWEEN 0 AND 2", "positive test 3-29 days after": f"{_BOTH_PA} AND {_LAG} BETWEEN 3 AND 29",
    "positive test 30+ days after": f"{_BOTH_PA} AND {_LAG} >= 30",
}
_TIMES = " UNION ALL ".join(f"""SELECT '{o}' AS figure, g AS "group", count(*) AS n, {cont(t, 0.25)} AS q1, {cont(t, 0.5)} AS median, {cont(t, 0.75)} AS q3
FROM both_rows WHERE {e} = 1 AND {t} IS NOT NULL GROUP BY g""" for o, (e, t) in OUTCOMES.items())
add("report_outcome_overlap", _overlap, with_steps(COHORT, BOTH, query=" UNION ALL ".join(
    f"SELECT '{name}' AS figure, CAST(NULL AS INTEGER) AS \"group\", count(*) FILTER ({c}) AS n, NULL AS q1, NULL AS median, NULL AS q3 FROM grouped"
    for name, c in _FIGURES.items()) + " UNION ALL " + _TIMES))
add("time_to_event_quartiles", lambda st: cv.time_quartiles(st.grouped), with_steps(COHORT, BOTH, query=_TIMES.replace("AS figure", "AS outcome")))

# properties and segments ------------------------------------------------------------------------------------------
_PROPERTY_DROPPED = [c for c in COHORT_COLUMNS if c not in DROPPED_AFTER_EXCLUSION]
_TEXT = ["ageband", "ageband2", "sex", "bmi", "smoking_status", "ethnicity", "imd", "region", "bpcat", "chronic_kidney_disease", "dialysis", "transplant", "prior_covid_cat"]
_DAYS = ["censor_date_2", "covid_vax_1_date", "covid_vax_2_date"]
_NUMERIC = [c for c in _PROPERTY_DROPPED if c not in (*_TEXT, *_DAYS, "patient_id")]


def _properties(st):
    found = properties(st.cohort, stage=snapshot)
    return rounded(found, "pct_nonmiss", "pct_miss", "mean", "sd", "pct")


def _properties_sql() -> str:
    places = ["mean", "min", *STEP_NAMES, "max"]
    none = ", ".join(f"CAST(NULL AS DATE) AS {p}_date" for p in places)
    as_dates = ", ".join(f"DATE '1970-01-01' + CAST(floor(\"{p}\") AS INTEGER) AS {p}_date" for p in places)
    blank = " REPLACE (" + ", ".join(f"CAST(NULL AS DOUBLE) AS \"{p}\"" for p in places) + ")"
    numbers = [f"SELECT 'number' AS kind, '{c}' AS \"column\", NULL AS level, {numeric_sql(c)}, NULL AS pct, false AS redacted, {none} FROM cohort" for c in _NUMERIC]
    dates = [f"SELECT *{blank}, {as_dates} FROM (SELECT 'date' AS kind, '{c}' AS \"column\", NULL AS level, {numeric_sql('x')}, NULL AS pct, false AS redacted "
             f"FROM (SELECT {c} - DATE '1970-01-01' AS x FROM cohort))" for c in _DAYS]
    levels = """SELECT 'category' AS kind, "column", level, n, CAST(NULL AS BIGINT) AS n_nonmiss, pct_nonmiss, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, pct, redacted, """ + none + " FROM cats"
    return " UNION ALL ".join([*numbers, *dates, levels])


def _cats() -> list[str]:
    from registry.q_counts import CAT_SELECT, MASK, _cat_counts
    return [f"counted AS (SELECT *, CAST(lvl = '(missing)' AS INTEGER) AS ord FROM ({_cat_counts(_TEXT)}))", MASK, f"cats AS ({CAT_SELECT})"]


add("report_data_properties", _properties, with_steps(COHORT, *_cats(), query=_properties_sql()))

_SEGMENTS = {
    "All": "true", "Immunocompromised": "immunosuppression = 1",
    "Time since 2nd dose (2-4 weeks)": "follow_up_time_vax2 BETWEEN 14 AND 23", "Time since 2nd dose (4-6 weeks)": "follow_up_time_vax2 BETWEEN 24 AND 41",
    "Time since 2nd dose (6-8 weeks)": "follow_up_time_vax2 BETWEEN 42 AND 55", "Time since 2nd dose (8+ weeks)": "follow_up_time_vax2 >= 56",
    **{f"Region - {x}": f"region = '{x}'" for x in ("London", "East of England", "East Midlands", "North East", "North West", "South East", "South West", "West Midlands", "Yorkshire and the Humber")},
    **{f"Ethnicity - {x}": f"ethnicity = '{x}'" for x in ("White", "Asian or Asian British", "Black or Black British")},
    "Ethnicity - Mixed/Other ethnic groups/Unknown": "ethnicity IN ('Mixed', 'Other ethnic groups', 'Unknown')", "Learning disability": "learning_disability = 1",
    "Organ transplant": "transplant IS NOT NULL", "Dialysis / Kidney disease": "dialysis IS NOT NULL OR chronic_kidney_disease <> 'No CKD'",
    **{f"Age - {x}": f"care_home_65plus <> 1 AND ageband2 = '{b}'" for x, b in (("<80", "16-79"), ("80 - 84", "80-84"), ("85 - 89", "85-89"), ("90 - 94", "90-94"), ("95+", "95+"))},
}
_SUBSETS = {"fully_vaccinated": "true"} | {o: f"{e} = 1" for o, (e, _) in OUTCOMES.items()}
_MATRIX = " UNION ALL ".join(f"SELECT '{s}' AS segment, " + ", ".join(f"count(*) FILTER (({c}) AND {w}) AS {t}" for t, w in _SUBSETS.items()) + " FROM cohort_all" for s, c in _SEGMENTS.items())
add("segment_matrix", lambda st: cv.segment_matrix(st.cohort_all, cv.cohort_segments(), cv.cohort_subsets()), on_cohort(_MATRIX))
add("report_segment_matrix", lambda st: cv.segment_report(st.cohort_all),
    on_cohort("SELECT segment, " + ", ".join(f"CASE WHEN {t} > 7 THEN round_even({t} / 5.0::DOUBLE, 0) * 5.0 END AS {t}" for t in _SUBSETS) + f" FROM ({_MATRIX})"))

# whole steps ----------------------------------------------------------------------------------------------------------
_MEASURED = ["bp_sys", "bp_dias", "creatinine"]
add("cohort_extract", lambda st: rounded(st.build_extract(), *_MEASURED),
    on_extract("SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURED) + ") FROM extract"))
add("cohort_processed", lambda st: exclude(derive_cohort(st.extract, rec.STUDY_END)), on_cohort("SELECT * FROM cohort"))
add("cohort_processed_all", lambda st: derive_cohort(st.extract, rec.STUDY_END), on_cohort("SELECT * FROM cohort_all"))
