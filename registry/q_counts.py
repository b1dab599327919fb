"""Joins, counts, rates, quantiles, summaries, windows and reshaping."""

from pyspark.sql import functions as F

from registry.base import add, r, rounded
from registry.q_derive import C
from registry.sql import codes, half_even, on_cohort, on_extract, on_records, text, with_steps, COHORT
from spanwise.functions.numbers import interval_cell, percent_of
from spanwise.operators import derive as d
from spanwise.operators import features as ft
from spanwise.operators import reshape as rs
from spanwise.operators import summaries as sm
from spanwise.operators.quantiles import quantiles, value_counts
from spanwise.operators.rates import OUTCOMES, crude_rate, rate_columns
from spanwise.operators.rates import test_counts as count_tests
from spanwise.operators.survival import event_lag_bins
from spanwise.plans import tables as tb

N = "count(*) AS n"


def n():
    return F.count(F.lit(1)).alias("n")


# joins -----------------------------------------------------------------------------------------------------------
_BY = ["ageband2", "sex"]


def _joined(st):
    base = st.cohort.groupBy(*_BY).agg(n())
    parts = [st.cohort.where(C(event) == 1).groupBy(*_BY).agg(F.count(F.lit(1)).alias(name)) for name, (event, _) in OUTCOMES.items()]
    return rs.chain_left_joins(base, parts, _BY)


add("left_join_keys", _joined, on_cohort(f"""SELECT ageband2, sex, count(*) AS n, {", ".join(
    f"CASE WHEN count(*) FILTER ({e} = 1) > 0 THEN count(*) FILTER ({e} = 1) END AS {o}" for o, (e, _) in OUTCOMES.items())} FROM cohort GROUP BY 1, 2"""))


def _renamed(st):
    terms = st.cohort.groupBy(F.concat(F.lit("chronic_kidney_disease"), C("chronic_kidney_disease")).alias("term")).agg(n())
    events = tb.events_by_level(st.cohort, "chronic_kidney_disease")
    return rs.left_join_on(terms, events, {"term": F.concat(F.lit("chronic_kidney_disease"), C("chronic_kidney_disease"))}).select(
        "term", "n", "outcome_name", "events")


add("left_join_renamed_keys", _renamed, on_cohort(f"""SELECT 'chronic_kidney_disease' || c AS term, n, outcome_name, CASE WHEN c IS NOT NULL THEN events END AS events FROM
(SELECT chronic_kidney_disease AS c, count(*) AS n FROM cohort GROUP BY 1) LEFT JOIN (
{" UNION ALL ".join(f"SELECT chronic_kidney_disease AS c, '{e}' AS outcome_name, CAST(sum({e}) AS BIGINT) AS events FROM cohort GROUP BY 1" for e, _ in OUTCOMES.values())}) USING (c)"""))
add(
    "natural_left_join",
    lambda st: rs.natural_left_join(st.cohort.groupBy(*_BY).agg(n()), st.cohort.where(C("covid_death") == 1).groupBy(*_BY).agg(F.count(F.lit(1)).alias("deaths"))),
    on_cohort("SELECT ageband2, sex, count(*) AS n, nullif(count(*) FILTER (covid_death = 1), 0) AS deaths FROM cohort GROUP BY 1, 2"),
)


def _population(st):
    counts = st.grouped.groupBy("group", "sex").agg(F.count(F.lit(1)).alias("n_x"))
    population = st.grouped.groupBy("group").agg(F.count(F.lit(1)).alias("n_y"))
    return counts.join(population, "group", "left")


add("join_population", _population, on_cohort("""SELECT "group", sex, count(*) AS n_x, CAST(sum(count(*)) OVER (PARTITION BY "group") AS BIGINT) AS n_y FROM grouped GROUP BY 1, 2"""))
_EVENT = ["patient_id", "event_date", "event_id", "code"]
add("codelist_semi_join", lambda st: ft.matching(st.records("clinical"), st.codelists, "dialysis").select(*_EVENT),
    on_records(f"SELECT patient_id, event_date, event_id, code FROM clinical WHERE code IN {codes('dialysis')}"))
add("codelist_anti_join", lambda st: ft.unmatched(st.records("clinical"), st.codelists, "dialysis").select(*_EVENT),
    on_records(f"SELECT patient_id, event_date, event_id, code FROM clinical WHERE code NOT IN {codes('dialysis')}"))


def _valid_at_test(st):
    """Region valid on the day of a person's first positive test."""
    from spanwise.operators.spells import attribute_as_of
    first = st.records("tests").where("positive").groupBy("patient_id").agg(F.min("event_date").alias("tested"))
    return ft.join_all(first, attribute_as_of(first, st.records("registrations"), C("tested"), "region", "region"))


add("interval_as_of_join", _valid_at_test, on_records("""SELECT f.patient_id, f.tested, v.region FROM
(SELECT patient_id, min(event_date) AS tested FROM test WHERE positive GROUP BY 1) f LEFT JOIN LATERAL (SELECT region FROM registration r
WHERE r.patient_id = f.patient_id AND r.start_date <= f.tested AND (r.end_date IS NULL OR r.end_date > f.tested)
ORDER BY r.start_date DESC, r.spell_id DESC LIMIT 1) v ON true"""))

# counts ------------------------------------------------------------------------------------------------------------
add("group_count", lambda st: st.cohort_all.groupBy("ethnicity").agg(n()), on_cohort("SELECT ethnicity, count(*) AS n FROM cohort_all GROUP BY 1"))
_TESTS_SQL = """count(*) FILTER (tests_conducted_any IS NULL) AS test_0, count(*) FILTER (tests_conducted_any = 1) AS test_1,
count(*) FILTER (tests_conducted_any = 2) AS test_2, count(*) FILTER (tests_conducted_any > 2) AS test_3, count(*) FILTER (tests_conducted_any > 3) AS test_over_3,
coalesce(sum(tests_conducted_any), 0) AS tests_any, coalesce(sum(tests_conducted_positive), 0) AS tests_positive"""
add("conditional_counts", lambda st: st.grouped.groupBy("group").agg(n(), *count_tests()), on_cohort(f'SELECT "group", count(*) AS n, {_TESTS_SQL} FROM grouped GROUP BY 1'))
add(
    "positivity",
    lambda st: st.grouped.groupBy("group").agg(*count_tests()).select("group", percent_of(C("tests_positive"), C("tests_any"), 2).alias("positivity")),
    on_cohort(f'SELECT "group", {half_even("p / a * 100.0", 2)} AS positivity FROM (SELECT "group", sum(tests_conducted_positive) AS p, sum(tests_conducted_any) AS a FROM grouped GROUP BY 1)'),
)


def _rolled(st):
    rolled = st.grouped.groupingSets([[], ["group"]], "group").agg(n(), F.sum(C("covid_death").cast("bigint")).alias("deaths"), F.grouping("group").alias("is_all"))
    return rolled.withColumn("group", F.coalesce("group", F.lit(0))).withColumn("is_all", C("is_all").cast("int"))


add("all_plus_groups", _rolled, on_cohort("""SELECT 0 AS "group", count(*) AS n, CAST(sum(covid_death) AS BIGINT) AS deaths, 1 AS is_all FROM grouped
UNION ALL SELECT "group", count(*), CAST(sum(covid_death) AS BIGINT), 0 FROM grouped GROUP BY 1"""))
add("sum_events_by_group", lambda st: tb.events_by_level(st.grouped, "group"), on_cohort(" UNION ALL ".join(
    f"SELECT \"group\", '{e}' AS outcome_name, CAST(sum({e}) AS BIGINT) AS events FROM grouped GROUP BY 1" for e, _ in OUTCOMES.values())))

LEVELS_SQL = {v: f"coalesce({v}, 'Unknown')" for v in tb.CATEGORIES} | {
    "ageband3": "CASE WHEN age < 30 THEN '16-29' WHEN age < 40 THEN '30-39' WHEN age < 50 THEN '40-49' WHEN age < 60 THEN '50-59' "
                "WHEN age < 70 THEN '60-69' WHEN age < 80 THEN '70-79' ELSE '80+' END",
    "bpcat": "CASE WHEN bpcat IN ('Elevated', 'High') THEN 'Elevated/high' ELSE bpcat END",
    "time_since_fully_vaccinated": "CASE WHEN follow_up_time < 28 THEN '0-4 weeks' WHEN follow_up_time < 56 THEN '4-8 weeks' "
                                   "WHEN follow_up_time < 84 THEN '8-12 weeks' ELSE '12+ weeks' END",
    "time_between_vaccinations": "CASE WHEN tbv < 42 THEN '6 weeks or less' WHEN tbv < 84 THEN '6-12 weeks' ELSE '12 weeks or more' END",
} | {v: f"CASE WHEN {v} = 1 THEN '{v}' END" for v in tb.CONDITIONS}


def long_sql(variables) -> str:
    """People x variables with known level, as a CTE ``long``."""
    return "long AS (SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{v}' AS variable, {LEVELS_SQL[v]} AS level, * FROM grouped" for v in variables) + ") WHERE level IS NOT NULL)"


ALL_VARIABLES = (*tb.CATEGORIES, *tb.CONDITIONS)
HIDDEN_SQL = "(variable, level) NOT IN (" + ", ".join(f"('{v}', '{x}')" for v, x in tb.HIDDEN_LEVELS) + ")"


def _multi(st):
    levels = tb.report_levels(st.grouped).select(*ALL_VARIABLES)
    long = levels.unpivot([], list(ALL_VARIABLES), "variable", "level").where(C("level").isNotNull())
    return rs.drop_pairs(long.groupBy("variable", "level").agg(n()), "variable", "level", tb.HIDDEN_LEVELS)


add("multi_variable_counts", _multi, with_steps(COHORT, long_sql(ALL_VARIABLES),
    query=f"SELECT variable, level, count(*) AS n FROM long WHERE {HIDDEN_SQL} GROUP BY 1, 2"))

# rates -------------------------------------------------------------------------------------------------------------
_RATE_VARS = ["ageband2", "sex", "bmi", "smoking_status", "chronic_kidney_disease", "region"]


def rate_select(e: str = "e", t: str = "t", per: float = 1000.0, suffix: str = "") -> str:
    rate = f"{e} * {365.25 * per} / nullif({t}, 0)"
    spread = f"1.0 / sqrt(nullif({e}, 0))"
    return ", ".join([
        f"{half_even(f'{t} / 365.25')} AS py{suffix}", f"{half_even(rate, 2)} AS rate{suffix}",
        f"{half_even(f'CASE WHEN {e} = 0 THEN 0.0 ELSE {rate} * exp(-({spread})) END', 2)} AS lower{suffix}",
        f"{half_even(f'{rate} * exp({spread})', 2)} AS upper{suffix}",
    ])


add(
    "crude_rate",
    lambda st: crude_rate(st.grouped, "covid_positive_test", "time_to_positive_test", _RATE_VARS),
    on_cohort(f"""SELECT variable, level, CAST(e AS BIGINT) AS events, {rate_select()} FROM (SELECT variable, level,
    CAST(count(*) FILTER (covid_positive_test = 1) AS DOUBLE) AS e, CAST(sum(time_to_positive_test) AS DOUBLE) AS t FROM ({" UNION ALL ".join(
        f"SELECT '{v}' AS variable, coalesce({v}, 'Unknown') AS level, * FROM grouped" for v in _RATE_VARS)})
    WHERE time_to_positive_test > -1 GROUP BY 1, 2)"""),
)


def _overall(st):
    stacked = F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), C(e).cast("bigint").alias("event"), C(t).cast("bigint").alias("time"))
                                  for o, (e, t) in OUTCOMES.items()]))
    cells = st.grouped.select("group", stacked.alias("s")).select("group", "s.*").groupBy("group", "outcome").agg(
        F.coalesce(F.sum("event"), F.lit(0)).alias("events"), F.coalesce(F.sum("time"), F.lit(0)).alias("days"))
    rolled = cells.groupingSets([["outcome"], ["group", "outcome"]], "group", "outcome").agg(F.sum("events").alias("events"), F.sum("days").alias("days"))
    return rolled.select(F.coalesce("group", F.lit(0)).alias("group"), "outcome", "events", *[
        c.alias(name) for name, c in rate_columns(C("events"), C("days")).items()])


_STACK = " UNION ALL ".join(f"SELECT g, '{o}' AS outcome, CAST(coalesce(sum({e}), 0) AS DOUBLE) AS e, CAST(coalesce(sum({t}), 0) AS DOUBLE) AS t FROM both_rows GROUP BY g"
                            for o, (e, t) in OUTCOMES.items())
BOTH = 'both_rows AS (SELECT 0 AS g, * FROM grouped UNION ALL SELECT "group" AS g, * FROM grouped)'
add("crude_rate_overall", _overall, with_steps(COHORT, BOTH, query=f'SELECT g AS "group", outcome, CAST(e AS BIGINT) AS events, {rate_select()} FROM ({_STACK})'))

# quantiles and summaries ----------------------------------------------------------------------------------------
_Q = [0.25, 0.5, 0.75]


def _interp(st):
    cells = st.grouped.groupBy("group", "follow_up_time").agg(n())
    q = F.percentile("follow_up_time", F.array(*[F.lit(p) for p in _Q]), C("n"))
    return cells.groupingSets([[], ["group"]], "group").agg(q.alias("q")).select(
        F.coalesce("group", F.lit(0)).alias("group"), interval_cell(F.rint(C("q")[1]), F.rint(C("q")[0]), F.rint(C("q")[2])).alias("follow_up"),
        *[C("q")[i].alias(f"q{i}") for i in range(3)])


def cont(x: str, p: float) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), {p})"


_FU = [half_even(cont("follow_up_time", p)) for p in _Q]
add("quantiles_interp", _interp, with_steps(COHORT, BOTH, query=f"""SELECT g AS "group", {text(_FU[1])} || ' (' || {text(_FU[0])} || '-' || {text(_FU[2])} || ')' AS follow_up,
{", ".join(f"{cont('follow_up_time', p)} AS q{i}" for i, p in enumerate(_Q))} FROM both_rows GROUP BY g"""))
add(
    "quantiles_continuous",
    lambda st: rounded(quantiles(value_counts(st.table("orders"), ["o_orderpriority"], "o_totalprice"), ["o_orderpriority"], _Q), "q0", "q1", "q2", digits=4),
    f"SELECT o_orderpriority, {', '.join(f'round(quantile_cont(o_totalprice, {p}), 4) AS q{i}' for i, p in enumerate(_Q))} FROM orders GROUP BY 1",
)
add(
    "quantiles_step",
    lambda st: quantiles(value_counts(st.table("lineitem"), ["l_returnflag"], "l_extendedprice"), ["l_returnflag"], sm.STEP_PROBS, "step"),
    f"SELECT l_returnflag, {', '.join(f'quantile_disc(l_extendedprice, {p}) AS q{i}' for i, p in enumerate(sm.STEP_PROBS))} FROM lineitem GROUP BY 1",
)


def numeric_sql(x: str, hidden: str = "false") -> str:
    parts = {
        "n": "count(*)", "n_nonmiss": f"count({x})", "pct_nonmiss": f"round(count({x}) / count(*)::DOUBLE, 6)",
        "n_miss": f"count(*) - count({x})", "pct_miss": f"round((count(*) - count({x})) / count(*)::DOUBLE, 6)",
        "unique": f"count(DISTINCT {x})", "mean": f"round(avg({x}), 6)", "sd": f"round(stddev_samp({x}), 6)", "min": f"CAST(min({x}) AS DOUBLE)",
        **{name: f"CAST(quantile_disc({x}, {p}) AS DOUBLE)" for name, p in zip(sm.STEP_NAMES, sm.STEP_PROBS)}, "max": f"CAST(max({x}) AS DOUBLE)",
    }
    return ", ".join(f"CASE WHEN NOT ({hidden}) THEN {v} END AS \"{k}\"" for k, v in parts.items())


_SIX = ["pct_nonmiss", "pct_miss", "mean", "sd"]
_NUMBERS = ["age", "tbv", "tests_conducted_any", "time_to_positive_test"]
add("summary_numeric", lambda st: rounded(sm.summary_numeric(st.cohort, _NUMBERS), *_SIX),
    on_cohort(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {numeric_sql(c)}, false AS redacted FROM cohort" for c in _NUMBERS)))
_DATES = ["death_date", "dereg_date", "covid_positive_test_date", "creatinine_date"]


def date_sql(x: str) -> str:
    day = f"({x} - DATE '1970-01-01')"
    date = "CAST(DATE '1970-01-01' + CAST({} AS INTEGER) AS DATE)"
    return f"""count(*) AS n, count({x}) AS n_nonmiss, round(count({x}) / count(*)::DOUBLE, 6) AS pct_nonmiss, count(*) - count({x}) AS n_miss,
    round((count(*) - count({x})) / count(*)::DOUBLE, 6) AS pct_miss, count(DISTINCT {x}) AS "unique", {date.format(f'floor(avg({day}))')} AS mean,
    round(stddev_samp({day}), 6) AS sd, min({x}) AS min, {", ".join(f"quantile_disc({x}, {p}) AS {name}" for name, p in zip(sm.STEP_NAMES, sm.STEP_PROBS))}, max({x}) AS max"""


add("summary_date", lambda st: rounded(sm.summary_date(st.extract, _DATES), "pct_nonmiss", "pct_miss", "sd"),
    on_extract(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", {date_sql(c)}, false AS redacted FROM extract" for c in _DATES)))

MASK = """small AS (SELECT *, n BETWEEN 1 AND 5 AS low FROM counted),
mk AS (SELECT *, low OR (bool_or(low) OVER m AND coalesce(sum(n) FILTER (low) OVER m, 0) <= 5
    AND row_number() OVER (PARTITION BY margin ORDER BY low, n, ord, lvl) = 1) AS mask FROM small WINDOW m AS (PARTITION BY margin))"""


add(
    "summary_cat_by_num",
    lambda st: rounded(sm.summary_by_category(st.cohort, "bpcat", "tests_conducted_any"), *_SIX),
    with_steps(COHORT, "counted AS (SELECT bpcat AS lvl, count(*) AS n, 1 AS margin, 0 AS ord FROM cohort GROUP BY 1)", MASK,
               query=f"""SELECT lvl AS level, s.* EXCLUDE (l), mask AS redacted FROM mk JOIN
               (SELECT bpcat AS l, {numeric_sql('tests_conducted_any', "count(*) <= 5 OR bpcat IN (SELECT lvl FROM mk WHERE mask)")} FROM cohort GROUP BY 1) s ON s.l = lvl"""),
)
_CATS = ["bpcat", "region", "transplant", "prior_covid_cat", "imd"]
_BP_LEVELS = ["Normal", "Elevated", "Very high", "High", "Unknown"]


def _cat_counts(cols, source="cohort"):
    return " UNION ALL ".join(f"SELECT '{c}' AS margin, coalesce({c}, '(missing)') AS lvl, count(*) AS n FROM {source} GROUP BY 2" for c in cols)


_BP_LIST = "[" + ", ".join(f"'{x}'" for x in _BP_LEVELS) + "]"
_CAT = [
    f"""counted AS (SELECT margin, lvl, CAST(sum(n) AS BIGINT) AS n, CASE WHEN lvl = '(missing)' THEN 1000 WHEN margin <> 'bpcat' THEN 0
    ELSE coalesce(list_position({_BP_LIST}, lvl), {len(_BP_LEVELS) + 1}) END AS ord FROM ({_cat_counts(_CATS)}
    UNION ALL SELECT 'bpcat', unnest({_BP_LIST}), 0) GROUP BY 1, 2)""", MASK,
]
CAT_SELECT = """SELECT margin AS "column", lvl AS level, CASE WHEN NOT mask THEN n END AS n,
CASE WHEN NOT mask THEN round(n / CAST(sum(n) OVER (PARTITION BY margin) AS DOUBLE), 6) END AS pct,
CASE WHEN NOT mask THEN round(CASE WHEN lvl = '(missing)' THEN 0 ELSE n END / CAST(sum(n) FILTER (lvl <> '(missing)') OVER (PARTITION BY margin) AS DOUBLE), 6) END AS pct_nonmiss,
mask AS redacted FROM mk"""
add("summary_categorical", lambda st: rounded(sm.summary_categorical(st.cohort, _CATS, {"bpcat": _BP_LEVELS}), "pct", "pct_nonmiss"),
    with_steps(COHORT, *_CAT, query=CAT_SELECT))

_TWO_WAY = [
    "p AS (SELECT a.lvl AS l1, b.lvl AS l2 FROM (SELECT DISTINCT coalesce(chronic_kidney_disease, '(missing)') AS lvl FROM cohort) a, (SELECT DISTINCT bpcat AS lvl FROM cohort) b)",
    """c2 AS (SELECT l1, l2, count(patient_id) AS n FROM p LEFT JOIN cohort ON coalesce(chronic_kidney_disease, '(missing)') = l1 AND bpcat = l2 GROUP BY 1, 2)""",
    """w AS (SELECT *, n BETWEEN 1 AND 5 AS low FROM c2)""",
    """w2 AS (SELECT *, low OR (bool_or(low) OVER a AND coalesce(sum(n) FILTER (low) OVER a, 0) <= 5 AND row_number() OVER (PARTITION BY l1 ORDER BY low, n, l2 = '(missing)', l2) = 1)
    OR (bool_or(low) OVER b AND coalesce(sum(n) FILTER (low) OVER b, 0) <= 5 AND row_number() OVER (PARTITION BY l2 ORDER BY low, n, l1 = '(missing)', l1) = 1) AS mask
    FROM w WINDOW a AS (PARTITION BY l1), b AS (PARTITION BY l2))""",
]
TWO_WAY_SELECT = """SELECT l1 AS level1, l2 AS level2, CASE WHEN NOT mask THEN n END AS n,
CASE WHEN NOT mask THEN round(n / CAST(nullif(sum(n) OVER (PARTITION BY l2), 0) AS DOUBLE), 6) END AS pct,
CASE WHEN NOT mask THEN round(CASE WHEN l1 = '(missing)' THEN 0 ELSE n END / CAST(nullif(sum(n) FILTER (l1 <> '(missing)') OVER (PARTITION BY l2), 0) AS DOUBLE), 6) END AS pct_nonmiss,
mask AS redacted FROM w2"""
_TOTAL = """UNION ALL SELECT level, 'Total', n, pct, pct_nonmiss, redacted FROM (
SELECT lvl AS level, CASE WHEN NOT mask THEN n END AS n, CASE WHEN NOT mask THEN round(n / CAST(sum(n) OVER () AS DOUBLE), 6) END AS pct,
CASE WHEN NOT mask THEN round(CASE WHEN lvl = '(missing)' THEN 0 ELSE n END / CAST(sum(n) FILTER (lvl <> '(missing)') OVER () AS DOUBLE), 6) END AS pct_nonmiss, mask AS redacted FROM mk)"""
add("crosstab_long", lambda st: rounded(sm.crosstab_long(st.cohort, "chronic_kidney_disease", "bpcat", total="Total"), "pct", "pct_nonmiss"),
    with_steps(COHORT, *_TWO_WAY, f"counted AS (SELECT *, CAST(lvl = '(missing)' AS INTEGER) AS ord FROM ({_cat_counts(['chronic_kidney_disease'])}))", MASK,
               query=f"{TWO_WAY_SELECT} {_TOTAL}"))
add("contingency", lambda st: sm.contingency(st.cohort, "covid_positive_test", "covid_hospital_admission", [0, 1]),
    on_cohort("""SELECT covid_positive_test, count(*) FILTER (covid_hospital_admission = 0) AS covid_hospital_admission_0,
    count(*) FILTER (covid_hospital_admission = 1) AS covid_hospital_admission_1 FROM cohort GROUP BY 1"""))
_ANY = "covid_positive_test = 1 OR covid_hospital_admission = 1 OR covid_death = 1"
_TOTALS = ["covid_positive_test", "covid_hospital_admission", "covid_death"]
add(
    "outcome_totals",
    lambda st: rs.melt(st.cohort.where(_ANY), ["patient_id"], _TOTALS).groupBy("variable").agg(F.sum(C("value").cast("bigint")).alias("breakthrough")),
    on_cohort(" UNION ALL ".join(f"SELECT '{c}' AS variable, CAST(sum({c}) AS BIGINT) AS breakthrough FROM cohort WHERE {_ANY}" for c in _TOTALS)),
)


def _unions(st):
    pos, adm, dead = (C(c) == 1 for c in _TOTALS)
    people = st.cohort.groupBy("patient_id").agg(F.bool_or(pos).alias("a"), F.bool_or(pos | adm).alias("b"), F.bool_or(pos | adm | dead).alias("c"))
    return people.agg(F.count_if("a").alias("positive"), F.count_if("b").alias("positive_or_admitted"), F.count_if("c").alias("any_outcome"))


add("distinct_patient_unions", _unions, on_cohort(f"""SELECT count(DISTINCT patient_id) FILTER (covid_positive_test = 1) AS positive,
count(DISTINCT patient_id) FILTER (covid_positive_test = 1 OR covid_hospital_admission = 1) AS positive_or_admitted,
count(DISTINCT patient_id) FILTER ({_ANY}) AS any_outcome FROM cohort"""))
add(
    "event_order_lag_bins",
    lambda st: st.cohort.where("covid_positive_test = 1 AND covid_hospital_admission = 1").agg(*event_lag_bins(st.cohort, "time_to_positive_test", "time_to_hospitalisation")),
    on_cohort("""SELECT count(*) FILTER (l < 0) AS before, count(*) FILTER (l >= 0) AS on_or_after, count(*) FILTER (l BETWEEN 0 AND 2) AS lag_to_2,
    count(*) FILTER (l BETWEEN 3 AND 29) AS lag_to_29, count(*) FILTER (l >= 30) AS lag_over_29
    FROM (SELECT time_to_positive_test - time_to_hospitalisation AS l FROM cohort WHERE covid_positive_test = 1 AND covid_hospital_admission = 1)"""),
)
_PROFILE = ["age", "tests_conducted_any", "covid_vax_2_date", "sex", "region", "chronic_kidney_disease", "covid_death"]


def _profile_sql(c: str) -> str:
    kind = {"covid_vax_2_date": "date", "sex": "string", "region": "string", "chronic_kidney_disease": "string", "tests_conducted_any": "double"}.get(c, "int")
    x = f"({c} - DATE '1970-01-01')" if kind == "date" else "CAST(NULL AS DOUBLE)" if kind == "string" else c
    return f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) AS n, count(*) - count({c}) AS n_missing, round(count({c}) / count(*)::DOUBLE, 6) AS complete_rate,
    count(DISTINCT {c}) AS n_unique, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS sd, CAST(min({x}) AS DOUBLE) AS min, CAST(max({x}) AS DOUBLE) AS max,
    {", ".join(f"{cont(x, p)} AS p{int(p * 100)}" for p in _Q)} FROM cohort"""


add("dataset_profile", lambda st: rounded(sm.dataset_profile(st.cohort, _PROFILE), "complete_rate", "mean", "sd"),
    on_cohort(" UNION ALL ".join(_profile_sql(c) for c in _PROFILE)))
add("histogram_counts", lambda st: st.extract.groupBy((F.floor((C("age") + 2.5) / 5) * 5).cast("int").alias("age_bin")).agg(n()),
    on_extract("SELECT CAST(floor((age + 2.5) / 5) * 5 AS INTEGER) AS age_bin, count(*) AS n FROM extract GROUP BY 1"))

# windows and sorting --------------------------------------------------------------------------------------------
add("share_of_group", lambda st: rs.share(st.grouped.groupBy("group", "sex").agg(n()), "n", ["group"]).withColumn("share", r("share")),
    on_cohort("""SELECT "group", sex, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY "group") AS DOUBLE), 6) AS share FROM grouped GROUP BY 1, 2"""))


def _group_max(st):
    counts = st.extract.groupBy("region", "covid_vax_2_date").agg(n())
    return counts.groupBy("region").agg(F.max("covid_vax_2_date").alias("covid_vax_2_date"), F.max_by("n", "covid_vax_2_date").alias("n"))


add("filter_group_max", _group_max, on_extract("""SELECT region, covid_vax_2_date, n FROM (SELECT region, covid_vax_2_date, count(*) AS n FROM extract GROUP BY 1, 2)
WHERE (region, covid_vax_2_date) IN (SELECT (region, max(covid_vax_2_date)) FROM extract GROUP BY region) OR
(region IS NULL AND covid_vax_2_date = (SELECT max(covid_vax_2_date) FROM extract WHERE region IS NULL))"""))


def _next_smallest(st):
    from spanwise.operators.disclosure import next_smallest
    counts = st.grouped.groupBy("group", "ethnicity").agg(n())
    return counts.where(C("ethnicity").isNotNull()).withColumn("picked", next_smallest(C("n"), ["group"], ["ethnicity"])).where("picked").drop("picked")


add("next_smallest", _next_smallest, on_cohort("""SELECT "group", ethnicity, n FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY n BETWEEN 1 AND 5, n, ethnicity) AS k
FROM (SELECT "group", ethnicity, count(*) AS n FROM grouped GROUP BY 1, 2)) WHERE k = 1"""))


def _ordered(st):
    counts = st.cohort.groupBy("ethnicity").agg(n()).withColumn("level_order", F.array_position(F.array(*[F.lit(x) for x in d.ETHNICITY_LABELS.values()]), C("ethnicity")))
    return counts.orderBy("level_order")


add("ordered_output", _ordered, on_cohort(f"""SELECT ethnicity, count(*) AS n, CAST(list_position([{', '.join(f"'{x}'" for x in d.ETHNICITY_LABELS.values())}], ethnicity) AS BIGINT) AS level_order
FROM cohort GROUP BY 1 ORDER BY level_order"""))

# reshaping and sets ----------------------------------------------------------------------------------------------
add("union_rows",
    lambda st: rs.union_rows(st.cohort.groupBy("sex").agg(n()), st.cohort.groupBy("imd").agg(n()), st.cohort.agg(n())),
    on_cohort("SELECT sex, NULL AS imd, count(*) AS n FROM cohort GROUP BY 1 UNION ALL SELECT NULL, imd, count(*) FROM cohort GROUP BY 2 UNION ALL SELECT NULL, NULL, count(*) FROM cohort"))
add("distinct_rows", lambda st: st.extract.select("region", "sex", "imd").distinct(), on_extract("SELECT DISTINCT region, sex, imd FROM extract"))
add("melt", lambda st: rs.melt(st.cohort, ["patient_id"], ["sex", "age", "covid_death"]),
    on_cohort(" UNION ALL ".join(f"SELECT patient_id, '{c}' AS variable, CAST({c} AS VARCHAR) AS value FROM cohort" for c in ("sex", "age", "covid_death"))))
_SEXES = ["Female", "Male"]


def _pivot(st):
    counts = st.grouped.groupBy("group", "sex").agg(n(), F.sum(C("covid_positive_test").cast("bigint")).alias("events"))
    return rs.pivot_wide(counts, ["group"], "sex", _SEXES, ["n", "events"])


add("pivot_wide", _pivot, on_cohort('SELECT "group", ' + ", ".join(
    f"nullif(count(*) FILTER (sex = '{s}'), 0) AS {s}__n, CAST(sum(covid_positive_test) FILTER (sex = '{s}') AS BIGINT) AS {s}__events" for s in _SEXES) + " FROM grouped GROUP BY 1"))
add("split_column",
    lambda st: rs.split_column(st.records("clinical").groupBy("code").agg(n()), "code", r"\.", ["priority", "status"]),
    on_records("SELECT split_part(code, '.', 1) AS priority, split_part(code, '.', 2) AS status, count(*) AS n FROM clinical GROUP BY ALL"))
_STAGES = [*tb.CKD_LEVELS, "Stage 6"]
add("complete_levels",
    lambda st: rs.complete_levels(st.grouped.where("chronic_kidney_disease IS NOT NULL").groupBy("group", "chronic_kidney_disease").agg(n()), "chronic_kidney_disease", _STAGES, ["group"]),
    on_cohort(f"""SELECT g.g AS "group", l.lvl AS chronic_kidney_disease, count(c.patient_id) AS n FROM (SELECT DISTINCT "group" AS g FROM grouped WHERE chronic_kidney_disease IS NOT NULL) g,
    (SELECT unnest([{', '.join(f"'{x}'" for x in _STAGES)}]) AS lvl) l LEFT JOIN grouped c ON c."group" = g.g AND c.chronic_kidney_disease = l.lvl GROUP BY 1, 2"""))
