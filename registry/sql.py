"""The same study records and steps as DuckDB SQL, used to check the Spark results."""

from __future__ import annotations

from registry.records import CODELISTS, DATES, REGIONS, STUDY_END
from spanwise.operators import derive as d
from spanwise.plans.extract import COMBINED_LISTS, DATED_CONDITIONS, DEPRIVATION_RANKS
from spanwise.plans.process import COHORT_COLUMNS, DROPPED_AFTER_EXCLUSION


def codes(name: str, categories: list[str] | None = None) -> str:
    """``('a', 'b')`` for an IN list."""
    entries = [e for part in COMBINED_LISTS.get(name, [name]) for e in CODELISTS[part][1]]
    kept = [e if isinstance(e, str) else e[0] for e in entries
            if categories is None or (not isinstance(e, str) and e[1] in categories)]
    return "(" + ", ".join(f"'{c}'" for c in dict.fromkeys(kept)) + ")"


def category_case(name: str, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in CODELISTS[name][1]) + " END"


def relabel(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{c}' THEN '{label}'" for c, label in labels.items()) + " END"


def pmod(x: str, n: int) -> str:
    return f"((({x}) % {n}) + {n}) % {n}"


def half_even(x: str, digits: int = 0) -> str:
    return f"round_even(({x}) * {float(10**digits)}, 0) / {float(10**digits)}" if digits else f"round_even({x}, 0)"


def text(x: str, digits: int = 2) -> str:
    cast = f"CAST(CAST({x} AS DECIMAL(28,{max(digits, 1)})) AS VARCHAR)"
    return rf"regexp_replace(regexp_replace({cast}, '0+$', ''), '\.$', '')"


def to_base(x: str, base: str) -> str:
    return f"(round_even(({x}) / ({base}), 0) * ({base}))"


_CENTS = "CAST(round(c_acctbal * 100.0) AS BIGINT)"
_REGION = (
    "CASE WHEN status = 'F' THEN CASE priority "
    + " ".join(f"WHEN '{p}' THEN '{a}'" for p, (a, _) in REGIONS.items())
    + " END ELSE CASE priority "
    + " ".join(f"WHEN '{p}' THEN '{b}'" for p, (_, b) in REGIONS.items() if b)
    + " END END"
)
RECORDS = f"""
ord AS (SELECT o_custkey AS patient_id, o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS event_date,
    o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS price FROM orders),
person AS (SELECT c_custkey AS patient_id,
    CASE WHEN {pmod('c', 97)} = 0 THEN NULL WHEN {pmod('c', 89)} = 0 THEN 'U'
         WHEN {pmod('c', 2)} = 0 THEN 'M' ELSE 'F' END AS sex,
    DATE '{DATES.age_on}' - CAST(3650 + {pmod('c * 37', 37500)} AS INTEGER) AS birth_date
    FROM (SELECT c_custkey, {_CENTS} AS c FROM customer)),
vaccination AS (SELECT patient_id, event_date, event_id, priority AS code, price > 470000 AS health_worker FROM ord),
clinical AS (SELECT patient_id, event_date, event_id, priority || '.' || status AS code,
    CASE WHEN priority = '3-MEDIUM' THEN price / 1000.0 ELSE price / 2500.0 END AS value,
    strftime(event_date, '%Y-%m-%d') || lpad(CAST(event_id AS VARCHAR), 20, '0') AS seq FROM ord),
medication AS (SELECT patient_id, event_date, event_id, p_brand AS code
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN ord ON event_id = l_orderkey),
test AS (SELECT patient_id, CAST(l_shipdate AS DATE) AS event_date, l_returnflag = 'R' AND l_quantity >= 48 AS positive
    FROM lineitem JOIN ord ON event_id = l_orderkey),
admission AS (SELECT patient_id, event_date, event_id, priority AS code, floor(price / 100000.0) AS value,
    strftime(event_date, '%Y-%m-%d') || lpad(CAST(event_id AS VARCHAR), 20, '0') AS seq FROM ord WHERE status = 'F'),
death AS (SELECT patient_id, max(event_date) + 10 AS event_date,
    arg_max(priority, strftime(event_date, '%Y-%m-%d') || lpad(CAST(event_id AS VARCHAR), 20, '0')) AS code
    FROM ord WHERE patient_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 3000)
    GROUP BY patient_id),
registration AS (SELECT patient_id, event_id AS spell_id, event_date + 20 AS start_date,
    CASE WHEN status = 'P' AND priority = '5-LOW' THEN NULL
         ELSE event_date + 20 + CAST(100 + floor(price / 500.0) AS INTEGER) END AS end_date,
    {_REGION} AS region FROM ord),
address AS (SELECT patient_id, event_id AS spell_id, event_date AS start_date,
    CASE WHEN price >= 20000 THEN CAST(floor(price / 500000.0 * 32844.0) AS INTEGER) END AS deprivation_rank FROM ord),
hospital_ethnicity AS (SELECT patient_id, CAST(CAST(floor(price / 100000.0) + 1 AS INTEGER) AS VARCHAR) AS ethnic_group
    FROM ord WHERE status = 'O'),
dose1 AS (SELECT patient_id, min(event_date) AS dose_1 FROM vaccination
    WHERE code IN {codes('covid_vaccine')} AND event_date BETWEEN DATE '{DATES.campaign_start}' AND DATE '{DATES.end}' GROUP BY 1),
all_doses AS (SELECT f.patient_id, dose_1, min(v.event_date) AS dose_2 FROM dose1 f
    LEFT JOIN vaccination v ON v.patient_id = f.patient_id AND v.code IN {codes('covid_vaccine')}
        AND v.event_date >= dose_1 + 15 AND v.event_date <= DATE '{DATES.end}' GROUP BY 1, 2),
doses AS (SELECT * FROM all_doses WHERE dose_2 IS NOT NULL)"""

END = f"DATE '{DATES.end}'"


def _last_dates() -> str:
    return ",\n".join(
        f"max(e.event_date) FILTER (e.code IN {codes(name)} AND e.event_date <= dose_2) AS {name}" for name in DATED_CONDITIONS
    )


def _day_mean(name: str, out: str) -> str:
    return f"""{out} AS (SELECT patient_id, arg_max(m, event_date) AS value, strftime(max(event_date), '%Y-%m') AS month FROM (
    SELECT i.patient_id, e.event_date, avg(e.value) AS m FROM idx i JOIN clinical e ON e.patient_id = i.patient_id
    WHERE e.code IN {codes(name)} AND e.event_date <= dose_2 GROUP BY 1, 2) GROUP BY 1)"""


_FIFTHS = [DEPRIVATION_RANKS * k / 5 for k in range(1, 5)]
EXTRACT = RECORDS + f""",
idx AS (SELECT s.patient_id, dose_1, dose_2, sex, birth_date FROM doses s LEFT JOIN person p ON p.patient_id = s.patient_id
    WHERE EXISTS (SELECT 1 FROM registration r WHERE r.patient_id = s.patient_id AND r.start_date <= dose_2 + 14
        AND (r.end_date IS NULL OR r.end_date > dose_2 + 14))),
dth AS (SELECT i.patient_id,
    min(e.event_date) FILTER (e.event_date BETWEEN dose_2 AND {END}) AS death_date,
    min(e.event_date) FILTER (e.event_date BETWEEN dose_2 + 14 AND {END}) AS post,
    min(e.event_date) FILTER (e.event_date BETWEEN dose_2 AND dose_2 + 14) AS post2,
    min(e.event_date) FILTER (e.code IN {codes('covid_identification')} AND e.event_date BETWEEN dose_2 + 14 AND {END}) AS cert,
    min(e.event_date) FILTER (e.code IN {codes('covid_identification')} AND e.event_date BETWEEN dose_2 AND dose_2 + 14) AS cert2
    FROM idx i LEFT JOIN death e ON e.patient_id = i.patient_id GROUP BY 1),
tst AS (SELECT i.patient_id,
    min(e.event_date) FILTER (positive AND e.event_date BETWEEN dose_2 + 14 AND {END}) AS pos_date,
    coalesce(bool_or(positive AND e.event_date BETWEEN dose_2 AND dose_2 + 14), false) AS early,
    coalesce(bool_or(positive AND e.event_date BETWEEN post - 28 AND post), false) AS near,
    coalesce(bool_or(positive AND e.event_date BETWEEN post2 - 28 AND post2), false) AS near2,
    min(e.event_date) FILTER (positive AND e.event_date <= dose_2 + 14) AS prior,
    count(*) FILTER (e.event_date BETWEEN dose_2 + 14 AND {END}) AS n_any,
    count(*) FILTER (positive AND e.event_date BETWEEN dose_2 + 14 AND {END}) AS n_pos
    FROM idx i JOIN dth ON dth.patient_id = i.patient_id LEFT JOIN test e ON e.patient_id = i.patient_id GROUP BY 1),
adm AS (SELECT i.patient_id,
    min(e.event_date) FILTER (e.event_date BETWEEN dose_2 + 14 AND {END}) AS adm_date,
    coalesce(bool_or(e.event_date BETWEEN dose_2 AND dose_2 + 14), false) AS early,
    arg_min(e.value, e.seq) FILTER (e.event_date BETWEEN dose_2 + 14 AND {END}) AS days,
    min(e.event_date) FILTER (e.event_date <= dose_2 + 14) AS prior
    FROM idx i LEFT JOIN admission e ON e.patient_id = i.patient_id AND e.code IN {codes('covid_identification')} GROUP BY 1),
cli AS (SELECT i.patient_id, {_last_dates()},
    coalesce(bool_or(e.code IN {codes('care_home')} AND e.event_date <= dose_2), false) AS care_home,
    max(e.event_date) FILTER (e.code IN {codes('high_risk')}) AS high_risk,
    max(e.event_date) FILTER (e.code IN {codes('lower_risk')}) AS lower_risk,
    arg_max(e.value, e.seq) FILTER (e.code IN {codes('bmi')} AND e.event_date >= CAST(dose_2 - INTERVAL 5 YEAR AS DATE)
        AND e.event_date >= CAST(birth_date + INTERVAL 16 YEAR AS DATE)) AS bmi_value,
    arg_max({category_case('smoking', 'e.code')}, e.seq) FILTER (e.code IN {codes('smoking')} AND e.event_date <= dose_2) AS smoking,
    coalesce(bool_or(e.code IN {codes('smoking', ['S', 'E'])} AND e.event_date <= dose_2), false) AS ever,
    arg_max({category_case('ethnicity', 'e.code')}, e.seq) FILTER (e.code IN {codes('ethnicity')}) AS ethnicity_6,
    arg_max(e.value, e.seq) FILTER (e.code IN {codes('creatinine')} AND e.event_date <= dose_2
        AND e.event_date >= CAST(dose_2 - INTERVAL 1 YEAR AS DATE)) AS creatinine,
    max(e.event_date) FILTER (e.code IN {codes('creatinine')} AND e.event_date <= dose_2
        AND e.event_date >= CAST(dose_2 - INTERVAL 1 YEAR AS DATE)) AS creatinine_date,
    min(e.event_date) FILTER (e.code IN {codes('prior_covid')} AND e.event_date <= dose_2 + 14) AS prior_case
    FROM idx i LEFT JOIN clinical e ON e.patient_id = i.patient_id GROUP BY 1),
{_day_mean('bp_sys', 'sys')},
{_day_mean('bp_dias', 'dia')},
med AS (SELECT i.patient_id, max(e.event_date) AS last_date FROM idx i JOIN medication e ON e.patient_id = i.patient_id
    AND e.code IN {codes('immunosuppression_medication')} AND e.event_date <= dose_2 GROUP BY 1),
reg AS (SELECT i.patient_id, CASE WHEN NOT bool_or(r.end_date IS NULL) AND max(r.end_date) BETWEEN dose_2 AND {END}
    THEN max(r.end_date) END AS dereg_date FROM idx i JOIN registration r ON r.patient_id = i.patient_id GROUP BY i.patient_id, dose_2),
prac AS (SELECT patient_id, region FROM (SELECT i.patient_id, r.region, row_number() OVER (PARTITION BY i.patient_id
    ORDER BY r.start_date DESC, r.spell_id DESC) AS k FROM idx i JOIN registration r ON r.patient_id = i.patient_id
    AND r.start_date <= dose_2 AND (r.end_date IS NULL OR r.end_date > dose_2)) WHERE k = 1),
adr AS (SELECT patient_id, {to_base('CAST(deprivation_rank AS DOUBLE)', '100.0')} AS rank FROM (
    SELECT i.patient_id, a.deprivation_rank, row_number() OVER (PARTITION BY i.patient_id
    ORDER BY a.start_date DESC, a.spell_id DESC) AS k FROM idx i JOIN address a ON a.patient_id = i.patient_id
    AND a.start_date <= dose_2) WHERE k = 1),
hcw AS (SELECT patient_id, bool_or(health_worker) AS flag FROM vaccination GROUP BY 1),
sus AS (SELECT patient_id, ethnic_group FROM (SELECT patient_id, ethnic_group, row_number() OVER (PARTITION BY patient_id
    ORDER BY count(*) DESC, ethnic_group DESC) AS k FROM hospital_ethnicity GROUP BY patient_id, ethnic_group) WHERE k = 1),
extract AS (SELECT i.patient_id,
    tst.pos_date AS covid_positive_test_date, tst.early AS covid_positive_test_within_2_weeks_post_vax2,
    tst.pos_date IS NOT NULL AND NOT tst.early AS covid_positive_test,
    adm.adm_date IS NOT NULL AND NOT tst.early AND NOT adm.early AS covid_hospital_admission,
    adm.adm_date AS covid_hospital_admission_date, adm.early AS covid_hospitalisation_within_2_weeks_post_vax2,
    CAST(coalesce(adm.days, 0) AS INTEGER) AS covid_hospitalisation_critical_care,
    dth.cert IS NOT NULL AND NOT tst.early AND NOT adm.early AS death_with_covid_on_the_death_certificate,
    dth.post IS NOT NULL AND tst.near AND NOT tst.early AND NOT adm.early AS death_with_28_days_of_covid_positive_test,
    dth.cert2 IS NOT NULL AND tst.near2 AS covid_death_within_2_weeks_post_vax2,
    reg.dereg_date, dth.death_date, cli.care_home,
    cli.high_risk IS NOT NULL AND NOT coalesce(cli.lower_risk >= cli.high_risk, false) AS shielded,
    coalesce(hcw.flag, false) AS hscworker,
    CAST(date_sub('year', i.birth_date, DATE '{DATES.age_on}') AS INTEGER) AS age, i.sex,
    CASE WHEN bmi_value >= 30 AND bmi_value < 35 THEN 'Obese I (30-34.9)' WHEN bmi_value >= 35 AND bmi_value < 40
        THEN 'Obese II (35-39.9)' WHEN bmi_value >= 40 AND bmi_value < 100 THEN 'Obese III (40+)' ELSE 'Not obese' END AS bmi,
    CASE WHEN smoking = 'S' THEN 'S' WHEN smoking = 'E' OR (smoking = 'N' AND ever) THEN 'E'
        WHEN smoking = 'N' AND NOT ever THEN 'N' ELSE 'M' END AS smoking_status,
    cli.ethnicity_6, sus.ethnic_group AS ethnicity_6_sus,
    CASE WHEN adr.rank >= 1 AND adr.rank < {_FIFTHS[0]} THEN '1' WHEN adr.rank >= {_FIFTHS[0]} AND adr.rank < {_FIFTHS[1]} THEN '2'
        WHEN adr.rank >= {_FIFTHS[1]} AND adr.rank < {_FIFTHS[2]} THEN '3'
        WHEN adr.rank >= {_FIFTHS[2]} AND adr.rank < {_FIFTHS[3]} THEN '4' WHEN adr.rank >= {_FIFTHS[3]} THEN '5' ELSE '0' END AS imd,
    prac.region, {", ".join(f"cli.{c}" for c in DATED_CONDITIONS)},
    med.last_date AS immunosuppression_medication_date,
    sys.value AS bp_sys, dia.value AS bp_dias, sys.month AS bp_sys_month, dia.month AS bp_dias_month,
    cli.creatinine, cli.creatinine_date, dose_1 AS covid_vax_1_date, dose_2 AS covid_vax_2_date,
    tst.prior AS prior_positive_test_date, cli.prior_case AS prior_primary_care_covid_case_date,
    adm.prior AS prior_covidadmitted_date,
    CAST(tst.n_any AS DOUBLE) AS tests_conducted_any, CAST(tst.n_pos AS DOUBLE) AS tests_conducted_positive
    FROM idx i LEFT JOIN dth USING (patient_id) LEFT JOIN tst USING (patient_id) LEFT JOIN adm USING (patient_id)
    LEFT JOIN cli USING (patient_id) LEFT JOIN sys USING (patient_id) LEFT JOIN dia USING (patient_id)
    LEFT JOIN med USING (patient_id) LEFT JOIN reg USING (patient_id) LEFT JOIN prac USING (patient_id)
    LEFT JOIN adr USING (patient_id) LEFT JOIN hcw USING (patient_id) LEFT JOIN sus USING (patient_id))"""

SE = f"DATE '{STUDY_END}'"
_FLAGS = [c for c in d.FLAGGED_CONDITIONS]


def _egfr(k: float, a: float, extra: str) -> str:
    return (f"pow(least(scr / {k}, 1.0), {a}) * pow(greatest(scr / {k}, 1.0), -1.209) * 141.0 * pow(0.993, age){extra}")


COHORT = EXTRACT + f""",
cleaned AS (SELECT * REPLACE (nullif(covid_hospitalisation_critical_care, 0) AS covid_hospitalisation_critical_care,
    nullif(age, 0) AS age, nullif(bp_sys, 0) AS bp_sys, nullif(bp_dias, 0) AS bp_dias, nullif(creatinine, 0) AS creatinine,
    nullif(tests_conducted_any, 0) AS tests_conducted_any, nullif(tests_conducted_positive, 0) AS tests_conducted_positive,
    CAST(covid_positive_test_within_2_weeks_post_vax2 AS INTEGER) AS covid_positive_test_within_2_weeks_post_vax2,
    CAST(covid_hospital_admission AS INTEGER) AS covid_hospital_admission,
    CAST(covid_hospitalisation_within_2_weeks_post_vax2 AS INTEGER) AS covid_hospitalisation_within_2_weeks_post_vax2,
    CAST(death_with_covid_on_the_death_certificate AS INTEGER) AS death_with_covid_on_the_death_certificate,
    CAST(death_with_28_days_of_covid_positive_test AS INTEGER) AS death_with_28_days_of_covid_positive_test,
    CAST(covid_death_within_2_weeks_post_vax2 AS INTEGER) AS covid_death_within_2_weeks_post_vax2,
    CAST(care_home AS INTEGER) AS care_home, CAST(shielded AS INTEGER) AS shielded, CAST(hscworker AS INTEGER) AS hscworker)
    FROM extract),
outcome AS (SELECT * EXCLUDE (covid_positive_test_date, covid_positive_test, covid_hospital_admission_date,
        covid_hospitalisation_critical_care),
    CASE WHEN covid_positive_test_date <= {SE} THEN covid_positive_test_date END AS covid_positive_test_date,
    CASE WHEN covid_positive_test_date <= {SE} THEN 1 ELSE 0 END AS covid_positive_test,
    CASE WHEN covid_hospital_admission = 1 THEN covid_hospital_admission_date END AS covid_hospital_admission_date,
    CASE WHEN covid_hospital_admission = 0 THEN 0 WHEN covid_hospitalisation_critical_care > 0 THEN 1 END
        AS covid_hospitalisation_critical_care,
    CASE WHEN death_with_covid_on_the_death_certificate = 1 OR death_with_28_days_of_covid_positive_test = 1
        THEN 1 ELSE 0 END AS covid_death,
    least(death_date, dereg_date, {SE}) AS censor FROM cleaned),
sexed AS (SELECT * EXCLUDE (sex), CASE sex WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' END AS sex,
    CASE WHEN creatinine BETWEEN 20 AND 3000 THEN creatinine END / 88.4 AS scr FROM outcome),
kidney AS (SELECT *, CASE sex WHEN 'Male' THEN {_egfr(0.9, -0.411, '')} WHEN 'Female' THEN {_egfr(0.7, -0.329, ' * 1.018')} END AS egfr,
    least(prior_positive_test_date, prior_primary_care_covid_case_date, prior_covidadmitted_date) AS prior_date FROM sexed),
cohort_wide AS (SELECT * REPLACE (
    CASE WHEN shielded = 1 AND age >= 16 AND age < 70 THEN 1 ELSE 0 END AS shielded,
    CASE WHEN bmi = 'Not obese' THEN 'Not obese' ELSE 'Obese' END AS bmi,
    CASE WHEN smoking_status IN ('S', 'E') THEN 'S&E' ELSE 'N&M' END AS smoking_status,
    {relabel('imd', d.IMD_LABELS)} AS imd, {relabel('region', d.REGION_LABELS)} AS region,
    {", ".join(f"CAST({c} IS NOT NULL AS INTEGER) AS {c}" for c in _FLAGS)},
    CASE WHEN dialysis > kidney_transplant THEN 'Previous kidney transplant'
        WHEN dialysis IS NOT NULL AND kidney_transplant IS NULL THEN 'No previous kidney transplant' END AS dialysis),
    covid_positive_test_date AS ptd, censor AS censor_date_1, censor AS censor_date_2,
    least({SE} - covid_vax_1_date, censor - covid_vax_1_date) AS follow_up_time_vax1,
    least({SE} - covid_vax_2_date, censor - covid_vax_2_date) AS follow_up_time_vax2,
    least(covid_positive_test_date - covid_vax_2_date - 14, censor - covid_vax_2_date - 14) AS time_to_positive_test,
    least(covid_hospital_admission_date - covid_vax_2_date - 14, censor - covid_vax_2_date - 14) AS time_to_hospitalisation,
    least(CASE WHEN covid_hospitalisation_critical_care = 1 THEN covid_hospital_admission_date END - covid_vax_2_date - 14,
        censor - covid_vax_2_date - 14) AS time_to_itu,
    least(CASE WHEN covid_death = 1 THEN death_date END - covid_vax_2_date - 14, censor - covid_vax_2_date - 14)
        AS time_to_covid_death,
    CASE WHEN care_home = 1 AND age >= 65 THEN 1 WHEN care_home = 1 AND age IS NULL THEN NULL ELSE 0 END AS care_home_65plus,
    CASE WHEN care_home = 0 THEN CASE WHEN age >= 80 THEN '80+' WHEN age >= 70 THEN '70-79' WHEN age >= 16 THEN '16-69' END END
        AS ageband,
    CASE WHEN age >= 95 THEN '95+' WHEN age >= 90 THEN '90-94' WHEN age >= 85 THEN '85-89' WHEN age >= 80 THEN '80-84'
        WHEN age >= 16 THEN '16-79' END AS ageband2,
    {relabel("coalesce(ethnicity_6, ethnicity_6_sus, '6')", d.ETHNICITY_LABELS)} AS ethnicity,
    CASE WHEN bp_sys < 120 AND bp_dias < 80 THEN 'Normal' WHEN bp_sys >= 120 AND bp_sys < 130 AND bp_dias < 80 THEN 'Elevated'
        WHEN bp_sys >= 130 AND bp_dias >= 90 THEN 'High' ELSE 'Unknown' END AS bpcat,
    CASE WHEN dialysis IS NULL AND kidney_transplant IS NULL THEN CASE WHEN egfr >= 60 THEN 'No CKD' WHEN egfr >= 45 THEN 'Stage 3a'
        WHEN egfr >= 30 THEN 'Stage 3b' WHEN egfr >= 15 THEN 'Stage 4' WHEN egfr < 15 THEN 'Stage 5' END END AS chronic_kidney_disease,
    CAST(immunosuppression_diagnosis_date IS NOT NULL OR immunosuppression_medication_date IS NOT NULL AS INTEGER) AS immunosuppression,
    CASE WHEN other_organ_transplant IS NOT NULL THEN 'Other' WHEN kidney_transplant IS NOT NULL AND dialysis IS NULL
        THEN 'No previous dialysis' WHEN kidney_transplant > dialysis THEN 'Previous dialysis' END AS transplant,
    covid_vax_2_date - covid_vax_1_date AS tbv,
    CASE WHEN prior_date < covid_vax_1_date THEN 'Prior to first dose'
        WHEN prior_date < covid_vax_2_date THEN 'Between first and second dose' END AS prior_covid_cat
    FROM kidney WHERE covid_vax_2_date > covid_vax_1_date),
cohort_all AS (SELECT {", ".join(COHORT_COLUMNS)} FROM cohort_wide),
cohort AS (SELECT {", ".join(c for c in COHORT_COLUMNS if c not in DROPPED_AFTER_EXCLUSION)} FROM cohort_all
    WHERE follow_up_time_vax2 >= 14 AND age >= 16 AND age < 110 AND sex IS NOT NULL
    AND covid_positive_test_within_2_weeks_post_vax2 = 0 AND covid_hospitalisation_within_2_weeks_post_vax2 = 0
    AND covid_death_within_2_weeks_post_vax2 = 0),
grouped AS (SELECT *, CASE WHEN care_home_65plus = 1 THEN 1 WHEN ageband = '80+' THEN 2 WHEN hscworker = 1 THEN 3
    WHEN ageband = '70-79' THEN 4 WHEN shielded = 1 THEN 5 WHEN age >= 50 AND age < 70 THEN 6 ELSE 7 END AS "group",
    follow_up_time_vax2 - 14 AS follow_up_time FROM cohort)"""


def on_records(query: str) -> str:
    return f"WITH {RECORDS}\n{query}"


def on_extract(query: str) -> str:
    return f"WITH {EXTRACT}\n{query}"


def on_cohort(query: str) -> str:
    return f"WITH {COHORT}\n{query}"


def with_steps(base: str, *steps: str, query: str) -> str:
    return f"WITH {base},\n" + ",\n".join(steps) + f"\n{query}"
