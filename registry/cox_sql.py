"""Cox models with several covariates as plain SQL: Newton steps with the linear systems solved by generated text.

Each step sums Efron likelihood, score and information per outcome and model and sweeps the information pivot by pivot. A
pivot that earlier terms leave next to nothing of is passed over: its coefficient stays where it is and has no variance.
Steps stop moving a model once its likelihood has settled, as the fit under test does.
"""

from __future__ import annotations


def _likelihood(i: int, p: int, pairs: list[tuple[int, int]]) -> list[str]:
    """Step ``i``: ``l<i>`` with ll, u*, i*_* per outcome and model at the coefficients of ``s<i>``."""
    xb = " + ".join(f"b{j} * x{j}" for j in range(p))
    moments = ["1.0", *[f"x{j}" for j in range(p)], *[f"x{j} * x{k}" for j, k in pairs]]
    day = ", ".join(f"sum(n * w * {m}) AS s{a}, sum(d * w * {m}) AS e{a}" for a, m in enumerate(moments))
    cum = ", ".join(f"sum(s{a}) OVER back AS s{a}, e{a}" for a in range(len(moments)))
    at = {pair: 1 + p + a for a, pair in enumerate(pairs)}
    tied = ["sum(ln(f0)) AS t0", *[f"sum(f{1 + j} / f0) AS t{1 + j}" for j in range(p)],
            *[f"sum(f{at[j, k]} / f0 - f{1 + j} * f{1 + k} / (f0 * f0)) AS i{j}_{k}" for j, k in pairs]]
    return [
        f"""d{i} AS MATERIALIZED (SELECT outcome, model, t, sum(d) AS d, sum(d * ln(w)) AS dxb, {", ".join(f"sum(d * x{j}) AS dx{j}" for j in range(p))}, {day}
        FROM (SELECT c.*, exp({xb}) AS w FROM cells c JOIN s{i} USING (outcome, model)) GROUP BY 1, 2, 3)""",
        f"""f{i} AS MATERIALIZED (SELECT outcome, model, {", ".join(f"s{a} - l / d * e{a} AS f{a}" for a in range(len(moments)))}
        FROM (SELECT *, unnest(range(0, CAST(d AS BIGINT))) AS l FROM (SELECT outcome, model, t, d, {cum} FROM d{i}
        WINDOW back AS (PARTITION BY outcome, model ORDER BY t DESC)) WHERE d > 0))""",
        f"""l{i} AS MATERIALIZED (SELECT *, {", ".join(f"dx{j} - t{1 + j} AS u{j}" for j in range(p))}, dxb - t0 AS ll FROM (SELECT outcome, model, sum(dxb) AS dxb,
        {", ".join(f"sum(dx{j}) AS dx{j}" for j in range(p))} FROM d{i} GROUP BY 1, 2) JOIN (SELECT outcome, model, {", ".join(tied)} FROM f{i} GROUP BY 1, 2) USING (outcome, model))""",
    ]


def _swept(source: str, p: int, pairs: list[tuple[int, int]]) -> str:
    """``source`` with ``a*_*`` swept to minus the inverse and ``g*`` to the solution, over the pivots ``ok*`` only."""
    inner = f"""SELECT *, {", ".join(f"i{j}_{k} AS a{j}_{k}" for j, k in pairs)}, {", ".join(f"u{j} AS g{j}" for j in range(p))} FROM {source}"""
    name = lambda j, k: f"a{min(j, k)}_{max(j, k)}"
    for q in range(p):
        pivot, ok = name(q, q), f"ok{q}"
        new = []
        for j, k in pairs:
            value = f"-1.0 / {pivot}" if j == k == q else f"{name(j, k)} / {pivot}" if q in (j, k) else f"{name(j, k)} - {name(j, q)} * {name(q, k)} / {pivot}"
            new.append(f"CASE WHEN {ok} THEN {value} ELSE {name(j, k)} END AS {name(j, k)}")
        new += [f"CASE WHEN {ok} THEN {f'g{q} / {pivot}' if j == q else f'g{j} - {name(j, q)} * g{q} / {pivot}'} ELSE g{j} END AS g{j}" for j in range(p)]
        marked = f"SELECT *, {pivot} > 1e-8 * greatest(i{q}_{q}, 0.0) AND i{q}_{q} > 1e-10 AS {ok} FROM ({inner})"
        inner = f"SELECT * REPLACE ({', '.join(new)}) FROM ({marked})"
    return inner


def newton_steps(rows: str, terms: list[str], models: dict[str, list[int]], steps: int = 21) -> list[str]:
    """CTEs from ``rows`` (outcome, t, e and what ``terms`` use) to ``cox``: outcome, model, b*, se* (NULL where aliased), done, steps.

    ``models`` lists the terms of each model; the others are held at zero.
    """
    p = len(terms)
    pairs = [(j, k) for j in range(p) for k in range(j, p)]
    cells = " UNION ALL ".join(
        f"SELECT outcome, '{m}' AS model, t, e, " + ", ".join(f"CAST({x if j in used else 0.0} AS DOUBLE) AS x{j}" for j, x in enumerate(terms)) + " FROM known"
        for m, used in models.items())
    xs = ", ".join(f"x{j}" for j in range(p))
    out = [f"known AS MATERIALIZED ({rows})",
           f"cells AS MATERIALIZED (SELECT outcome, model, t, {xs}, CAST(count(*) AS DOUBLE) AS n, CAST(sum(e) AS DOUBLE) AS d FROM ({cells}) GROUP BY ALL)",
           f"s0 AS MATERIALIZED (SELECT DISTINCT outcome, model, {', '.join(f'CAST(0 AS DOUBLE) AS b{j}' for j in range(p))}, CAST(NULL AS DOUBLE) AS ll, false AS done, 0 AS steps FROM cells)"]
    for i in range(steps):
        out += _likelihood(i, p, pairs)
        out.append(f"w{i} AS MATERIALIZED ({_swept(f'l{i}', p, pairs)})")
        settled = f"(s.done OR coalesce(abs(w.ll - s.ll) <= 1e-9 * (abs(w.ll) + 1e-9), false) OR NOT ({' OR '.join(f'ok{j}' for j in range(p))}))"
        moved = ", ".join(f"CASE WHEN {settled} OR NOT ok{j} THEN b{j} ELSE b{j} + g{j} END AS b{j}" for j in range(p))
        out.append(f"""s{i + 1} AS MATERIALIZED (SELECT s.outcome, s.model, {moved}, w.ll, {settled} AS done,
        CASE WHEN s.done THEN s.steps ELSE {i} END AS steps FROM s{i} s JOIN w{i} w USING (outcome, model))""")
    last = steps - 1
    errors = ", ".join(f"CASE WHEN ok{j} THEN sqrt(-a{j}_{j}) END AS se{j}" for j in range(p))
    out.append(f"""cox AS MATERIALIZED (SELECT outcome, model, {", ".join(f"s{last}.b{j}" for j in range(p))}, {errors}, s{steps}.done, s{steps}.steps
    FROM s{last} JOIN w{last} USING (outcome, model) JOIN s{steps} USING (outcome, model))""")
    return out


def tidy_steps(names: dict[int, str], tail: str) -> str:
    """``tidy``: a row per model and named term with hazard ratio, 95 % limits and the p-value that ``tail`` makes of ``z``."""
    each = " UNION ALL ".join(f"SELECT outcome, model, '{name}' AS term, b{j} AS b, se{j} AS se, done, steps FROM cox" for j, name in names.items())
    return f"""tidy AS (SELECT outcome, model, term, CASE WHEN se IS NOT NULL THEN round(exp(b), 6) END AS estimate,
    round(exp(b - 1.959963984540054 * se), 6) AS conf_low, round(exp(b + 1.959963984540054 * se), 6) AS conf_high,
    CASE WHEN se IS NOT NULL THEN round({tail}, 6) END AS p_value, done AS converged, CAST(steps AS INTEGER) AS steps
    FROM (SELECT *, least(abs(b / se), 12.0) AS z FROM ({each})))"""
