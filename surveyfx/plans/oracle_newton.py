"""Reference SQL of the iterative fits: Newton steps written out as materialized CTEs.

Each step is one aggregation (score and information) and a Gauss-Jordan elimination, one CTE per pivot. The number of
steps is fixed; the starting point is close enough that they all converge to rounding error.
"""

from __future__ import annotations

from surveyfx.plans.oracle import SQL, WELCH_SELECT, linear, welch_cte
from surveyfx.plans.oracle_base import Z95, result, survey

LOGIT_STEPS = 8
ORDINAL_STEPS = 7


def eliminate(tag: str, source: str, p: int, wide: int, keep: str) -> str:
    """CTEs that reduce columns a{i}_{j} (p rows, `wide` columns) of `source` to solved form; the last is `{tag}_{p}`."""
    out, prev = [], source
    for c in range(1, p + 1):
        cols = []
        for i in range(1, p + 1):
            for j in range(c + 1, wide + 1):
                pivot = f"a{c}_{j} / a{c}_{c}"
                cols.append(f"{pivot} AS a{i}_{j}" if i == c else f"a{i}_{j} - a{i}_{c} * ({pivot}) AS a{i}_{j}")
        out.append(f"{tag}_{c} AS MATERIALIZED (SELECT {keep}, {', '.join(cols)} FROM {prev})")
        prev = f"{tag}_{c}"
    return ",\n".join(out)


def _newton(p: int, sums: str, group: str, steps: int) -> str:
    """CTEs from `b0` to the estimate: `est` has question, b1.., v{i}_{j}. `sums` is a template over {b}."""
    params = ", ".join(f"b{i}" for i in range(1, p + 1))
    keep = f"{group}, {params}"
    ctes = []
    for k in range(steps):
        ctes.append(f"s{k} AS MATERIALIZED ({sums.format(b=f'b_{k}', keep=keep)})")
        aug = ", ".join(f"g{i} AS a{i}_{p + 1}" for i in range(1, p + 1))
        full = ", ".join(f"h{min(i, j)}_{max(i, j)} AS a{i}_{j}" for i in range(1, p + 1) for j in range(1, p + 1))
        ctes.append(f"m{k} AS MATERIALIZED (SELECT {keep}, {full}, {aug} FROM s{k})")
        ctes.append(eliminate(f"e{k}", f"m{k}", p, p + 1, keep))
        nxt = ", ".join(f"b{i} + a{i}_{p + 1} AS b{i}" for i in range(1, p + 1))
        ctes.append(f"b_{k + 1} AS MATERIALIZED (SELECT {group}, {nxt} FROM e{k}_{p})")
    ctes.append(f"sf AS MATERIALIZED ({sums.format(b=f'b_{steps}', keep=keep)})")
    full = ", ".join(f"h{min(i, j)}_{max(i, j)} AS a{i}_{j}" for i in range(1, p + 1) for j in range(1, p + 1))
    ident = ", ".join(f"{float(i == j)} AS a{i}_{p + j}" for i in range(1, p + 1) for j in range(1, p + 1))
    ctes.append(f"mf AS MATERIALIZED (SELECT {keep}, ll, {full}, {ident} FROM sf)")
    ctes.append(eliminate("ef", "mf", p, 2 * p, f"{keep}, ll"))
    inv = ", ".join(f"a{i}_{p + j} AS v{i}_{j}" for i in range(1, p + 1) for j in range(1, p + 1))
    ctes.append(f"est AS MATERIALIZED (SELECT {keep}, ll, {inv} FROM ef_{p})")
    return ",\n".join(ctes)


def logit(design: list[str], y: str, where: str, weight: str = "1.0", group: str = "question") -> str:
    """CTEs `dat`, `size`, ..., `est` of a binary logit on the design expressions."""
    head, step = _logit_parts(design, y, where, weight, group)
    return head + ",\n" + _newton(len(design), step, group, LOGIT_STEPS)


def _logit_parts(design: list[str], y: str, where: str, weight: str, group: str) -> tuple[str, str]:
    p = len(design)
    xs = ", ".join(f"x{i}" for i in range(1, p + 1))
    eta = " + ".join(f"b{i} * x{i}" for i in range(1, p + 1))
    sums = ", ".join(
        [f"sum(wy * x{i} - w * mu * x{i}) AS g{i}" for i in range(1, p + 1)]
        + [f"sum(w * mu * (1 - mu) * x{i} * x{j}) AS h{i}_{j}" for i in range(1, p + 1) for j in range(i, p + 1)]
        + ["sum(wy * ln(mu) + (w - wy) * ln(1 - mu)) AS ll"]
    )
    start = ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(1, p + 1))
    head = f"""
used AS (
  SELECT *, {', '.join(f'CAST({d} AS DOUBLE) AS x{i}' for i, d in enumerate(design, 1))}, CAST({weight} AS DOUBLE) AS ww, CAST({y} AS DOUBLE) AS yy
  FROM obs WHERE {y} IS NOT NULL AND {where}
),
dat AS MATERIALIZED (SELECT {group}, {xs}, sum(ww) AS w, sum(ww * yy) AS wy, count(*) AS n FROM used GROUP BY {group}, {xs}),
size AS (SELECT {group}, sum(n) AS n FROM dat GROUP BY {group}),
b_0 AS (SELECT DISTINCT {group}, {start} FROM dat)"""
    step = f"SELECT {{keep}}, {sums} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS mu FROM dat JOIN {{b}} USING ({group})) GROUP BY {{keep}}"
    return head, step


def ordinal(design: list[str], rank: str, classes: int, source: str = "partisan", group: str = "question") -> str:
    """CTEs of a cumulative logit; parameters are the thresholds, then the slopes."""
    head, step = _ordinal_parts(design, rank, classes, source, group)
    return head + ",\n" + _newton(classes - 1 + len(design), step, group, ORDINAL_STEPS)


def _ordinal_parts(design: list[str], rank: str, classes: int, source: str, group: str) -> tuple[str, str]:
    cuts, q = classes - 1, len(design)
    p = cuts + q
    xs = ", ".join(f"x{i}" for i in range(1, q + 1))
    eta = " + ".join(f"b{cuts + i} * x{i}" for i in range(1, q + 1))
    up = "CASE y " + " ".join(f"WHEN {j} THEN 1 / (1 + exp(-(b{j} - eta)))" for j in range(1, classes)) + " ELSE 1.0 END"
    lo = "CASE y " + " ".join(f"WHEN {j + 1} THEN 1 / (1 + exp(-(b{j} - eta)))" for j in range(1, classes)) + " ELSE 0.0 END"
    a = [f"(y = {j})::INT" for j in range(1, classes)] + [f"-x{i}" for i in range(1, q + 1)]
    b = [f"(y = {j + 1})::INT" for j in range(1, classes)] + [f"-x{i}" for i in range(1, q + 1)]
    grad = [f"sum(w * (da * {a[i]} + db * {b[i]})) AS g{i + 1}" for i in range(p)]
    info = [
        f"-sum(w * (haa * {a[i]} * {a[j]} + hbb * {b[i]} * {b[j]} + hab * ({a[i]} * {b[j]} + {b[i]} * {a[j]}))) AS h{i + 1}_{j + 1}"
        for i in range(p) for j in range(i, p)
    ]
    cum = [f"sum(w) FILTER (y <= {j})" for j in range(1, classes)]
    start = ", ".join([f"ln({c} / (sum(w) - {c})) AS b{j}" for j, c in enumerate(cum, 1)] + [f"0.0::DOUBLE AS b{cuts + i}" for i in range(1, q + 1)])
    head = f"""
partisan AS (
  SELECT *, CASE WHEN pid7 BETWEEN 5 AND 7 THEN 1 ELSE 0 END AS rep, CASE WHEN pid7 <= 3 THEN 1 ELSE 0 END AS dem
  FROM obs WHERE pid7 IN (1, 2, 3, 5, 6, 7)
),
ranked AS (SELECT *, {', '.join(f'CAST({d} AS DOUBLE) AS x{i}' for i, d in enumerate(design, 1))}, {rank} AS y FROM {source}),
dat AS MATERIALIZED (SELECT {group}, {xs}, y, CAST(count(*) AS DOUBLE) AS w FROM ranked WHERE y IS NOT NULL GROUP BY {group}, {xs}, y),
size AS (SELECT {group}, CAST(sum(w) AS BIGINT) AS n FROM dat GROUP BY {group}),
b_0 AS (SELECT {group}, {start} FROM dat GROUP BY {group})"""
    step = f"""SELECT {{keep}}, {', '.join(grad + info)}, sum(w * ln(pr)) AS ll FROM (
    SELECT *, fu / pr AS da, -fl / pr AS db, fu * (1 - 2 * up) / pr - (fu / pr) * (fu / pr) AS haa,
           -fl * (1 - 2 * lo) / pr - (fl / pr) * (fl / pr) AS hbb, fu * fl / (pr * pr) AS hab
    FROM (SELECT *, up - lo AS pr, up * (1 - up) AS fu, lo * (1 - lo) AS fl
          FROM (SELECT *, {up} AS up, {lo} AS lo FROM (SELECT *, {eta} AS eta FROM dat JOIN {{b}} USING ({group})))))
    GROUP BY {{keep}}"""
    return head, step


def last_parameter_bounds(p: int, step: str, steps: int = 6) -> list[str]:
    """CTEs `low` and `high`: profile-likelihood bounds of the last parameter.

    Newton's method on the system "log-likelihood equals its target, all other scores are zero" (Venzon and Moolgavkar
    1988), started at the Wald bound.
    """
    keep = "question, " + ", ".join(f"b{i}" for i in range(1, p + 1))
    system = ", ".join(
        [f"h{min(i, j)}_{max(i, j)} AS a{i}_{j}" for i in range(1, p) for j in range(1, p + 1)]
        + [f"g{i} AS a{i}_{p + 1}" for i in range(1, p)]
        + [f"g{j} AS a{p}_{j}" for j in range(1, p + 1)]
        + [f"goal - s.ll AS a{p}_{p + 1}"]
    )
    moved = ", ".join(f"b{i} + a{i}_{p + 1} AS b{i}" for i in range(1, p + 1))
    ctes = [f"target AS (SELECT question, ll - {3.841458820694124 / 2} AS goal FROM est)"]
    for side, sign in (("low", "-"), ("high", "+")):
        start = ", ".join(f"b{i} {sign} {Z95} * v{i}_{p} / sqrt(v{p}_{p}) AS b{i}" for i in range(1, p + 1))
        ctes.append(f"{side}_0 AS MATERIALIZED (SELECT question, {start} FROM est)")
        for k in range(steps):
            name = f"{side}_{k + 1}" if k < steps - 1 else side
            ctes.append(f"s{side}{k} AS MATERIALIZED ({step.format(b=f'{side}_{k}', keep=keep)})")
            ctes.append(f"m{side}{k} AS MATERIALIZED (SELECT {keep}, {system} FROM s{side}{k} s JOIN target USING (question))")
            ctes.append(eliminate(f"e{side}{k}", f"m{side}{k}", p, p + 1, keep))
            ctes.append(f"{name} AS MATERIALIZED (SELECT question, {moved} FROM e{side}{k}_{p})")
    return ctes


def coefficients(names: dict[int, str], key: str = "CAST(NULL AS VARCHAR) AS subgroup", group: str = "question", tag: str = "fit") -> str:
    parts = [
        f"SELECT {group}, {key}, '{name}' AS term, b{i} AS estimate, sqrt(v{i}_{i}) AS std_error, n, true AS converged, ll AS loglik FROM est JOIN size USING ({group})"
        for i, name in names.items()
    ]
    return f"{tag} AS (" + "\nUNION ALL ".join(parts) + ")"


def contrast(p: int, grids: dict[str, tuple[list[str], list[str]]], typical: str) -> str:
    """Effect of moving from the second to the first design row of each subgroup, at columns of `typical`."""
    rows = [
        f"SELECT question, '{sub}' AS subgroup, {', '.join(f'CAST({e} AS DOUBLE) AS u{i}' for i, e in enumerate(on, 1))}, "
        f"{', '.join(f'CAST({e} AS DOUBLE) AS o{i}' for i, e in enumerate(off, 1))} FROM ({typical})"
        for sub, (on, off) in grids.items()
    ]
    eta1 = " + ".join(f"b{i} * u{i}" for i in range(1, p + 1))
    eta0 = " + ".join(f"b{i} * o{i}" for i in range(1, p + 1))
    grad = ", ".join(f"m1 * (1 - m1) * u{i} - m0 * (1 - m0) * o{i} AS d{i}" for i in range(1, p + 1))
    var = " + ".join(f"d{i} * d{j} * v{i}_{j}" for i in range(1, p + 1) for j in range(1, p + 1))
    return f"""
grid AS ({' UNION ALL '.join(rows)}),
moved AS (SELECT *, 1 / (1 + exp(-({eta1}))) AS m1, 1 / (1 + exp(-({eta0}))) AS m0 FROM grid JOIN est USING (question)),
slope AS (SELECT *, {grad} FROM moved),
fit AS (SELECT question, subgroup, 'treat' AS term, m1 - m0 AS estimate, sqrt({var}) AS std_error, n, true AS converged FROM slope JOIN size USING (question))"""


KIND = "CASE WHEN question <= 'q5' THEN 'Factual' ELSE 'Policy' END AS question_type"


def typed(source: str = "fit") -> str:
    return f"(SELECT *, {KIND} FROM {source})"


# ---- logit with controls ------------------------------------------------------------------------------------------

for name, weight in (("direction_or_ctrl", "1.0"), ("direction_or_w", "weight")):
    SQL[name] = survey(
        result(typed(), extra=("question_type",), exponentiate=True),
        logit(["1", "treat", "sawf"], "agree_opinion", "true", weight),
        coefficients({2: "treat"}),
    )

# With the log odds ratio fixed, the control arm's probability solves a quadratic, so the profile likelihood is closed
# and its bounds follow by bisection.
_PROFILE = """
tab AS (
  SELECT question, CAST(count(*) FILTER (treat = 1 AND response = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (treat = 1 AND response = 2) AS DOUBLE) AS b,
         CAST(count(*) FILTER (treat = 0 AND response = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (treat = 0 AND response = 2) AS DOUBLE) AS d
  FROM obs GROUP BY question
),
fit AS (
  SELECT *, CAST(NULL AS VARCHAR) AS subgroup, 'treat' AS term, ln(a * d / (b * c)) AS estimate, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS std_error,
         a + b + c + d AS n, true AS converged,
         a * ln(a / (a + b)) + b * ln(b / (a + b)) + c * ln(c / (c + d)) + d * ln(d / (c + d)) AS top
  FROM tab
)"""


def _walk(name: str, sign: str) -> str:
    """Bisection as a recursive CTE: `inside` moves out while the deviance stays below the χ² quantile."""
    return f"""
{name} AS (
  SELECT question, 0 AS i, estimate AS inside, estimate {sign} 6 * std_error AS outside FROM fit
  UNION ALL
  SELECT question, i + 1, CASE WHEN dev < 3.841458820694124 THEN mid ELSE inside END, CASE WHEN dev < 3.841458820694124 THEN outside ELSE mid END
  FROM (
    SELECT *, 2 * (top - (a * ln(p1) + b * ln(1 - p1) + c * ln(p0) + d * ln(1 - p0))) AS dev FROM (
      SELECT *, r * p0 / (1 - p0 + r * p0) AS p1 FROM (
        SELECT *, 2 * (a + c) / (k + sqrt(k * k + 4 * (c + d) * (r - 1) * (a + c))) AS p0 FROM (
          SELECT *, (a + b) * r + c + d - (a + c) * (r - 1) AS k FROM (
            SELECT w.*, f.a, f.b, f.c, f.d, f.top, (inside + outside) / 2 AS mid, exp((inside + outside) / 2) AS r
            FROM {name} w JOIN fit f USING (question) WHERE i < 60)))))
)"""


_BOUNDS = """bounds AS (
  SELECT fit.*, exp(lo.inside) AS low, exp(hi.inside) AS high FROM fit
  JOIN walk_low lo ON lo.question = fit.question AND lo.i = 60 JOIN walk_high hi ON hi.question = fit.question AND hi.i = 60
)"""
SQL["direction_or_profile"] = survey(
    "SELECT * EXCLUDE (low, high) REPLACE (round(low, 6) + 0.0 AS conf_low, round(high, 6) + 0.0 AS conf_high) FROM ("
    + result("bounds", extra=("low", "high"), exponentiate=True)
    + ")",
    _PROFILE, _walk("walk_low", "-"), _walk("walk_high", "+"), _BOUNDS,
).replace("WITH ", "WITH RECURSIVE ", 1)


def least_squares(design: list[str], names: list[str], y: str, where: str, weight: str) -> str:
    """Normal equations of a weighted fit; t reference."""
    p = len(design)
    pairs = [(i, j) for i in range(1, p + 1) for j in range(1, p + 1)]
    head = f"""
used AS (
  SELECT question, {', '.join(f'CAST({d} AS DOUBLE) AS x{i}' for i, d in enumerate(design, 1))}, CAST({weight} AS DOUBLE) AS w, CAST({y} AS DOUBLE) AS y
  FROM obs WHERE {y} IS NOT NULL AND {where}
),
normal AS MATERIALIZED (
  SELECT question, count(*) AS n, sum(w * y * y) AS yy, {', '.join(f'sum(w * x{i} * y) AS g{i}' for i in range(1, p + 1))},
         {', '.join(f'sum(w * x{i} * x{j}) AS a{i}_{j}' for i, j in pairs)}, {', '.join(f'{float(i == j)} AS a{i}_{p + j}' for i, j in pairs)}
  FROM used GROUP BY question
)"""
    keep = "question, n, yy, " + ", ".join(f"g{i}" for i in range(1, p + 1))
    beta = ", ".join(f"{' + '.join(f'a{i}_{p + j} * g{j}' for j in range(1, p + 1))} AS b{i}" for i in range(1, p + 1))
    left = f"(yy - ({' + '.join(f'b{i} * g{i}' for i in range(1, p + 1))})) / (n - {p})"
    rows = "\nUNION ALL ".join(
        f"SELECT question, CAST(NULL AS VARCHAR) AS subgroup, '{name}' AS term, b{i} AS estimate, sqrt(s2 * a{i}_{p + i}) AS std_error, "
        f"CAST(n - {p} AS DOUBLE) AS df, n, true AS converged FROM scaled"
        for i, name in enumerate(names, 1)
    )
    return survey(
        result("fit", reference="t"), head, eliminate("ls", "normal", p, 2 * p, keep), f"beta AS (SELECT *, {beta} FROM ls_{p})",
        f"scaled AS MATERIALIZED (SELECT *, {left} AS s2 FROM beta)", f"fit AS ({rows})",
    )


SQL["certainty_coefficients"] = least_squares(
    ["1", "treat", "(party3 = 'Rep')::INT", "(party3 = 'Ind')::INT", "treat * (party3 = 'Rep')::INT", "treat * (party3 = 'Ind')::INT", "sawf"],
    ["(Intercept)", "treat", "party[Rep]", "party[Ind]", "treat:party[Rep]", "treat:party[Ind]", "saw"],
    "not_sure", "party3 IS NOT NULL", "weight",
)

S = "(seen2 = 'Yes')::INT"
SQL["direction_by_exposure_ctrl"] = survey(
    result("fit", exponentiate=True),
    logit(["1", "treat", S, f"treat * {S}", "(party3 = 'Ind')::INT", "(party3 = 'Rep')::INT"], "agree_opinion", "party3 IS NOT NULL"),
    contrast(
        6,
        {s: (["1", "1", v, v, "i", "r"], ["1", "0", v, "0", "i", "r"]) for s, v in (("No", "0"), ("Yes", "1"))},
        """SELECT question, CASE WHEN top = 'Ind' THEN 1 ELSE 0 END AS i, CASE WHEN top = 'Rep' THEN 1 ELSE 0 END AS r
           FROM (SELECT question, arg_max(party3, c) AS top FROM (SELECT question, party3, count(*) AS c FROM used GROUP BY ALL) GROUP BY question)""",
    ),
)
SQL["direction_by_exposure_w"] = survey(
    result("fit", exponentiate=True),
    logit(["1", "treat", S, f"treat * {S}", "pid3_baseline"], "agree_opinion", "pid3_baseline IS NOT NULL", "weight"),
    contrast(
        5,
        {s: (["1", "1", v, v, "c"], ["1", "0", v, "0", "c"]) for s, v in (("No", "0"), ("Yes", "1"))},
        "SELECT question, avg(pid3_baseline) AS c FROM used GROUP BY question",
    ),
)
R, I = "(party3 = 'Rep')::INT", "(party3 = 'Ind')::INT"
for name, weight in (("direction_by_party_ctrl", "1.0"), ("direction_by_party_w", "weight")):
    SQL[name] = survey(
        result("fit", exponentiate=True),
        logit(["1", "treat", R, I, f"treat * {R}", f"treat * {I}", "sawf"], "agree_opinion", "party3 IS NOT NULL", weight),
        contrast(
            7,
            {s: (["1", "1", r, i, r, i, "s"], ["1", "0", r, i, "0", "0", "s"]) for s, r, i in (("Dem", "0", "0"), ("Rep", "1", "0"), ("Ind", "0", "1"))},
            "SELECT question, CASE WHEN avg(sawf) > 0.5 THEN 1 ELSE 0 END AS s FROM used GROUP BY question",
        ),
    )

SCORE = "CASE WHEN pid7_baseline <= 3 THEN 1 WHEN pid7_baseline = 4 THEN 4 ELSE 3 END"
_dmu = "mu * (1 - mu)"
_ame_grad = [
    f"sum(n * {_dmu} * (1 - 2 * mu) * b2 * x{i}){f' + sum(n * {_dmu})' if i == 2 else ''} AS d{i}" for i in range(1, 5)
]
_ame_var = " + ".join(f"d{i} * d{j} * v{i}_{j}" for i in range(1, 5) for j in range(1, 5))
SQL["party_ame"] = survey(
    result(typed("(FROM fit UNION ALL BY NAME FROM ame)"), extra=("question_type",)),
    logit(["1", SCORE, "treat", "sawf"], "agree_all", "pid7_baseline <> 8", "weight"),
    coefficients({2: "pid"}),
    f"""
slopes AS (
  SELECT question, sum(n) AS m, b2 * sum(n * {_dmu}) AS s, {', '.join(_ame_grad)}
  FROM (SELECT dat.*, est.* EXCLUDE (question), 1 / (1 + exp(-(b1 * x1 + b2 * x2 + b3 * x3 + b4 * x4))) AS mu FROM dat JOIN est USING (question))
  GROUP BY question, b2
),
ame AS (
  SELECT question, CAST(NULL AS VARCHAR) AS subgroup, 'slope(pid)' AS term, s / m AS estimate, sqrt({_ame_var}) / m AS std_error, m AS n, true AS converged
  FROM slopes JOIN est USING (question)
)""",
)

# ---- ordinal logit ------------------------------------------------------------------------------------------------

CODE_RANK = "response"
AGREE_RANK = "CASE response WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 END"
CODE_CUTS = {1: "Yes|No", 2: "No|Not sure"}
AGREE_CUTS = {1: "Disagree|Not sure", 2: "Not sure|Agree"}

SQL["ordinal_party"] = survey(result("fit"), ordinal(["treat", "rep", "treat * rep"], AGREE_RANK, 3), coefficients({5: "treat:rep"}))
SQL["ordinal_party_profile"] = survey(
    "SELECT * EXCLUDE (low, high) REPLACE (round(low, 6) + 0.0 AS conf_low, round(high, 6) + 0.0 AS conf_high) FROM ("
    + result("bounds", extra=("low", "high"))
    + ")",
    ordinal(["treat", "rep", "treat * rep"], AGREE_RANK, 3),
    coefficients({5: "treat:rep"}),
    *last_parameter_bounds(5, _ordinal_parts(["treat", "rep", "treat * rep"], AGREE_RANK, 3, "partisan", "question")[1]),
    "bounds AS (SELECT fit.*, l.b5 AS low, h.b5 AS high FROM fit JOIN low l USING (question) JOIN high h USING (question))",
)
SQL["ordinal_table"] = survey(
    """SELECT CAST(substr(question, 2) AS INTEGER) AS position, CASE question """
    + " ".join(
        f"WHEN '{k}' THEN '{v}'"
        for k, v in {
            "q1": "First delivery was complete", "q2": "Second delivery was late", "q3": "Third delivery was insured",
            "q4": "Fourth delivery was inspected", "q5": "Fifth delivery was signed for", "q6": "Carrier was justified",
            "q7": "Carrier should be investigated", "q8": "Support ending the contract",
        }.items()
    )
    + """ END AS outcome,
    printf('%.3f', estimate) AS coefficient, printf('%.3f', std_error) AS se, printf('%.3f', statistic) AS z_value,
    printf('%.4f', p_value) AS p_value, p_value < 0.05 AS significant FROM full_table ORDER BY position""",
    ordinal(["treat", "rep", "treat * rep"], AGREE_RANK, 3),
    coefficients({5: "treat:rep"}),
    f"full_table AS ({result('fit')})",
)
SQL["ordinal_party_wide"] = survey(
    """SELECT question, round(b4, 6) + 0.0 AS estimate_treat_dem, round(b5, 6) + 0.0 AS estimate_treat_rep,
    round(sqrt(v4_4), 6) + 0.0 AS std_error_treat_dem, round(sqrt(v5_5), 6) + 0.0 AS std_error_treat_rep FROM est""",
    ordinal(["rep", "treat * dem", "treat * rep"], CODE_RANK, 3),
)
SQL["ordinal_five_point"] = survey(
    result("fit"),
    ordinal(["treat", "rep", "treat * rep"], "CASE supp WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END", 5,
            source="(SELECT * REPLACE ('(all)' AS question) FROM partisan)"),
    coefficients({1: "Strongly support|Somewhat support", 2: "Somewhat support|Not sure", 3: "Not sure|Somewhat oppose",
                  4: "Somewhat oppose|Strongly oppose", 5: "treat", 6: "rep", 7: "treat:rep"}),
)


def several(models: dict[str, tuple[list[str], dict[int, str]]], rank: str, extra: tuple[str, ...] = ()) -> str:
    """Results of several ordinal models, each from its own nested statement."""
    parts = []
    for model, (design, names) in models.items():
        body = ordinal(design, rank, 3) + ",\n" + coefficients(names, key=f"'{model}' AS model")
        parts.append(f"SELECT * FROM (WITH {body.strip()} {result('fit', keys=('question', 'model', 'term'), extra=extra)})")
    return survey("\nUNION ALL\n".join(parts))


SQL["ordinal_interaction_only"] = several(
    {
        "both": (["treat * dem", "treat * rep"], CODE_CUTS | {3: "treat:dem", 4: "treat:rep"}),
        "rep": (["treat * rep"], CODE_CUTS | {3: "treat:rep"}),
    },
    CODE_RANK,
)
SQL["ordinal_reparam"] = several(
    {
        "interaction": (["treat", "rep", "treat * rep"], AGREE_CUTS | {3: "treat", 4: "rep", 5: "treat_rep"}),
        "per_party": (["rep", "treat * rep", "treat * dem"], AGREE_CUTS | {3: "rep", 4: "treat_rep", 5: "treat_dem"}),
    },
    AGREE_RANK,
    extra=("round(loglik, 6) + 0.0 AS loglik",),
)
SQL["model_stack"] = several(
    {
        "main": (["treat", "rep"], AGREE_CUTS | {3: "treat", 4: "rep"}),
        "crossed": (["treat", "rep", "treat * rep"], AGREE_CUTS | {3: "treat", 4: "rep", 5: "treat:rep"}),
        "treat_only": (["treat"], AGREE_CUTS | {3: "treat"}),
    },
    AGREE_RANK,
)

# ---- one cell table, many analyses --------------------------------------------------------------------------------

_PARTS = {
    "linear": f"SELECT * EXCLUDE (question_type) FROM ({SQL['certainty_by_party_w']})",
    "contrasts": SQL["certainty_logit_by_party"],
    "shares": f"SELECT CAST(response AS VARCHAR) AS subgroup, * EXCLUDE (response, prob_control, prob_treated) FROM ({SQL['multinom_shares']})",
    "odds": survey(result("fit"), logit(["1", "treat"], "agree_opinion", "true", "weight"), coefficients({1: "(Intercept)", 2: "treat"})),
    "logit": survey(
        result("fit"), logit(["1", "treat", "sawf"], "agree_opinion", "true", "weight"), coefficients({1: "(Intercept)", 2: "treat", 3: "saw1"})
    ),
    "least_squares": least_squares(["1", "treat", "(party = 'Rep')::INT"], ["(Intercept)", "treat", "rep"], "not_sure", "party IS NOT NULL", "1.0"),
}
SQL["shared_cells_effects"] = "\nUNION ALL BY NAME\n".join(
    f"SELECT '{name}' AS analysis, * FROM ({sql})" for name, sql in _PARTS.items()
)


# ---- profile bounds of controlled and weighted logits -------------------------------------------------------------

def _with_bounds(table: str, transform: str = "") -> str:
    return f"SELECT * EXCLUDE (low, high) REPLACE (coalesce(round({transform}(low), 6) + 0.0, conf_low) AS conf_low, coalesce(round({transform}(high), 6) + 0.0, conf_high) AS conf_high) FROM ({table})"


for name, weight in (("direction_or_ctrl_profile", "1.0"), ("direction_or_w_profile", "weight")):
    _design = ["1", "sawf", "treat"]
    SQL[name] = survey(
        _with_bounds(result(typed("bounds"), extra=("question_type", "low", "high"), exponentiate=True), "exp"),
        logit(_design, "agree_opinion", "true", weight),
        coefficients({3: "treat"}),
        *last_parameter_bounds(3, _logit_parts(_design, "agree_opinion", "true", weight, "question")[1]),
        "bounds AS (SELECT fit.*, l.b3 AS low, h.b3 AS high FROM fit JOIN low l USING (question) JOIN high h USING (question))",
    )

_design = ["1", "treat", "sawf", SCORE]
SQL["party_ame_profile"] = (
    "WITH wald AS (" + SQL["party_ame"] + "), profile AS (" + survey(
        "SELECT question, 'pid' AS term, l.b4 AS low, h.b4 AS high FROM low l JOIN high h USING (question)",
        logit(_design, "agree_all", "pid7_baseline <> 8", "weight"),
        *last_parameter_bounds(4, _logit_parts(_design, "agree_all", "pid7_baseline <> 8", "weight", "question")[1]),
    ) + ") " + _with_bounds("SELECT wald.*, low, high FROM wald LEFT JOIN profile USING (question, term)")
)

# ---- continuous outcome, lists, order, snapshot -------------------------------------------------------------------

# centred before any product is taken
_y = "(caseid * 37 % 1009) / 100.0 + treat * response / 10.0"
_z = "((caseid * 7919) % 1000003) / 1e6"
_used = "response IS NOT NULL AND party IS NOT NULL"
_around = "PARTITION BY question"
SQL["linear_continuous"] = f"SELECT * FROM ({least_squares(['1', 'treat', "(party = 'Rep')::INT", "treat * (party = 'Rep')::INT", f'{_z} - avg({_z}) OVER ({_around})'], ['(Intercept)', 'treat', 'party[Rep]', 'treat:party[Rep]', 'seconds'], f'({_y})', _used, 'weight')}) WHERE term <> '(Intercept)'"
SQL["linear_undeclared_code"] = least_squares(["1", "treat", "pid3_baseline"], ["(Intercept)", "treat", "pid3_baseline"], "not_sure", "pid3_baseline IS NOT NULL", "1.0")
SQL["logit_undeclared_code"] = survey(
    "SELECT question, count(*) AS n, false AS converged, 'values outside the list of pid3_baseline' AS error FROM obs WHERE agree_opinion IS NOT NULL AND pid3_baseline IS NOT NULL GROUP BY question"
)
SQL["certainty_ols_ordered"] = f"SELECT *, CAST(row_number() OVER (ORDER BY estimate, question, term) AS INTEGER) AS position FROM ({SQL['certainty_ols']})"
SQL["direction_or_ordered"] = f"SELECT *, CAST(row_number() OVER (ORDER BY -estimate, question, term) AS INTEGER) AS position FROM ({SQL['direction_or']})"
SQL["nested_logit_ordered"] = (
    "SELECT *, CAST(row_number() OVER (ORDER BY CASE WHEN dichotomy = 'certainty' THEN estimate ELSE 0 END, question, dichotomy, term) AS INTEGER) AS position "
    f"FROM ({SQL['nested_logit']})"
)
SQL["certainty_wls_ctrl_means"] = f"SELECT e.*, m.control_mean, m.treatment_mean FROM ({SQL['certainty_wls_ctrl']}) e JOIN ({SQL['weighted_means']}) m USING (question)"
SQL["snapshot_question"] = survey(
    "SELECT question, treat, response, count(*) AS n, round(CAST(sum(weight) AS DOUBLE), 6) + 0.0 AS weight FROM long WHERE question = 'q3' GROUP BY ALL"
)

# ---- open covariates ----------------------------------------------------------------------------------------------

OPEN = "((caseid * 7919) % 1000003) / 1e6"
SQL["direction_open_covariate"] = survey(
    result("fit"), logit(["1", "treat", OPEN], "agree_opinion", "true"), coefficients({1: "(Intercept)", 2: "treat", 3: "open"})
)
_design = ["1", OPEN, "treat"]
SQL["direction_open_covariate_profile"] = survey(
    _with_bounds(result("bounds", extra=("low", "high"))),
    logit(_design, "agree_opinion", "true", "weight"),
    coefficients({3: "treat"}),
    *last_parameter_bounds(3, _logit_parts(_design, "agree_opinion", "true", "weight", "question")[1]),
    "bounds AS (SELECT fit.*, l.b3 AS low, h.b3 AS high FROM fit JOIN low l USING (question) JOIN high h USING (question))",
)


def average_slope(p: int, k: int, name: str) -> str:
    """CTEs `slopes` and `ame`: average derivative of the fitted probability by the k-th design column alone."""
    eta = " + ".join(f"b{i} * x{i}" for i in range(1, p + 1))
    grad = ", ".join(f"sum(n * {_dmu} * (1 - 2 * mu) * b{k} * x{i}){f' + sum(n * {_dmu})' if i == k else ''} AS d{i}" for i in range(1, p + 1))
    var = " + ".join(f"d{i} * d{j} * v{i}_{j}" for i in range(1, p + 1) for j in range(1, p + 1))
    return f"""
slopes AS (
  SELECT question, sum(n) AS m, b{k} * sum(n * {_dmu}) AS s, {grad}
  FROM (SELECT dat.*, est.* EXCLUDE (question), 1 / (1 + exp(-({eta}))) AS mu FROM dat JOIN est USING (question)) GROUP BY question, b{k}
),
ame AS (
  SELECT question, CAST(NULL AS VARCHAR) AS subgroup, 'slope({name})' AS term, s / m AS estimate, sqrt({var}) / m AS std_error, m AS n, true AS converged
  FROM slopes JOIN est USING (question)
)"""


SQL["slope_open_covariate"] = survey(
    result("(FROM fit UNION ALL BY NAME FROM ame)"),
    logit(["1", "treat", S, f"treat * {S}", OPEN], "agree_opinion", "true"),
    contrast(
        5,
        {s: (["1", "1", v, v, "c"], ["1", "0", v, "0", "c"]) for s, v in (("No", "0"), ("Yes", "1"))},
        f"SELECT question, avg({OPEN}) AS c FROM used GROUP BY question",
    ),
    average_slope(5, 5, "open"),
)
SQL["ordinal_open_covariate"] = survey(
    result("fit", extra=("round(loglik, 6) + 0.0 AS loglik",)), ordinal(["treat", "rep", OPEN], AGREE_RANK, 3), coefficients(AGREE_CUTS | {3: "treat", 4: "rep", 5: "open"})
)
_STACK = {
    "treat": (["1", "treat"], "true", {1: "(Intercept)", 2: "treat"}),
    "open": (["1", "treat", OPEN], "true", {1: "(Intercept)", 2: "treat", 3: "open"}),
    "party": (["1", "treat", R, I, OPEN], "party3 IS NOT NULL", {1: "(Intercept)", 2: "treat", 3: "party[Rep]", 4: "party[Ind]", 5: "open"}),
}
SQL["open_model_stack"] = survey("\nUNION ALL\n".join(
    f"SELECT * FROM (WITH {(logit(design, 'agree_opinion', where) + ', ' + coefficients(names, key=f'{chr(39)}{model}{chr(39)} AS model')).strip()} "
    f"{result('fit', keys=('model', 'question', 'term'))})"
    for model, (design, where, names) in _STACK.items()
))


# ---- multinomial with covariates ----------------------------------------------------------------------------------

def softmax(design: list[str], code: str, classes: int, weight: str) -> str:
    """CTEs of a multinomial logit against class 1; parameter (c - 2) q + i belongs to design column i of class c."""
    q = len(design)
    xs = ", ".join(f"x{i}" for i in range(1, q + 1))
    place = [(c, i) for c in range(2, classes + 1) for i in range(1, q + 1)]
    number = {ci: k for k, ci in enumerate(place, 1)}
    e = ", ".join(f"exp({' + '.join(f'b{number[c, i]} * x{i}' for i in range(1, q + 1))}) AS e{c}" for c in range(2, classes + 1))
    total = "1 + " + " + ".join(f"e{c}" for c in range(2, classes + 1))
    mu = ", ".join(f"e{c} / ({total}) AS m{c}" for c in range(2, classes + 1))
    own = "CASE y WHEN 1 THEN 1 " + " ".join(f"WHEN {c} THEN e{c}" for c in range(2, classes + 1)) + f" END / ({total})"
    sums = ", ".join(
        [f"sum(w * ((y = {c})::INT - m{c}) * x{i}) AS g{number[c, i]}" for c, i in place]
        + [f"sum(w * m{c} * ({int(c == d)} - m{d}) * x{i} * x{j}) AS h{number[c, i]}_{number[d, j]}" for c, i in place for d, j in place if number[c, i] <= number[d, j]]
        + ["sum(w * ln(pr)) AS ll"]
    )
    start = ", ".join(f"0.0::DOUBLE AS b{k}" for k in number.values())
    step = f"SELECT {{keep}}, {sums} FROM (SELECT *, {mu}, {own} AS pr FROM (SELECT *, {e} FROM dat JOIN {{b}} USING (question))) GROUP BY {{keep}}"
    return f"""
used AS (
  SELECT *, {', '.join(f'CAST({d} AS DOUBLE) AS x{i}' for i, d in enumerate(design, 1))}, {code} AS y, CAST({weight} AS DOUBLE) AS ww FROM obs WHERE {code} IS NOT NULL
),
dat AS MATERIALIZED (SELECT question, {xs}, y, sum(ww) AS w, count(*) AS n FROM used GROUP BY question, {xs}, y),
size AS (SELECT question, sum(n) AS n FROM dat GROUP BY question),
b_0 AS (SELECT DISTINCT question, {start} FROM dat),
{_newton(len(place), step, "question", LOGIT_STEPS)}"""


def class_probabilities(q: int, labels: dict[int, str], grid: tuple[list[str], list[str]], typical: str) -> str:
    """CTE `fit`: coefficients against class 1, and each class's probability at the rows of `grid` (treated, control)."""
    k = len(labels)
    number = {(c, i): (c - 2) * q + i for c in range(2, k + 1) for i in range(1, q + 1)}
    ctes = [f"place AS (SELECT est.*, {', '.join(f'CAST({x} AS DOUBLE) AS {t}{i}' for t, row in zip('uo', grid) for i, x in enumerate(row, 1))} FROM est JOIN ({typical}) USING (question))"]
    e = ", ".join(f"exp({' + '.join(f'b{number[c, i]} * {t}{i}' for i in range(1, q + 1))}) AS e{t}{c}" for t in "uo" for c in range(2, k + 1))
    ctes.append(f"lifted AS (SELECT *, 1.0 AS eu1, 1.0 AS eo1, {e} FROM place)")
    p = ", ".join(f"e{t}{c} / ({' + '.join(f'e{t}{d}' for d in range(1, k + 1))}) AS p{t}{c}" for t in "uo" for c in range(1, k + 1))
    ctes.append(f"shares AS (SELECT *, {p} FROM lifted)")
    parts = []

    def part(label: str, term: str, value: str, grad: dict[int, str]) -> str:
        var = " + ".join(f"({a}) * ({b}) * v{i}_{j}" for i, a in grad.items() for j, b in grad.items())
        return f"SELECT question, '{label}' AS subgroup, '{term}' AS term, {value} AS estimate, sqrt({var}) AS std_error, n, true AS converged FROM shares JOIN size USING (question)"

    for c, label in labels.items():
        slope = {t: {m: f"p{t}{c} * ({int(c == d)} - p{t}{d}) * {t}{i}" for (d, i), m in number.items()} for t in "uo"}
        parts.append(part(label, "treat=0", f"po{c}", slope["o"]))
        parts.append(part(label, "treat=1", f"pu{c}", slope["u"]))
        parts.append(part(label, "treat", f"pu{c} - po{c}", {m: f"{slope['u'][m]} - {slope['o'][m]}" for m in number.values()}))
    ctes.append("prob AS (" + "\nUNION ALL ".join(parts) + ")")
    return ",\n".join(ctes)


def _multinomial(design: list[str], names: list[str], weight: str, grid: tuple[list[str], list[str]], typical: str) -> str:
    labels = {1: "Yes", 2: "No", 3: "Not sure"}
    q = len(design)
    return survey(
        result("(FROM fit UNION ALL BY NAME FROM prob)"),
        softmax(design, "response", 3, weight),
        coefficients({(c - 2) * q + i: f"{labels[c]}:{name}" for c in (2, 3) for i, name in enumerate(names, 1)}),
        class_probabilities(q, labels, grid, typical),
    )


SQL["multinom_control"] = _multinomial(
    ["1", "treat", "sawf"], ["(Intercept)", "treat", "saw"], "weight", (["1", "1", "s"], ["1", "0", "s"]),
    "SELECT question, CASE WHEN avg(sawf) > 0.5 THEN 1 ELSE 0 END AS s FROM used GROUP BY question",
)
SQL["multinom_open_covariate"] = _multinomial(
    ["1", "treat", OPEN], ["(Intercept)", "treat", "open"], "1.0", (["1", "1", "s"], ["1", "0", "s"]), f"SELECT question, avg({OPEN}) AS s FROM used GROUP BY question"
)


# ---- moment states, hook, snapshot, audit -------------------------------------------------------------------------

_far = "(caseid * 37 % 1009) / 100.0 + treat * response / 10.0"
_z3 = "((caseid * 7919) % 1000003) / 1e3"
_answered = "response IS NOT NULL"
_cross = ["1", "treat", "(party = 'Rep')::INT", "treat * (party = 'Rep')::INT"]
_fit_sql = {
    "adjusted": f"SELECT * EXCLUDE (question_type) FROM ({linear(_far, weight='weight', control=_z3, reference='t')})",
    "by_party": f"SELECT * EXCLUDE (question_type) FROM ({linear(_far, by='party', weight='weight', reference='t')})",
    "crossed": f"SELECT * FROM ({least_squares(_cross, ['(Intercept)', 'treat', 'party[Rep]', 'treat:party[Rep]'], f'({_far})', _answered + ' AND party IS NOT NULL', 'weight')}) WHERE term <> '(Intercept)'",
}
SQL["moment_states"] = "\nUNION ALL BY NAME\n".join(f"SELECT '{k}' AS analysis, * FROM ({sql})" for k, sql in _fit_sql.items())
SQL["moment_states_welch"] = survey(
    f"SELECT * EXCLUDE (m1, m2) FROM (SELECT question, {WELCH_SELECT.format(m1='m1', m2='m2')}, CAST(n AS BIGINT) AS n FROM welch)",
    f"tests AS (SELECT question, 2 - treat AS g, {_far} AS y FROM obs WHERE {_answered})," + welch_cte("tests", "question"),
)
SQL["snapshot_replace"] = survey(
    """SELECT question, treat, CASE WHEN question = 'q3' THEN CASE response WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE response END ELSE response END AS response,
    count(*) AS n, round(CAST(sum(weight) AS DOUBLE), 6) + 0.0 AS weight FROM long GROUP BY ALL"""
)
SQL["saved_table"] = SQL["ordinal_table"]
SQL["codebook_audit"] = survey(
    """SELECT coalesce(o.var_name, k.var_name) AS var_name, coalesce(o.code, k.code) AS code, value_label, coalesce(n, 0) AS n,
    CASE WHEN n IS NULL THEN 'unused' WHEN o.code IS NULL THEN 'missing' WHEN value_label IS NULL THEN 'unlabelled' ELSE 'labelled' END AS status
    FROM (SELECT var_name, CAST(code AS BIGINT) AS code, count(*) AS n FROM (
            SELECT unnest([""" + ", ".join(f"'q{j}'" for j in range(1, 9)) + """]) AS var_name,
              unnest([q1, q2, CASE WHEN caseid % 50 = 0 THEN 9 ELSE q3 END, CASE WHEN q4 <> 2 THEN q4 END, q5, q6, q7, q8]) AS code FROM wide) GROUP BY ALL) o
    FULL JOIN (SELECT 'q' || j AS var_name, CAST(c AS BIGINT) AS code,
                 CASE WHEN c = 3 THEN 'Not sure' WHEN j = 6 THEN CASE c WHEN 1 THEN 'Was justified' ELSE 'Was not justified' END WHEN c = 1 THEN 'Yes' ELSE 'No' END AS value_label
               FROM range(1, 9) a(j), range(1, 4) b(c)) k ON o.var_name = k.var_name AND o.code = k.code"""
)
SQL["folded_median"] = survey(
    """SELECT question, treat, round(max(total), 6) + 0.0 AS total, CAST(min(bin) FILTER (below >= total / 2 - 1e-9) AS INTEGER) AS median, CAST(count(*) AS INTEGER) AS bins,
    true AS converged, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT *, sum(w) OVER (PARTITION BY question, treat ORDER BY bin) AS below, sum(w) OVER (PARTITION BY question, treat) AS total
          FROM (SELECT question, treat, CAST(floor(((caseid * 7919) % 1000003) / 1e6 * 1000) AS INTEGER) AS bin, sum(CAST(weight AS DOUBLE)) AS w
                FROM long WHERE response IS NOT NULL GROUP BY ALL)) GROUP BY question, treat"""
)
