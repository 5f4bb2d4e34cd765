"""Reference SQL (DuckDB dialect) of the closed-form queries, keyed like the registry."""

from __future__ import annotations

from surveyfx.plans.oracle_base import QUESTIONS, T95_DF4, normal_p, r6, result, survey, t_p, t_q

SQL: dict[str, str] = {}

LABELS = {
    "q1": "First delivery was complete", "q2": "Second delivery was late", "q3": "Third delivery was insured",
    "q4": "Fourth delivery was inspected", "q5": "Fifth delivery was signed for", "q6": "Carrier was justified",
    "q7": "Carrier should be investigated", "q8": "Support ending the contract",
}

WELCH_SELECT = ", ".join(
    [
        r6("mean1", "{m1}"), r6("mean2", "{m2}"), r6("difference", "difference"), r6("std_error", "std_error"),
        r6("difference / std_error", "statistic"), r6("df", "df"), r6("(" + t_p("(difference / std_error)", "df") + ")", "p_value"),
        r6(f"difference - {t_q('df')} * std_error", "conf_low"), r6(f"difference + {t_q('df')} * std_error", "conf_high"),
    ]
)


def welch_cte(source: str, by: str) -> str:
    """`source` has columns {by}, g (1 / 2), y."""
    return f"""
sides AS (
  SELECT {by}, count(*) FILTER (g = 1) AS n1, count(*) FILTER (g = 2) AS n2, avg(y) FILTER (g = 1) AS mean1, avg(y) FILTER (g = 2) AS mean2,
         var_samp(y) FILTER (g = 1) / count(*) FILTER (g = 1) AS v1, var_samp(y) FILTER (g = 2) / count(*) FILTER (g = 2) AS v2
  FROM {source} WHERE g IS NOT NULL AND y IS NOT NULL GROUP BY {by}
),
welch AS (
  SELECT {by}, mean1, mean2, mean1 - mean2 AS difference, sqrt(v1 + v2) AS std_error,
         (v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1)) AS df, n1 + n2 AS n
  FROM sides
)"""


def linear(y: str, by: str | None = None, weight: str = "1.0", control: str | None = None, reference: str = "normal") -> str:
    """Effects of y ~ treat (* by) (+ control) by within-cell sums; signs flipped to control − treated."""
    sub, s = by or "CAST(NULL AS VARCHAR)", control or "0.0"
    needs = " AND ".join(f"{c} IS NOT NULL" for c in (y, by, control) if c)
    ctes = f"""
rows_used AS (
  SELECT question, question_type, {sub} AS sub, treat, CAST({y} AS DOUBLE) AS y, CAST({s} AS DOUBLE) AS s, CAST({weight} AS DOUBLE) AS w
  FROM obs WHERE {needs}
),
centred AS (
  SELECT *, sum(w * y) OVER c / sum(w) OVER c AS ym, sum(w * s) OVER c / sum(w) OVER c AS sm
  FROM rows_used WINDOW c AS (PARTITION BY question, sub, treat)
),
resid AS (
  SELECT question, sum(w * (s - sm) * (s - sm)) AS sss, sum(w * (s - sm) * (y - ym)) AS ssy, sum(w * (y - ym) * (y - ym)) AS syy,
         count(*) AS n, count(DISTINCT coalesce(sub, '') || treat) AS k
  FROM centred GROUP BY question
),
sigma AS (
  SELECT question, sss, n, {'ssy / sss' if control else '0.0'} AS b, CAST(n - k - {1 if control else 0} AS DOUBLE) AS df,
         ({'syy - ssy * ssy / sss' if control else 'syy'}) / (n - k - {1 if control else 0}) AS s2
  FROM resid
),
arm AS (
  SELECT question, any_value(question_type) AS question_type, sub,
         max(CASE WHEN treat = 1 THEN ym END) - max(CASE WHEN treat = 0 THEN ym END) AS dy,
         max(CASE WHEN treat = 1 THEN sm END) - max(CASE WHEN treat = 0 THEN sm END) AS ds,
         1 / sum(w) FILTER (treat = 1) + 1 / sum(w) FILTER (treat = 0) AS inv
  FROM centred GROUP BY question, sub
),
fit AS (
  SELECT question, question_type, sub AS subgroup, 'treat' AS term, -(dy - b * ds) AS estimate,
         sqrt(s2 * (inv + {'ds * ds / sss' if control else '0.0'})) AS std_error, df, n, true AS converged
  FROM arm JOIN sigma USING (question)
)"""
    return survey(result("fit", extra=("question_type",), reference=reference), ctes)


def risk_difference(y: str, by: str, scale: str = "response") -> str:
    value, var = ("p", "p * (1 - p) / m") if scale == "response" else ("ln(p / (1 - p))", "1 / (m * p) + 1 / (m * (1 - p))")
    ctes = f"""
arm AS (
  SELECT question, {by} AS subgroup, treat, CAST(count(*) AS DOUBLE) AS m, avg({y}) AS p
  FROM obs WHERE {y} IS NOT NULL AND {by} IS NOT NULL GROUP BY ALL
),
fit AS (
  SELECT question, subgroup, 'treat' AS term,
         max(CASE WHEN treat = 1 THEN {value} END) - max(CASE WHEN treat = 0 THEN {value} END) AS estimate,
         sqrt(sum({var})) AS std_error, sum(sum(m)) OVER (PARTITION BY question) AS n, true AS converged
  FROM arm GROUP BY question, subgroup
)"""
    return survey(result("fit", exponentiate=True), ctes)


STANCE_SHARES = """
stance_n AS (SELECT question, party, treat, stance, count(*) AS n FROM obs WHERE party IS NOT NULL AND stance IS NOT NULL GROUP BY ALL),
shares AS (
  SELECT question, party, treat, max(CASE WHEN stance = 1 THEN p END) AS yes, max(CASE WHEN stance = 2 THEN p END) AS no,
         max(CASE WHEN stance = 3 THEN p END) AS not_sure
  FROM (SELECT *, n / sum(n) OVER (PARTITION BY question, party, treat) AS p FROM stance_n) GROUP BY ALL
)"""


def ztest(covariance: bool) -> str:
    cov = " + 2 * y1 * n1 / m1 + 2 * y0 * n0 / m0" if covariance else ""
    ctes = f"""
parts AS (
  SELECT question, party, avg((stance = 1)::INT) FILTER (treat = 1) AS y1, avg((stance = 1)::INT) FILTER (treat = 0) AS y0,
         avg((stance = 2)::INT) FILTER (treat = 1) AS n1, avg((stance = 2)::INT) FILTER (treat = 0) AS n0,
         count(*) FILTER (treat = 1) AS m1, count(*) FILTER (treat = 0) AS m0
  FROM obs WHERE party IS NOT NULL AND stance IS NOT NULL GROUP BY question, party
),
tested AS (
  SELECT question, party, (y1 - n1) - (y0 - n0) AS d,
         sqrt(y1 * (1 - y1) / m1 + y0 * (1 - y0) / m0 + n1 * (1 - n1) / m1 + n0 * (1 - n0) / m0{cov}) AS se
  FROM parts
),
p AS (SELECT *, {normal_p('(d / se)')} AS p_value FROM tested)"""
    return survey(
        f"""SELECT question, party, {r6('d', 'diff_effect')}, {r6('se', 'se_diff_effect')}, {r6('d / se', 'z_stat')}, {r6('p_value', 'p_value')},
        CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' WHEN p_value < 0.1 THEN '†' ELSE '' END AS significance
        FROM p""",
        ctes,
    )


def agreement(where: str) -> str:
    return survey(
        f"""SELECT question, arm, pid7_baseline, {r6('mean', 'mean')},
        round(abs(max(CASE WHEN pid7_baseline = 7 THEN mean END) OVER q - max(CASE WHEN pid7_baseline = 1 THEN mean END) OVER q), 6) + 0.0 AS diff
        FROM means WINDOW q AS (PARTITION BY question, arm)""",
        f"""means AS (
  SELECT question, CASE WHEN treat = 1 THEN 'Treatment' ELSE 'Control' END AS arm, pid7_baseline, avg(agree_all) AS mean
  FROM obs WHERE pid7_baseline <> 8 AND response IS NOT NULL AND {where} GROUP BY ALL)""",
    )


def randomization(source: str) -> str:
    ctes = f"""
tests AS (
  SELECT unnest(['saw_by_treat', 'saw_by_party', 'treat_by_party']) AS test,
         unnest([sawf, sawf, treat]) AS y, unnest([treat + 1, side, side]) AS g
  FROM (SELECT CASE WHEN saw = 1 THEN 1.0 ELSE 0.0 END AS sawf, treat, CASE WHEN pid7_baseline <= 3 THEN 1 WHEN pid7_baseline BETWEEN 5 AND 7 THEN 2 END AS side
        FROM {source} WHERE treat IS NOT NULL)
),""" + welch_cte("tests", "test").lstrip()
    return survey(f"SELECT test, {WELCH_SELECT.format(m1='mean1', m2='mean2')}, CAST(n AS BIGINT) AS n FROM welch", ctes)


def multinomial(by: tuple[str, ...], weight: str, model_errors: bool) -> str:
    keys = ", ".join(by)
    d1, d0 = ("w1", "w0") if model_errors else ("rows1", "rows0")
    return f"""
totals AS (
  SELECT {keys}, count(*) FILTER (treat = 1) AS rows1, count(*) FILTER (treat = 0) AS rows0,
         CAST(sum({weight}) FILTER (treat = 1 AND response IS NOT NULL) AS DOUBLE) AS w1, CAST(sum({weight}) FILTER (treat = 0 AND response IS NOT NULL) AS DOUBLE) AS w0,
         count(response) AS n, count(DISTINCT response) AS classes
  FROM obs GROUP BY {keys}
),
classes AS (
  SELECT {keys}, response, coalesce(CAST(sum({weight}) FILTER (treat = 1) AS DOUBLE), 0) AS c1, coalesce(CAST(sum({weight}) FILTER (treat = 0) AS DOUBLE), 0) AS c0
  FROM obs WHERE response IS NOT NULL GROUP BY {keys}, response
),
fit AS (
  SELECT {keys}, response, 'treat' AS term, n, c0 / w0 AS p0, c1 / w1 AS p1,
         CASE WHEN classes > 1 THEN c1 / w1 - c0 / w0 END AS estimate,
         CASE WHEN classes > 1 THEN sqrt(c1 / w1 * (1 - c1 / w1) / {d1} + c0 / w0 * (1 - c0 / w0) / {d0}) END AS std_error,
         CAST(2 * (classes - 1) AS DOUBLE) AS df, classes > 1 AS converged,
         CASE WHEN classes < 2 THEN 'needs at least two response classes' END AS error
  FROM classes JOIN totals USING ({keys})
)"""


# ---- sources, recodes, reshaping ----------------------------------------------------------------------------------

SQL["survey_wide"] = survey(
    f"SELECT caseid, pid7_baseline, pid7, pid3_baseline, saw, {r6('CAST(weight AS DOUBLE)', 'weight')}, supp, treat, {', '.join(QUESTIONS)} FROM wide"
)
SQL["survey_long"] = survey(
    f"SELECT caseid, treat, pid7_baseline, pid7, pid3_baseline, saw, {r6('CAST(weight AS DOUBLE)', 'weight')}, supp, question, response FROM long"
)
SQL["codebook"] = survey(
    f"""SELECT var_name, CASE var_name {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())} END AS label, code,
    CASE WHEN code = 3 THEN 'Not sure' WHEN var_name = 'q6' THEN CASE code WHEN 1 THEN 'Was justified' ELSE 'Was not justified' END
         WHEN code = 1 THEN 'Yes' ELSE 'No' END AS value_label,
    count(response) AS n, CAST(substr(var_name, 2) AS INTEGER) AS question_rank,
    CASE WHEN var_name <= 'q5' THEN 'Factual' ELSE 'Policy' END AS question_type, var_name IN ('q2', 'q7', 'q8') AS reverse_coded
    FROM (SELECT 'q' || j AS var_name, CAST(c AS INTEGER) AS code FROM range(1, 9) a(j), range(1, 4) b(c)) k
    LEFT JOIN long ON question = var_name AND response = code GROUP BY var_name, code"""
)
SQL["outcomes"] = survey(
    "SELECT caseid, question, CAST(not_sure AS DOUBLE) AS not_sure, CAST(agree_all AS DOUBLE) AS agree_all, "
    "CAST(agree_opinion AS DOUBLE) AS agree_opinion, CAST(sawf AS DOUBLE) AS saw_flag FROM obs"
)
SQL["recode_party"] = survey(
    """SELECT caseid, CASE pid7_baseline WHEN 1 THEN 'Strong Dem' WHEN 2 THEN 'Weak Dem' WHEN 3 THEN 'Lean Dem' WHEN 4 THEN 'Independent'
         WHEN 5 THEN 'Lean Rep' WHEN 6 THEN 'Weak Rep' WHEN 7 THEN 'Strong Rep' WHEN 8 THEN 'None' END AS pid_label,
    CASE WHEN pid7_baseline <= 3 THEN 'Dem' WHEN pid7_baseline BETWEEN 5 AND 7 THEN 'Rep' END AS party,
    CASE WHEN pid7_baseline <= 3 THEN 'Dem' WHEN pid7_baseline = 4 THEN 'Ind' WHEN pid7_baseline BETWEEN 5 AND 7 THEN 'Rep' END AS party3,
    CASE WHEN pid7_baseline <= 3 THEN 'Dem' WHEN pid7_baseline = 4 THEN 'Ind' WHEN pid7_baseline BETWEEN 5 AND 7 THEN 'Rep' ELSE 'None' END AS pid_collapsed,
    CASE WHEN pid7 <= 3 THEN 1 ELSE 0 END AS dem, CASE WHEN pid7 BETWEEN 5 AND 7 THEN 1 ELSE 0 END AS rep,
    CASE WHEN pid7_baseline <= 3 THEN 1 WHEN pid7_baseline = 4 THEN 4 WHEN pid7_baseline BETWEEN 5 AND 7 THEN 3 END AS party_score
    FROM wide"""
)
SQL["labelled_responses"] = survey(
    """SELECT 'metadata' AS source, question, CASE response WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' WHEN 3 THEN 'Not sure' END AS answer, count(*) AS n
    FROM long GROUP BY ALL
    UNION ALL
    SELECT 'join', question, CASE WHEN response = 3 THEN 'Not sure' WHEN question = 'q6' THEN CASE response WHEN 1 THEN 'Was justified' WHEN 2 THEN 'Was not justified' END
      WHEN response = 1 THEN 'Yes' WHEN response = 2 THEN 'No' END, count(*) FROM long GROUP BY ALL"""
)
SQL["ordered_levels"] = survey(
    """SELECT caseid, CASE supp WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 5 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5 END AS supp_rank,
    CASE supp WHEN 1 THEN 'Strongly support' WHEN 2 THEN 'Somewhat support' WHEN 5 THEN 'Not sure' WHEN 3 THEN 'Somewhat oppose' WHEN 4 THEN 'Strongly oppose' END AS supp_label,
    CAST(4 - saw AS INTEGER) AS saw_rank,
    CASE WHEN pid7_baseline <= 3 THEN 1 WHEN pid7_baseline BETWEEN 5 AND 7 THEN 2 WHEN pid7_baseline = 4 THEN 3 END AS party_rank,
    CASE WHEN pid3_baseline <= 2 THEN pid3_baseline END AS two_party
    FROM wide"""
)
SQL["question_order"] = survey(
    f"""SELECT question, {r6('m', 'mean_not_sure')}, n, CAST(row_number() OVER (ORDER BY m, question) AS INTEGER) AS position_up,
    CAST(row_number() OVER (ORDER BY -m, question) AS INTEGER) AS position_down,
    CAST(substr(question, 2) AS INTEGER) AS rank, CAST(9 - CAST(substr(question, 2) AS INTEGER) AS INTEGER) AS rank_reversed
    FROM (SELECT question, avg(not_sure) AS m, count(not_sure) AS n FROM obs GROUP BY question)"""
)
SQL["group_keys"] = survey("SELECT count(DISTINCT question) AS n_questions, min(question) AS first_question FROM long WHERE response IS NOT NULL")
SQL["reverse_coded"] = survey("SELECT question, response, stance, count(*) AS n FROM obs GROUP BY ALL")
SQL["cells"] = survey(
    f"""SELECT question, treat, pid7_baseline, saw, response, count(*) AS n, count(*) AS n_used, {r6('CAST(sum(weight) AS DOUBLE)', 'w')}
    FROM obs WHERE response IS NOT NULL GROUP BY question, treat, pid7_baseline, saw, response"""
)

# ---- descriptive effect tables ------------------------------------------------------------------------------------

SQL["pro_effect_wide"] = survey(
    f"""SELECT question, {', '.join(r6(f"max(CASE WHEN party = '{p}' AND treat = 1 THEN yes END) - max(CASE WHEN party = '{p}' AND treat = 0 THEN yes END)", p) for p in ('Dem', 'Rep'))}
    FROM shares GROUP BY question""",
    STANCE_SHARES,
)
SQL["shares_wide"] = survey(f"SELECT question, party, treat, {r6('yes', 'yes')}, {r6('no', 'no')}, {r6('not_sure', 'not_sure')} FROM shares", STANCE_SHARES)
SQL["did_party_ztest"] = ztest(False)
SQL["did_party_ztest_cov"] = ztest(True)
SQL["uncertainty_effect"] = survey(
    f"""SELECT question, party, {r6('c', 'control')}, {r6('t', 'treated')}, {r6('t - c', 'effect_not_sure')},
    {r6("CAST(substr(question, 2) AS INTEGER) + CASE WHEN party = 'Rep' THEN 0.1 ELSE -0.1 END::DOUBLE", 'y_position')},
    {r6('(c + t) / 2', 'midpoint')}, {r6('100 * round(t - c, 2)', 'effect_label')}
    FROM (SELECT question, party, max(CASE WHEN treat = 0 THEN not_sure END) AS c, max(CASE WHEN treat = 1 THEN not_sure END) AS t FROM shares GROUP BY ALL)""",
    STANCE_SHARES,
)
SQL["net_support"] = survey(
    f"""SELECT question, party, treat, {r6('yes', 'support')}, {r6('no', 'oppose')}, {r6('not_sure', 'not_sure')}, {r6('d1', 'difference_treatment')},
    {r6('d0', 'difference_control')}, {r6('d1 - d0', 'difference_effect')}
    FROM (SELECT *, max(CASE WHEN treat = 1 THEN yes - no END) OVER g AS d1, max(CASE WHEN treat = 0 THEN yes - no END) OVER g AS d0
          FROM shares WINDOW g AS (PARTITION BY question, party))""",
    STANCE_SHARES,
)
SQL["both_effects"] = survey(
    f"""SELECT question, party, effect_type, {r6('v', 'effect_value')}, CASE effect_type WHEN 'Uncertainty' THEN 1 ELSE 2 END AS effect_rank
    FROM (SELECT a.question, a.party, unnest(['Uncertainty', 'Direction']) AS effect_type,
          unnest([a.not_sure - b.not_sure, (a.yes - a.no) - (b.yes - b.no)]) AS v
          FROM shares a JOIN shares b ON a.question = b.question AND a.party = b.party AND a.treat = 1 AND b.treat = 0)""",
    STANCE_SHARES,
)
SQL["response_distribution"] = survey(
    f"""SELECT question, party, CASE response WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' ELSE 'Not sure' END AS response, n, {r6('w', 'w')},
    {r6('w / sum(w) OVER (PARTITION BY question, party)', 'share')}
    FROM (SELECT question, party, response, count(*) AS n, CAST(sum(weight) AS DOUBLE) AS w FROM obs
          WHERE treat = 1 AND party IS NOT NULL AND response IS NOT NULL GROUP BY ALL)"""
)
SQL["agree_by_pid7"] = agreement("true")
SQL["agree_by_pid7_treated"] = agreement("treat = 1")

GAPS = """
gaps AS (
  SELECT question, question_type, treat, avg(agree_all) FILTER (party = 'Dem') AS dem, avg(agree_all) FILTER (party = 'Rep') AS rep
  FROM obs GROUP BY ALL
)"""
SQL["party_gap_did"] = survey(
    f"""SELECT question, treat, {r6('dem', '"Dem"')}, {r6('rep', '"Rep"')}, {r6('rep - dem', 'diff')},
    round(max(CASE WHEN treat = 1 THEN rep - dem END) OVER (PARTITION BY question) - max(CASE WHEN treat = 0 THEN rep - dem END) OVER (PARTITION BY question), 6) + 0.0 AS diff_in_diff
    FROM gaps""",
    GAPS,
)
SQL["party_gap_treated"] = survey(
    f"""SELECT question, {r6('dem', '"Dem"')}, {r6('rep', '"Rep"')}, {r6('abs(rep - dem)', 'diff')}, question_type FROM gaps WHERE treat = 1""", GAPS
)
SQL["weighted_means"] = survey(
    f"""SELECT question, {r6('CAST(sum(weight) FILTER (treat = 0 AND response = 3) AS DOUBLE) / CAST(sum(weight) FILTER (treat = 0 AND response IS NOT NULL) AS DOUBLE)', 'control_mean')},
    {r6('CAST(sum(weight) FILTER (treat = 1 AND response = 3) AS DOUBLE) / CAST(sum(weight) FILTER (treat = 1 AND response IS NOT NULL) AS DOUBLE)', 'treatment_mean')}
    FROM obs GROUP BY question"""
)

# ---- tests and least squares --------------------------------------------------------------------------------------

SQL["certainty_welch"] = survey(
    f"""SELECT question, {WELCH_SELECT.format(m1='control_mean', m2='treatment_mean')}, CAST(n AS BIGINT) AS n,
    CASE WHEN question <= 'q5' THEN 'Factual' ELSE 'Policy' END AS question_type FROM welch""",
    "tests AS (SELECT question, treat + 1 AS g, not_sure AS y FROM obs)," + welch_cte("tests", "question"),
)
SQL["randomization_checks"] = randomization("long")
SQL["randomization_checks_respondent"] = randomization("wide")
SQL["certainty_ols"] = linear("not_sure", reference="t")
SQL["certainty_ols_ctrl"] = linear("not_sure", control="sawf", reference="t")
SQL["certainty_wls_ctrl"] = linear("not_sure", control="sawf", weight="weight", reference="t")
SQL["certainty_by_exposure"] = linear("not_sure", by="seen2")
SQL["certainty_by_exposure3"] = linear("not_sure", by="seen3")
SQL["certainty_by_exposure_w"] = linear("not_sure", by="seen2", weight="weight", control="pid3_baseline")
SQL["certainty_by_party"] = linear("not_sure", by="party3")
SQL["certainty_by_party_ctrl"] = linear("not_sure", by="party3", control="sawf")
SQL["certainty_by_party_w"] = linear("not_sure", by="party3", weight="weight", control="sawf")
SQL["did_party_ols"] = survey(
    result("fit", reference="t"),
    """
arm AS (
  SELECT question, party, treat, CAST(count(*) AS DOUBLE) AS m, avg(agree_all) AS y, var_pop(agree_all) * count(*) AS ss
  FROM obs WHERE party IS NOT NULL AND response IS NOT NULL GROUP BY ALL
),
fit AS (
  SELECT question, CAST(NULL AS VARCHAR) AS subgroup, 'rep:treat' AS term,
         sum(CASE WHEN (party = 'Rep') = (treat = 1) THEN y ELSE -y END) AS estimate,
         sqrt(sum(ss) / (sum(m) - 4) * sum(1 / m)) AS std_error, sum(m) - 4 AS df, sum(m) AS n, true AS converged
  FROM arm GROUP BY question
)""",
)

# ---- logit with closed forms --------------------------------------------------------------------------------------

SQL["direction_or"] = survey(
    result("fit", extra=("question_type",), exponentiate=True),
    """
tab AS (
  SELECT question, any_value(question_type) AS question_type, CAST(count(*) FILTER (treat = 1 AND response = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (treat = 1 AND response = 2) AS DOUBLE) AS b,
         CAST(count(*) FILTER (treat = 0 AND response = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (treat = 0 AND response = 2) AS DOUBLE) AS d
  FROM obs GROUP BY question
),
fit AS (
  SELECT question, question_type, CAST(NULL AS VARCHAR) AS subgroup, 'treat' AS term, ln(a * d / (b * c)) AS estimate,
         sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS std_error, a + b + c + d AS n, true AS converged
  FROM tab
)""",
)
SQL["certainty_logit_by_exposure"] = risk_difference("not_sure", "seen2")
SQL["certainty_logit_by_party"] = risk_difference("not_sure", "party3")
SQL["direction_by_exposure"] = risk_difference("agree_opinion", "seen2")
SQL["direction_by_exposure_or"] = risk_difference("agree_opinion", "seen2", "link")
SQL["direction_by_party"] = risk_difference("agree_opinion", "party3")
SQL["exposure_by_party_logit"] = survey(
    result("fit"),
    """
tab AS (
  SELECT party3 AS p, ln(avg(sawf) / (1 - avg(sawf))) AS lo, 1 / sum(sawf) + 1 / sum(1 - sawf) AS v, count(*) AS m
  FROM obs WHERE party3 IS NOT NULL GROUP BY party3
),
fit AS (
  SELECT '(all)' AS question, CAST(NULL AS VARCHAR) AS subgroup, CASE WHEN t.p = 'Dem' THEN '(Intercept)' ELSE 'party[' || t.p || ']' END AS term,
         CASE WHEN t.p = 'Dem' THEN t.lo ELSE t.lo - r.lo END AS estimate, sqrt(CASE WHEN t.p = 'Dem' THEN t.v ELSE t.v + r.v END) AS std_error,
         (SELECT sum(m) FROM tab) AS n, true AS converged
  FROM tab t JOIN tab r ON r.p = 'Dem'
)""",
)
SQL["nested_logit"] = survey(
    result("fit", keys=("question", "dichotomy", "term"), extra=("question_type",), width="1.96"),
    """
w AS (
  SELECT question, any_value(question_type) AS question_type,
         CAST(sum(weight) FILTER (treat = 1 AND response = 1) AS DOUBLE) AS y1, CAST(sum(weight) FILTER (treat = 1 AND response = 2) AS DOUBLE) AS n1,
         CAST(sum(weight) FILTER (treat = 1 AND response = 3) AS DOUBLE) AS u1, CAST(sum(weight) FILTER (treat = 0 AND response = 1) AS DOUBLE) AS y0,
         CAST(sum(weight) FILTER (treat = 0 AND response = 2) AS DOUBLE) AS n0, CAST(sum(weight) FILTER (treat = 0 AND response = 3) AS DOUBLE) AS u0,
         count(response) AS n, count(*) FILTER (response <> 3) AS n_dir
  FROM obs GROUP BY question
),
fit AS (
  SELECT question, question_type, 'certainty' AS dichotomy, 'treat' AS term, ln((y1 + n1) / u1) - ln((y0 + n0) / u0) AS estimate,
         sqrt(1 / (y1 + n1) + 1 / u1 + 1 / (y0 + n0) + 1 / u0) AS std_error, n, true AS converged FROM w
  UNION ALL
  SELECT question, question_type, 'direction', 'treat', ln(y1 / n1) - ln(y0 / n0), sqrt(1 / y1 + 1 / n1 + 1 / y0 + 1 / n0), n_dir, true FROM w
)""",
)

# ---- multinomial --------------------------------------------------------------------------------------------------

SQL["multinom_shares"] = survey(
    result("fit", keys=("question", "response", "term"), width="1.96", extra=(r6("p0", "prob_control"), r6("p1", "prob_treated"))),
    multinomial(("question",), "weight", False),
)
DF4_P = "(1 - (3.0 / 4) * abs(estimate / std_error) / sqrt(1 + pow(estimate / std_error, 2) / 4) * (1 - pow(estimate / std_error, 2) / 12 / (1 + pow(estimate / std_error, 2) / 4)))"
SQL["multinom_contrast"] = survey(
    result("labelled", keys=("question", "response", "term"), reference="t", width=str(T95_DF4), p=DF4_P),
    multinomial(("question",), "1", True),
    "labelled AS (SELECT * REPLACE (CASE response WHEN 1 THEN 'Yes' WHEN 2 THEN 'No' ELSE 'Not sure' END AS response) FROM fit)",
)
_GROUPS = multinomial(("question", "supp"), "weight", False)
SQL["failed_groups"] = survey(result("fit", keys=("question", "supp", "response", "term"), extra=("error",), width="1.96"), _GROUPS)
SQL["fitted_groups"] = survey(result("(SELECT * FROM fit WHERE converged)", keys=("question", "supp", "response", "term"), width="1.96"), _GROUPS)
