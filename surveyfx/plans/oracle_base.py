"""Pieces of the reference SQL: the survey view, distribution tails and the result table.

The SQL repeats the definitions from scratch and uses other numerical methods than the library (series and quadrature
instead of rational approximations and continued fractions), so agreement is evidence.
"""

from __future__ import annotations

QUESTIONS = [f"q{j}" for j in range(1, 9)]

SURVEY = f"""
people AS (
  SELECT o_orderkey AS caseid,
         CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 2 END AS treat_raw,
         CAST(c_nationkey % 8 + 1 AS INTEGER) AS pid7_baseline,
         CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END AS saw,
         CAST((5 + o_custkey % 11) / 10.0 AS DECIMAL(18,6)) AS weight,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS supp
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
),
coded AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_partkey % 17 = 0 THEN NULL
              WHEN treat_raw = 0 AND l_returnflag = 'R' AND l_suppkey % 5 = 0 THEN 1
              WHEN treat_raw = 0 AND l_returnflag = 'R' AND pid7_baseline BETWEEN 5 AND 7 AND l_suppkey % 5 = 1 THEN 2
              WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 WHEN l_returnflag = 'R' THEN 3 END AS code
  FROM lineitem JOIN people ON l_orderkey = caseid
),
answered AS (
  SELECT l_orderkey,
         {", ".join(f"CAST(min(CASE WHEN l_linenumber = {j} THEN code END) AS INTEGER) AS q{j}" for j in range(1, 8))}
  FROM coded GROUP BY l_orderkey
),
wide AS (
  SELECT caseid, pid7_baseline,
         CAST(CASE WHEN caseid % 13 = 0 THEN pid7_baseline % 8 + 1 ELSE pid7_baseline END AS INTEGER) AS pid7,
         CASE WHEN pid7_baseline <= 3 THEN 1 WHEN pid7_baseline BETWEEN 5 AND 7 THEN 2 WHEN pid7_baseline = 4 THEN 3
              WHEN pid7_baseline = 8 THEN 4 END AS pid3_baseline,
         saw, weight, supp, CAST(1 - treat_raw AS INTEGER) AS treat, {", ".join(QUESTIONS[:7])},
         CASE WHEN supp IN (1, 2) THEN 1 WHEN supp IN (3, 4) THEN 2 WHEN supp = 5 THEN 3 END AS q8
  FROM people LEFT JOIN answered ON l_orderkey = caseid
),
long AS (
  SELECT caseid, treat, pid7_baseline, pid7, pid3_baseline, saw, weight, supp,
         unnest([{", ".join(f"'{q}'" for q in QUESTIONS)}]) AS question, unnest([{", ".join(QUESTIONS)}]) AS response
  FROM wide WHERE treat IS NOT NULL
),
obs AS (
  SELECT *,
         CASE WHEN response = 3 THEN 1.0 WHEN response IN (1, 2) THEN 0.0 END AS not_sure,
         CASE WHEN response = 1 THEN 1.0 WHEN response IN (2, 3) THEN 0.0 END AS agree_all,
         CASE WHEN response = 1 THEN 1.0 WHEN response = 2 THEN 0.0 END AS agree_opinion,
         CASE WHEN pid7_baseline <= 3 THEN 'Dem' WHEN pid7_baseline BETWEEN 5 AND 7 THEN 'Rep' END AS party,
         CASE WHEN pid7_baseline <= 3 THEN 'Dem' WHEN pid7_baseline = 4 THEN 'Ind' WHEN pid7_baseline BETWEEN 5 AND 7 THEN 'Rep' END AS party3,
         CASE WHEN saw = 1 THEN 'Yes' ELSE 'No' END AS seen2,
         CASE saw WHEN 1 THEN 'Yes' WHEN 2 THEN 'Heard' ELSE 'No' END AS seen3,
         CASE WHEN saw = 1 THEN 1.0 ELSE 0.0 END AS sawf,
         CASE WHEN question IN ('q2', 'q7', 'q8') THEN CASE response WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 END ELSE response END AS stance,
         CASE WHEN question IN ('q1', 'q2', 'q3', 'q4', 'q5') THEN 'Factual' ELSE 'Policy' END AS question_type
  FROM long
)"""

Z95 = 1.959963984540054
T95_DF4 = 2.7764451051977987


def survey(body: str, *ctes: str) -> str:
    """Full statement: survey view, further CTEs, body."""
    return "WITH " + ",\n".join([SURVEY.strip(), *(c.strip() for c in ctes)]) + "\n" + body.strip()


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def normal_p(z: str) -> str:
    """Two-sided normal p-value from the power series of the normal integral."""
    a = f"greatest(abs({z}), 1e-300)"
    term = f"exp((2 * k + 1) * ln({a}) - (lgamma(2 * k + 2) - k * ln(2.0) - lgamma(k + 1)))"
    total = f"list_sum(list_transform(range(0, 160), lambda k: {term}))"
    return f"CASE WHEN abs({z}) > 8 THEN 0.0 ELSE 1 - sqrt(2 / pi()) * exp(-({z}) * ({z}) / 2) * {total} END"


def t_p(t: str, df: str) -> str:
    """Two-sided t p-value by Simpson's rule on the density."""
    h = f"(abs({t}) / 2000.0)"
    log_const = f"(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - 0.5 * ln({df} * pi()))"
    weight = "(CASE WHEN k = 0 OR k = 2000 THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    point = f"{weight} * exp({log_const} - ({df} + 1) / 2 * ln(1 + k * {h} * k * {h} / {df}))"
    return f"1 - 2 * {h} / 3 * list_sum(list_transform(range(0, 2001), lambda k: {point}))"


def t_q(df: str) -> str:
    """97.5% t quantile for large degrees of freedom (expansion in 1/df)."""
    z = Z95
    return (
        f"({z} + {(z**3 + z) / 4} / {df} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / ({df} * {df})"
        f" + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / ({df} * {df} * {df}))"
    )


def result(
    source: str,
    keys: tuple[str, ...] = ("question", "subgroup", "term"),
    extra: tuple[str, ...] = (),
    reference: str = "normal",
    width: str | None = None,
    p: str | None = None,
    exponentiate: bool = False,
) -> str:
    """SELECT that completes `source(keys, estimate, std_error, df, n, converged)` to a result table."""
    stat = "(estimate / std_error)"
    if reference == "t":
        p, width = p or t_p(stat, "df"), width or t_q("df")
        df = r6("df", "df")
    else:
        p, width, df = normal_p(stat), width or str(Z95), "CAST(NULL AS DOUBLE) AS df"
    tr = (lambda e: f"exp({e})") if exponentiate else (lambda e: f"({e})")
    cols = [
        *keys,
        r6(tr("estimate"), "estimate"),
        r6("std_error", "std_error"),
        r6(stat, "statistic"),
        df,
        r6(f"({p})", "p_value"),
        r6(tr(f"estimate - {width} * std_error"), "conf_low"),
        r6(tr(f"estimate + {width} * std_error"), "conf_high"),
        "CAST(n AS BIGINT) AS n",
        "converged",
        *extra,
    ]
    return f"SELECT {', '.join(cols)} FROM {source}"
