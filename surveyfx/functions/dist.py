"""Normal and Student-t tails as Column expressions.

Spark has no error function and no t distribution, and a result table should not start a Python worker just to get
p-values, so both are written as SQL expressions over built-in functions (one text per function keeps the driver-side cost of
building them low; `_let` names an intermediate value once instead of repeating its expression tree):

* normal tail: rational approximations of erfc (W. J. Cody, Math. Comp. 23, 1969);
* t tail, more than 200 degrees of freedom: G. W. Hill's normal transformation (CACM Algorithm 395, 1970);
* t tail, up to 200: continued fraction of the incomplete beta integral, folded over a fixed sequence;
* t quantile: Cornish-Fisher expansion above 200 degrees of freedom, Newton steps on the tail below.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGE_DF = 200.0
#: Newton steps of the t quantile; a quantile that has not settled by then is null.
T_STEPS = 12

# Cody's coefficients, highest power first.
ERF_NUM = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DEN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
MID_NUM = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
MID_DEN = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
FAR_NUM = (
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1,
    1.60837851487422766e-2, 6.58749161529837803e-4,
)
FAR_DEN = (
    1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2,
    2.33520497626869185e-3,
)


def _poly(coefs: Sequence[float], x: str) -> str:
    out = f"{coefs[0]!r}D"
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _normal_p(z: str) -> str:
    inv = "(1.0D / (a * a))"
    near = f"1.0D - a * {_poly(ERF_NUM, '(a * a)')} / {_poly(ERF_DEN, '(a * a)')}"
    mid = f"exp(-a * a) * {_poly(MID_NUM, 'a')} / {_poly(MID_DEN, 'a')}"
    far = f"exp(-a * a) / a * ({1 / math.sqrt(math.pi)!r}D - {inv} * {_poly(FAR_NUM, inv)} / {_poly(FAR_DEN, inv)})"
    body = f"CASE WHEN a <= 0.46875D THEN {near} WHEN a <= 4.0D THEN {mid} ELSE {far} END"
    return _let("a", f"abs({z}) / {math.sqrt(2.0)!r}D", body)


def _log_gamma_half_step(a: str) -> str:
    """ln Γ(a + 1/2) − ln Γ(a): asymptotic series at a + 10, brought back by the recurrence."""
    i2 = "(1.0D / (s * s))"
    series = f"ln(s) / 2 + {_poly((17 / 14336, -1 / 640, 1 / 192, -1 / 8), i2)} / s"
    down = " + ".join(f"log1p(0.5D / (s - {10 - k}))" for k in range(10))
    return _let("s", f"{a} + 10.0D", f"{series} - ({down})")


def _beta_fraction(x: str, a: str, b: str, steps: int = 100) -> str:
    """Continued fraction of the incomplete beta integral (modified Lentz), one partial numerator per element."""
    even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    numerator = _let("m", "CAST(k DIV 2 AS DOUBLE)", f"IF(k % 2 = 0, {even}, {odd})")
    step = _let(
        "u",
        numerator,
        "named_struct('c', 1 + u / acc.c, 'd', 1 / (1 + u * acc.d), 'h', acc.h * (1 + u / acc.c) / (1 + u * acc.d))",
    )
    start = "named_struct('c', 1.0D, 'd', 0.0D, 'h', 1.0D)"
    return f"aggregate(sequence(1, {steps}), {start}, (acc, k) -> {step}, acc -> 1.0D / acc.h)"


def _t_p_small(t: str, df: str) -> str:
    a = f"({df} / 2)"
    front = f"exp({a} * ln(x) + {_log_gamma_half_step(a)}) * sqrt(1 - x) * {1 / math.sqrt(math.pi)!r}D"
    direct = f"{front} / {a} * {_beta_fraction('x', a, '0.5D')}"
    mirrored = f"1.0D - {front} / 0.5D * {_beta_fraction('(1 - x)', '0.5D', a)}"
    return _let(
        "x",
        f"{df} / ({df} + {t} * {t})",
        f"CASE WHEN x = 1 THEN 1.0D WHEN x < ({a} + 1) / ({a} + 2.5D) THEN {direct} ELSE {mirrored} END",
    )


def _t_p_large(t: str, df: str) -> str:
    a = f"({df} - 0.5D)"
    b = f"(48 * {a} * {a})"
    inner = f"{_poly((-0.4, -3.3, -24.0, -85.5), 'y')} / (0.8D * y * y + 100 + {b})"
    return _normal_p(_let("y", f"{a} * log1p({t} * {t} / {df})", f"(({inner} + y + 3) / {b} + 1) * sqrt(y)"))


def _t_quantile_small(z: float, level: float, df: str) -> str:
    density = f"exp({_log_gamma_half_step(f'{df} / 2')} - ln({df} * {math.pi!r}D) / 2 - ({df} + 1) / 2 * log1p(q * q / {df}))"
    # ln p is concave and falling in ln q: Newton steps on these scales settle from above, also in heavy tails
    alpha = repr(1 - level)
    step = f"q * exp(ln({_t_p_small('q', df)} / {alpha}D) * {_t_p_small('q', df)} / (2 * {density} * q))"
    found = f"aggregate(sequence(1, {T_STEPS}), {z!r}D, (q, i) -> {step})"
    return _let("q", found, f"CASE WHEN abs({_t_p_small('q', df)} / {alpha}D - 1) < 1e-7D THEN q END")


def normal_p(z: str) -> Column:
    """Two-sided normal p-value of the column (or SQL text) `z`."""
    return F.expr(_normal_p(z))


def normal_quantile(level: float) -> float:
    """Half-width multiplier of a central interval, e.g. 1.95996 for 0.95."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def t_p(t: str, df: str) -> Column:
    """Two-sided Student-t p-value; `df` may be fractional."""
    return F.expr(f"CASE WHEN {df} > {LARGE_DF}D THEN {_t_p_large(t, df)} WHEN {df} > 0 THEN {_t_p_small(t, df)} END")


def t_quantile(level: float, df: str) -> Column:
    """Half-width multiplier of a central t interval."""
    z = normal_quantile(level)
    terms = (
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (z**3 + z) / 4,
        z,
    )
    large, small = _poly(terms, f"(1.0D / {df})"), _t_quantile_small(z, level, df)
    return F.expr(f"CASE WHEN {df} > {LARGE_DF}D THEN {large} WHEN {df} > 0 THEN {small} END")
