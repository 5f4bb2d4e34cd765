"""Closed forms for designs with one parameter per covariate cell.

When a model has as many parameters as covariate cells, its fitted values are the cell means, so estimates and
standard errors follow from cell totals by arithmetic. These operators stay in the JVM: one partially aggregated
shuffle of cell totals, then windows over a handful of rows per question.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyfx.functions.recode import cases, member, ratio
from surveyfx.operators.cells import cell_totals, moments, row_count, row_weight
from surveyfx.operators.inference import with_inference
from surveyfx.operators.reshape import gather, picked


# ---- linear -------------------------------------------------------------------------------------------------------

def _linear_arms(
    rows: DataFrame, outcome: str, treat: str, question: str, by: str | None, weight: str | None, control: str | None, coded: bool = False
) -> DataFrame:
    """Adjusted mean pieces per arm, with the question's residual variance and degrees of freedom on every row."""
    keys = [question, *([by] if by else []), treat]
    arms = moments(rows, keys, outcome, weight, control, coded).where(F.col("w") > 0)
    if not control:
        arms = arms.withColumns({k: F.lit(0.0) for k in ("smean", "css", "csy")})
    q = Window.partitionBy(question)
    total = {f"t{c}": F.sum(c).over(q) for c in ("cyy", "css", "csy", "n")}
    out = arms.withColumns({**total, "k": F.count(F.lit(1)).over(q)})
    # a control that never varies inside a cell is dropped, as a rank-deficient fit would
    rank = F.when(F.col("tcss") > 0, 1).otherwise(0)
    slope = F.when(F.col("tcss") > 0, F.col("tcsy") / F.col("tcss")).otherwise(0.0)
    out = out.withColumns({"slope": slope, "df": (F.col("tn") - F.col("k") - rank).cast("double")})
    return out.withColumn("s2", F.when(F.col("df") > 0, (F.col("tcyy") - F.col("slope") * F.col("tcsy")) / F.col("df")))


def _question_level() -> list[Column]:
    return [F.max(c).alias(c) for c in ("slope", "s2", "df", "tcss", "tn")]


def linear_effects(
    rows: DataFrame,
    outcome: str,
    treat: str = "treat",
    by: str | None = None,
    weight: str | None = None,
    control: str | None = None,
    reference: str = "normal",
    level: float = 0.95,
    question: str = "question",
    coded: bool = False,
    arm_means: bool = False,
) -> DataFrame:
    """Treatment effect of a least-squares fit of outcome on treat (× by) (+ one numeric control), per subgroup.

    The control is partialled out within the cells, which gives exactly the coefficients of the joint fit. `coded` says
    that outcome and control have a few values each, so that one pass is enough for a weighted fit as well. `arm_means` adds
    the outcome's (weighted) means in both arms.
    """
    arms = _linear_arms(rows, outcome, treat, question, by, weight, control, coded)
    keys = [question, *([by] if by else [])]
    on, off = F.col(treat) == 1, F.col(treat) == 0
    wide = arms.groupBy(*keys).agg(
        *(picked(F.col(c), cond).alias(f"{c}{a}") for a, cond in (("1", on), ("0", off)) for c in ("mean", "smean", "w")),
        *_question_level(),
    )
    ds = F.col("smean1") - F.col("smean0")
    shift = F.coalesce(F.try_divide(ds * ds, F.col("tcss")), F.lit(0.0))
    fits = wide.select(
        question,
        (F.col(by).cast("string") if by else F.lit(None).cast("string")).alias("subgroup"),
        F.lit(treat).alias("term"),
        (F.col("mean1") - F.col("mean0") - F.col("slope") * ds).alias("estimate"),
        F.sqrt(F.col("s2") * (1 / F.col("w1") + 1 / F.col("w0") + shift)).alias("std_error"),
        "df",
        F.col("tn").alias("n"),
        F.col("mean0").alias("control_mean"),
        F.col("mean1").alias("treatment_mean"),
    ).withColumn("converged", F.col("estimate").isNotNull() & F.col("std_error").isNotNull())
    return with_inference(fits, [question, "subgroup", "term"], reference, level, extra=("control_mean", "treatment_mean") if arm_means else ())


def linear_did(
    rows: DataFrame,
    outcome: str,
    group_flag: str,
    treat: str = "treat",
    weight: str | None = None,
    level: float = 0.95,
    question: str = "question",
) -> DataFrame:
    """Interaction term of a least-squares fit of outcome on group_flag × treat (both 0/1), with a t interval."""
    arms = _linear_arms(rows, outcome, treat, question, group_flag, weight, None)
    sign = F.when(F.col(group_flag) == F.col(treat), 1.0).otherwise(-1.0)
    wide = arms.groupBy(question).agg(
        F.sum(sign * F.col("mean")).alias("estimate"), F.sum(1 / F.col("w")).alias("inv"), F.count(F.lit(1)).alias("cells"), *_question_level()
    )
    full = F.col("cells") == 4
    fits = wide.select(
        question,
        F.lit(None).cast("string").alias("subgroup"),
        F.lit(f"{group_flag}:{treat}").alias("term"),
        F.when(full, F.col("estimate")).alias("estimate"),
        F.when(full, F.sqrt(F.col("s2") * F.col("inv"))).alias("std_error"),
        "df",
        F.col("tn").alias("n"),
        (full & (F.col("df") > 0)).alias("converged"),
    )
    return with_inference(fits, [question, "subgroup", "term"], "t", level)


# ---- binary logit -------------------------------------------------------------------------------------------------

def _logit_from_cells(cells: DataFrame, by: Sequence[str], factor: str, outcome: str, levels: Sequence) -> DataFrame:
    """Coefficients of outcome ~ factor from weighted 2 × L tables; `levels[0]` is the reference."""
    one, zero = F.col(outcome) == 1, F.col(outcome) == 0
    arms = cells.where(F.col(factor).isin(*levels)).groupBy(*by, factor).agg(
        F.sum(F.when(one, F.col("w"))).alias("a"), F.sum(F.when(zero, F.col("w"))).alias("b"), F.sum("n").alias("n")
    )
    ref, group = F.col(factor) == levels[0], Window.partitionBy(*by)
    known = (F.col("a") > 0) & (F.col("b") > 0)
    arms = arms.withColumns(
        {
            "logit": F.when(known, F.ln(F.col("a") / F.col("b"))),
            "v": F.when(known, 1 / F.col("a") + 1 / F.col("b")),
        }
    ).withColumns(
        {
            "logit0": F.max(F.when(ref, F.col("logit"))).over(group),
            "v0": F.max(F.when(ref, F.col("v"))).over(group),
            "total": F.sum("n").over(group),
        }
    )
    binary = tuple(levels) == (0, 1)
    names = {lv: factor if binary else f"{factor}[{lv}]" for lv in levels[1:]}
    term = cases([(ref, "(Intercept)"), *((F.col(factor) == lv, name) for lv, name in names.items())])
    return arms.select(
        *by,
        F.lit(None).cast("string").alias("subgroup"),
        term.alias("term"),
        F.when(ref, F.col("logit")).otherwise(F.col("logit") - F.col("logit0")).alias("estimate"),
        F.sqrt(F.when(ref, F.col("v")).otherwise(F.col("v") + F.col("v0"))).alias("std_error"),
        F.col("total").alias("n"),
    ).withColumn("converged", F.col("estimate").isNotNull())


def saturated_logit(
    rows: DataFrame,
    outcome: str,
    factor: str,
    levels: Sequence = (0, 1),
    weight: str | None = None,
    by: Sequence[str] = ("question",),
    exponentiate: bool = False,
    level: float = 0.95,
) -> DataFrame:
    """Logistic fit of a 0/1 outcome on one factor: intercept and one log-odds difference per further level."""
    cells = cell_totals(rows, [*by, factor, outcome], weight)
    fits = _logit_from_cells(cells, list(by), factor, outcome, levels)
    return with_inference(fits, [*by, "subgroup", "term"], "normal", level, exponentiate=exponentiate)


def logit_contrasts(
    rows: DataFrame,
    outcome: str,
    by: str,
    treat: str = "treat",
    weight: str | None = None,
    scale: str = "response",
    exponentiate: bool = False,
    level: float = 0.95,
    question: str = "question",
) -> DataFrame:
    """Treatment contrast in each subgroup of a logistic fit of outcome on treat × by.

    `scale="response"` contrasts probabilities (delta-method error), `scale="link"` log odds.
    """
    cells = cell_totals(rows, [question, by, treat, outcome], weight)
    arms = cells.groupBy(question, by, treat).agg(
        F.sum("w").alias("w"), F.sum(F.when(F.col(outcome) == 1, F.col("w")).otherwise(0.0)).alias("a"), F.sum("n").alias("n")
    )
    p = F.col("a") / F.col("w")
    inner = (F.col("a") > 0) & (F.col("a") < F.col("w"))
    if scale == "response":
        value, var = p, p * (1 - p) / F.col("w")
    elif scale == "link":
        value = F.when(inner, F.ln(F.col("a") / (F.col("w") - F.col("a"))))
        var = F.when(inner, 1 / F.col("a") + 1 / (F.col("w") - F.col("a")))
    else:
        raise ValueError(f"unknown scale {scale!r}")
    arms = arms.where(F.col("w") > 0).select(
        question, by, treat, value.alias("value"), var.alias("var"), inner.alias("inner"),
        F.sum("n").over(Window.partitionBy(question)).alias("n"),
    )
    on, off = F.col(treat) == 1, F.col(treat) == 0
    fits = arms.groupBy(question, by).agg(
        (picked(F.col("value"), on) - picked(F.col("value"), off)).alias("estimate"),
        F.sqrt(picked(F.col("var"), on) + picked(F.col("var"), off)).alias("std_error"),
        F.max("n").alias("n"),
        (F.every("inner") & (F.count(F.lit(1)) == 2)).alias("converged"),
    ).select(question, F.col(by).cast("string").alias("subgroup"), F.lit(treat).alias("term"), "estimate", "std_error", "n", "converged")
    return with_inference(fits, [question, "subgroup", "term"], "normal", level, exponentiate=exponentiate)


def nested_logit(
    rows: DataFrame,
    response: str,
    dichotomies: Mapping[str, tuple[Sequence, Sequence]],
    treat: str = "treat",
    weight: str | None = None,
    multiplier: float | None = 1.96,
    question: str = "question",
) -> DataFrame:
    """Nested dichotomies ``{name: (codes counted 0, codes counted 1)}``, each a logistic fit on treat.

    The answers are scanned once: the response cells are small, and every dichotomy regroups them.
    """
    cells = cell_totals(rows, [question, treat, response], weight)
    sides = {
        name: cases([(member(response, zero), 0), (member(response, one), 1)]) for name, (zero, one) in dichotomies.items()
    }
    tall = gather(cells.withColumns(sides), [question, treat, "n", "w"], list(dichotomies), "dichotomy", "side").dropna(subset=["side"])
    fits = _logit_from_cells(tall, [question, "dichotomy"], treat, "side", (0, 1))
    return with_inference(fits, [question, "dichotomy", "subgroup", "term"], "normal", multiplier=multiplier)


# ---- multinomial --------------------------------------------------------------------------------------------------

def multinomial_effects(
    rows: DataFrame,
    response: str,
    treat: str = "treat",
    weight: str | None = None,
    by: Sequence[str] = ("question",),
    errors: str = "arm_size",
    drop_failed: bool = False,
    level: float = 0.95,
) -> DataFrame:
    """Change in the probability of each response class between the arms of a multinomial fit on treat.

    The fitted probabilities are the (weighted) class shares of an arm. `errors="arm_size"` divides the binomial
    variance by the arm's row count, rows with a missing response included, and uses ±1.96 standard errors.
    `errors="model"` uses the model's own covariance (arm weight) and a t interval on its number of parameters.
    The predicted probabilities of both arms come along. Groups that cannot be fitted (one response class, one arm) keep a row with `converged` false and the reason in
    `error`, unless `drop_failed`.
    """
    kept = rows.dropna(subset=[*by, treat])
    w = F.sum(row_weight(rows, weight)).cast("double")
    cells = kept.groupBy(*by, treat, response).agg(row_count(rows).alias("n"), w.alias("w"))
    answered = F.col(response).isNotNull()
    arm, group = Window.partitionBy(*by, treat), Window.partitionBy(*by)
    on, off = F.col(treat) == 1, F.col(treat) == 0
    cells = cells.withColumns(
        {
            "share": ratio(F.when(answered, F.col("w")), F.sum(F.when(answered, F.col("w"))).over(arm)),
            **{f"rows{a}": F.sum(F.when(c, F.col("n"))).over(group) for a, c in (("1", on), ("0", off))},
            **{f"w{a}": F.sum(F.when(c & answered, F.col("w"))).over(group) for a, c in (("1", on), ("0", off))},
            "total": F.sum(F.when(answered, F.col("n"))).over(group),
        }
    )
    level_cols = ("rows1", "rows0", "w1", "w0", "total")
    wide = cells.where(answered).groupBy(*by, response).agg(
        F.coalesce(picked(F.col("share"), on), F.lit(0.0)).alias("p1"),
        F.coalesce(picked(F.col("share"), off), F.lit(0.0)).alias("p0"),
        *(F.max(c).alias(c) for c in level_cols),
    ).withColumn("classes", F.count(F.lit(1)).over(group))
    if errors == "arm_size":
        d1, d0, reference, multiplier = "rows1", "rows0", "normal", 1.96
    elif errors == "model":
        d1, d0, reference, multiplier = "w1", "w0", "t", None
    else:
        raise ValueError(f"unknown errors {errors!r}")
    error = cases(
        [
            (F.col("classes") < 2, "needs at least two response classes"),
            (F.col("w1").isNull() | F.col("w0").isNull(), "needs answers in both arms"),
        ]
    )
    p1, p0 = F.col("p1"), F.col("p0")
    se = F.sqrt(ratio(p1 * (1 - p1), F.col(d1)) + ratio(p0 * (1 - p0), F.col(d0)))
    fits = wide.withColumn("error", error).select(
        *by, response,
        F.lit(treat).alias("term"),
        F.when(F.col("error").isNull(), p1 - p0).alias("estimate"),
        F.when(F.col("error").isNull(), se).alias("std_error"),
        (2.0 * (F.col("classes") - 1)).alias("df"),
        F.col("total").alias("n"),
        F.col("error").isNull().alias("converged"),
        "error",
        *(F.when(F.col("error").isNull(), p).alias(name) for p, name in ((p0, "prob_control"), (p1, "prob_treated"))),
    )
    extra = ("error", "prob_control", "prob_treated")
    out = with_inference(fits, [*by, response, "term"], reference, level, multiplier, extra=extra)
    return out.where("converged") if drop_failed else out
