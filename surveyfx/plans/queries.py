"""Registered queries: each reads the sample tables under `sf_dir` and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyfx.functions.recode import (
    cases, collapse, flag, flag_in, indicator, known_level, level_rank, recode, relabel, strip_suffix, swap_codes,
)
from surveyfx.operators import cells, descriptive, reshape, saturated, ttest
from surveyfx.operators.fit import AverageSlope, Coefficients, Contrast, Model, Probabilities, fit, fit_many
from surveyfx.operators.fold import fold_by
from surveyfx.operators.linear import fit_linear
from surveyfx.operators.inference import RESULT_COLUMNS, flip_sign, with_inference
from surveyfx.operators.report import effect_table, write_table
from surveyfx.operators.spec import ModelSpec, crossed
from surveyfx.plans.survey_view import CODEBOOK, PARTY, PARTY3, YES_NO, survey_long, survey_wide
from surveyfx.sources.codebook import audit_codes, codebook_from_metadata, decode_labelled, join_value_labels
from surveyfx.sources.longform import read_long, write_long
from surveyfx.sources.scratch import shared_folder
from surveyfx.sources.snapshot import read_snapshot, write_snapshot

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
NAMES = {"wide_table": "survey_wide", "long_table": "survey_long", "cell_table": "cells"}

PARTIES = ("Dem", "Rep")
SWAP = {1: 2, 2: 1, 3: 3}
STANCES = {1: "yes", 2: "no", 3: "not_sure"}
FIVE_POINT = {1: "Strongly support", 2: "Somewhat support", 5: "Not sure", 3: "Somewhat oppose", 4: "Strongly oppose"}


def query(fn: Query) -> Query:
    REGISTRY[NAMES.get(fn.__name__, fn.__name__)] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating columns and drop the sign of zero, so that two engines can be compared by value."""
    return df.selectExpr(
        *(f"round(`{name}`, {digits}) + 0.0D AS `{name}`" if kind == "double" else f"`{name}`" for name, kind in df.dtypes)
    )


def result(df: DataFrame, *extra: str, keys: Sequence[str] = ("question", "subgroup", "term")) -> DataFrame:
    return rounded(df.select(*keys, *RESULT_COLUMNS, *extra))


# ---- analysis columns ---------------------------------------------------------------------------------------------

def not_sure() -> Column:
    return indicator("response", 3)


def agree_all() -> Column:
    """1 for yes, 0 for every other known answer."""
    return flag(F.col("response") == 1).cast("double")


def agree_opinion() -> Column:
    """1 for yes, 0 for no, null for "not sure"."""
    return F.when(F.col("response") != 3, indicator("response", 1))


def saw_yes_no() -> Column:
    return recode("saw", {"Yes": (1,), "No": (2, 3)})


def saw_levels() -> Column:
    return recode("saw", {"Yes": (1,), "Heard": (2,), "No": (3,)})


def saw_flag() -> Column:
    return indicator("saw", 1)


def stance() -> Column:
    """Answer in the pro direction: reverse-coded questions swapped."""
    return swap_codes("question", "response", CODEBOOK.reversed_names, SWAP)


def question_type() -> Column:
    return CODEBOOK.kind("question", "Factual", "Policy")


def party() -> Column:
    return recode("pid7_baseline", PARTY)


def party3() -> Column:
    return recode("pid7_baseline", PARTY3)


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey_long(spark, sf_dir).select("question", "treat", party().alias("party"), stance().alias("stance"))


def stance_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stances(spark, sf_dir).where(F.col("party").isin(*PARTIES))
    return descriptive.shares_wide(rows, ["question", "party", "treat"], "stance", STANCES)


# ---- sources, recodes, reshaping ----------------------------------------------------------------------------------

@query
def wide_table(spark, sf_dir):
    return rounded(survey_wide(spark, sf_dir).withColumn("weight", F.col("weight").cast("double")))


@query
def long_table(spark, sf_dir):
    long = survey_long(spark, sf_dir)
    return rounded(long.select("caseid", "treat", "pid7_baseline", "pid7", "pid3_baseline", "saw", F.col("weight").cast("double").alias("weight"), "supp", "question", "response"))


@query
def codebook(spark, sf_dir):
    """Labels read back from the wide table's metadata, with how often each code was answered."""
    wide = survey_wide(spark, sf_dir)
    used = survey_long(spark, sf_dir).where(F.col("response").isNotNull()).groupBy("question", "response").agg(F.count(F.lit(1)).alias("n"))
    labels = codebook_from_metadata(wide)
    return labels.join(used, (labels.var_name == used.question) & (labels.code == used.response), "left").select(
        "var_name", "label", "code", "value_label", F.coalesce("n", F.lit(0)).alias("n"),
        CODEBOOK.rank("var_name").alias("question_rank"),
        CODEBOOK.kind("var_name", "Factual", "Policy").alias("question_type"),
        F.col("var_name").isin(*CODEBOOK.reversed_names).alias("reverse_coded"),
    )


@query
def outcomes(spark, sf_dir):
    long = survey_long(spark, sf_dir)
    return long.select(
        "caseid", "question", not_sure().alias("not_sure"), agree_all().alias("agree_all"),
        agree_opinion().alias("agree_opinion"), saw_flag().alias("saw_flag"),
    )


@query
def recode_party(spark, sf_dir):
    wide = survey_wide(spark, sf_dir)
    labels = {1: "Strong Dem", 2: "Weak Dem", 3: "Lean Dem", 4: "Independent", 5: "Lean Rep", 6: "Weak Rep", 7: "Strong Rep", 8: "None"}
    text = cases(((F.col("pid7_baseline") == code, label) for code, label in labels.items()))
    wide = wide.withColumn("pid_label", text)
    return wide.select(
        "caseid", "pid_label",
        party().alias("party"), party3().alias("party3"),
        collapse("pid_label", {"Dem": ("Strong Dem", "Weak Dem", "Lean Dem"), "Rep": ("Lean Rep", "Weak Rep", "Strong Rep"), "Ind": ("Independent",)}).alias("pid_collapsed"),
        flag_in("pid7", (1, 2, 3)).alias("dem"), flag_in("pid7", (5, 6, 7)).alias("rep"),
        recode("pid7_baseline", {1: (1, 2, 3), 4: (4,), 3: (5, 6, 7)}).alias("party_score"),
    )


@query
def labelled_responses(spark, sf_dir):
    """Codes to labels twice: through column metadata on the wide table, and through a codebook join on the long one."""
    wide = survey_wide(spark, sf_dir)
    names = CODEBOOK.names
    # the codes travel beside their decoded labels
    both = decode_labelled(wide.select("*", *(F.col(q).alias(f"{q}_code", metadata={}) for q in names))).where(F.col("treat").isNotNull())
    short = {"Was justified": "Yes", "Was not justified": "No"}
    pairs = [F.struct(F.lit(q).alias("question"), F.col(f"{q}_code").alias("response"), relabel(q, short).alias("decoded")) for q in names]
    tall = both.select(F.explode(F.array(*pairs)).alias("a")).select("a.*")
    # the answers are counted once, and both ways of labelling name the counts
    counts = tall.groupBy("question", "response", "decoded").agg(F.count(F.lit(1)).alias("n"))
    named = join_value_labels(counts, codebook_from_metadata(wide))
    ways = F.array(F.struct(F.lit("metadata").alias("source"), F.col("decoded").alias("answer")), F.struct(F.lit("join").alias("source"), F.col("value_label").alias("answer")))
    return named.select("question", "n", F.explode(ways).alias("way")).groupBy("way.source", "question", "way.answer").agg(F.sum("n").alias("n"))


@query
def ordered_levels(spark, sf_dir):
    """Level order, relabelling and reference levels."""
    wide = survey_wide(spark, sf_dir)
    order = tuple(FIVE_POINT)
    return wide.select(
        "caseid",
        level_rank("supp", order).alias("supp_rank"),
        recode("supp", {label: (code,) for code, label in FIVE_POINT.items()}).alias("supp_label"),
        level_rank(saw_levels(), ("No", "Heard", "Yes")).alias("saw_rank"),
        level_rank(party3(), ("Dem", "Rep", "Ind")).alias("party_rank"),
        known_level("pid3_baseline", (1, 2)).alias("two_party"),
    )


@query
def question_order(spark, sf_dir):
    """Question order three ways: reversed codebook order, mean uncertainty, and its negative."""
    rows = survey_long(spark, sf_dir).select("question", not_sure().alias("not_sure"))
    means = rows.groupBy("question").agg(F.avg("not_sure").alias("mean_not_sure"), F.count("not_sure").alias("n"))
    mean = F.col("mean_not_sure")
    both = means.withColumns({"position_up": reshape.position(mean, "question"), "position_down": reshape.position(-mean, "question")})
    return rounded(both.select(
        "question", "mean_not_sure", "n", "position_up", "position_down",
        CODEBOOK.rank("question").alias("rank"), CODEBOOK.rank("question", descending=True).alias("rank_reversed"),
    ))


@query
def group_keys(spark, sf_dir):
    """Distinct questions with answers, their number, and the first in display order."""
    answered = survey_long(spark, sf_dir).where(F.col("response").isNotNull())
    keys = answered.select("question").distinct().select(CODEBOOK.rank().alias("rank"), "question")
    return keys.agg(F.countDistinct("question").alias("n_questions"), F.min_by("question", "rank").alias("first_question"))


@query
def reverse_coded(spark, sf_dir):
    long = survey_long(spark, sf_dir)
    return long.select("question", "response", stance().alias("stance")).groupBy("question", "response", "stance").agg(F.count(F.lit(1)).alias("n"))


@query
def cell_table(spark, sf_dir):
    long = survey_long(spark, sf_dir)
    return rounded(cells.cell_totals(long, ["question", "treat", "pid7_baseline", "saw", "response"], "weight"))


# ---- descriptive effect tables ------------------------------------------------------------------------------------

@query
def pro_effect_wide(spark, sf_dir):
    rows = stances(spark, sf_dir).withColumn("party", F.coalesce("party", F.lit("Other")))
    return rounded(descriptive.pro_share_effect(rows, "party", "treat", "stance", PARTIES))


@query
def shares_wide(spark, sf_dir):
    return rounded(stance_shares(spark, sf_dir))


@query
def did_party_ztest(spark, sf_dir):
    rows = stances(spark, sf_dir).where(F.col("party").isin(*PARTIES))
    return rounded(descriptive.net_support_ztest(rows, ["question", "party"], "treat", "stance"))


@query
def did_party_ztest_cov(spark, sf_dir):
    """Same test, counting the covariance of the yes and no shares of one arm."""
    rows = stances(spark, sf_dir).where(F.col("party").isin(*PARTIES))
    return rounded(descriptive.net_support_ztest(rows, ["question", "party"], "treat", "stance", covariance=True))


@query
def uncertainty_effect(spark, sf_dir):
    shares = stance_shares(spark, sf_dir)
    return rounded(descriptive.uncertainty_effect(shares, "party", "treat", "not_sure", CODEBOOK.rank(), "Rep"))


@query
def net_support(spark, sf_dir):
    shares = reshape.rename(stance_shares(spark, sf_dir), {"yes": "support", "no": "oppose"})
    return rounded(descriptive.net_support(shares, "party", "treat", "support", "oppose"))


@query
def both_effects(spark, sf_dir):
    effects = descriptive.both_effects(stance_shares(spark, sf_dir), "party", "treat", "yes", "no", "not_sure")
    return rounded(effects.withColumn("effect_rank", level_rank("effect_type", ("Uncertainty", "Direction"))))


@query
def response_distribution(spark, sf_dir):
    rows = survey_long(spark, sf_dir).where(F.col("treat") == 1).withColumn("party", party())
    out = descriptive.response_distribution(rows, ["question", "party"], "response", "weight")
    label = recode("response", {text: (code,) for code, text in YES_NO.items()})
    return rounded(out.select("question", "party", label.alias("response"), "n", "w", "share"))


def _agreement(long: DataFrame) -> DataFrame:
    rows = long.where(F.col("pid7_baseline") != 8).select(
        "question", "pid7_baseline", cases([(F.col("treat") == 1, "Treatment")], "Control").alias("arm"), agree_all().alias("agree")
    )
    return descriptive.spread_of_means(rows, "pid7_baseline", ["question", "arm"], "agree", low=1, high=7)


@query
def agree_by_pid7(spark, sf_dir):
    return rounded(_agreement(survey_long(spark, sf_dir)))


@query
def agree_by_pid7_treated(spark, sf_dir):
    return rounded(_agreement(survey_long(spark, sf_dir).where(F.col("treat") == 1)))


@query
def party_gap_did(spark, sf_dir):
    rows = survey_long(spark, sf_dir).select("question", "treat", party().alias("party"), agree_all().alias("agree"))
    return rounded(descriptive.party_gap_did(rows, "party", "treat", "agree"))


@query
def party_gap_treated(spark, sf_dir):
    rows = survey_long(spark, sf_dir).where(F.col("treat") == 1).select("question", party().alias("party"), agree_all().alias("agree"))
    gaps = descriptive.party_gap(rows, "party", ["question"], "agree")
    return rounded(gaps.select("question", "Dem", "Rep", F.abs("diff").alias("diff"), question_type().alias("question_type")))


@query
def weighted_means(spark, sf_dir):
    rows = survey_long(spark, sf_dir).withColumn("not_sure", not_sure())
    return rounded(descriptive.weighted_arm_means(rows, "treat", "not_sure", "weight"))


# ---- tests and least squares --------------------------------------------------------------------------------------

@query
def certainty_welch(spark, sf_dir):
    rows = survey_long(spark, sf_dir).select("question", "treat", not_sure().alias("not_sure"))
    out = ttest.welch(rows, "not_sure", "treat", first=0, second=1)
    out = reshape.rename(out, {"mean1": "control_mean", "mean2": "treatment_mean"})
    return rounded(out.withColumn("question_type", question_type()))


def _randomization(rows: DataFrame) -> DataFrame:
    arm = F.when(F.col("treat") == 0, 1).when(F.col("treat") == 1, 2)
    side = recode("pid7_baseline", {1: PARTY["Dem"], 2: PARTY["Rep"]})
    return ttest.welch_many(
        rows, {"saw_by_treat": (saw_flag(), arm), "saw_by_party": (saw_flag(), side), "treat_by_party": (F.col("treat"), side)}
    )


@query
def randomization_checks(spark, sf_dir):
    return rounded(_randomization(survey_long(spark, sf_dir)))


@query
def randomization_checks_respondent(spark, sf_dir):
    """Same tests, each respondent counted once."""
    return rounded(_randomization(survey_wide(spark, sf_dir).where(F.col("treat").isNotNull())))


def _certainty(spark, sf_dir, by=None, weight=None, control=None, reference="normal", arm_means=False, **columns) -> DataFrame:
    rows = survey_long(spark, sf_dir).select("question", "treat", "weight", not_sure().alias("not_sure"), *(c.alias(k) for k, c in columns.items()))
    out = saturated.linear_effects(rows, "not_sure", by=by, weight=weight, control=control, reference=reference, coded=True, arm_means=arm_means)
    means = ("control_mean", "treatment_mean") if arm_means else ()
    return result(flip_sign(out).withColumn("question_type", question_type()), "question_type", *means)


@query
def certainty_ols(spark, sf_dir):
    return _certainty(spark, sf_dir, reference="t")


@query
def certainty_ols_ctrl(spark, sf_dir):
    return _certainty(spark, sf_dir, reference="t", control="saw", saw=saw_flag())


@query
def certainty_wls_ctrl(spark, sf_dir):
    return _certainty(spark, sf_dir, reference="t", weight="weight", control="saw", saw=saw_flag())


@query
def certainty_by_exposure(spark, sf_dir):
    return _certainty(spark, sf_dir, by="seen", seen=saw_yes_no())


@query
def certainty_by_exposure3(spark, sf_dir):
    return _certainty(spark, sf_dir, by="seen", seen=saw_levels())


@query
def certainty_by_exposure_w(spark, sf_dir):
    return _certainty(spark, sf_dir, by="seen", weight="weight", control="pid3", seen=saw_yes_no(), pid3=F.col("pid3_baseline"))


@query
def certainty_by_party(spark, sf_dir):
    return _certainty(spark, sf_dir, by="party", party=party3())


@query
def certainty_by_party_ctrl(spark, sf_dir):
    return _certainty(spark, sf_dir, by="party", control="saw", party=party3(), saw=saw_flag())


@query
def certainty_by_party_w(spark, sf_dir):
    return _certainty(spark, sf_dir, by="party", weight="weight", control="saw", party=party3(), saw=saw_flag())


@query
def did_party_ols(spark, sf_dir):
    rows = survey_long(spark, sf_dir).select("question", "treat", flag(party() == "Rep").alias("rep"), agree_all().alias("agree"))
    return result(saturated.linear_did(rows, "agree", "rep"))


@query
def certainty_coefficients(spark, sf_dir):
    """Full coefficient table of the weighted least-squares fit with party interaction and exposure control."""
    rows = survey_long(spark, sf_dir).select(
        "question", "treat", "weight", not_sure().alias("not_sure"), party3().alias("party"), saw_flag().alias("saw")
    )
    spec = ModelSpec(
        "not_sure", (*crossed("treat", "party"), ("saw",)), levels={"party": ("Dem", "Rep", "Ind")},
        codes={"treat": BINARY, "saw": BINARY, "not_sure": BINARY}, weight="weight",
    )
    return result(with_inference(fit_linear(rows, spec, [Coefficients()]), ["question", "subgroup", "term"], "t"))


@query
def linear_continuous(spark, sf_dir):
    """A continuous outcome far from zero, on treat × party and a control in seconds since an epoch; slopes only."""
    case = F.col("caseid")
    rows = survey_long(spark, sf_dir).where(F.col("response").isNotNull()).select(
        "question", "treat", "weight", party().alias("party"),
        (F.lit(1e8) + (case * 37 % 1009) / 100 + F.col("treat") * F.col("response") / 10).alias("y"),
        (F.lit(1.7e9) + case * 7919 % 1000003).alias("seconds"),
    )
    spec = ModelSpec("y", (*crossed("treat", "party"), ("seconds",)), levels={"party": PARTIES}, codes={"treat": BINARY}, weight="weight")
    fits = with_inference(fit_linear(rows, spec, [Coefficients(only=("treat", "party[Rep]", "treat:party[Rep]", "seconds"))]), ["question", "subgroup", "term"], "t")
    return result(fits.withColumns({c: F.col(c) * F.when(F.col("term") == "seconds", 1e6).otherwise(1.0) for c in ("estimate", "std_error", "conf_low", "conf_high")}))


def _open_outcome(spark, sf_dir) -> DataFrame:
    """An outcome and a control of open values."""
    case = F.col("caseid")
    return survey_long(spark, sf_dir).where(F.col("response").isNotNull()).select(
        "question", "treat", "weight", party().alias("party"), (F.lit(1e3) + (case * 37 % 1009) / 100 + F.col("treat") * F.col("response") / 10).alias("y"),
        (case * 7919 % 1000003 / 1e3).alias("z"),
    )


@query
def moment_states(spark, sf_dir):
    """A Welch test and least squares, weighted and not, with and without a control, from one table of moment states."""
    states = cells.compress(_open_outcome(spark, sf_dir), ["question", "treat", "party"], "weight", measures=["y", ("y", "z")])
    folder = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    states.write.parquet(folder)
    stored = spark.read.schema(states.schema).parquet(folder)
    keys = ["question", "subgroup", "term"]
    spec = ModelSpec("y", crossed("treat", "party"), levels={"party": PARTIES}, codes={"treat": BINARY}, weight="weight")
    only = Coefficients(only=("treat", "party[Rep]", "treat:party[Rep]"))
    stacked = reshape.stack(
        {
            "adjusted": flip_sign(saturated.linear_effects(stored, "y", weight="weight", control="z", reference="t")),
            "by_party": flip_sign(saturated.linear_effects(stored, "y", by="party", weight="weight", reference="t")),
            "crossed": with_inference(fit_linear(stored, spec, [only]), keys, "t"),
        },
        "analysis",
    )
    return result(stacked, keys=("analysis", *keys))


@query
def moment_states_welch(spark, sf_dir):
    """Welch's test of an open outcome from unweighted moment states."""
    states = cells.compress(_open_outcome(spark, sf_dir), ["question", "treat", "party"], measures=["y"])
    return rounded(ttest.welch(states, "y", "treat", first=1, second=0).drop("mean1", "mean2"))


@query
def linear_undeclared_code(spark, sf_dir):
    """A numeric control with a value that its list leaves out: least squares keep every row."""
    rows = survey_long(spark, sf_dir).select("question", "treat", "pid3_baseline", not_sure().alias("not_sure"))
    spec = ModelSpec("not_sure", (("treat",), ("pid3_baseline",)), codes={"treat": (0, 1), "pid3_baseline": (1, 2, 3)})
    return result(with_inference(fit_linear(rows, spec, [Coefficients()]), ["question", "subgroup", "term"], "t"))


@query
def logit_undeclared_code(spark, sf_dir):
    """The same control in a logit: questions that hold the value say so instead of losing rows."""
    rows = survey_long(spark, sf_dir).select("question", "treat", "pid3_baseline", agree_opinion().alias("agree"))
    spec = ModelSpec("agree", (("treat",), ("pid3_baseline",)), codes={"treat": (0, 1), "pid3_baseline": (1, 2, 3)})
    return fit(rows, Model(spec, "logit", (Coefficients(),))).select("question", "n", "converged", "error")


def _positioned(df: DataFrame, value: Column) -> DataFrame:
    return df.withColumn("position", reshape.position(value, "question", "term"))


@query
def certainty_ols_ordered(spark, sf_dir):
    """The effect table in the order of its own estimates."""
    return _positioned(certainty_ols(spark, sf_dir), F.col("estimate"))


@query
def direction_or_ordered(spark, sf_dir):
    """Odds ratios, the largest first."""
    return _positioned(direction_or(spark, sf_dir), -F.col("estimate"))


@query
def nested_logit_ordered(spark, sf_dir):
    """Both dichotomies in the order of the certainty estimates; the others rank as zero."""
    table = nested_logit(spark, sf_dir)
    value = F.col("estimate") * F.when(F.col("dichotomy") == "certainty", 1).otherwise(0)
    return table.withColumn("position", reshape.position(value, "question", "dichotomy", "term"))


@query
def certainty_wls_ctrl_means(spark, sf_dir):
    """Weighted, controlled effects beside the weighted means of both arms, from the same moments."""
    return _certainty(spark, sf_dir, reference="t", weight="weight", control="saw", arm_means=True, saw=saw_flag())


@query
def snapshot_question(spark, sf_dir):
    """Write the long table as a snapshot partitioned by question, read one question back and count its cells."""
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    write_long(survey_long(spark, sf_dir), folder)
    kept = read_long(spark, folder, ["q3"])
    return kept.groupBy("question", "treat", "response").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").cast("double").alias("weight")).transform(rounded)


@query
def snapshot_replace(spark, sf_dir):
    """Write a snapshot, replace one question's answers by their mirror image, and count what is then read back."""
    folder = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    long = survey_long(spark, sf_dir).select("caseid", "question", "treat", "response", "weight")
    write_snapshot(long, folder)
    write_snapshot(read_snapshot(spark, folder, ["q3"]).withColumn("response", recode("response", {new: (old,) for old, new in SWAP.items()})), folder, merge=True)
    kept = read_snapshot(spark, folder)
    return kept.groupBy("question", "treat", "response").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").cast("double").alias("weight")).transform(rounded)


@query
def codebook_audit(spark, sf_dir):
    """Codes against labels, with a stray code in one question and a label that nobody chose in another."""
    wide = survey_wide(spark, sf_dir)
    odd = {"q3": F.when(F.col("caseid") % 50 == 0, 9).otherwise(F.col("q3")), "q4": F.when(F.col("q4") != 2, F.col("q4"))}
    dirty = CODEBOOK.attach(wide.withColumns(odd))
    return audit_codes(dirty)


@query
def saved_table(spark, sf_dir):
    """The publication table, saved as a text file and read again."""
    table = ordinal_table(spark, sf_dir)
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    write_table(table, folder)
    return spark.read.option("header", True).schema(table.schema).csv(folder)


@query
def folded_median(spark, sf_dir):
    """Weighted median of an open value by question and arm, by a user's own functions on pieces of a group."""
    rows = survey_long(spark, sf_dir).where(F.col("response").isNotNull()).select(
        "question", "treat", F.col("weight").cast("double").alias("weight"), F.floor(open_value() * 1000).cast("int").alias("bin")
    )

    def partial(frame):
        return frame.groupby("bin")["weight"].sum().to_dict()

    def merge(a, b):
        return {k: a.get(k, 0.0) + b.get(k, 0.0) for k in a.keys() | b.keys()}

    def finish(state):
        total, below = sum(state.values()), 0.0
        for k in sorted(state):
            below += state[k]
            if below >= total / 2 - 1e-9:
                return [{"total": total, "median": k, "bins": len(state), "converged": True}]

    return rounded(fold_by(rows, ["question", "treat"], partial, merge, finish, "total double, median int, bins int, converged boolean, error string"))


# ---- logit with closed forms --------------------------------------------------------------------------------------

@query
def direction_or(spark, sf_dir):
    rows = survey_long(spark, sf_dir).select("question", "treat", agree_opinion().alias("agree"))
    out = saturated.saturated_logit(rows, "agree", "treat", exponentiate=True).where(F.col("term") == "treat")
    return result(out.withColumn("question_type", question_type()), "question_type")


def _contrast(spark, sf_dir, outcome: Column, by: Column, scale: str = "response") -> DataFrame:
    rows = survey_long(spark, sf_dir).select("question", "treat", outcome.alias("y"), by.alias("sub"))
    return result(saturated.logit_contrasts(rows, "y", "sub", scale=scale, exponentiate=True))


@query
def certainty_logit_by_exposure(spark, sf_dir):
    return _contrast(spark, sf_dir, not_sure(), saw_yes_no())


@query
def certainty_logit_by_party(spark, sf_dir):
    return _contrast(spark, sf_dir, not_sure(), party3())


@query
def direction_by_exposure(spark, sf_dir):
    return _contrast(spark, sf_dir, agree_opinion(), saw_yes_no())


@query
def direction_by_exposure_or(spark, sf_dir):
    """The same contrast on the link scale: odds ratios per subgroup."""
    return _contrast(spark, sf_dir, agree_opinion(), saw_yes_no(), scale="link")


@query
def direction_by_party(spark, sf_dir):
    return _contrast(spark, sf_dir, agree_opinion(), party3())


@query
def exposure_by_party_logit(spark, sf_dir):
    """One pooled fit over all long rows, full coefficient table."""
    rows = survey_long(spark, sf_dir).select(F.lit("(all)").alias("question"), saw_flag().alias("saw"), party3().alias("party"))
    return result(saturated.saturated_logit(rows, "saw", "party", levels=("Dem", "Ind", "Rep")))


@query
def nested_logit(spark, sf_dir):
    rows = survey_long(spark, sf_dir)
    out = saturated.nested_logit(rows, "response", {"certainty": ((3,), (1, 2)), "direction": ((2,), (1,))}, weight="weight")
    out = out.where(F.col("term") == "treat").withColumn("question_type", question_type())
    return result(out, "question_type", keys=("question", "dichotomy", "term"))


# ---- multinomial --------------------------------------------------------------------------------------------------

@query
def multinom_shares(spark, sf_dir):
    out = saturated.multinomial_effects(survey_long(spark, sf_dir), "response", weight="weight")
    return result(out, "prob_control", "prob_treated", keys=("question", "response", "term"))


@query
def multinom_contrast(spark, sf_dir):
    rows = survey_long(spark, sf_dir)
    out = saturated.multinomial_effects(rows, "response", errors="model")
    label = recode("response", {f"{text} prob": (code,) for code, text in YES_NO.items()})
    out = out.withColumn("response", strip_suffix(label, " prob"))
    return result(out, keys=("question", "response", "term"))


@query
def failed_groups(spark, sf_dir):
    """A fit per question and five-point answer: the eighth question is one class within each, so those groups fail."""
    rows = survey_long(spark, sf_dir)
    out = saturated.multinomial_effects(rows, "response", weight="weight", by=("question", "supp"))
    return result(out, "error", keys=("question", "supp", "response", "term"))


@query
def fitted_groups(spark, sf_dir):
    rows = survey_long(spark, sf_dir)
    out = saturated.multinomial_effects(rows, "response", weight="weight", by=("question", "supp"), drop_failed=True)
    return result(out, keys=("question", "supp", "response", "term"))


# ---- logit with controls ------------------------------------------------------------------------------------------

BINARY = (0, 1)
SEEN = ("No", "Yes")
PARTY_LEVELS = ("Dem", "Rep", "Ind")


def _direction(spark, sf_dir) -> DataFrame:
    return survey_long(spark, sf_dir).select(
        "question", "treat", "weight", "pid3_baseline", agree_opinion().alias("agree"),
        saw_flag().alias("saw"), saw_yes_no().alias("seen"), party3().alias("party"),
    )


def _odds_ratio(spark, sf_dir, weight: str | None, profile: bool = False) -> DataFrame:
    spec = ModelSpec("agree", (("treat",), ("saw",)), codes={"treat": BINARY, "saw": BINARY}, weight=weight)
    fits = fit(_direction(spark, sf_dir), Model(spec, "logit", (Coefficients(profile=profile, only=("treat",)),)))
    out = with_inference(fits, ["question", "subgroup", "term"], exponentiate=True)
    return result(out.withColumn("question_type", question_type()), "question_type")


@query
def direction_or_ctrl(spark, sf_dir):
    return _odds_ratio(spark, sf_dir, None)


@query
def direction_or_w(spark, sf_dir):
    return _odds_ratio(spark, sf_dir, "weight")


@query
def direction_or_ctrl_profile(spark, sf_dir):
    """With profile-likelihood bounds."""
    return _odds_ratio(spark, sf_dir, None, profile=True)


@query
def direction_or_w_profile(spark, sf_dir):
    return _odds_ratio(spark, sf_dir, "weight", profile=True)


def _direction_contrast(spark, sf_dir, spec: ModelSpec, by: str) -> DataFrame:
    fits = fit(_direction(spark, sf_dir), Model(spec, "logit", (Contrast("treat", by),)))
    return result(with_inference(fits, ["question", "subgroup", "term"], exponentiate=True))


@query
def direction_or_profile(spark, sf_dir):
    """Odds ratio of the plain logit with profile-likelihood bounds."""
    spec = ModelSpec("agree", (("treat",),), codes={"treat": BINARY})
    fits = fit(_direction(spark, sf_dir), Model(spec, "logit", (Coefficients(profile=True, only=("treat",)),)))
    return result(with_inference(fits, ["question", "subgroup", "term"], exponentiate=True))


@query
def direction_by_exposure_ctrl(spark, sf_dir):
    spec = ModelSpec(
        "agree", (*crossed("treat", "seen"), ("party",)), levels={"seen": SEEN, "party": ("Dem", "Ind", "Rep")}, codes={"treat": BINARY}
    )
    return _direction_contrast(spark, sf_dir, spec, "seen")


@query
def direction_by_exposure_w(spark, sf_dir):
    spec = ModelSpec(
        "agree", (*crossed("treat", "seen"), ("pid3_baseline",)), levels={"seen": SEEN},
        codes={"treat": BINARY, "pid3_baseline": (1, 2, 3, 4)}, weight="weight",
    )
    return _direction_contrast(spark, sf_dir, spec, "seen")


def _party_direction_spec(weight: str | None) -> ModelSpec:
    return ModelSpec(
        "agree", (*crossed("treat", "party"), ("saw",)), levels={"party": PARTY_LEVELS}, codes={"treat": BINARY, "saw": BINARY}, weight=weight
    )


@query
def direction_by_party_ctrl(spark, sf_dir):
    return _direction_contrast(spark, sf_dir, _party_direction_spec(None), "party")


@query
def direction_by_party_w(spark, sf_dir):
    return _direction_contrast(spark, sf_dir, _party_direction_spec("weight"), "party")


def _party_score(spark, sf_dir, profile: bool) -> DataFrame:
    rows = survey_long(spark, sf_dir).where(F.col("pid7_baseline") != 8).select(
        "question", "treat", "weight", agree_all().alias("agree"), saw_flag().alias("saw"),
        recode("pid7_baseline", {1: (1, 2, 3), 4: (4,), 3: (5, 6, 7)}).alias("pid"),
    )
    spec = ModelSpec(
        "agree", (("pid",), ("treat",), ("saw",)), codes={"pid": (1, 3, 4), "treat": BINARY, "saw": BINARY}, weight="weight"
    )
    fits = fit(rows, Model(spec, "logit", (Coefficients(only=("pid",), profile=profile), AverageSlope("pid"))))
    out = with_inference(fits, ["question", "subgroup", "term"])
    return result(out.withColumn("question_type", question_type()), "question_type")


def open_value() -> Column:
    """A covariate without a list of values."""
    return F.col("caseid") * 7919 % 1000003 / 1e6


def _open_direction(spark, sf_dir) -> DataFrame:
    return survey_long(spark, sf_dir).select(
        "question", "treat", "weight", agree_opinion().alias("agree"), saw_yes_no().alias("seen"), party3().alias("party"), open_value().alias("open")
    )


@query
def direction_open_covariate(spark, sf_dir):
    """A logit with a covariate of any value, fitted by passes over the rows."""
    spec = ModelSpec("agree", (("treat",), ("open",)), codes={"treat": BINARY})
    fits = fit(_open_direction(spark, sf_dir), Model(spec, "logit", (Coefficients(),)))
    return result(with_inference(fits, ["question", "subgroup", "term"]))


@query
def direction_open_covariate_profile(spark, sf_dir):
    """Profile-likelihood bounds over the rows: one pass serves all open searches."""
    spec = ModelSpec("agree", (("treat",), ("open",)), codes={"treat": BINARY}, weight="weight")
    fits = fit(_open_direction(spark, sf_dir), Model(spec, "logit", (Coefficients(profile=True, only=("treat",)),)))
    return result(with_inference(fits, ["question", "subgroup", "term"]))


@query
def slope_open_covariate(spark, sf_dir):
    """Average slope of an open covariate and treatment contrasts at its mean, from one fit over the rows."""
    spec = ModelSpec("agree", (*crossed("treat", "seen"), ("open",)), levels={"seen": SEEN}, codes={"treat": BINARY})
    fits = fit(_open_direction(spark, sf_dir), Model(spec, "logit", (AverageSlope("open"), Contrast("treat", "seen"))))
    return result(with_inference(fits, ["question", "subgroup", "term"]))


@query
def open_model_stack(spark, sf_dir):
    """Three models with open covariates; each pass over the rows serves those that still run."""
    def model(*terms):
        levels = {"party": PARTY_LEVELS} if ("party",) in terms else {}
        return Model(ModelSpec("agree", terms, levels=levels, codes={"treat": BINARY}), "logit", (Coefficients(),))

    models = {"treat": model(("treat",)), "open": model(("treat",), ("open",)), "party": model(("treat",), ("party",), ("open",))}
    fits = fit_many(_open_direction(spark, sf_dir), models, by_rows=True)
    return result(with_inference(fits, ["model", "question", "term"]), keys=("model", "question", "term"))


@query
def party_ame(spark, sf_dir):
    """Party score as a number: its log-odds coefficient and its average effect on the probability, from one fit."""
    return _party_score(spark, sf_dir, False)


@query
def party_ame_profile(spark, sf_dir):
    """The same with profile-likelihood bounds of the coefficient; the average effect keeps its Wald bounds."""
    return _party_score(spark, sf_dir, True)


# ---- ordinal logit ------------------------------------------------------------------------------------------------

CODE_ORDER = {1: "Yes", 2: "No", 3: "Not sure"}
AGREE_ORDER = {2: "Disagree", 3: "Not sure", 1: "Agree"}


def _partisans(spark, sf_dir) -> DataFrame:
    """Respondents of the two parties, with hand-made interaction columns."""
    rows = survey_long(spark, sf_dir).where(F.col("pid7").isin(1, 2, 3, 5, 6, 7))
    dem, rep = flag_in("pid7", (1, 2, 3)), flag_in("pid7", (5, 6, 7))
    return rows.select(
        "question", "response", "supp", "treat", dem.alias("dem"), rep.alias("rep"),
        (F.col("treat") * dem).alias("treat_dem"), (F.col("treat") * rep).alias("treat_rep"),
    )


def _ordinal(terms, ordered=None, outcome: str = "response", **report) -> Model:
    columns = dict.fromkeys(c for t in terms for c in t)
    spec = ModelSpec(outcome, tuple(terms), codes=dict.fromkeys(columns, BINARY), ordered=ordered or AGREE_ORDER, intercept=False)
    return Model(spec, "ordinal", (Coefficients(**report),))


@query
def ordinal_party(spark, sf_dir):
    model = _ordinal(crossed("treat", "rep"), only=("treat:rep",))
    return result(with_inference(fit(_partisans(spark, sf_dir), model), ["question", "subgroup", "term"]))


@query
def ordinal_party_profile(spark, sf_dir):
    """The interaction term with profile-likelihood bounds."""
    model = _ordinal(crossed("treat", "rep"), only=("treat:rep",), profile=True)
    return result(with_inference(fit(_partisans(spark, sf_dir), model), ["question", "subgroup", "term"]))


@query
def ordinal_party_wide(spark, sf_dir):
    model = _ordinal((("rep",), ("treat_dem",), ("treat_rep",)), CODE_ORDER, only=("treat_dem", "treat_rep"))
    fits = fit(_partisans(spark, sf_dir), model)
    return rounded(reshape.spread(fits, ["question"], "term", {t: t for t in ("treat_dem", "treat_rep")}, ["estimate", "std_error"]))


@query
def ordinal_interaction_only(spark, sf_dir):
    """Interactions without main effects: both parties, and one party alone, from one cell table."""
    models = {
        "both": _ordinal((("treat", "dem"), ("treat", "rep")), CODE_ORDER),
        "rep": _ordinal((("treat", "rep"),), CODE_ORDER),
    }
    fits = fit_many(_partisans(spark, sf_dir), models)
    return result(with_inference(fits, ["question", "model", "term"]), keys=("question", "model", "term"))


@query
def ordinal_reparam(spark, sf_dir):
    """Two parameterisations of one model; their log-likelihoods agree."""
    models = {
        "interaction": _ordinal((("treat",), ("rep",), ("treat_rep",))),
        "per_party": _ordinal((("rep",), ("treat_rep",), ("treat_dem",))),
    }
    fits = with_inference(fit_many(_partisans(spark, sf_dir), models), ["question", "model", "term"], extra=("loglik",))
    return result(fits, "loglik", keys=("question", "model", "term"))


@query
def ordinal_five_point(spark, sf_dir):
    """Five-point item over all long rows, thresholds included."""
    rows = _partisans(spark, sf_dir).withColumn("question", F.lit("(all)"))
    fits = fit(rows, _ordinal(crossed("treat", "rep"), FIVE_POINT, "supp"))
    return result(with_inference(fits, ["question", "subgroup", "term"]))


@query
def ordinal_table(spark, sf_dir):
    """Publication table of the interaction term: labels, question order, fixed decimals, significance flag."""
    fits = fit(_partisans(spark, sf_dir), _ordinal(crossed("treat", "rep"), only=("treat:rep",)))
    return effect_table(with_inference(fits, ["question", "subgroup", "term"]), CODEBOOK)


@query
def model_stack(spark, sf_dir):
    """Results of different models under each other, with the model's name."""
    rows = _partisans(spark, sf_dir)
    models = {
        "main": _ordinal((("treat",), ("rep",))), "crossed": _ordinal(crossed("treat", "rep")), "treat_only": _ordinal((("treat",),)),
    }
    fits = fit_many(rows, models)
    return result(with_inference(fits, ["model", "question", "term"]), keys=("model", "question", "term"))


@query
def ordinal_open_covariate(spark, sf_dir):
    """An ordinal fit with a covariate of any value: thresholds and slopes from built-in sums over the rows."""
    rows = survey_long(spark, sf_dir).where(F.col("pid7").isin(1, 2, 3, 5, 6, 7)).select(
        "question", "response", "treat", flag_in("pid7", (5, 6, 7)).alias("rep"), open_value().alias("open")
    )
    spec = ModelSpec("response", (("treat",), ("rep",), ("open",)), codes={"treat": BINARY, "rep": BINARY}, ordered=AGREE_ORDER, intercept=False)
    fits = fit(rows, Model(spec, "ordinal", (Coefficients(),)))
    return result(with_inference(fits, ["question", "subgroup", "term"], extra=("loglik",)), "loglik")


# ---- multinomial with covariates ----------------------------------------------------------------------------------

@query
def multinom_control(spark, sf_dir):
    """Multinomial fit with a control, weighted: coefficients, and class probabilities at the control's mode."""
    rows = survey_long(spark, sf_dir).select("question", "treat", "weight", "response", saw_flag().alias("saw"))
    spec = ModelSpec("response", (("treat",), ("saw",)), codes={"treat": BINARY, "saw": BINARY}, ordered=YES_NO, weight="weight")
    fits = fit(rows, Model(spec, "multinomial", (Coefficients(), Probabilities("treat"))))
    return result(with_inference(fits, ["question", "subgroup", "term"]))


@query
def multinom_open_covariate(spark, sf_dir):
    """The same with an open covariate, by passes over the rows; probabilities at its mean."""
    rows = survey_long(spark, sf_dir).select("question", "treat", "response", open_value().alias("open"))
    spec = ModelSpec("response", (("treat",), ("open",)), codes={"treat": BINARY}, ordered=YES_NO)
    fits = fit(rows, Model(spec, "multinomial", (Coefficients(), Probabilities("treat"))))
    return result(with_inference(fits, ["question", "subgroup", "term"]))


# ---- one cell table, many analyses --------------------------------------------------------------------------------

@query
def shared_cells_effects(spark, sf_dir):
    """Six analyses from one compressed table: the answers are scanned and joined once."""
    codes = ["question", "treat", "pid7_baseline", "saw", "response"]
    cells_once = cells.compress(survey_long(spark, sf_dir), codes, "weight").withColumns(
        {
            "not_sure": not_sure(), "agree": agree_opinion(), "party": party3(), "saw1": saw_flag().cast("int"),
            "rep": flag(party() == "Rep"),
        }
    )
    keys = ["question", "subgroup", "term"]
    linear = saturated.linear_effects(cells_once, "not_sure", by="party", weight="weight", control="saw1", coded=True)
    odds = saturated.saturated_logit(cells_once, "agree", "treat", weight="weight")
    contrasts = saturated.logit_contrasts(cells_once, "not_sure", "party", exponentiate=True)
    shares = saturated.multinomial_effects(cells_once, "response", weight="weight")
    spec = ModelSpec("agree", (("treat",), ("saw1",)), codes={"treat": BINARY, "saw1": BINARY}, weight="weight")
    logit = with_inference(fit(cells_once, Model(spec, "logit", (Coefficients(),))), keys)
    least = with_inference(fit_linear(cells_once, ModelSpec("not_sure", (("treat",), ("rep",)), codes={"treat": BINARY, "rep": BINARY, "not_sure": BINARY}), [Coefficients()]), keys, "t")
    stacked = reshape.stack(
        {
            "linear": flip_sign(linear), "odds": odds, "contrasts": contrasts, "logit": logit, "least_squares": least,
            "shares": shares.withColumn("subgroup", F.col("response").cast("string")).select(*keys, *RESULT_COLUMNS),
        },
        "analysis",
    )
    return result(stacked, keys=("analysis", *keys))
