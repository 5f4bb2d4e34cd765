"""Descriptive effect tables: shares, gaps and differences in differences.

Each table is one partially aggregated groupBy over the answers; the pivots, windows and column arithmetic after it
work on one row per question, subgroup and arm.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.functions import dist
from surveyfx.functions.recode import ratio, stars, weighted_mean
from surveyfx.operators.cells import count_where, is_compressed, row_count, row_weight
from surveyfx.operators.reshape import gather, pick, share_within, spread

YES, NO, NOT_SURE = 1, 2, 3


def response_counts(rows: DataFrame, by: Sequence[str], response: str, weight: str | None = None) -> DataFrame:
    """Rows `n` (and weight `w`) per group and response; combinations that do not occur are absent."""
    kept = rows.dropna(subset=[*by, response])
    aggs = [row_count(rows).alias("n")]
    if weight:
        aggs.append(F.sum(weight).cast("double").alias("w"))
    return kept.groupBy(*by, response).agg(*aggs)


def response_distribution(rows: DataFrame, by: Sequence[str], response: str, weight: str) -> DataFrame:
    """Weighted share of each response within a group."""
    counts = response_counts(rows, by, response, weight)
    return counts.withColumn("share", share_within("w", by))


def response_shares(rows: DataFrame, by: Sequence[str], response: str) -> DataFrame:
    """Unweighted share of each response within a group."""
    counts = response_counts(rows, by, response)
    return counts.withColumn("share", share_within("n", by))


def shares_wide(rows: DataFrame, by: Sequence[str], response: str, classes: Mapping[object, str]) -> DataFrame:
    """Response shares with one column per response class."""
    return spread(response_shares(rows, by, response), by, response, classes, ["share"])


def pro_share_effect(
    rows: DataFrame, party: str, treat: str, response: str, parties: Sequence[str], yes: int = YES, question: str = "question"
) -> DataFrame:
    """Treatment effect on the share of `yes`, one column per party. Every known response counts in the denominator."""
    shares = response_shares(rows, [question, party, treat], response)
    arms = spread(
        shares.where((F.col(response) == yes) & F.col(party).isin(*parties)),
        [question, party], treat, {0: "control", 1: "treated"}, ["share"],
    )
    effects = arms.select(question, party, (F.col("treated") - F.col("control")).alias("effect"))
    return spread(effects, [question], party, {p: p for p in parties}, ["effect"])


def net_support_ztest(
    rows: DataFrame, by: Sequence[str], treat: str, response: str, covariance: bool = False, yes: int = YES, no: int = NO
) -> DataFrame:
    """Change of net support (share of yes minus share of no) between the arms, with a z-test.

    The variance adds the four binomial variances. `covariance` also counts the negative covariance of the two
    shares of one arm.
    """
    y, t = F.col(response), F.col(treat)
    counts = rows.dropna(subset=[*by, response]).groupBy(*by).agg(
        count_where(rows, (y == yes) & (t == 1)).alias("y1"),
        count_where(rows, (y == yes) & (t == 0)).alias("y0"),
        count_where(rows, (y == no) & (t == 1)).alias("n1"),
        count_where(rows, (y == no) & (t == 0)).alias("n0"),
        count_where(rows, t == 1).alias("size1"),
        count_where(rows, t == 0).alias("size0"),
    )
    shares = counts.select(
        *by, "size1", "size0",
        *(ratio(F.col(f"{c}{a}"), F.col(f"size{a}")).alias(f"p_{c}{a}") for c in "yn" for a in "10"),
    )

    def spread_of(arm: str) -> Column:
        py, pn, size = F.col(f"p_y{arm}"), F.col(f"p_n{arm}"), F.col(f"size{arm}")
        total = ratio(py * (1 - py), size) + ratio(pn * (1 - pn), size)
        return total + ratio(2 * py * pn, size) if covariance else total

    tested = shares.select(
        *by,
        ((F.col("p_y1") - F.col("p_n1")) - (F.col("p_y0") - F.col("p_n0"))).alias("diff_effect"),
        F.sqrt(spread_of("1") + spread_of("0")).alias("se_diff_effect"),
    ).withColumn("z_stat", F.try_divide("diff_effect", "se_diff_effect"))
    return tested.withColumn("p_value", dist.normal_p("z_stat")).withColumn("significance", stars("p_value"))


def uncertainty_effect(
    shares: DataFrame, party: str, treat: str, not_sure: str, position: Column, upper_party: str, question: str = "question"
) -> DataFrame:
    """Effect on the share of "not sure", with the coordinates of its arrow: control, treated, midpoint, height."""
    arms = spread(shares, [question, party], treat, {0: "control", 1: "treated"}, [not_sure])
    effect = F.col("treated") - F.col("control")
    return arms.select(
        "*",
        effect.alias("effect_not_sure"),
        (position + F.when(F.col(party) == upper_party, 0.1).otherwise(-0.1)).alias("y_position"),
        ((F.col("control") + F.col("treated")) / 2).alias("midpoint"),
        (100 * F.round(effect, 2)).alias("effect_label"),
    )


def net_support(shares: DataFrame, party: str, treat: str, yes: str, no: str, question: str = "question") -> DataFrame:
    """Net support of both arms and its change, on every row of the share table."""
    net, by = F.col(yes) - F.col(no), [question, party]
    return shares.withColumns(
        {
            "difference_treatment": pick(net, F.col(treat) == 1, by),
            "difference_control": pick(net, F.col(treat) == 0, by),
        }
    ).withColumn("difference_effect", F.col("difference_treatment") - F.col("difference_control"))


def both_effects(
    shares: DataFrame, party: str, treat: str, yes: str, no: str, not_sure: str, question: str = "question"
) -> DataFrame:
    """Effects on uncertainty and on direction, stacked."""
    treated, control = F.col(treat) == 1, F.col(treat) == 0

    def change(value: Column) -> Column:
        return F.max(F.when(treated, value)) - F.max(F.when(control, value))

    wide = shares.groupBy(question, party).agg(
        change(F.col(not_sure)).alias("Uncertainty"), change(F.col(yes) - F.col(no)).alias("Direction")
    )
    return gather(wide, [question, party], ["Uncertainty", "Direction"], "effect_type", "effect_value")


def mean_by(rows: DataFrame, by: Sequence[str], outcome: str) -> DataFrame:
    n = row_weight(rows)
    mean = ratio(F.sum(n * F.col(outcome)), F.sum(n)) if is_compressed(rows) else F.avg(outcome)
    return rows.dropna(subset=[*by, outcome]).groupBy(*by).agg(mean.alias("mean"))


def spread_of_means(rows: DataFrame, level: str, by: Sequence[str], outcome: str, low, high) -> DataFrame:
    """Mean outcome per level, and the absolute distance between the two extreme levels on every row."""
    means = mean_by(rows, [*by, level], outcome)
    mean, lev = F.col("mean"), F.col(level)
    return means.withColumn("diff", F.abs(pick(mean, lev == high, by) - pick(mean, lev == low, by)))


def party_gap(rows: DataFrame, party: str, by: Sequence[str], outcome: str, parties: tuple[str, str] = ("Dem", "Rep")) -> DataFrame:
    """Mean outcome of two parties side by side and their difference (second minus first)."""
    means = mean_by(rows, [*by, party], outcome)
    wide = spread(means, by, party, {p: p for p in parties}, ["mean"])
    return wide.withColumn("diff", F.col(parties[1]) - F.col(parties[0]))


def party_gap_did(rows: DataFrame, party: str, treat: str, outcome: str, question: str = "question") -> DataFrame:
    """Party gap per arm, and its change between the arms."""
    gaps = party_gap(rows, party, [question, treat], outcome)
    change = pick(F.col("diff"), F.col(treat) == 1, [question]) - pick(F.col("diff"), F.col(treat) == 0, [question])
    return gaps.withColumn("diff_in_diff", change)


def weighted_arm_means(rows: DataFrame, treat: str, outcome: str, weight: str, by: Sequence[str] = ("question",)) -> DataFrame:
    """Weighted mean of the outcome in the control and the treated arm."""
    y, w, t = F.col(outcome), F.col(weight), F.col(treat)

    def arm_mean(arm: int) -> Column:
        x = F.when(t == arm, y)
        lost = F.sum(F.when(x.isNotNull(), F.col("_n") - F.col("_n_known")).otherwise(0)) if is_compressed(rows) else None
        return weighted_mean(x, w, lost)

    return rows.groupBy(*by).agg(arm_mean(0).alias("control_mean"), arm_mean(1).alias("treatment_mean"))
