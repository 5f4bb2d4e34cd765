"""Welch's two-sample t-test per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyfx.functions import dist
from surveyfx.functions.recode import ratio
from surveyfx.operators.cells import count_columns, is_compressed, moments, plain_mean, row_count, weighted_moment
from surveyfx.operators.reshape import picked


def _from_arms(arms: DataFrame, by: Sequence[str], arm: str, first, second, level: float) -> DataFrame:
    """`arms` holds n, mean and variance per group and arm."""
    sides = {"1": F.col(arm) == first, "2": F.col(arm) == second}
    wide = arms.groupBy(*by).agg(
        *(picked(F.col(c), cond).alias(f"{c}{k}") for k, cond in sides.items() for c in ("n", "mean", "var"))
    )
    v1, v2 = ratio(F.col("var1"), F.col("n1")), ratio(F.col("var2"), F.col("n2"))
    se = wide.select(
        *by,
        F.col("mean1"), F.col("mean2"),
        (F.col("mean1") - F.col("mean2")).alias("difference"),
        F.sqrt(v1 + v2).alias("std_error"),
        F.try_divide((v1 + v2) * (v1 + v2), F.try_divide(v1 * v1, F.col("n1") - 1) + F.try_divide(v2 * v2, F.col("n2") - 1)).alias("df"),
        (F.col("n1") + F.col("n2")).alias("n"),
    ).withColumn("statistic", F.try_divide("difference", "std_error"))
    half = dist.t_quantile(level, "df") * F.col("std_error")
    return se.select(
        *by, "mean1", "mean2", "difference", "std_error", "statistic", "df",
        dist.t_p("statistic", "df").alias("p_value"),
        (F.col("difference") - half).alias("conf_low"),
        (F.col("difference") + half).alias("conf_high"),
        "n",
    )


def welch(
    rows: DataFrame, outcome: str, arm: str, first=0, second=1, by: Sequence[str] = ("question",), level: float = 0.95
) -> DataFrame:
    """Mean of `first` minus mean of `second`, with Welch's degrees of freedom. Missing values are left out."""
    if is_compressed(rows):
        sums = moments(rows, [*by, arm], outcome)
        arms = sums.select(*by, arm, "n", "mean", ratio(F.col("cyy"), F.col("n") - 1).alias("var"))
    else:
        arms = rows.dropna(subset=[*by, outcome, arm]).groupBy(*by, arm).agg(
            F.count(F.lit(1)).alias("n"), plain_mean(F.col(outcome).cast("double")).alias("mean"), F.var_samp(outcome).alias("var")
        )
    return _from_arms(arms, by, arm, first, second, level)


def welch_many(rows: DataFrame, tests: Mapping[str, tuple[Column, Column]], level: float = 0.95) -> DataFrame:
    """Several tests on coded columns in one pass: ``{name: (outcome, arm)}``, where an arm is 1 or 2.

    The rows are reduced to the combinations of all coded columns first (missing values included, since each test has
    its own complete cases); every combination then contributes to each test.
    """
    pairs = list(tests.values())
    columns = {f"{side}{i}": c for i, p in enumerate(pairs) for c, side in zip(p, "yg")}
    coded = rows.select(*(c.alias(name) for name, c in columns.items()), *count_columns(rows))
    cells = coded.groupBy(*columns).agg(row_count(coded).alias("n"))
    parts = F.array(
        *(
            F.struct(F.lit(name).alias("test"), F.col(f"y{i}").cast("double").alias("y"), F.col(f"g{i}").cast("int").alias("g"))
            for i, name in enumerate(tests)
        )
    )
    tall = cells.select("n", F.explode(parts).alias("part")).select("n", "part.*").dropna()
    # the combinations are few, so a mean to take moments around comes from a window over them
    tall = tall.withColumn("near", F.avg("y").over(Window.partitionBy("test", "g")))
    n, d = F.col("n").cast("double"), F.col("y") - F.col("near")
    arms = tall.groupBy("test", "g").agg(
        F.sum("n").alias("n"), (F.max("near") + ratio(F.sum(n * d), F.sum("n"))).alias("mean"), ratio(weighted_moment(n, d, d), F.sum("n") - 1).alias("var")
    )
    return _from_arms(arms, ["test"], "g", 1, 2, level)
