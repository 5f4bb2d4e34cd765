"""From estimate and standard error to a full result table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyfx.functions import dist

RESULT_COLUMNS = (
    "estimate", "std_error", "statistic", "df", "p_value", "conf_low", "conf_high", "n", "converged",
)


def with_inference(
    fits: DataFrame,
    keys: list[str],
    reference: str = "normal",
    level: float | None = None,
    multiplier: float | None = None,
    exponentiate: bool = False,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Add statistic, p-value and interval.

    `reference` is "normal" or "t" (then `df` must be present). `multiplier` fixes the interval's half-width in
    standard errors. Interval bounds that the fit already carries (profile likelihood) are kept, and the others are
    made at their level; asking for another level is an error. Without either, the level is 0.95. `exponentiate`
    transforms estimate and bounds and leaves standard error, statistic and p-value on the fitted scale.
    """
    carried = next((f.metadata.get("level") for f in fits.schema.fields if f.name == "conf_low"), None)
    if carried is not None and level not in (None, carried):
        raise ValueError(f"the fit carries bounds at level {carried}, not {level}")
    level = carried or level or 0.95
    if reference not in ("normal", "t"):
        raise ValueError(f"unknown reference distribution {reference!r}")
    out = fits.withColumn("statistic", F.try_divide("estimate", "std_error"))
    if reference == "t":
        out = out.withColumn("df", F.col("df").cast("double"))
        p, width = dist.t_p("statistic", "df"), dist.t_quantile(level, "df")
    else:
        out = out.withColumn("df", F.lit(None).cast("double"))
        p, width = dist.normal_p("statistic"), F.lit(dist.normal_quantile(level))
    if multiplier is not None:
        width = F.lit(float(multiplier))
    half = width * F.col("std_error")
    low, high = F.col("estimate") - half, F.col("estimate") + half
    if "conf_low" in fits.columns:
        low, high = F.coalesce("conf_low", low), F.coalesce("conf_high", high)
    out = out.withColumns({"p_value": p, "conf_low": low, "conf_high": high})
    if exponentiate:
        out = out.withColumns({c: F.exp(c) for c in ("estimate", "conf_low", "conf_high")})
    return out.select(*keys, *RESULT_COLUMNS, *extra)


def flip_sign(results: DataFrame) -> DataFrame:
    """Report control − treatment instead of treatment − control: bounds trade places, so low ≤ high still holds."""
    neg = {c: -F.col(c) for c in ("estimate", "statistic")}
    return results.withColumns({**neg, "conf_low": -F.col("conf_high"), "conf_high": -F.col("conf_low")})


