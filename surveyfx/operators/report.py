"""Result tables for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyfx.sources.codebook import Codebook


def effect_table(results: DataFrame, codebook: Codebook, alpha: float = 0.05) -> DataFrame:
    """Labelled, ordered and formatted: three decimals for estimates, four for p-values, a flag below `alpha`."""
    table = results.select(
        codebook.rank("question").alias("position"),
        codebook.label("question").alias("outcome"),
        *(F.format_number(c, 3).alias(name) for c, name in (("estimate", "coefficient"), ("std_error", "se"), ("statistic", "z_value"))),
        F.format_number("p_value", 4).alias("p_value"),
        (F.col("p_value") < alpha).alias("significant"),
    )
    return table.orderBy("position")


def write_table(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """Save a result table."""
    writer = table.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
