"""Wide and long survey tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_wide(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | T.StructType | None = None) -> DataFrame:
    """Load one row per respondent. Text formats need a schema, so that no pass is spent on inference."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv input needs an explicit schema")
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def treatment_from_zero(raw: str) -> Column:
    """1 for raw code 0 (treated), 0 for any other code, null when not randomized."""
    return F.when(F.col(raw) == 0, 1).when(F.col(raw).isNotNull(), 0)


def to_long(wide: DataFrame, questions: Sequence[str], question: str = "question", response: str = "response") -> DataFrame:
    """One row per respondent and question; null responses are kept. An Expand inside the scan task, no shuffle."""
    ids = [c for c in wide.columns if c not in set(questions)]
    return wide.unpivot(ids, list(questions), question, response)


def write_long(long: DataFrame, path: str, question: str = "question") -> None:
    """Store the long table partitioned by question, so that a filter on it prunes directories.

    The rows are rebalanced by question: small questions meet in one file, and one that holds a large share of all
    rows is split over as many tasks as its size asks for. So the number of files follows the data, not the tasks.
    """
    long.hint("rebalance", question).write.mode("overwrite").partitionBy(question).parquet(path)


def read_long(spark: SparkSession, path: str, questions: Sequence[str] | None = None, question: str = "question") -> DataFrame:
    df = spark.read.parquet(path)
    return df if questions is None else df.where(F.col(question).isin(*questions))
