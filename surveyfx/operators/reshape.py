"""Reshaping, within-group shares and row picks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyfx.functions.recode import ratio


def spread(
    df: DataFrame, ids: Sequence[str], names_from: str, values: Mapping[object, str], value_cols: Sequence[str]
) -> DataFrame:
    """Long to wide. `values` lists the expected names and their column labels, so no job is spent on finding them.

    One value column gives columns named by label; several give ``{value}_{label}``. An absent cell is null.
    """
    picks = [F.first(c, ignorenulls=True).alias(c) for c in value_cols]
    wide = df.groupBy(*ids).pivot(names_from, list(values)).agg(*picks)
    if len(value_cols) == 1:
        renamed = [F.col(f"`{v}`").alias(label) for v, label in values.items()]
    else:
        renamed = [F.col(f"`{v}_{c}`").alias(f"{c}_{label}") for v, label in values.items() for c in value_cols]
    return wide.select(*ids, *renamed)


def gather(df: DataFrame, ids: Sequence[str], columns: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(list(ids), list(columns), names_to, values_to)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """``{"old": "new"}``."""
    return df.withColumnsRenamed(dict(names))


def rename_at(df: DataFrame, position: int, name: str) -> DataFrame:
    """Rename by 0-based position."""
    return df.withColumnRenamed(df.columns[position], name)


def stack(frames: Mapping[str, DataFrame], label: str) -> DataFrame:
    """Rows of several results under each other, with their name in column `label`."""
    tagged = [f.select(F.lit(name).alias(label), "*") for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def share_within(value: str, groups: Sequence[str]) -> Column:
    """Window column: a value over its group total."""
    return ratio(F.col(value), F.sum(value).over(Window.partitionBy(*groups)))


def pick(value: Column, cond: Column, groups: Sequence[str]) -> Column:
    """Window column: the value of the group's one row that meets `cond`, on every row of the group."""
    return F.max(F.when(cond, value)).over(Window.partitionBy(*groups))


def picked(value: Column, cond: Column) -> Column:
    """Aggregate form of `pick`."""
    return F.max(F.when(cond, value))


def order_by_mean(df: DataFrame, key: str, value: Column, name: str = "position") -> DataFrame:
    """Add the display position of `key`: ascending mean of `value` over its rows, ties by name.

    The means are ranked after the reduction to one row per key, so the unpartitioned ranking window sees keys only.
    """
    means = df.groupBy(key).agg(F.avg(value).alias("_mean"))
    ranked = means.withColumn(name, F.row_number().over(Window.orderBy("_mean", key))).drop("_mean")
    return df.join(ranked, key)


def position(value: Column, *ties: str) -> Column:
    """Window column: display position by ascending `value`, ties by the named columns. For finished tables of a few rows per question."""
    return F.row_number().over(Window.orderBy(value, *ties))
