"""Declarative model specifications and their design matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import combinations
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.functions.recode import known_level, level_rank
from surveyfx.operators.cells import count_columns

INTERCEPT = "(Intercept)"


def crossed(*columns: str) -> tuple[tuple[str, ...], ...]:
    """All main effects and products of the columns."""
    return tuple(c for size in range(1, len(columns) + 1) for c in combinations(columns, size))


@dataclass(frozen=True)
class ModelSpec:
    """outcome ~ terms, where a term is a tuple of columns that are multiplied.

    levels   categorical covariates: closed list, first entry is the reference; other values count as missing
    codes    numeric covariates with a closed list of values, which bounds the covariate patterns of a group. A group
             that holds another value is not fitted and says so. A numeric covariate without a list is allowed, but
             then the number of patterns is unbounded and the fit runs as distributed passes over the rows. An outcome
             with a list saves a weighted least-squares fit a pass.
    ordered  outcome codes in rank order with their labels (ordinal models)
    """

    outcome: str
    terms: tuple[tuple[str, ...], ...]
    levels: Mapping[str, tuple] = field(default_factory=dict)
    codes: Mapping[str, tuple] = field(default_factory=dict)
    weight: str | None = None
    ordered: Mapping[object, str] = field(default_factory=dict)
    intercept: bool = True

    def with_terms(self, terms) -> ModelSpec:
        return replace(self, terms=tuple(terms))

    @property
    def covariates(self) -> list[str]:
        return list(dict.fromkeys(c for term in self.terms for c in term))

    def cell_bound(self) -> int | None:
        """Largest possible number of cells per group; None when a covariate has no closed list."""
        sizes = [len(self.levels.get(c, self.codes.get(c, ()))) for c in self.covariates]
        return prod(sizes) * max(len(self.ordered), 2) if all(sizes) else None

    def columns(self, listed: bool = True) -> dict[str, Column]:
        """Covariates and outcome as the fit wants them. A category outside its list becomes null, which a model drops;
        a number outside its list becomes infinite (`listed`), which a fit reports, or stays as it is."""
        out: dict[str, Column] = {}
        for c in self.covariates:
            if c in self.levels:
                out[c] = known_level(c, self.levels[c])
            else:
                value = F.col(c).cast("double")
                inside = value.isNull() | value.isin(*(float(v) for v in self.codes[c])) if c in self.codes and listed else None
                out[c] = value if inside is None else F.when(inside, value).otherwise(F.lit(float("inf")))
        out["_y"] = level_rank(self.outcome, tuple(self.ordered)) if self.ordered else F.col(self.outcome).cast("double")
        return out

    def outside(self, frame: pd.DataFrame) -> list[str]:
        """Covariates of a group that hold numbers outside their list."""
        return [c for c in self.covariates if c not in self.levels and c in self.codes and np.isinf(frame[c].to_numpy(float)).any()]

    def project(self, rows: DataFrame, by: Sequence[str], listed: bool = True) -> DataFrame:
        weight = [F.col(self.weight).alias("_weight")] if self.weight else []
        return rows.select(*by, *(c.alias(n) for n, c in self.columns(listed).items()), *weight, *count_columns(rows))

    # -- design ----------------------------------------------------------------------------------------------------

    def _expand(self, frame: pd.DataFrame, column: str) -> list[np.ndarray]:
        values = frame[column].to_numpy()
        if column in self.levels:
            return [(values == level).astype(float) for level in self.levels[column][1:]]
        return [values.astype(float)]

    def _product(self, frame: pd.DataFrame, columns: Sequence[str]) -> list[np.ndarray]:
        parts = [np.ones(len(frame))]
        for c in columns:
            parts = [p * e for p in parts for e in self._expand(frame, c)]
        return parts

    def names(self) -> list[str]:
        names = [INTERCEPT] if self.intercept else []
        for term in self.terms:
            parts = [""]
            for c in term:
                suffixes = [f"[{lv}]" for lv in self.levels[c][1:]] if c in self.levels else [""]
                parts = [f"{p}:{c}{s}" if p else f"{c}{s}" for p in parts for s in suffixes]
            names += parts
        return names

    def matrix(self, frame: pd.DataFrame) -> np.ndarray:
        """Design matrix of a frame of covariate values."""
        parts = [np.ones(len(frame))] if self.intercept else []
        for term in self.terms:
            parts += self._product(frame, term)
        return np.column_stack(parts) if parts else np.zeros((len(frame), 0))

    def design_columns(self) -> list[Column]:
        """The same design matrix as Column expressions over projected rows."""

        def expand(c: str) -> list[Column]:
            if c in self.levels:
                return [(F.col(c) == level).cast("double") for level in self.levels[c][1:]]
            return [F.col(c).cast("double")]

        parts = [F.lit(1.0)] if self.intercept else []
        for term in self.terms:
            products = [F.lit(1.0)]
            for c in term:
                products = [p * e for p in products for e in expand(c)]
            parts += products
        return parts

    def slope_columns(self, column: str) -> list[Column]:
        """`slope_matrix` as Column expressions."""
        parts = [F.lit(0.0)] if self.intercept else []
        for term in self.terms:
            inner = replace(self, terms=(tuple(c for c in term if c != column),), intercept=False)
            products = inner.design_columns()
            parts += products if column in term else [F.lit(0.0)] * len(products)
        return parts

    def open_columns(self) -> list[bool]:
        """Whether a column of the design has a factor of open values, which may lie far from zero."""
        parts = [False] if self.intercept else []
        for term in self.terms:
            width = 1
            for c in term:
                width *= len(self.levels[c]) - 1 if c in self.levels else 1
            parts += [any(c not in self.levels and c not in self.codes for c in term)] * width
        return parts

    def slope_matrix(self, frame: pd.DataFrame, column: str) -> np.ndarray:
        """Derivative of the design matrix with respect to one numeric covariate."""
        parts = [np.zeros(len(frame))] if self.intercept else []
        for term in self.terms:
            if column in term:
                parts += self._product(frame, [c for c in term if c != column])
            else:
                parts += [np.zeros(len(frame))] * len(self._product(frame.iloc[:1], term))
        return np.column_stack(parts)

    def typical_by_mode(self, column: str) -> bool:
        """Whether a covariate's typical value is its mode (categories, 0/1 codes) rather than its mean."""
        return column in self.levels or (column in self.codes and set(self.codes[column]) <= {0, 1})
