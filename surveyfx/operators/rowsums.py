"""Sums over rows as built-in aggregates: what a Newton step or a report needs, for each task's parameters.

A task is a group's parameter vector at which sums are wanted: a model's next candidate, or a point of a profile search.
Rows meet the tasks of their group, which come from a table of a few rows per group that Spark broadcasts when it is
small, and never leave the JVM; partial aggregation leaves one row of sums per task of the cluster and group.

All models that are fitted together share one design: the columns of all of them. A task's vector is laid out over
these columns, with zeros where its model has no term, and its sums are picked out again by `unpack`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expit(x: str) -> str:
    return f"(1 / (1 + exp(-greatest(least({x}, 700D), -700D))))"


def dot(at: int, p: int) -> str:
    return " + ".join([f"candidate[{at + i}] * _x{i}" for i in range(p)] or ["0D"])


def upper(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


class LogitSums:
    def __init__(self, p: int, ordered: Sequence):
        self.p = p
        self.width = p

    def columns(self) -> list[dict[str, str]]:
        return [{"eta": dot(0, self.p)}, {"mu": expit("eta")}, {"off": "_w * (_y - mu)", "curve": "_w * mu * (1 - mu)"}]

    def sums(self) -> list[str]:
        return [
            "sum(_w * (_y * eta - greatest(eta, 0D) - log1p(exp(-abs(eta)))))",
            *(f"sum(off * _x{i})" for i in range(self.p)),
            *(f"sum(curve * _x{i} * _x{j})" for i, j in upper(self.p)),
        ]

    def slots(self, own: Sequence[int], classes: Sequence[int]) -> list[int]:
        """Where a model's parameters stand in the shared layout."""
        return list(own)

    def information(self, rest: np.ndarray) -> np.ndarray:
        return triangle(rest, self.p)

    def defined(self, theta: np.ndarray, classes: Sequence[int]) -> bool:
        return True


class OrdinalSums:
    """Thresholds first, as many as the outcome can have; those of unobserved classes stay unused."""

    def __init__(self, p: int, ordered: Sequence):
        self.p, self.k = p, len(ordered) - 1
        self.width = self.k + p

    def columns(self) -> list[dict[str, str]]:
        return [
            {"eta": dot(self.k, self.p), "rank": "cast(array_position(classes, cast(_y as int)) as int) - 1"},
            {
                "up": f"CASE WHEN rank = size(classes) - 1 THEN 1D ELSE {expit('get(candidate, rank) - eta')} END",
                "lo": f"CASE WHEN rank = 0 THEN 0D ELSE {expit('get(candidate, rank - 1) - eta')} END",
            },
            {"p": "greatest(up - lo, 1e-300D)", "fu": "up * (1 - up)", "fl": "lo * (1 - lo)"},
            {"da": "fu / p", "db": "-fl / p"},
            {"haa": "fu * (1 - 2 * up) / p - da * da", "hbb": "-fl * (1 - 2 * lo) / p - db * db", "hab": "-da * db"},
        ]

    def sums(self) -> list[str]:
        """A row moves with its upper and its lower threshold; `at` picks what belongs to threshold j."""

        def at(j: int, as_upper: str, as_lower: str) -> str:
            return f"CASE rank WHEN {j} THEN {as_upper} WHEN {j + 1} THEN {as_lower} ELSE 0D END"

        k, p = range(self.k), range(self.p)
        return [
            "sum(_w * ln(p))",
            *(f"sum(_w * {at(j, 'da', 'db')})" for j in k),
            *(f"-sum(_w * (da + db) * _x{i})" for i in p),
            *(f"-sum(_w * {at(j, 'haa', 'hbb')})" for j in k),
            *(f"-sum(CASE WHEN rank = {j} THEN _w * hab ELSE 0D END)" for j in k[1:]),
            *(f"sum(_w * _x{i} * {at(j, '(haa + hab)', '(hbb + hab)')})" for j in k for i in p),
            *(f"-sum(_w * _x{i} * _x{j} * (haa + hbb + 2 * hab))" for i, j in upper(self.p)),
        ]

    def slots(self, own: Sequence[int], classes: Sequence[int]) -> list[int]:
        return [*range(len(classes) - 1), *(self.k + i for i in own)]

    def information(self, rest: np.ndarray) -> np.ndarray:
        k, p = self.k, self.p
        diagonal, beside, cross, slopes = np.split(rest, np.cumsum([k, k - 1, k * p]))
        out = np.zeros((self.width, self.width))
        out[:k, :k] = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
        out[:k, k:] = cross.reshape(k, p)
        out[k:, :k] = out[:k, k:].T
        out[k:, k:] = triangle(slopes, p)
        return out

    def defined(self, theta: np.ndarray, classes: Sequence[int]) -> bool:
        return bool(np.all(np.diff(theta[: len(classes) - 1]) > 0))


class SoftmaxSums:
    """A coefficient vector for each possible class; the first observed one keeps zeros."""

    def __init__(self, p: int, ordered: Sequence):
        self.p, self.k = p, len(ordered)
        self.width = self.k * p

    def columns(self) -> list[dict[str, str]]:
        k = range(self.k)
        return [
            {f"eta{c}": f"CASE WHEN array_contains(classes, {c + 1}) THEN {dot(c * self.p, self.p)} END" for c in k},
            {"top": f"greatest({', '.join(f'eta{c}' for c in k)})"},
            {f"e{c}": f"coalesce(exp(eta{c} - top), 0D)" for c in k},
            {"total": " + ".join(f"e{c}" for c in k), "own": "CASE cast(_y as int) " + " ".join(f"WHEN {c + 1} THEN eta{c}" for c in k) + " END"},
            {f"p{c}": f"e{c} / total" for c in k},
        ]

    def sums(self) -> list[str]:
        k = range(self.k)
        return [
            "sum(_w * (own - top - ln(total)))",
            *(f"sum(_w * (CASE WHEN _y = {c + 1} THEN 1D ELSE 0D END - p{c}) * _x{i})" for c in k for i in range(self.p)),
            *(f"sum(_w * p{c} * ({float(c == d)}D - p{d}) * _x{i} * _x{j})" for c in k for d in k[c:] for i, j in upper(self.p)),
        ]

    def slots(self, own: Sequence[int], classes: Sequence[int]) -> list[int]:
        return [(c - 1) * self.p + i for c in classes[1:] for i in own]

    def information(self, rest: np.ndarray) -> np.ndarray:
        out = np.zeros((self.k, self.p, self.k, self.p))
        pairs = upper(self.k)
        for (c, d), block in zip(pairs, np.split(rest, len(pairs))):
            out[c, :, d, :] = triangle(block, self.p)
            out[d, :, c, :] = out[c, :, d, :].T
        return out.reshape(self.width, self.width)

    def defined(self, theta: np.ndarray, classes: Sequence[int]) -> bool:
        return True


FAMILY_SUMS = {"logit": LogitSums, "ordinal": OrdinalSums, "multinomial": SoftmaxSums}


def triangle(values: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    out[np.triu_indices(p)] = values
    return out + np.triu(out, 1).T


def laid_out(theta: np.ndarray, slots: Sequence[int], width: int) -> np.ndarray:
    out = np.zeros(width)
    out[slots] = theta
    return out


def unpack(family, v: np.ndarray, slots: Sequence[int], theta: np.ndarray, classes: Sequence[int]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, score and information of a model's own parameters; no likelihood where thresholds cross."""
    loglik = float(v[0]) if family.defined(theta, classes) else -math.inf
    info = family.information(v[1 + family.width :])
    return loglik, v[1 : 1 + family.width][slots], info[np.ix_(slots, slots)]


def task_sums(data: DataFrame, tasks: DataFrame, by: Sequence[str], columns: Sequence[dict[str, str]], sums: Sequence[str]) -> DataFrame:
    """(by, task, v): the sums at each task's candidate, over the rows that its model uses."""
    rows = data.join(tasks.select(*by, "task", "model", "classes", "candidate"), list(by)).where("get(_use, model)")
    for step in columns:
        rows = rows.withColumns({name: F.expr(e) for name, e in step.items()})
    out = rows.groupBy(*by, "task").agg(F.expr(f"array({', '.join(sums)})").alias("v"))
    # columns of their own, as the sums are set beside the tasks they came from
    return out.select(*(F.col(c).alias(c) for c in [*by, "task"]), "v")


def newton_sums(data: DataFrame, tasks: DataFrame, by: Sequence[str], family) -> DataFrame:
    return task_sums(data, tasks, by, family.columns(), family.sums())


def slope_sums(data: DataFrame, tasks: DataFrame, by: Sequence[str], p: int, models: Sequence[int]) -> DataFrame:
    """Row count, Σ of the derivative of the fitted probability, and Σ of its gradient; `_d{m}_{i}` holds what the design
    column i of model m gains when the variable does. Each row counts once, whatever its weight."""

    def derivative(i: int) -> str:
        return "CASE model " + " ".join(f"WHEN {m} THEN _d{m}_{i}" for m in models) + " END"

    columns = [
        {"eta": dot(0, p), **{f"_d{i}": derivative(i) for i in range(p)}},
        {"mu": expit("eta"), "lean": " + ".join(f"candidate[{i}] * _d{i}" for i in range(p))},
        {"v": "_rows * mu * (1 - mu)"},
    ]
    sums = ["sum(_rows)", "sum(v * lean)", *(f"sum(v * (1 - 2 * mu) * lean * _x{i} + v * _d{i})" for i in range(p))]
    return task_sums(data, tasks, by, columns, sums)
