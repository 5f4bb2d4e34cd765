"""Least squares for any term list.

The normal equations only need second moments. They are computed by built-in aggregates in one partially aggregated
groupBy, whatever the covariates are (coded or continuous), centred where the model has an intercept, and each group's
p × p system is solved on the correlation scale where its one row of moments lies, without another shuffle.

Without weights, the built-in co-moments are centred. With weights, columns of open values are taken around their group
means, for which one pass over the rows comes first; levels and columns with a list in `codes` (the outcome may have
one, too) need none. The lists do not filter: every number stays in the fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.operators.cells import centred, count_columns, from_state, inner_columns, is_compressed, never_varies, plain_mean, row_count, row_weight, state_of, weighted_moment
from surveyfx.operators.fit import FIT_FIELDS, FIT_NAMES, Fitted, Linear, Report, result_frame
from surveyfx.operators.spec import ModelSpec

#: Smallest eigenvalue of the regressors' correlations from which the data determine every parameter.
RANK_TOL = 1e-10


def _typical_columns(spec: ModelSpec, n: Column) -> list[Column]:
    """Sums over rows behind the typical covariate values, in the order the reports read them."""
    out = [F.sum(n).cast("double")]
    for c in spec.covariates:
        if spec.typical_by_mode(c):
            out += [F.sum(F.when(F.col(c) == v, n).otherwise(0)).cast("double") for v in spec.levels.get(c, spec.codes.get(c))]
        else:
            out.append(F.sum(n * F.col(c).cast("double")))
    return out


def fit_linear(
    rows: DataFrame, spec: ModelSpec, reports: Sequence[Report], by: Sequence[str] = ("question",)
) -> DataFrame:
    """Columns: `by`, FIT_FIELDS and the residual degrees of freedom `df`. Contrasts are on the outcome's own scale."""
    if state_of(rows, [spec.outcome]):
        rows = from_state(rows, [spec.outcome], spec.weight)
    keyed = spec.project(rows, by, listed=False).dropna()
    weight = "_weight" if spec.weight else None
    w = row_weight(keyed, weight).cast("double")
    p = len(spec.names())
    flat = keyed.select(
        *by, *spec.covariates, *([weight] if weight else []), *count_columns(keyed), w.alias("_w"), F.col("_y"), *(c.alias(f"_x{i}") for i, c in enumerate(spec.design_columns()))
    )

    first = 1 if spec.intercept else 0
    names = [f"_x{i}" for i in range(first, p)]
    plain = not (weight or is_compressed(keyed))
    far = [x for x, is_open in zip(names, spec.open_columns()[first:]) if is_open] + ([] if spec.outcome in spec.codes else ["_y"])
    near = [] if plain or not spec.intercept else far
    flat = centred(flat, by, near, small=is_compressed(keyed))
    w = F.col("_w")
    x0 = {c: F.col(f"{c}0") if c in near else F.lit(0.0) for c in [*names, "_y"]}
    d = {c: F.col(c) - x0[c] for c in x0}

    def cross(a: str, b: str) -> Column:
        """Around the means where an intercept takes the means up; products as they are where none does."""
        if not spec.intercept:
            return F.sum(w * F.col(a) * F.col(b))
        if plain:
            return F.count(F.lit(1)) * F.covar_pop(a, b)
        return F.when(never_varies(F.col(a)) | never_varies(F.col(b)), 0.0).otherwise(weighted_moment(w, d[a], d[b]))

    def mean(a: str) -> Column:
        return plain_mean(F.col(a)) if plain else F.max(x0[a]) + F.try_divide(F.sum(w * d[a]), F.sum(w))

    sums = flat.groupBy(*by).agg(
        row_count(flat, weight, used=True).alias("n"),
        F.sum(w).alias("w"),
        F.array(*(cross(a, b) for i, a in enumerate(names) for b in names[i:])).cast("array<double>").alias("gram"),
        F.array(*(cross(a, "_y") for a in names)).cast("array<double>").alias("xy"),
        (cross("_y", "_y") + sum((F.sum(c) for c in inner_columns(flat)), F.lit(0.0))).alias("yy"),
        F.array(*(mean(a) for a in names)).cast("array<double>").alias("x_mean"),
        mean("_y").alias("y_mean"),
        F.array(*_typical_columns(spec, row_weight(flat))).alias("typical"),
    )
    types = dict(sums.dtypes)
    keys, q = list(by), p - first
    upper = np.triu_indices(q)

    def solve(batch: pd.DataFrame) -> list[list[dict]]:
        """The result rows of each group; all groups of a batch are solved together."""
        m = len(batch)
        gram = np.zeros((m, q, q))
        if q:
            gram[:, *upper] = np.stack(batch["gram"])
        gram = gram + np.transpose(np.triu(gram, 1), (0, 2, 1))
        xy = np.stack(batch["xy"]).astype(float) if q else np.zeros((m, 0))
        yy, n = batch["yy"].to_numpy(float), batch["n"].to_numpy(np.int64)
        df = (n - p).astype(float)
        # on the scale of correlations, rank does not depend on the units of the columns
        scale = np.sqrt(np.einsum("mii->mi", gram))
        usable = np.all(scale > 0, axis=1) & (df > 0)
        scale[scale <= 0] = 1.0
        unit = gram / (scale[:, :, None] * scale[:, None, :])
        unit[~usable] = np.eye(q)
        usable &= np.linalg.eigvalsh(unit).min(axis=1, initial=1.0) > RANK_TOL
        unit[~usable] = np.eye(q)
        inverse = np.linalg.inv(unit) / (scale[:, :, None] * scale[:, None, :])
        beta = np.einsum("mij,mj->mi", inverse, xy)
        s2 = (yy - np.einsum("mi,mi->m", beta, xy)) / np.where(df > 0, df, 1.0)
        out = []
        for k, (typical, total, y_mean) in enumerate(zip(batch["typical"], batch["w"], batch["y_mean"])):
            base = {"n": int(n[k]), "df": df[k]}
            if not usable[k]:
                out.append([base | {"converged": False, "error": "more parameters than the data determines"}])
                continue
            if not (np.isfinite(s2[k]) and s2[k] > 0):
                out.append([base | {"converged": False, "error": "no residual variance"}])
                continue
            theta, vcov = beta[k], inverse[k]
            if first:
                mean = np.asarray(batch["x_mean"].iloc[k], float)
                lean = vcov @ mean
                theta = np.concatenate([[y_mean - mean @ theta], theta])
                vcov = np.block([[np.array([[1 / total + mean @ lean]]), -lean[None, :]], [-lean[:, None], vcov]])
            fitted = Fitted(Linear(spec), [], theta, s2[k] * vcov, np.asarray(typical, float))
            out.append([r | base | {"converged": True} for report in reports for r in report.rows(fitted)])
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = zip(batch[keys].itertuples(index=False, name=None), solve(batch))
                yield result_frame([dict(zip(keys, group)) | r for group, rows in found for r in rows], [*keys, *FIT_NAMES, "df"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), FIT_FIELDS, "df double"])
    return sums.mapInPandas(run, schema)
