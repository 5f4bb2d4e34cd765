"""Cell totals: the sufficient statistics every estimator here starts from.

A survey model has coded covariates, so the rows of one covariate pattern only matter through their count, weight sum
and outcome sums. One partially aggregated groupBy therefore replaces the respondents: map-side combine leaves at most
(cells × tasks) rows to shuffle, however large or skewed the questions are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyfx.sources.scratch import Scratch

COUNTS = ("_n", "_n_known", "_n_used")
#: Metadata of a column that counts the rows behind each row.
MARK = {"surveyfx.counts": "rows"}
#: Metadata key of a column that counts the rows behind a moment state; its value lists the measures of the state.
STATE = "surveyfx.state"


def compress(rows: DataFrame, keys: Sequence[str], weight: str | None = None, measures: Sequence[str | tuple[str, ...]] = ()) -> DataFrame:
    """Rows reduced to one per combination of coded columns, for any number of later analyses.

    Missing codes are kept as codes of their own, since every analysis has its own complete cases. The weight column
    keeps its name and holds the weight sum; `_n`, `_n_known` and `_n_used` count rows, rows with a weight and rows
    with a non-zero weight. The operators recognise the frame by the mark that `_n` carries and give the same results
    as on the rows: whatever they use is computed from the keys, as no other column is left.

    `measures` are columns of any values. Each, or each tuple of them, leaves a moment state per cell: rows, weight, means
    and centred second moments of the rows where all its columns are known. States merge exactly, so Welch tests and
    least squares on a measure (or a pair, for an outcome and a control) give what they would on the rows.
    """
    w = F.col(weight) if weight else F.lit(1)
    aggs = [F.count(F.lit(1)).alias("_n", metadata=MARK), F.count(w).alias("_n_known"), F.count_if(w != 0).alias("_n_used")]
    states = [(m,) if isinstance(m, str) else tuple(m) for m in measures]
    columns = list(dict.fromkeys(c for m in states for c in m))
    flat = rows.select(*keys, *([weight] if weight else []), *(F.col(c).cast("double").alias(c) for c in columns))
    flat = centred(flat, keys, columns if weight else [])
    for k, names in enumerate(states):
        aggs += _state(f"_s{k}", names, weight)
    return flat.groupBy(*keys).agg(*([F.sum(weight).alias(weight)] if weight else []), *aggs)


def _state(name: str, measures: Sequence[str], weight: str | None) -> list[Column]:
    known = F.greatest(*(F.col(c).isNull() for c in [*measures, *([weight] if weight else [])]), F.lit(False)) == F.lit(False)
    pairs = [(a, b) for a in range(len(measures)) for b in range(a, len(measures))]
    n = F.count_if(known)
    if weight is None:
        x = [F.when(known, F.col(c)) for c in measures]
        w, used = n.cast("double"), n
        means, moments = [plain_mean(c) for c in x], [n * F.covar_pop(x[a], x[b]) for a, b in pairs]
    else:
        v = F.when(known, F.col(weight).cast("double"))
        d = [F.col(c) - F.col(f"{c}0") for c in measures]
        w, used = F.sum(v), F.count_if(known & (F.col(weight) != 0))
        means = [F.max(f"{c}0") + F.try_divide(F.sum(v * x), F.sum(v)) for c, x in zip(measures, d)]
        still = [F.min(F.when(known, F.col(c))) == F.max(F.when(known, F.col(c))) for c in measures]
        moments = [F.when(still[a] | still[b], 0.0).otherwise(weighted_moment(v, d[a], d[b])) for a, b in pairs]
    return [
        n.alias(f"{name}_n", metadata={STATE: list(measures)}), used.alias(f"{name}_used"), w.alias(f"{name}_w"),
        *(c.alias(f"{name}_mean{a}") for a, c in enumerate(means)), *(c.alias(f"{name}_m{a}{b}") for (a, b), c in zip(pairs, moments)),
    ]


def state_of(rows: DataFrame, measures: Sequence[str]) -> str | None:
    """Name of the moment state of exactly these measures."""
    for f in rows.schema.fields:
        if STATE in f.metadata and sorted(f.metadata[STATE]) == sorted(measures):
            return f.name[: -len("_n")]
    return None


def from_state(rows: DataFrame, measures: Sequence[str], weight: str | None) -> DataFrame:
    """A compressed frame in which each measure stands at its cell's mean; `_inner{a}{b}` holds the moments within cells."""
    name = state_of(rows, measures)
    order = next(f.metadata[STATE] for f in rows.schema.fields if f.name == f"{name}_n")
    at = {c: order.index(c) for c in measures}
    own = [f.name for f in rows.schema.fields if not f.name.startswith("_") and f.name not in measures and f.name != weight]
    pairs = [(a, b) for a in range(len(measures)) for b in range(a, len(measures))]
    inner = {f"_inner{a}{b}": "{}_m{}{}".format(name, *sorted((at[measures[a]], at[measures[b]]))) for a, b in pairs}
    return rows.where(F.col(f"{name}_n") > 0).select(
        *own, *(F.col(f"{name}_mean{at[c]}").alias(c) for c in measures), *([F.col(f"{name}_w").alias(weight)] if weight else []),
        F.col(f"{name}_n").alias("_n", metadata=MARK), F.col(f"{name}_n").alias("_n_known"), F.col(f"{name}_used").alias("_n_used"),
        *(F.col(c).alias(k) for k, c in inner.items()),
    )


def is_compressed(rows: DataFrame) -> bool:
    return is_marked(rows, "_n")


def is_marked(df: DataFrame, column: str) -> bool:
    """Whether a column counts rows of a reduction made here; a column that only has the name does not."""
    return any(f.name == column and MARK.items() <= f.metadata.items() for f in df.schema.fields)


def count_columns(rows: DataFrame) -> list[str]:
    """The count columns (and moments within cells) to carry through a projection."""
    return [*COUNTS, *inner_columns(rows)] if is_compressed(rows) else []


def inner_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("_inner")]


def row_count(rows: DataFrame, weight: str | None = None, used: bool = False) -> Column:
    """Aggregate: rows behind the current group; with a weight, those where it is known (or non-zero, when `used`)."""
    if is_compressed(rows):
        return F.sum("_n" if weight is None else "_n_used" if used else "_n_known")
    if used and weight:
        return F.count_if(F.col(weight) != 0)
    return F.count(weight if weight else F.lit(1))


def count_where(rows: DataFrame, cond: Column) -> Column:
    """Aggregate: rows behind the current group that meet a condition."""
    if is_compressed(rows):
        return F.sum(F.when(cond, F.col("_n")).otherwise(0))
    return F.count_if(cond)


def row_weight(rows: DataFrame, weight: str | None = None) -> Column:
    """Weight of the current row (a cell's weight sum or row count on compressed input)."""
    if weight:
        return F.col(weight)
    return F.col("_n") if is_compressed(rows) else F.lit(1)


def cell_totals(rows: DataFrame, keys: Sequence[str], weight: str | None = None, complete: bool = True) -> DataFrame:
    """Rows (`n`), rows with a non-zero weight (`n_used`) and weight (`w`) per complete combination of `keys`.

    Rows with a missing key, or a missing weight when one is used, are dropped as a model fit would drop them. Without
    a weight every row weighs one. Weights are summed in their own type: decimal weights give totals that do not
    depend on the order of the rows. `complete=False` keeps missing keys as cells of their own. The weight is never a
    key, or its distinct values would multiply the cells.
    """
    needed = [*keys, *([weight] if weight else [])]
    out = (rows.dropna(subset=needed) if complete else rows).groupBy(*keys)
    if weight is None:
        return out.agg(row_count(rows).alias("n", metadata=MARK)).withColumns({"n_used": F.col("n"), "w": F.col("n").cast("double")})
    return out.agg(
        row_count(rows, weight).alias("n", metadata=MARK),
        row_count(rows, weight, used=True).alias("n_used"),
        F.sum(weight).cast("double").alias("w"),
    )


def centred(flat: DataFrame, keys: Sequence[str], columns: Sequence[str], small: bool = False) -> DataFrame:
    """Rows with `{column}0`, the plain mean of each column in the row's group, as a point near which to take moments.

    The means are a table of one row per group, stored first, so that the planner sees its size: it broadcasts a small
    one, and otherwise joins as it would any two tables. Only keys, columns and the partial means are read for it.
    `small` says that a group has few rows (cells), whose mean a window gives in the same pass.
    """
    if not columns:
        return flat
    if small:
        return flat.withColumns({f"{c}0": F.avg(c).over(Window.partitionBy(*keys)) for c in columns})
    names = {k: f"_{i}_key" for i, k in enumerate(keys)}
    means = flat.groupBy(*(F.col(k).alias(n) for k, n in names.items())).agg(*(F.avg(c).alias(f"{c}0") for c in columns))
    means = Scratch(flat.sparkSession, "centres").stored(means, "means")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()], F.lit(True))
    return flat.join(means, same).drop(*names.values())


def weighted_moment(w: Column, a: Column, b: Column) -> Column:
    """Aggregate: Σ w (a − ā)(b − b̄) around the weighted means, of columns that are already taken near their means."""
    return F.sum(w * a * b) - F.try_divide(F.sum(w * a) * F.sum(w * b), F.sum(w))


def plain_mean(a: Column) -> Column:
    """Aggregate: mean of a column of any size. Summed in two parts, the leading digits and the rest, so that the running
    sum does not swallow the digits in which values far from zero differ."""
    lead = F.when(F.abs(a) < 1e38, a.cast("float").cast("double")).otherwise(a)
    return F.avg(lead) + F.avg(a - lead)


def never_varies(a: Column) -> Column:
    return F.min(a) == F.max(a)


def moments(
    rows: DataFrame, keys: Sequence[str], outcome: str, weight: str | None = None, control: str | None = None, coded: bool = False
) -> DataFrame:
    """Weighted mean and centred second moments of `outcome` (and of one additive `control`) per combination of `keys`.

    Columns: `n` (rows with a non-zero weight), `w`, `mean`, `cyy` and, with a control s, `smean`, `css`, `csy`.

    Nothing cancels however large the values are beside their spread, and a column that never varies gives exactly
    zero. Without weights, built-in co-moments are centred and merge stably. With weights, moments are taken around a
    point near the group's mean: `coded` columns, whose few values are the cells of one aggregation, get theirs from
    those cells in the same pass; for any others a pass for the group means comes first.
    """
    if state_of(rows, measured := [outcome, *([control] if control else [])]):
        rows, coded = from_state(rows, measured, weight), True
    needed = [*keys, outcome, *([weight] if weight else []), *([control] if control else [])]
    kept = rows.dropna(subset=needed)
    y, s = F.col(outcome).cast("double"), F.col(control).cast("double") if control else None
    if weight is None and not is_compressed(rows):
        n = F.count(F.lit(1))
        sums = {"w": n.cast("double"), "mean": plain_mean(y), "cyy": n * F.var_pop(y)}
        if control:
            sums |= {"smean": plain_mean(s), "css": n * F.var_pop(s), "csy": n * F.covar_pop(s, y)}
        return kept.groupBy(*keys).agg(n.alias("n"), *(e.alias(k) for k, e in sums.items()))

    if is_compressed(rows):
        used = F.col("_n_used" if weight else "_n")
    else:
        used = (F.col(weight) != 0).cast("bigint")
    near = ["_y", *(["_s"] if control else [])]
    inner = inner_columns(rows)
    flat = kept.select(*keys, row_weight(rows, weight).alias("_w"), used.alias("_used"), y.alias("_y"), *([s.alias("_s")] if control else []), *inner)
    if coded:
        flat = flat.groupBy(*keys, *near).agg(*(F.sum(c).alias(c) for c in ("_w", "_used", *inner)))
    flat = centred(flat, keys, near, small=coded)
    w, dy = F.col("_w").cast("double"), F.col("_y") - F.col("_y0")
    mean = {c: F.max(f"{c}0") + F.try_divide(F.sum(w * (F.col(c) - F.col(f"{c}0"))), F.sum(w)) for c in near}
    still = {c: never_varies(F.col(c)) for c in near}
    sums = {"w": F.sum(w), "mean": mean["_y"], "cyy": F.when(still["_y"], 0.0).otherwise(weighted_moment(w, dy, dy))}
    if control:
        ds = F.col("_s") - F.col("_s0")
        sums |= {
            "smean": mean["_s"],
            "css": F.when(still["_s"], 0.0).otherwise(weighted_moment(w, ds, ds)),
            "csy": F.when(still["_s"] | still["_y"], 0.0).otherwise(weighted_moment(w, ds, dy)),
        }
    for k, within in {"cyy": "_inner00", "csy": "_inner01", "css": "_inner11"}.items():
        if k in sums and within in inner:
            sums[k] = sums[k] + F.sum(within)
    return flat.groupBy(*keys).agg(F.sum("_used").alias("n"), *(e.alias(k) for k, e in sums.items()))
