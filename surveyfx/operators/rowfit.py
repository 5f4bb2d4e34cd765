"""Maximum-likelihood fits whose rows stay where they are.

Each Newton step of all models and groups still running is one partially aggregated pass over the rows (`rowsums`); the
update of a group's parameters is a small call on its sums. Profile bounds go on in the same way: each bound of each
parameter is a search whose next point comes from the sums at the points before, and one pass serves all searches that
are still open. State is written to the session's shared folder after each pass, so a lost executor costs one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.operators import rowsums
from surveyfx.operators.cells import is_compressed, row_weight
from surveyfx.operators.fit import (
    FAMILIES, FIT_FIELDS, FIT_NAMES, AverageSlope, Coefficients, Fitted, Model, State, advance, bound_search, replay, result_frame, scaled_inverse,
)
from surveyfx.operators.spec import ModelSpec
from surveyfx.sources.scratch import Scratch

STATE = (
    "task int, model int, classes array<int>, n bigint, theta array<double>, candidate array<double>, loglik double, "
    "info array<double>, steps int, status string, error string, typical array<double>"
)
STATE_NAMES = [f.split()[0] for f in STATE.split(", ")]
#: A search for one profile bound: the fit it starts from, and flattened sums at its points so far.
SEARCH = (
    "task int, model int, classes array<int>, theta array<double>, vcov array<double>, loglik double, "
    "parameter int, side int, level double, candidate array<double>, answers array<array<double>>, bound double"
)
SEARCH_NAMES = [f.split()[0] for f in SEARCH.split(", ")]
#: Searches of one model, so that their numbers differ between models.
SEARCHES = 100_000


class Plan:
    """What the models of one call share: the design columns, and each model's place in them."""

    def __init__(self, models: Mapping[str, Model]):
        self.names, self.models = list(models), list(models.values())
        families, outcomes = {m.family for m in self.models}, {tuple(m.spec.ordered) for m in self.models}
        if len(families) > 1 or len(outcomes) > 1:
            raise ValueError("models that share passes need one family and outcome")
        at = {name: i for i, name in enumerate(dict.fromkeys(name for m in self.models for name in m.spec.names()))}
        self.own = [[at[name] for name in m.spec.names()] for m in self.models]
        self.p = len(at)
        self.sums = rowsums.FAMILY_SUMS[self.models[0].family](self.p, outcomes.pop())
        self.families = [FAMILIES[m.family](m.spec) for m in self.models]

    def design(self) -> list[Column]:
        columns = {i: c for own, m in zip(self.own, self.models) for i, c in zip(own, m.spec.design_columns())}
        return [columns[i] for i in range(self.p)]

    def laid_out(self, model: int, theta: np.ndarray, classes: Sequence[int]) -> np.ndarray:
        return rowsums.laid_out(theta, self.sums.slots(self.own[model], classes), self.sums.width)

    def unpack(self, model: int, v: np.ndarray, theta: np.ndarray, classes: Sequence[int]):
        return rowsums.unpack(self.sums, v, self.sums.slots(self.own[model], classes), theta, classes)


def _finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def _numbers(spec: ModelSpec) -> list[str]:
    return [c for c in spec.covariates if c not in spec.levels]


def _typical(spec: ModelSpec, rows: Column) -> list[Column]:
    """`typical_sums` as aggregates: rows, then per covariate its counts per level or its sum."""
    out = [F.sum(rows)]
    for c in spec.covariates:
        if spec.typical_by_mode(c):
            out += [F.sum(F.when(F.col(c) == v, rows).otherwise(0.0)) for v in spec.levels.get(c, spec.codes.get(c))]
        else:
            out.append(F.sum(rows * F.col(c)))
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in out]


def _rows(keyed: DataFrame, plan: Plan, by: Sequence[str], weight: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of all models with the shared design, and per group and outcome class the totals of each model."""
    w = row_weight(keyed, "_weight" if weight else None).cast("double")
    rows_behind = F.col("_n_used" if weight else "_n") if is_compressed(keyed) else F.lit(1)
    columns = list(dict.fromkeys(c for m in plan.models for c in m.spec.covariates))
    flat = keyed.select(*by, *columns, "_y", w.alias("_w"), rows_behind.cast("double").alias("_rows")).dropna(subset=[*by, "_y", "_w"]).where("_w > 0")
    use = [F.lit(True) if not m.spec.covariates else ~F.greatest(*(F.col(c).isNull() for c in m.spec.covariates), F.lit(False)) for m in plan.models]
    flat = flat.withColumn("_use", F.array(*use))

    totals = []
    for k, m in enumerate(plan.models):
        here = F.when(F.get("_use", F.lit(k)), F.col("_rows")).otherwise(0.0)
        bad = [F.coalesce(F.max(F.get("_use", F.lit(k)) & ~_finite(F.col(c))), F.lit(False)) for c in _numbers(m.spec)]
        totals.append(F.struct(
            F.sum(here).cast("bigint").alias("n"), F.sum(F.when(F.get("_use", F.lit(k)), F.col("_w")).otherwise(0.0)).alias("w"),
            F.array(*bad).cast("array<boolean>").alias("bad"), F.array(*_typical(m.spec, here)).alias("typical"),
        ))
    counts = flat.groupBy(*by, "_y").agg(F.array(*totals).alias("totals"))

    # a group with a number that is none, or outside its list, is not fitted by the models that use it
    def known(c: Column) -> Column:
        return F.when(_finite(c), c).otherwise(0.0)

    slopes = {
        f"_d{k}_{i}": known(dict(zip(plan.own[k], m.spec.slope_columns(r.variable))).get(i, F.lit(0.0)))
        for k, m in enumerate(plan.models) for r in m.reports if isinstance(r, AverageSlope) for i in range(plan.p)
    }
    design = {f"_x{i}": known(c) for i, c in enumerate(plan.design())}
    data = flat.select(*by, "_y", "_w", "_rows", "_use", *(c.alias(n) for n, c in {**design, **slopes}.items()))
    return data, counts


def _key_fields(df: DataFrame, by: Sequence[str]) -> str:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"`{k}` {types[k]}" for k in by)


def _packed(by: Sequence[str], key: tuple, rows: list[dict], names: list[str]) -> pd.DataFrame:
    return result_frame([dict(zip(by, key)) | r for r in rows], [*by, *names])


def _state_row(plan: Plan, model: int, classes: list[int], n: int, s: State, typical: Sequence[float]) -> dict:
    return {
        "task": model, "model": model, "classes": classes, "n": n, "theta": list(map(float, s.theta)),
        "candidate": plan.laid_out(model, s.candidate, classes).tolist() if s.status == "run" else list(map(float, s.candidate)),
        "loglik": float(s.loglik), "info": [] if s.info is None else s.info.ravel().tolist(), "steps": s.steps, "status": s.status, "error": s.error,
        "typical": list(map(float, typical)),
    }


def _state(plan: Plan, row: pd.Series) -> tuple[State, list[int]]:
    theta, classes = np.asarray(row["theta"], float), [int(c) for c in row["classes"]]
    info = np.asarray(row["info"], float).reshape(len(theta), -1) if len(row["info"]) else None
    candidate = np.asarray(row["candidate"], float)
    if row["status"] == "run":
        candidate = candidate[plan.sums.slots(plan.own[int(row["model"])], classes)]
    return State(theta, candidate, row["loglik"], info, int(row["steps"]), row["status"], row["error"]), classes


def _newton(data: DataFrame, counts: DataFrame, plan: Plan, by: list[str], scratch: Scratch) -> DataFrame:
    """The state of every model and group once none is running."""
    schema = f"{_key_fields(data, by)}, {STATE}"

    def begin(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_y")
        out = []
        for k, (m, family) in enumerate(zip(plan.models, plan.families)):
            mine = [(int(y), t[k]) for y, t in zip(frame["_y"], frame["totals"])]
            seen = [(y, t) for y, t in mine if t["n"] > 0]
            classes = [y for y, _ in seen]
            n = sum(t["n"] for _, t in seen)
            typical = np.sum([t["typical"] for _, t in seen], axis=0) if seen else np.zeros(0)
            bad = [c for i, c in enumerate(_numbers(m.spec)) if any(t["bad"][i] for _, t in seen)]
            s = State(np.zeros(0), np.zeros(0))
            if bad:
                s.status, s.error = "failed", f"values outside the list of {', '.join(bad)}"
                if any(c not in m.spec.codes for c in bad):
                    s.error = f"values that are no numbers in {', '.join(bad)}"
            elif len(classes) < 2:
                s.status, s.error = "failed", "needs at least two response classes"
            else:
                start = family.start(classes, np.array([t["w"] for _, t in seen]))
                s = State(start, start)
            out.append(_state_row(plan, k, classes, n, s, typical))
        return _packed(by, key, out, STATE_NAMES)

    def update(key: tuple, sums: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        row = old.iloc[0]
        s, classes = _state(plan, row)
        model = int(row["model"])
        if len(sums):
            answer = plan.unpack(model, np.asarray(sums["v"].iloc[0], float), s.candidate, classes)
            s = advance(s, *answer, plan.models[model].max_steps, plan.models[model].tolerance)
        return _packed(by, key[:-1], [_state_row(plan, model, classes, int(row["n"]), s, row["typical"])], STATE_NAMES)

    state = scratch.stored(counts.groupBy(*by).applyInPandas(begin, schema), "step-0")
    step = 0
    while not (running := state.where("status = 'run'")).isEmpty():
        sums = rowsums.newton_sums(data, running, by, plan.sums)
        updated = sums.groupBy(*by, "task").cogroup(state.groupBy(*by, "task")).applyInPandas(update, schema)
        step += 1
        state = scratch.stored(updated, f"step-{step}")
        scratch.remove(f"step-{step - 1}")
    return state


def _bounds(data: DataFrame, state: DataFrame, plan: Plan, by: list[str], scratch: Scratch) -> DataFrame | None:
    """(by, model, parameter, side, bound) of all profile bounds that the models report."""
    wanted = [[r for r in m.reports if isinstance(r, Coefficients) and r.profile] for m in plan.models]
    if not any(wanted):
        return None
    schema = f"{_key_fields(data, by)}, {SEARCH}"

    def point(row: dict | pd.Series, answers: list[list[float]]) -> dict:
        """The next point of a search, or its result, from the sums at the points before."""
        theta, model, classes = np.asarray(row["theta"], float), int(row["model"]), [int(c) for c in row["classes"]]
        vcov, p = np.asarray(row["vcov"], float).reshape(len(theta), -1), len(theta)
        m = plan.models[model]
        search = bound_search(theta, vcov, row["loglik"], int(row["parameter"]), int(row["side"]), row["level"], m.max_steps, m.tolerance)
        known = [(a[0], np.array(a[1 : p + 1]), np.array(a[p + 1 :]).reshape(p, p)) for a in answers]
        at, bound = replay(search, known)
        candidate = None if at is None else plan.laid_out(model, at, classes).tolist()
        return {"candidate": candidate, "answers": answers, "bound": None if bound is None else float(bound)}

    def begin(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in frame.iterrows():
            s, classes = _state(plan, row)
            model = int(row["model"])
            if s.status != "ok":
                continue
            vcov = scaled_inverse(s.info)
            names = plan.families[model].names(classes)
            for r in wanted[model]:
                for k, name in enumerate(names):
                    if r.only and name not in r.only:
                        continue
                    for side in (-1, 1):
                        base = {
                            "task": model * SEARCHES + 2 * k + (side > 0), "model": model, "classes": classes, "theta": s.theta.tolist(), "vcov": vcov.ravel().tolist(),
                            "loglik": float(s.loglik), "parameter": k, "side": side, "level": r.level,
                        }
                        out.append(base | point(base, []))
        return _packed(by, key, out, SEARCH_NAMES)

    def update(key: tuple, sums: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        row = old.iloc[0].to_dict()
        classes = [int(c) for c in row["classes"]]
        answers = [list(a) for a in row["answers"]]
        if len(sums):
            model = int(row["model"])
            at = np.asarray(row["candidate"], float)[plan.sums.slots(plan.own[model], classes)]
            loglik, score, info = plan.unpack(model, np.asarray(sums["v"].iloc[0], float), at, classes)
            row |= point(row, [*answers, [loglik, *score, *info.ravel()]])
        plain = {c: row[c] for c in SEARCH_NAMES}
        return _packed(by, key[:-1], [plain], SEARCH_NAMES)

    found = scratch.stored(state.groupBy(*by).applyInPandas(begin, schema), "bounds-0")
    step = 0
    while not (running := found.where("candidate is not null")).isEmpty():
        sums = rowsums.newton_sums(data, running, by, plan.sums)
        updated = sums.groupBy(*by, "task").cogroup(found.groupBy(*by, "task")).applyInPandas(update, schema)
        step += 1
        found = scratch.stored(updated, f"bounds-{step}")
        scratch.remove(f"bounds-{step - 1}")
    return found.groupBy(*by, "model").agg(F.collect_list(F.struct("parameter", "side", "bound")).alias("bounds"))


def _slopes(data: DataFrame, state: DataFrame, plan: Plan, by: list[str]) -> DataFrame | None:
    """(by, model, v): the sums of the average slopes."""
    models = [k for k, m in enumerate(plan.models) if any(isinstance(r, AverageSlope) for r in m.reports)]
    if not models:
        return None
    width = plan.sums.width

    def at(batches):
        for frame in batches:
            full = [plan.laid_out(int(m), np.asarray(t, float), [int(c) for c in cl]).tolist() if s == "ok" else [0.0] * width for m, t, cl, s in zip(frame["model"], frame["theta"], frame["classes"], frame["status"])]
            yield frame[[*by, "task", "model", "classes"]].assign(candidate=full)

    fitted = state.where((F.col("status") == "ok") & F.col("model").isin(models))
    tasks = fitted.mapInPandas(at, f"{_key_fields(data, by)}, task int, model int, classes array<int>, candidate array<double>")
    sums = rowsums.slope_sums(data, tasks, by, plan.p, models)
    return sums.select(*by, F.col("task").alias("model"), "v")


def fit_rows(keyed: DataFrame, models: Mapping[str, Model], by: Sequence[str], weight: bool) -> DataFrame:
    """Columns: `by`, `model`, FIT_FIELDS. `keyed` holds the projected columns of all models."""
    by, plan = list(by), Plan(models)
    scratch = Scratch(keyed.sparkSession, "fit")
    data, counts = _rows(keyed, plan, by, weight)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        state = _newton(data, counts, plan, by, scratch)
        bounds = _bounds(data, state, plan, by, scratch)
        slopes = _slopes(data, state, plan, by)
        done = state
        if bounds is not None:
            done = done.join(bounds, [*by, "model"], "left")
        if slopes is not None:
            done = done.join(slopes, [*by, "model"], "left")
        done = scratch.stored(done, "done")
    finally:
        data.unpersist()

    def finish(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in frame.iterrows():
            s, classes = _state(plan, row)
            model = int(row["model"])
            m, fitted = plan.models[model], None
            if s.status == "ok":
                sums = np.asarray(row["typical"], float)
                if row.get("v") is not None and any(isinstance(r, AverageSlope) for r in m.reports):
                    v = np.asarray(row["v"], float)
                    sums = np.concatenate([sums, v[:2], v[2:][plan.own[model]]])
                bounds = {(b["parameter"], b["side"]): np.nan if b["bound"] is None else b["bound"] for b in (row["bounds"] if row.get("bounds") is not None else [])}
                fitted = Fitted(plan.families[model], classes, s.theta, scaled_inverse(s.info), sums, None, s.loglik, bounds=bounds)
            out += [{"model": plan.names[model]} | r for r in m.rows(s, fitted, int(row["n"]))]
        return _packed(by, key, out, ["model", *FIT_NAMES])

    return done.groupBy(*by).applyInPandas(finish, f"{_key_fields(data, by)}, model string, {FIT_FIELDS}")
