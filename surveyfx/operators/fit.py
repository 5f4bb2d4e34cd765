"""Maximum-likelihood fits per group: binary, cumulative (ordinal) and multinomial logit.

Newton's method needs three sums per step: log-likelihood, score and information. They are additive over rows, which
allows two execution shapes:

* closed covariate lists: rows are reduced to cell totals in one distributed aggregation, and every group's cells (a
  number bounded by the specification, whatever the data size) are fitted in one `applyInPandas` call;
* open covariates: the rows stay where they are; each step of all models and groups is one partially aggregated pass of
  built-in sums over them and a small update (`rowfit`). Only sums and coefficients move.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Generator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyfx.functions.dist import normal_quantile
from surveyfx.operators.cells import cell_totals, count_columns, is_compressed, is_marked
from surveyfx.operators.spec import ModelSpec

MAX_STEPS = 50
#: A fit has settled when a step would raise the log-likelihood by less than this share of its size.
TOLERANCE = 1e-20

FIT_FIELDS = (
    "subgroup string, term string, estimate double, std_error double, conf_low double, conf_high double, "
    "n bigint, loglik double, converged boolean, error string"
)


FIT_NAMES = tuple(f.split()[0] for f in FIT_FIELDS.split(", "))


# ---- likelihoods --------------------------------------------------------------------------------------------------

def _expit(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


class Linear:
    """Least squares; solved from moments, see `linear.fit_linear`."""

    def __init__(self, spec: ModelSpec):
        self.spec = spec

    def names(self, classes: Sequence[int]) -> list[str]:
        return self.spec.names()


class Logit:
    """0/1 outcome."""

    def __init__(self, spec: ModelSpec):
        self.spec = spec

    def names(self, classes: Sequence[int]) -> list[str]:
        return self.spec.names()

    def start(self, classes: Sequence[int], class_weights: np.ndarray) -> np.ndarray:
        return np.zeros(len(self.spec.names()))

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, classes: Sequence[int]):
        eta = x @ theta
        mu = _expit(eta)
        loglik = float(np.sum(w * (y * eta - np.logaddexp(0.0, eta))))
        return loglik, x.T @ (w * (y - mu)), (x * (w * mu * (1 - mu))[:, None]).T @ x


class Ordinal:
    """Ranked outcome: logit P(Y ≤ j) = threshold_j − xβ over the classes observed in the group."""

    def __init__(self, spec: ModelSpec):
        self.spec = spec

    def names(self, classes: Sequence[int]) -> list[str]:
        labels = list(self.spec.ordered.values())
        cuts = [f"{labels[a - 1]}|{labels[b - 1]}" for a, b in zip(classes, classes[1:])]
        return cuts + self.spec.names()

    def start(self, classes: Sequence[int], class_weights: np.ndarray) -> np.ndarray:
        below = np.cumsum(class_weights)[:-1] / np.sum(class_weights)
        return np.concatenate([np.log(below / (1 - below)), np.zeros(len(self.spec.names()))])

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, classes: Sequence[int]):
        cuts = len(classes) - 1
        rank = np.searchsorted(np.asarray(classes), y)
        if np.any(np.diff(theta[:cuts]) <= 0):
            return -math.inf, np.zeros(len(theta)), np.eye(len(theta))
        edge = np.concatenate([[-math.inf], theta[:cuts], [math.inf]])
        eta = x @ theta[cuts:]
        upper, lower = _expit(edge[rank + 1] - eta), _expit(edge[rank] - eta)
        upper[rank == cuts], lower[rank == 0] = 1.0, 0.0
        p = np.maximum(upper - lower, 1e-300)
        fu, fl = upper * (1 - upper), lower * (1 - lower)
        # each row moves with two linear predictors: its upper and its lower threshold minus xβ
        eye = np.vstack([np.eye(cuts), np.zeros((1, cuts))])
        a = np.hstack([eye[rank], -x])
        b = np.hstack([eye[rank - 1], -x])
        da, db = fu / p, -fl / p
        haa = fu * (1 - 2 * upper) / p - da * da
        hbb = -fl * (1 - 2 * lower) / p - db * db
        hab = -da * db
        score = a.T @ (w * da) + b.T @ (w * db)
        cross = (a * (w * hab)[:, None]).T @ b
        hess = (a * (w * haa)[:, None]).T @ a + (b * (w * hbb)[:, None]).T @ b + cross + cross.T
        return float(np.sum(w * np.log(p))), score, -hess


class Softmax:
    """Unordered classes: log-odds of each observed class against the first one observed."""

    def __init__(self, spec: ModelSpec):
        self.spec = spec

    def labels(self, classes: Sequence[int]) -> list[str]:
        known = list(self.spec.ordered.values())
        return [known[c - 1] for c in classes]

    def names(self, classes: Sequence[int]) -> list[str]:
        return [f"{label}:{name}" for label in self.labels(classes)[1:] for name in self.spec.names()]

    def start(self, classes: Sequence[int], class_weights: np.ndarray) -> np.ndarray:
        return np.zeros((len(classes) - 1) * len(self.spec.names()))

    def probabilities(self, x: np.ndarray, theta: np.ndarray) -> np.ndarray:
        eta = x @ theta.reshape(-1, x.shape[1]).T
        eta = np.column_stack([np.zeros(len(x)), eta])
        e = np.exp(eta - eta.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def sums(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, theta: np.ndarray, classes: Sequence[int]):
        p = self.probabilities(x, theta)
        rank = np.searchsorted(np.asarray(classes), y)
        loglik = float(np.sum(w * np.log(np.maximum(p[np.arange(len(x)), rank], 1e-300))))
        off = w[:, None] * ((rank[:, None] == np.arange(1, len(classes))) - p[:, 1:])
        k = len(classes) - 1
        curve = w[:, None, None] * p[:, 1:, None] * (np.eye(k) - p[:, None, 1:])
        info = np.einsum("nkl,ni,nj->kilj", curve, x, x)
        return loglik, (off.T @ x).ravel(), info.reshape(k * x.shape[1], -1)


FAMILIES = {"logit": Logit, "ordinal": Ordinal, "multinomial": Softmax}


# ---- Newton as a state machine ------------------------------------------------------------------------------------

@dataclass
class State:
    """Last accepted point, next candidate, and status: run, ok or failed."""

    theta: np.ndarray
    candidate: np.ndarray
    loglik: float = -math.inf
    info: np.ndarray | None = None
    steps: int = 0
    status: str = "run"
    error: str | None = None


def scaled_inverse(info: np.ndarray) -> np.ndarray:
    """Inverse of an information matrix, taken on the scale where its diagonal is one."""
    d = np.sqrt(np.diag(info))
    if not np.all(d > 0):
        raise np.linalg.LinAlgError("no information on a parameter")
    return np.linalg.inv(info / np.outer(d, d)) / np.outer(d, d)


def advance(s: State, loglik: float, score: np.ndarray, info: np.ndarray, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> State:
    """One update from the sums at the candidate: accept and step on, or halve the step.

    The size of a step is its Newton decrement, which depends on the units of neither covariates nor weights.
    """
    s.steps += 1
    if s.steps > max_steps:
        s.status, s.error = "failed", "no convergence"
    elif not math.isfinite(loglik) or loglik < s.loglik - 1e-9 * abs(s.loglik) and math.isfinite(s.loglik):
        s.candidate = (s.theta + s.candidate) / 2
    else:
        s.theta, s.loglik, s.info = s.candidate, loglik, info
        try:
            step = scaled_inverse(info) @ score
        except np.linalg.LinAlgError:
            s.status, s.error = "failed", "singular information"
            return s
        s.candidate = s.theta + step
        if not np.all(np.isfinite(step)):
            s.status, s.error = "failed", "singular information"
        elif abs(float(score @ step)) <= tolerance * abs(loglik):
            s.theta, s.status = s.candidate, "ok"
    return s


#: A search yields the point at which it wants the sums, is sent them, and returns its result.
Search = Generator[np.ndarray, tuple[float, np.ndarray, np.ndarray], object]


def newton_search(start: np.ndarray, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> Search:
    s = State(start, start)
    while s.status == "run":
        s = advance(s, *(yield s.candidate), max_steps, tolerance)
    return s


def solved(search: Search, evaluate: Callable[[np.ndarray], tuple]):
    """Run a search where the sums are at hand."""
    try:
        at = next(search)
        while True:
            at = search.send(evaluate(at))
    except StopIteration as done:
        return done.value


def replay(search: Search, answers: Sequence[tuple]) -> tuple[np.ndarray | None, object]:
    """The point a search wants next after the answers so far, or its result. A search needs no other memory, so one
    that waits for a pass over the rows is kept as its answers."""
    try:
        at = next(search)
        for answer in answers:
            at = search.send(answer)
        return at, None
    except StopIteration as done:
        return None, done.value


def newton(evaluate: Callable[[np.ndarray], tuple], start: np.ndarray, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> State:
    return solved(newton_search(start, max_steps, tolerance), evaluate)


# ---- fitted model and reports -------------------------------------------------------------------------------------

@dataclass
class Fitted:
    """What a report may use. `sums` is `report_sums` added up over the rows, so both execution shapes can supply it;
    profile bounds come from `evaluate` or, where they were found before, from `bounds` by parameter and side."""

    family: Logit | Ordinal | Softmax | Linear
    classes: list[int]
    theta: np.ndarray
    vcov: np.ndarray
    sums: np.ndarray | None = None
    evaluate: Callable | None = None
    loglik: float = math.nan
    max_steps: int = MAX_STEPS
    tolerance: float = TOLERANCE
    bounds: Mapping[tuple[int, int], float] | None = None

    def se(self, gradient: np.ndarray) -> float:
        return math.sqrt(float(gradient @ self.vcov @ gradient))


@dataclass(frozen=True)
class Coefficients:
    """Coefficient table; `profile` replaces Wald bounds by profile-likelihood bounds."""

    profile: bool = False
    level: float = 0.95
    only: tuple[str, ...] | None = None

    def rows(self, fit: Fitted) -> list[dict]:
        out = []
        for k, name in enumerate(fit.family.names(fit.classes)):
            if self.only and name not in self.only:
                continue
            row = {"term": name, "estimate": fit.theta[k], "std_error": math.sqrt(fit.vcov[k, k])}
            if self.profile:
                row["conf_low"], row["conf_high"] = profile_bounds(fit, k, self.level)
            out.append(row)
        return out


@dataclass(frozen=True)
class Contrast:
    """Effect of `treat` 0 → 1 at each level of `by`, other covariates at their typical value (or `at`)."""

    treat: str
    by: str
    at: dict = field(default_factory=dict)
    scale: str = "response"

    def rows(self, fit: Fitted) -> list[dict]:
        spec = fit.family.spec
        base = typical_values(spec, fit.sums) | self.at
        levels = spec.levels.get(self.by, spec.codes.get(self.by))
        out = []
        for level in levels:
            grid = pd.DataFrame([base | {self.by: level, self.treat: t} for t in (0.0, 1.0)])
            x = spec.matrix(grid)
            eta = x @ fit.theta
            if self.scale == "link":
                value, slope = eta, np.ones(2)
            else:
                value = _expit(eta)
                slope = value * (1 - value)
            gradient = slope[1] * x[1] - slope[0] * x[0]
            out.append({"subgroup": str(level), "term": self.treat, "estimate": value[1] - value[0], "std_error": fit.se(gradient)})
        return out


@dataclass(frozen=True)
class AverageSlope:
    """Average over rows of the derivative of the fitted probability, each row counting once whatever its weight."""

    variable: str

    def sums(self, spec: ModelSpec, frame: pd.DataFrame, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
        x, d = spec.matrix(frame), spec.slope_matrix(frame, self.variable)
        mu = _expit(x @ theta)
        v, eta_slope = mu * (1 - mu), d @ theta
        gradient = (n * v * (1 - 2 * mu) * eta_slope) @ x + (n * v) @ d
        return np.concatenate([[np.sum(n), np.sum(n * v * eta_slope)], gradient])

    def rows(self, fit: Fitted) -> list[dict]:
        total, slope, *rest = fit.sums[typical_width(fit.family.spec) :]
        gradient = np.asarray(rest)
        return [{"term": f"slope({self.variable})", "estimate": slope / total, "std_error": fit.se(gradient / total)}]


@dataclass(frozen=True)
class Probabilities:
    """Probability of each class of a multinomial fit with `treat` at 0 and at 1, and the change between them; other
    covariates at their typical value (or `at`)."""

    treat: str
    at: dict = field(default_factory=dict)

    def rows(self, fit: Fitted) -> list[dict]:
        spec = fit.family.spec
        base = typical_values(spec, fit.sums) | self.at
        x = spec.matrix(pd.DataFrame([base | {self.treat: t} for t in (0.0, 1.0)]))
        p = fit.family.probabilities(x, fit.theta)
        k = np.arange(len(fit.classes))
        # ∂p_c / ∂β_d = p_c (1[c = d] − p_d) x
        slope = [(p[t, :, None] * ((k[:, None] == k[None, 1:]) - p[t, None, 1:]))[:, :, None] * x[t] for t in (0, 1)]
        slope = [g.reshape(len(k), -1) for g in slope]
        out = []
        for c, label in enumerate(fit.family.labels(fit.classes)):
            parts = ((f"{self.treat}=0", p[0, c], slope[0][c]), (f"{self.treat}=1", p[1, c], slope[1][c]), (self.treat, p[1, c] - p[0, c], slope[1][c] - slope[0][c]))
            out += [{"subgroup": label, "term": term, "estimate": value, "std_error": fit.se(gradient)} for term, value, gradient in parts]
        return out


Report = Coefficients | Contrast | AverageSlope | Probabilities


@dataclass(frozen=True)
class Model:
    """A specification, its family ("logit", "ordinal" or "multinomial") and what to report of the fit."""

    spec: ModelSpec
    family: str
    reports: tuple[Report, ...]
    max_steps: int = MAX_STEPS
    tolerance: float = TOLERANCE

    @property
    def level(self) -> float | None:
        """Confidence level of profile bounds, if the model reports any."""
        return next((r.level for r in self.reports if isinstance(r, Coefficients) and r.profile), None)

    def report_sums(self, frame: pd.DataFrame, n: np.ndarray, theta: np.ndarray) -> np.ndarray:
        """Typical-value sums, followed by the sums of an average slope when one is reported."""
        slopes = [r.sums(self.spec, frame, n, theta) for r in self.reports if isinstance(r, AverageSlope)]
        return np.concatenate([typical_sums(self.spec, frame, n), *slopes[:1]])

    def rows(self, s: State, fit: Fitted | None, n: int) -> list[dict]:
        if s.status != "ok":
            return [{"n": n, "converged": False, "error": s.error}]
        shared = {"n": n, "loglik": s.loglik, "converged": True}
        return [row | shared for r in self.reports for row in r.rows(fit)]


def typical_sums(spec: ModelSpec, frame: pd.DataFrame, n: np.ndarray) -> np.ndarray:
    """Row count, then per covariate its counts per level (mode rule) or its sum (mean rule)."""
    parts = [np.array([np.sum(n)])]
    for c in spec.covariates:
        values = frame[c].to_numpy()
        if spec.typical_by_mode(c):
            parts.append(np.array([np.sum(n[values == lv]) for lv in spec.levels.get(c, spec.codes.get(c))]))
        else:
            parts.append(np.array([np.sum(n * values.astype(float))]))
    return np.concatenate(parts)


def typical_width(spec: ModelSpec) -> int:
    return 1 + sum(len(spec.levels.get(c, spec.codes.get(c))) if spec.typical_by_mode(c) else 1 for c in spec.covariates)


def typical_values(spec: ModelSpec, sums: np.ndarray) -> dict:
    """Mode for categories and 0/1 codes (first listed on a tie), mean for other numbers."""
    out, at = {}, 1
    for c in spec.covariates:
        if spec.typical_by_mode(c):
            choices = spec.levels.get(c, spec.codes.get(c))
            out[c] = choices[int(np.argmax(sums[at : at + len(choices)]))]
            at += len(choices)
        else:
            out[c] = sums[at] / sums[0]
            at += 1
    return out


def bound_search(
    top: np.ndarray, vcov: np.ndarray, loglik: float, k: int, side: int, level: float, max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE
) -> Search:
    """Search for the value of parameter k, below (-1) or above (1) its estimate, where the likelihood, maximised over
    the other parameters, has dropped by the χ² quantile / 2."""
    z, se = normal_quantile(level), math.sqrt(vcov[k, k])
    free = np.arange(len(top)) != k

    def excess(value: float, warm: np.ndarray) -> Generator:
        search = newton_search(warm, max_steps, tolerance)
        try:
            rest = next(search)
            while True:
                theta = np.empty(len(top))
                theta[free], theta[k] = rest, value
                at, score, info = yield theta
                rest = search.send((at, score[free], info[np.ix_(free, free)]))
        except StopIteration as done:
            s = done.value
        if s.status != "ok":
            return math.nan, warm
        return math.sqrt(max(2 * (loglik - s.loglik), 0.0)) - z, s.theta

    near, far, rest = top[k], top[k] + side * z * se, top[free] + side * z * vcov[free, k] / se
    f_near, (f_far, rest) = -z, (yield from excess(far, rest))
    while f_far < 0:
        near, f_near, far = far, f_far, far + side * z * se / 2
        f_far, rest = yield from excess(far, rest)
    if math.isnan(f_far):
        return math.nan
    for _ in range(60):  # secant inside the bracket; the root of the deviance is close to linear
        mid = near + (far - near) * -f_near / (f_far - f_near)
        f_mid, rest = yield from excess(mid, rest)
        if math.isnan(f_mid) or abs(f_mid) < 1e-11:
            return mid if not math.isnan(f_mid) else math.nan
        if f_mid < 0:
            near, f_near, f_far = mid, f_mid, f_far / 2
        else:
            far, f_far, f_near = mid, f_mid, f_near / 2
    return math.nan  # a bound that was not reached is no bound


def profile_bounds(fit: Fitted, k: int, level: float) -> tuple[float, float]:
    if fit.bounds is not None:
        return fit.bounds[k, -1], fit.bounds[k, 1]
    return tuple(solved(bound_search(fit.theta, fit.vcov, fit.loglik, k, side, level, fit.max_steps, fit.tolerance), fit.evaluate) for side in (-1, 1))


# ---- cells in one call per group ----------------------------------------------------------------------------------

def result_frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    """Rows as a pandas frame of plain Python values, missing entries None."""
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})


def fit_by(
    cells: DataFrame, by: Sequence[str], fn: Callable[[pd.DataFrame], list[dict]], fields: str = FIT_FIELDS, bounded: bool = False
) -> DataFrame:
    """Apply `fn` to every group's cells. An exception becomes a row with `converged` false and the message.

    One call sees a whole group, so the input must be reduced first: cell totals or a compressed frame. `bounded`
    vouches for any other input whose groups stay small whatever the data size.
    """
    if not (bounded or is_marked(cells, "n") or is_compressed(cells)):
        raise ValueError("fit_by takes cell totals or a compressed frame; pass bounded=True if groups are small by construction")
    keys = list(by)
    names = [f.split()[0] for f in fields.split(", ")]
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), fields])

    def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = fn(frame)
        except Exception as e:  # noqa: BLE001 - a group that cannot be fitted must not stop the others
            rows = [{"converged": False, "error": f"{type(e).__name__}: {e}"}]
        return result_frame([dict(zip(keys, group)) | r for r in rows], [*keys, *names])

    return cells.groupBy(*keys).applyInPandas(run, schema)


def _fit_frame(model: Model, frame: pd.DataFrame) -> list[dict]:
    """Fit one model on one group's cells: columns of the specification, `_y`, `n`, `n_used`, `w`."""
    family = FAMILIES[model.family](model.spec)
    frame = frame[frame["w"] > 0]
    if outside := model.spec.outside(frame):
        return [{"n": int(frame["n_used"].sum()), "converged": False, "error": f"values outside the list of {', '.join(outside)}"}]
    x, y, w = model.spec.matrix(frame), frame["_y"].to_numpy(), frame["w"].to_numpy(float)
    n, used = frame["n"].to_numpy(), int(frame["n_used"].sum())
    classes = sorted(set(y.astype(int)))
    if len(classes) < 2:
        return [{"n": used, "converged": False, "error": "needs at least two response classes"}]

    def evaluate(theta: np.ndarray):
        return family.sums(x, y, w, theta, classes)

    s = newton(evaluate, family.start(classes, np.array([w[y == c].sum() for c in classes])), model.max_steps, model.tolerance)
    fitted = None
    if s.status == "ok":
        sums = model.report_sums(frame, n, s.theta)
        fitted = Fitted(family, classes, s.theta, scaled_inverse(s.info), sums, evaluate, s.loglik, model.max_steps, model.tolerance)
    return model.rows(s, fitted, used)


def _finished(fits: DataFrame, levels: set[float | None], drop_failed: bool) -> DataFrame:
    """Results with the level of their profile bounds noted on the bound, so that no other level is mixed in later."""
    noted = {level for level in levels if level is not None}
    if len(noted) > 1:
        raise ValueError("models fitted together need one confidence level")
    for level in noted:
        fits = fits.withMetadata("conf_low", {"level": level})
    return fits.where("converged") if drop_failed else fits


def fit(rows: DataFrame, model: Model, by: Sequence[str] = ("question",), by_rows: bool | None = None, drop_failed: bool = False) -> DataFrame:
    """Fit a model in every group and report. Columns: `by`, then FIT_FIELDS.

    `by_rows` chooses between passes over the rows and one call on each group's cells; by default cells are used
    when every covariate has a closed list. `drop_failed` leaves groups that could not be fitted out.
    """
    keyed = model.spec.project(rows, by)
    if model.spec.cell_bound() is None if by_rows is None else by_rows:
        from surveyfx.operators.rowfit import fit_rows  # which builds on this module

        return _finished(fit_rows(keyed, {"": model}, by, model.spec.weight is not None).drop("model"), {model.level}, drop_failed)
    keys = [*by, *model.spec.covariates, "_y"]
    cells = cell_totals(keyed, keys, "_weight" if model.spec.weight else None)
    return _finished(fit_by(cells, by, lambda frame: _fit_frame(model, frame)), {model.level}, drop_failed)


def fit_many(
    rows: DataFrame, models: Mapping[str, Model], by: Sequence[str] = ("question",), by_rows: bool | None = None, drop_failed: bool = False
) -> DataFrame:
    """Fit several models of one outcome from one shared cell table, or in shared passes over the rows. Columns: `by`,
    `model`, then FIT_FIELDS.

    The shared cells are keyed by the covariates of all models, missing values included, because each model has its
    own complete cases. The models must agree on outcome, weight and closed lists.
    """
    specs = [m.spec for m in models.values()]
    if len({(sp.outcome, tuple(sp.ordered.items()), sp.weight) for sp in specs}) > 1:
        raise ValueError("models that share cells need the same outcome and weight")
    columns: dict = {}
    for sp in specs:
        for c in sp.covariates:
            listed = sp.levels.get(c, sp.codes.get(c))
            if columns.setdefault(c, listed) != listed:
                raise ValueError(f"models disagree on the values of {c}")
    exprs = {name: c for sp in specs for name, c in sp.columns().items()}
    weight = specs[0].weight
    keyed = rows.select(*by, *(c.alias(n) for n, c in exprs.items()), *([F.col(weight).alias("_weight")] if weight else []), *count_columns(rows))
    if not all(columns.values()) if by_rows is None else by_rows:
        from surveyfx.operators.rowfit import fit_rows

        return _finished(fit_rows(keyed, models, by, weight is not None), {m.level for m in models.values()}, drop_failed)
    kept = keyed.dropna(subset=["_y", *(["_weight"] if weight else [])])
    cells = cell_totals(kept, [*by, *exprs], "_weight" if weight else None, complete=False)

    def fn(frame: pd.DataFrame) -> list[dict]:
        out = []
        for name, m in models.items():
            part = frame.dropna(subset=m.spec.covariates)
            try:
                found = _fit_frame(m, part)
            except Exception as e:  # noqa: BLE001 - one failing model must not hide the others
                found = [{"converged": False, "error": f"{type(e).__name__}: {e}"}]
            out += [{"model": name} | r for r in found]
        return out

    return _finished(fit_by(cells, by, fn, "model string, " + FIT_FIELDS), {m.level for m in models.values()}, drop_failed)
