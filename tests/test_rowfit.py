"""Fits by passes over the rows against fits from cells, brute force and plain Newton; weighted moments against fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyfx.operators import rowsums, saturated, ttest
from surveyfx.operators.cells import compress
from surveyfx.operators.fit import AverageSlope, Coefficients, Contrast, Model, Probabilities, fit, fit_many
from surveyfx.operators.fold import fold_by
from surveyfx.operators.linear import fit_linear
from surveyfx.operators.spec import ModelSpec, crossed
from surveyfx.sources.codebook import audit_codes, with_labels
from surveyfx.sources.snapshot import read_snapshot, write_snapshot

BOTH = (0, 1)
ORDER = {1: "low", 2: "mid", 3: "high", 4: "top"}


# --- weighted moments ---


def solve(x, y, w):
    """Weighted least squares in fractions: coefficients and squared errors of the slopes."""
    p, n = len(x[0]), len(x)
    a = [[sum(w[k] * x[k][i] * x[k][j] for k in range(n)) for j in range(p)] + [sum(w[k] * x[k][i] * y[k] for k in range(n))] + [Fraction(i == j) for j in range(p)] for i in range(p)]
    for c in range(p):
        a[c] = [v / a[c][c] for v in a[c]]
        for i in range(p):
            if i != c:
                a[i] = [u - a[i][c] * v for u, v in zip(a[i], a[c])]
    beta = [r[p] for r in a]
    s2 = sum(w[k] * (y[k] - sum(b * v for b, v in zip(beta, x[k]))) ** 2 for k in range(n)) / (n - p)
    return beta, [s2 * a[i][p + 1 + i] for i in range(p)]


@pytest.fixture(scope="module")
def far(spark):
    rng = random.Random(8)
    rows = [("q", i % 2, i // 2 % 2, 1e8 + round(rng.gauss(0, 1), 3), 1.7e9 + rng.randint(0, 10**6), rng.choice((0.5, 0.75, 1.25, 8.0))) for i in range(600)]
    return rows, spark.createDataFrame(rows, "question string, treat int, rep int, y double, seconds double, weight double").repartition(7).cache()


def exact(rows, columns):
    x = [[Fraction(1), *(Fraction(v) for v in columns(r))] for r in rows]
    return solve(x, [Fraction(r[3]) for r in rows], [Fraction(r[5]) for r in rows])


def test_weighted_least_squares_equal_fractions(far):
    rows, df = far
    beta, var = exact(rows, lambda r: (r[1], r[2], r[1] * r[2], r[4]))
    spec = ModelSpec("y", (*crossed("treat", "rep"), ("seconds",)), codes={"treat": BOTH, "rep": BOTH}, weight="weight")
    got = {r.term: r for r in fit_linear(df, spec, [Coefficients()]).collect()}
    for k, term in enumerate(("treat", "rep", "treat:rep", "seconds"), 1):
        assert got[term].estimate == pytest.approx(float(beta[k]), rel=1e-9)
        assert got[term].std_error == pytest.approx(math.sqrt(var[k]), rel=1e-9)


@pytest.mark.parametrize("control", [None, "seconds"])
def test_weighted_effects_equal_fractions(far, control):
    rows, df = far
    beta, var = exact(rows, lambda r: (r[1], *([r[4]] if control else [])))
    states = compress(df, ["question", "treat", "rep"], "weight", measures=[("y", "seconds") if control else "y"])
    for frame in (df, states):
        got = saturated.linear_effects(frame, "y", weight="weight", control=control).first()
        assert got.estimate == pytest.approx(float(beta[1]), abs=5e-8) and got.std_error == pytest.approx(math.sqrt(var[1]), rel=1e-9)


def test_coded_columns_take_one_pass_and_give_the_same(far):
    df = far[1].withColumns({"z": (F.col("y") > 1e8).cast("double"), "s": F.col("rep") * 3})
    a, b = (saturated.linear_effects(df, "z", weight="weight", control="s", coded=coded).first() for coded in (True, False))
    assert a.estimate == pytest.approx(b.estimate, rel=1e-10) and a.std_error == pytest.approx(b.std_error, rel=1e-10) and a.n == b.n


# --- moment states ---


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        q = "hot" if i % 3 else ("q2", "q3", None)[i % 9 // 3]
        rows.append((q, rng.choice((0, 1, None)) if i % 7 == 0 else i % 2, rng.choice("ab"), None if i % 11 == 0 else rng.gauss(5, 2), None if i % 13 == 0 else rng.gauss(0, 1), None if i % 17 == 0 else rng.choice((0.0, 0.5, 2.0))))
    return spark.createDataFrame(rows, "question string, treat int, sub string, y double, z double, weight double").repartition(5).cache()


def same(a, b, *keys):
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for f in a[k].__fields__:
            assert a[k][f] == (pytest.approx(b[k][f], rel=1e-9, abs=1e-12) if isinstance(b[k][f], float) else b[k][f]), (k, f)


@pytest.mark.parametrize("weight", [None, "weight"])
def test_states_give_what_the_rows_give(awkward, weight):
    states = compress(awkward, ["question", "treat", "sub"], weight, measures=["y", ("y", "z")])
    spec = ModelSpec("y", (("treat",), ("sub",)), levels={"sub": ("a", "b")}, codes={"treat": BOTH}, weight=weight)
    for frame_fn in (
        lambda f: saturated.linear_effects(f, "y", weight=weight), lambda f: saturated.linear_effects(f, "y", by="sub", weight=weight, control="z"),
        lambda f: fit_linear(f, spec, [Coefficients()]), *([] if weight else [lambda f: ttest.welch(f, "y", "treat")]),
    ):
        a, b = frame_fn(awkward), frame_fn(states)
        same(a, b, *[c for c in ("question", "subgroup", "term") if c in a.columns])


# --- passes over the rows ---


@pytest.fixture(scope="module")
def coded(spark):
    rng = random.Random(12)
    rows = []
    for i in range(3000):
        q = "hot" if i % 5 < 3 else f"q{i % 5}"
        t, p = i % 2, rng.choice("DRI")
        # one question never answers "mid"
        y = min(4, 1 + int(rng.random() * 3 + 0.4 * t + 0.3 * (p == "R")))
        y = rng.randint(1, 4) if rng.random() < 0.3 else y
        y = 3 if q == "q4" and y == 2 else y
        rows.append((q, t, None if i % 41 == 0 else p, rng.choice((0, 1)), float(y > 2), None if i % 29 == 0 else y, rng.choice((0.5, 1.0, 1.5))))
    return spark.createDataFrame(rows, "question string, treat int, party string, saw int, agree double, y int, weight double").repartition(6).cache()


def model(family, terms, *reports, weight="weight"):
    outcome = "agree" if family == "logit" else "y"
    used = {c for t in terms for c in t}
    return Model(
        ModelSpec(outcome, terms, levels={"party": ("D", "R", "I")} if "party" in used else {}, codes={c: BOTH for c in ("treat", "saw") if c in used},
                  weight=weight, ordered={} if family == "logit" else ORDER, intercept=family != "ordinal"), family, reports,
    )


TERMS = (*crossed("treat", "party"), ("saw",))


@pytest.mark.parametrize(
    ("family", "reports"),
    [
        ("logit", (Coefficients(), Contrast("treat", "party"), AverageSlope("treat"))), ("logit", (Coefficients(profile=True, only=("treat", "saw")),)),
        ("ordinal", (Coefficients(),)), ("ordinal", (Coefficients(profile=True, only=("saw", "low|mid")),)), ("multinomial", (Coefficients(), Probabilities("treat"))),
        ("multinomial", (Coefficients(profile=True, only=("high:treat",)),)),
    ],
)
def test_rows_give_what_cells_give(coded, family, reports):
    m = model(family, TERMS, *reports)
    a, b = (fit(coded, m, by_rows=by_rows) for by_rows in (False, True))
    a, b = ({(r.question, r.subgroup, r.term): r for r in df.collect()} for df in (a, b))
    assert a.keys() == b.keys() and all(r.converged for r in a.values())
    for k in a:
        for f in ("estimate", "std_error", "conf_low", "conf_high", "loglik"):
            assert a[k][f] == (None if b[k][f] is None else pytest.approx(b[k][f], rel=1e-7, abs=1e-9)), (k, f)
        assert a[k].n == b[k].n


def test_softmax_equals_plain_newton(coded):
    frame = coded.where("question = 'hot'").dropna(subset=["y", "party"]).toPandas()
    x = np.column_stack([np.ones(len(frame)), frame["treat"], frame["saw"]])
    w, y = frame["weight"].to_numpy(), frame["y"].to_numpy()
    b = np.zeros((3, 3))
    for _ in range(30):
        e = np.exp(np.column_stack([np.zeros(len(x)), x @ b.T]))
        p = e / e.sum(axis=1, keepdims=True)
        g = np.concatenate([x.T @ (w * ((y == c + 2) - p[:, c + 1])) for c in range(3)])
        h = np.block([[(x * (w * p[:, c + 1] * ((c == d) - p[:, d + 1]))[:, None]).T @ x for d in range(3)] for c in range(3)])
        b = b + np.linalg.solve(h, g).reshape(3, 3)
    m = model("multinomial", (("treat",), ("saw",)), Coefficients())
    got = {r.term: r for r in fit(coded.dropna(subset=["party"]), m, by_rows=True).where("question = 'hot'").collect()}
    for c, label in enumerate(("mid", "high", "top")):
        assert [got[f"{label}:{n}"].estimate for n in ("(Intercept)", "treat", "saw")] == pytest.approx(b[c].tolist(), rel=1e-8)
    assert got["top:saw"].std_error == pytest.approx(math.sqrt(np.linalg.inv(h)[8, 8]), rel=1e-8)


def test_average_slope_is_that_of_moved_rows(coded):
    df = coded.withColumn("open", F.col("saw") * 0.7 + F.xxhash64("question", "weight", "y") % 97 / 97).dropna()
    m = Model(ModelSpec("agree", (*crossed("treat", "open"),), codes={"treat": BOTH}), "logit", (Coefficients(), AverageSlope("open")))
    got = {r.term: r for r in fit(df, m).where("question = 'hot'").collect()}
    frame = df.where("question = 'hot'").toPandas()
    b = [got[n].estimate for n in ("(Intercept)", "treat", "open", "treat:open")]

    def mean(step):
        z = frame["open"] + step
        return np.mean(1 / (1 + np.exp(-(b[0] + b[1] * frame["treat"] + b[2] * z + b[3] * frame["treat"] * z))))

    assert got["slope(open)"].estimate == pytest.approx((mean(1e-5) - mean(-1e-5)) / 2e-5, rel=1e-7)


def test_several_models_share_their_passes(coded, monkeypatch):
    models = {"a": model("logit", (("treat",),), Coefficients()), "b": model("logit", (("treat",), ("party",)), Coefficients()), "c": model("logit", TERMS, Coefficients(), AverageSlope("saw"))}
    passes = []
    whole = rowsums.newton_sums
    monkeypatch.setattr(rowsums, "newton_sums", lambda *a: passes.append(1) or whole(*a))
    alone = {}
    for k, m in models.items():
        passes.clear()
        for r in fit(coded, m, by_rows=True).collect():
            alone[k, r.question, r.term] = r
        alone[k] = len(passes)
    passes.clear()
    got = fit_many(coded, models, by_rows=True).collect()
    assert len(passes) == max(alone[k] for k in models)
    assert len(got) == sum(isinstance(k, tuple) for k in alone)
    for r in got:
        assert (r.estimate, r.std_error, r.n) == pytest.approx((alone[r.model, r.question, r.term].estimate, alone[r.model, r.question, r.term].std_error, alone[r.model, r.question, r.term].n), rel=1e-9)


def test_numbers_that_are_none_are_reported(spark):
    rows = [(q, i % 2, float("nan") if q == "bad" and i == 7 else i % 10 / 10, float(i * 7 % 5 < 2)) for q in ("bad", "good") for i in range(200)]
    df = spark.createDataFrame(rows, "question string, treat int, open double, y double")
    got = {r.question: r for r in fit(df, Model(ModelSpec("y", (("treat",), ("open",)), codes={"treat": BOTH}), "logit", (Coefficients(only=("open",)),))).collect()}
    assert got["good"].converged and (got["bad"].converged, got["bad"].error) == (False, "values that are no numbers in open")


def test_step_limits_hold_for_bounds_too(coded):
    m = model("logit", TERMS, Coefficients(profile=True, only=("treat",)))
    loose = Model(m.spec, "logit", m.reports, max_steps=8, tolerance=1e-6)
    for by_rows in (False, True):
        r = fit(coded, loose, by_rows=by_rows).first()
        assert r.converged and r.conf_low < r.estimate < r.conf_high


# --- hook on pieces of groups ---


def test_fold_equals_whole_groups(coded):
    fields = "total double, top int, converged boolean, error string"
    args = (lambda f: (f["weight"].sum(), int(f["y"].max())), lambda a, b: (a[0] + b[0], max(a[1], b[1])), lambda s: [{"total": s[0], "top": s[1], "converged": True}], fields)
    got = {(r.question, r.party): r for r in fold_by(coded.dropna(subset=["y"]), ["question", "party"], *args).collect()}
    want = {(r.question, r.party): r for r in coded.dropna(subset=["y"]).groupBy("question", "party").agg(F.sum("weight").alias("total"), F.max("y").alias("top")).collect()}
    assert got.keys() == want.keys() and (None in {p for _, p in got})
    assert all(got[k].total == pytest.approx(want[k].total) and got[k].top == want[k].top for k in want)


def test_fold_reports_groups_that_fail(coded):
    def partial(frame):
        if (frame["question"] == "q4").any():
            raise ValueError("no")
        return len(frame)

    got = {r.question: r for r in fold_by(coded, ["question"], partial, lambda a, b: a + b, lambda n: [{"n": n, "converged": True}], "n bigint, converged boolean, error string").collect()}
    assert (got["q4"].converged, got["q4"].error) == (False, "ValueError: no") and got["hot"].n == 1800


def test_fold_sends_states_not_rows(coded):
    df = fold_by(coded, ["question"], len, lambda a, b: a + b, lambda n: [{"n": n, "converged": True}], "n bigint, converged boolean, error string")
    text = df._jdf.queryExecution().executedPlan().toString()
    below = text[text.rindex("Exchange hashpartitioning(question") :]
    assert "MapInPandas" in below


# --- snapshot ---


def test_a_failed_write_leaves_the_snapshot(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.createDataFrame([("q1", 1, 2), ("q1", 2, 1), ("q 2/é", 1, 3), (None, 9, 9)], "question string, caseid long, response int")
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, path)
    assert write_snapshot(df, path) == 1
    assert sorted(map(tuple, read_snapshot(spark, path).select("question", "caseid", "response").collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    broken = df.withColumn("response", F.when(F.col("question") == "q1", F.raise_error(F.lit("lost")).cast("int")).otherwise(7))
    with pytest.raises(Exception, match="lost"):
        write_snapshot(broken, path)
    assert read_snapshot(spark, path).count() == 4 and read_snapshot(spark, path, ["q1"]).count() == 2
    assert write_snapshot(df.where("question = 'q1'").withColumn("response", F.lit(5)), path, merge=True) == 2
    got = {(r.question, r.caseid): r.response for r in read_snapshot(spark, path).collect()}
    assert got == {("q1", 1): 5, ("q1", 2): 5, ("q 2/é", 1): 3, (None, 9): 9}
    assert [r.response for r in read_snapshot(spark, path, ["q 2/é"]).collect()] == [3]
    with pytest.raises(ValueError):
        write_snapshot(df.withColumn("more", F.lit(1)), path, merge=True)
    assert write_snapshot(df.where("question = 'q1'"), path) == 3 and read_snapshot(spark, path).count() == 2


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    from surveyfx.sources import snapshot

    path = str(tmp_path / "s")
    df = spark.createDataFrame([("q1", 1)], "question string, response int")
    write_snapshot(df, path)
    with pytest.raises(RuntimeError):
        snapshot._commit(spark, path, 1, {})
    assert read_snapshot(spark, path).count() == 1


# --- codebook ---


def test_audit_finds_stray_unused_and_missing_codes(spark):
    df = spark.createDataFrame([(1, 2, "x"), (9, 2, "y"), (None, 2, "z"), (1, 1, "x")], "a int, b int, c string")
    df = with_labels(df, {"a": ("A", {1: "one", 2: "two"}), "b": ("B", {1: "one", 2: "two"})})
    got = {(r.var_name, r.code): (r.n, r.status) for r in audit_codes(df).collect()}
    assert got == {("a", 1): (2, "labelled"), ("a", 2): (0, "unused"), ("a", 9): (1, "unlabelled"), ("a", None): (1, "missing"), ("b", 1): (1, "labelled"), ("b", 2): (3, "labelled")}
    assert {r.var_name for r in audit_codes(df, ["b"]).collect()} == {"b"}
