"""Model fits against brute force, against each other, and on awkward data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyfx.functions.recode import indicator, recode
from surveyfx.operators import descriptive, saturated, ttest
from surveyfx.operators.cells import compress
from surveyfx.operators.fit import AverageSlope, Coefficients, Contrast, Model, fit, fit_by, fit_many
from surveyfx.operators.linear import fit_linear
from surveyfx.operators.spec import ModelSpec, crossed

PARTY = {"Dem": (1, 2, 3), "Rep": (5, 6, 7), "Ind": (4,)}
BOTH = (0, 1)


@pytest.fixture(scope="module")
def rows(long):
    return long.select(
        "question", "treat", "weight", "response",
        indicator("response", 3).alias("not_sure"),
        F.when(F.col("response") != 3, indicator("response", 1)).alias("agree"),
        recode("pid7_baseline", PARTY).alias("party"),
        F.when(F.col("pid7_baseline").isin(5, 6, 7), 1).when(F.col("pid7_baseline").isin(1, 2, 3), 0).alias("rep"),
        indicator("saw", 1).alias("saw"),
        (F.col("caseid") % 97 / 97).alias("age"),
    ).persist()


def table(df, *key):
    return {tuple(r[k] for k in key): r for r in df.collect()}


def arrays(rows, question, outcome, *columns):
    frame = rows.where(F.col("question") == question).select(outcome, "weight", *columns).dropna().toPandas()
    return frame[outcome].to_numpy(float), frame["weight"].to_numpy(float), frame


def newton_logit(x, y, w):
    b = np.zeros(x.shape[1])
    for _ in range(40):
        mu = 1 / (1 + np.exp(-x @ b))
        h = x.T @ (x * (w * mu * (1 - mu))[:, None])
        b = b + np.linalg.solve(h, x.T @ (w * (y - mu)))
    return b, np.linalg.inv(h)


LOGIT = ModelSpec(
    "agree", (*crossed("treat", "party"), ("saw",)), levels={"party": ("Dem", "Rep", "Ind")},
    codes={"treat": BOTH, "saw": BOTH}, weight="weight",
)


def test_logit_equals_row_level_fit(rows):
    got = table(fit(rows, Model(LOGIT, "logit", (Coefficients(),))), "question", "term")
    y, w, f = arrays(rows, "q2", "agree", "treat", "party", "saw")
    t, r, i = f["treat"].to_numpy(float), (f["party"] == "Rep").to_numpy(float), (f["party"] == "Ind").to_numpy(float)
    x = np.column_stack([np.ones(len(y)), t, r, i, t * r, t * i, f["saw"].to_numpy(float)])
    b, v = newton_logit(x, y, w)
    for k, name in enumerate(LOGIT.names()):
        assert got["q2", name].estimate == pytest.approx(b[k], abs=1e-9)
        assert got["q2", name].std_error == pytest.approx(math.sqrt(v[k, k]), abs=1e-9)
        assert got["q2", name].n == len(y) and got["q2", name].converged
    # score equations
    mu = 1 / (1 + np.exp(-x @ [got["q2", n].estimate for n in LOGIT.names()]))
    assert np.max(np.abs(x.T @ (w * (y - mu)))) < 1e-6


def test_saturated_logit_equals_newton(rows):
    spec = ModelSpec("agree", (("treat",),), codes={"treat": BOTH}, weight="weight")
    a = table(fit(rows, Model(spec, "logit", (Coefficients(),))), "question", "term")
    b = table(saturated.saturated_logit(rows, "agree", "treat", weight="weight"), "question", "term")
    assert set(a) == set(b)
    for k in a:
        assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-9) and a[k].std_error == pytest.approx(b[k].std_error, abs=1e-9)


def test_logit_contrasts_equal_grid_contrasts(rows):
    spec = ModelSpec("agree", crossed("treat", "party"), levels={"party": ("Dem", "Rep", "Ind")}, codes={"treat": BOTH})
    for scale in ("response", "link"):
        a = table(fit(rows, Model(spec, "logit", (Contrast("treat", "party", scale=scale),))), "question", "subgroup")
        b = table(saturated.logit_contrasts(rows, "agree", "party", scale=scale), "question", "subgroup")
        assert set(a) == set(b) and len(a) == 24
        for k in a:
            assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-9) and a[k].std_error == pytest.approx(b[k].std_error, abs=1e-9)


@pytest.mark.parametrize("control", [None, "saw"])
def test_closed_linear_equals_general(rows, control):
    terms = (*crossed("treat", "party"), *([(control,)] if control else []))
    spec = ModelSpec("not_sure", terms, levels={"party": ("Dem", "Rep", "Ind")}, codes={"treat": BOTH, "saw": BOTH}, weight="weight")
    a = table(fit_linear(rows, spec, [Contrast("treat", "party", scale="link")]), "question", "subgroup")
    b = table(saturated.linear_effects(rows, "not_sure", by="party", weight="weight", control=control), "question", "subgroup")
    assert set(a) == set(b) and len(a) == 24
    for k in a:
        assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-10) and a[k].std_error == pytest.approx(b[k].std_error, abs=1e-10)


def test_linear_equals_lstsq(rows):
    """A continuous covariate, row by row."""
    spec = ModelSpec("not_sure", (("treat",), ("age",), ("treat", "age")), weight="weight")
    got = table(fit_linear(rows, spec, [Coefficients()]), "question", "term")
    y, w, f = arrays(rows, "q5", "not_sure", "treat", "age")
    t, a = f["treat"].to_numpy(float), f["age"].to_numpy(float)
    x = np.column_stack([np.ones(len(y)), t, a, t * a])
    s = np.sqrt(w)
    b = np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]
    v = np.sum(w * (y - x @ b) ** 2) / (len(y) - 4) * np.linalg.inv(x.T @ (x * w[:, None]))
    for k, name in enumerate(spec.names()):
        assert got["q5", name].estimate == pytest.approx(b[k], abs=1e-9)
        assert got["q5", name].std_error == pytest.approx(math.sqrt(v[k, k]), abs=1e-9)
        assert got["q5", name].df == len(y) - 4


def test_welch_is_minus_ols(rows):
    w = table(ttest.welch(rows, "not_sure", "treat"), "question")
    o = table(saturated.linear_effects(rows, "not_sure", reference="t"), "question")
    for k in w:
        assert w[k].difference == pytest.approx(-o[k].estimate, abs=1e-12)


def test_did_equals_interaction(rows):
    spec = ModelSpec("agree", crossed("rep", "treat"), codes={"rep": BOTH, "treat": BOTH})
    a = table(fit_linear(rows, spec, [Coefficients(only=("rep:treat",))]), "question")
    b = table(saturated.linear_did(rows, "agree", "rep"), "question")
    for k in a:
        assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-10) and a[k].std_error == pytest.approx(b[k].std_error, abs=1e-10)


def ordinal(terms, profile=False, **kw):
    columns = {c for t in terms for c in t}
    spec = ModelSpec("response", terms, codes=dict.fromkeys(columns, BOTH), ordered={2: "No", 3: "Not sure", 1: "Yes"}, intercept=False)
    return Model(spec, "ordinal", (Coefficients(profile=profile, **kw),))


def test_ordinal_reparameterisation(rows):
    both = rows.withColumns({"treat_rep": F.col("treat") * F.col("rep"), "treat_dem": F.col("treat") * (1 - F.col("rep"))})
    models = {"a": ordinal((("treat",), ("rep",), ("treat_rep",))), "b": ordinal((("rep",), ("treat_rep",), ("treat_dem",)))}
    got = table(fit_many(both, models), "model", "question", "term")
    for q in {k[1] for k in got}:
        assert got["a", q, "rep"].loglik == pytest.approx(got["b", q, "rep"].loglik, abs=1e-8)
        assert got["b", q, "treat_rep"].estimate == pytest.approx(got["a", q, "treat"].estimate + got["a", q, "treat_rep"].estimate, abs=1e-8)


def test_fit_many_equals_single_fits(rows):
    models = {"main": ordinal((("treat",),)), "crossed": ordinal(crossed("treat", "rep"))}
    many = table(fit_many(rows, models), "model", "question", "term")
    for name, model in models.items():
        for (q, term), r in table(fit(rows, model), "question", "term").items():
            assert many[name, q, term].estimate == pytest.approx(r.estimate, abs=1e-10)
            assert many[name, q, term].n == r.n


def test_ordinal_gradient_is_zero(rows):
    """Independent check: numerical derivative of the log-likelihood at the fit."""
    got = table(fit(rows, ordinal(crossed("treat", "rep"))), "question", "term")
    f = rows.where("question = 'q1'").select("response", "treat", "rep").dropna().toPandas()
    y = f["response"].map({2: 0, 3: 1, 1: 2}).to_numpy()
    x = np.column_stack([f["treat"], f["rep"], f["treat"] * f["rep"]]).astype(float)

    def loglik(th):
        cum = [1 / (1 + np.exp(-(t - x @ th[2:]))) for t in th[:2]]
        p = np.column_stack([cum[0], cum[1] - cum[0], 1 - cum[1]])
        return np.sum(np.log(p[np.arange(len(y)), y]))

    names = ["No|Not sure", "Not sure|Yes", "treat", "rep", "treat:rep"]
    th = np.array([got["q1", n].estimate for n in names])
    assert loglik(th) == pytest.approx(got["q1", "treat"].loglik, abs=1e-8)
    for k in range(5):
        e = np.eye(5)[k] * 1e-5
        assert abs(loglik(th + e) - loglik(th - e)) / 2e-5 < 1e-3
        curvature = -(loglik(th + 20 * e) - 2 * loglik(th) + loglik(th - 20 * e)) / (2e-4) ** 2
        assert curvature > 0


def profile_drop(rows, outcome_spec, question, term, value):
    """Deviance rise of a refit with one coefficient fixed, by brute force on rows."""
    f = rows.where(F.col("question") == question).select("agree", "treat", "saw").dropna().toPandas()
    y, t, s = (f[c].to_numpy(float) for c in ("agree", "treat", "saw"))

    def best(fixed):
        x = np.column_stack([np.ones(len(y)), s] if fixed is not None else [np.ones(len(y)), s, t])
        off = fixed * t if fixed is not None else np.zeros(len(y))
        b = np.zeros(x.shape[1])
        for _ in range(40):
            mu = 1 / (1 + np.exp(-(x @ b + off)))
            b = b + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
        eta = x @ b + off
        return np.sum(y * eta - np.logaddexp(0, eta))

    return 2 * (best(None) - best(value))


def test_profile_bounds_by_refit(rows):
    spec = ModelSpec("agree", (("treat",), ("saw",)), codes={"treat": BOTH, "saw": BOTH})
    got = table(fit(rows, Model(spec, "logit", (Coefficients(profile=True, only=("treat",)),))), "question")
    r = got["q4",]
    assert r.conf_low < r.estimate < r.conf_high
    for bound in (r.conf_low, r.conf_high):
        assert profile_drop(rows, spec, "q4", "treat", bound) == pytest.approx(3.841458820694124, abs=1e-6)


def test_ordinal_profile_close_to_wald(rows):
    got = table(fit(rows, ordinal(crossed("treat", "rep"), profile=True, only=("treat:rep",))), "question")
    for r in got.values():
        assert r.conf_low == pytest.approx(r.estimate - 1.96 * r.std_error, abs=0.1 * r.std_error)
        assert r.conf_high == pytest.approx(r.estimate + 1.96 * r.std_error, abs=0.1 * r.std_error)


def test_average_slope_brute_force(rows):
    spec = ModelSpec("agree", (("rep",), ("treat",), ("saw",)), codes={"rep": BOTH, "treat": BOTH, "saw": BOTH}, weight="weight")
    got = table(fit(rows, Model(spec, "logit", (AverageSlope("rep"),))), "question")
    y, w, f = arrays(rows, "q3", "agree", "rep", "treat", "saw")
    x = np.column_stack([np.ones(len(y)), f["rep"], f["treat"], f["saw"]]).astype(float)
    b, v = newton_logit(x, y, w)

    def slope(beta):
        mu = 1 / (1 + np.exp(-x @ beta))
        return np.mean(mu * (1 - mu)) * beta[1]

    gradient = np.array([(slope(b + 1e-6 * e) - slope(b - 1e-6 * e)) / 2e-6 for e in np.eye(4)])
    assert got["q3",].estimate == pytest.approx(slope(b), abs=1e-9)
    assert got["q3",].std_error == pytest.approx(math.sqrt(gradient @ v @ gradient), abs=1e-7)


@pytest.mark.parametrize("partitions", [1, 13])
def test_order_and_partitioning_do_not_matter(rows, partitions):
    a = table(fit(rows, Model(LOGIT, "logit", (Contrast("treat", "party"),))), "question", "subgroup")
    moved = rows.repartition(partitions, F.rand(7))
    b = table(fit(moved, Model(LOGIT, "logit", (Contrast("treat", "party"),))), "question", "subgroup")
    for k in a:
        assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-9)


def test_weight_scale_leaves_estimates(rows):
    scaled = rows.withColumn("weight", F.col("weight") * 3)
    model = Model(LOGIT, "logit", (Coefficients(),))
    a, b = (table(fit(r, model), "question", "term") for r in (rows, scaled))
    for k in a:
        assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-8)
        assert a[k].std_error == pytest.approx(b[k].std_error * math.sqrt(3), abs=1e-8)


# ---- compressed input gives the same answers as rows --------------------------------------------------------------

def test_compressed_input_equals_rows(rows):
    codes = ["question", "treat", "party", "saw", "response", "not_sure", "agree", "rep"]
    packed = compress(rows, codes, "weight")
    assert packed.count() < rows.count() / 2
    plain = ModelSpec("agree", (("treat",), ("rep",)), codes={"treat": BOTH, "rep": BOTH})
    ops = [
        lambda d: saturated.linear_effects(d, "not_sure", by="party", weight="weight", control="saw"),
        lambda d: saturated.linear_effects(d, "not_sure", reference="t"),
        lambda d: saturated.saturated_logit(d, "agree", "treat", weight="weight"),
        lambda d: saturated.logit_contrasts(d, "not_sure", "party"),
        lambda d: saturated.multinomial_effects(d, "response", weight="weight").withColumnRenamed("response", "subgroup"),
        lambda d: fit(d, Model(LOGIT, "logit", (Contrast("treat", "party"), Coefficients()))),
        lambda d: fit(d, Model(plain, "logit", (AverageSlope("rep"),))),
        lambda d: fit_linear(d, plain, [Coefficients()]),
        lambda d: fit_linear(d, LOGIT, [Contrast("treat", "party", scale="link")]),
    ]
    for op in ops:
        a, b = (table(op(d), "question", "subgroup", "term") for d in (rows, packed))
        assert set(a) == set(b) and a
        for k in a:
            assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-9)
            assert a[k].std_error == pytest.approx(b[k].std_error, abs=1e-9)
            assert a[k].n == b[k].n


def test_compressed_descriptives_equal_rows(rows):
    packed = compress(rows, ["question", "treat", "party", "response", "not_sure", "agree"], "weight")
    arm = F.col("treat") + 1
    ops = [
        lambda d: ttest.welch(d, "not_sure", "treat"),
        lambda d: ttest.welch_many(d, {"t": (F.col("not_sure"), arm)}).withColumnRenamed("test", "question"),
        lambda d: descriptive.net_support_ztest(d, ["question", "party"], "treat", "response"),
        lambda d: descriptive.party_gap_did(d, "party", "treat", "agree"),
        lambda d: descriptive.weighted_arm_means(d, "treat", "not_sure", "weight"),
        lambda d: descriptive.response_distribution(d, ["question", "treat"], "response", "weight"),
        lambda d: descriptive.shares_wide(d, ["question", "treat"], "response", {1: "yes", 2: "no", 3: "unsure"}),
        lambda d: descriptive.pro_share_effect(d, "party", "treat", "response", ["Dem", "Rep"]),
    ]
    for op in ops:
        a, b = ({tuple(v for v in r if not isinstance(v, float)): r for r in op(d).collect()} for d in (rows, packed))
        assert set(a) == set(b) and a
        for k in a:
            for x, y in zip(a[k], b[k]):
                assert x == y or x == pytest.approx(y, abs=1e-9)


def test_compressed_null_and_zero_weights(spark):
    data = [("a", 1, 1.0, 2.0, 5), ("a", 1, 0.0, 1.0, 5), ("a", 0, 1.0, 1.0, 5), ("a", 0, 0.0, 2.0, 5), ("a", 1, 1.0, None, 3), ("a", 0, 1.0, 0.0, 3)]
    df = small(spark, data)
    packed = compress(df, ["question", "treat", "y"], "weight")
    for weight in (None, "weight"):
        a, b = (saturated.linear_effects(d, "y", weight=weight).first() for d in (df, packed))
        # centred moments of rows and of cells merge in another order: equal but for the last bits
        assert all(x == y or x == pytest.approx(y, rel=1e-13) for x, y in zip(a, b, strict=True))


# ---- the row-distributed shape gives the same answers ------------------------------------------------------------

@pytest.mark.parametrize(
    "model",
    [
        Model(LOGIT, "logit", (Coefficients(), Contrast("treat", "party"))),
        Model(ModelSpec("agree", (("rep",), ("saw",)), codes={"rep": BOTH, "saw": BOTH}), "logit", (Coefficients(), AverageSlope("rep"))),
        ordinal(crossed("treat", "rep")),
    ],
    ids=["contrast", "slope", "ordinal"],
)
def test_distributed_fit_equals_cell_fit(rows, model):
    a = table(fit(rows, model), "question", "subgroup", "term")
    b = table(fit(rows, model, by_rows=True), "question", "subgroup", "term")
    assert set(a) == set(b) and a
    for k in a:
        assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-8)
        assert a[k].std_error == pytest.approx(b[k].std_error, abs=1e-8)
        assert a[k].n == b[k].n and a[k].converged and b[k].converged


def test_distributed_fit_accepts_compressed_rows(rows):
    packed = compress(rows, ["question", "treat", "party", "rep", "saw", "response", "agree"], "weight")
    model = Model(LOGIT, "logit", (Contrast("treat", "party"),))
    a = table(fit(rows, model), "question", "subgroup")
    b = table(fit(packed, model, by_rows=True), "question", "subgroup")
    assert set(a) == set(b) and a
    for k in a:
        assert a[k].estimate == pytest.approx(b[k].estimate, abs=1e-8) and a[k].n == b[k].n


def test_continuous_covariate(rows):
    spec = ModelSpec("agree", (("treat",), ("age",)), weight="weight")
    assert spec.cell_bound() is None
    got = table(fit(rows, Model(spec, "logit", (Coefficients(),))), "question", "term")
    y, w, f = arrays(rows, "q7", "agree", "treat", "age")
    b, v = newton_logit(np.column_stack([np.ones(len(y)), f["treat"], f["age"]]).astype(float), y, w)
    for k, name in enumerate(spec.names()):
        assert got["q7", name].estimate == pytest.approx(b[k], abs=1e-8)


# ---- awkward data -------------------------------------------------------------------------------------------------

def small(spark, data):
    """(question, treat, y, weight, repeat)"""
    rows = [(q, t, y, w) for q, t, y, w, k in data for _ in range(k)]
    return spark.createDataFrame(rows, "question string, treat int, y double, weight double")


SMALL = ModelSpec("y", (("treat",),), codes={"treat": BOTH})


def test_known_odds_ratio(spark):
    df = small(spark, [("a", 1, 1.0, 1.0, 30), ("a", 1, 0.0, 1.0, 15), ("a", 0, 1.0, 1.0, 10), ("a", 0, 0.0, 1.0, 20)])
    r = saturated.saturated_logit(df, "y", "treat", exponentiate=True).where("term = 'treat'").first()
    assert r.estimate == pytest.approx(4.0) and r.std_error == pytest.approx(math.sqrt(1 / 30 + 1 / 15 + 1 / 10 + 1 / 20))


def test_separation_is_reported(spark):
    df = small(spark, [("sep", 1, 1.0, 1.0, 9), ("sep", 0, 0.0, 1.0, 9), ("ok", 1, 1.0, 1.0, 3), ("ok", 1, 0.0, 1.0, 2), ("ok", 0, 1.0, 1.0, 4), ("ok", 0, 0.0, 1.0, 5)])
    for by_rows in (False, True):
        got = fit(df, Model(SMALL, "logit", (Coefficients(only=("treat",)),)), by_rows=by_rows).collect()
        state = {r.question: (r.converged, r.estimate is None, r.error is None) for r in got}
        assert state == {"sep": (False, True, False), "ok": (True, False, True)}
    closed = {r.question: (r.converged, r.estimate) for r in saturated.saturated_logit(df, "y", "treat").where("term = 'treat'").collect()}
    assert closed["sep"] == (False, None) and closed["ok"][0]
    contrast = {r.question: r.converged for r in saturated.logit_contrasts(df.withColumn("s", F.lit("x")), "y", "s").collect()}
    assert contrast == {"sep": False, "ok": True}


def test_single_arm_and_single_class(spark):
    df = small(spark, [("arm", 1, 1.0, 1.0, 3), ("arm", 1, 0.0, 1.0, 3), ("class", 1, 1.0, 1.0, 3), ("class", 0, 1.0, 1.0, 3)])
    got = {r.question: (r.converged, r.error) for r in fit(df, Model(SMALL, "logit", (Coefficients(),))).collect()}
    assert got["arm"] == (False, "singular information")
    assert got["class"] == (False, "needs at least two response classes")
    lin = {r.question: (r.converged, r.estimate) for r in saturated.linear_effects(df, "y").collect()}
    assert lin["arm"] == (False, None) and lin["class"] == (True, 0.0)
    multi = {(r.question, r.y): r.error for r in saturated.multinomial_effects(df, "y").collect()}
    assert multi["arm", 1.0] == "needs answers in both arms"
    assert multi["class", 1.0] == "needs at least two response classes"
    assert saturated.multinomial_effects(df, "y", drop_failed=True).count() == 0


def test_class_absent_in_one_arm(spark):
    df = small(spark, [("a", 1, 1.0, 1.0, 4), ("a", 0, 1.0, 1.0, 2), ("a", 0, 2.0, 1.0, 2)])
    got = {r.y: r.estimate for r in saturated.multinomial_effects(df, "y").collect()}
    assert got == {1.0: 0.5, 2.0: -0.5}


def test_null_and_zero_weights(spark):
    base = [("a", 1, 1.0, 2.0, 5), ("a", 1, 0.0, 1.0, 5), ("a", 0, 1.0, 1.0, 5), ("a", 0, 0.0, 2.0, 5)]
    extra = [("a", 1, 1.0, None, 3), ("a", 0, 1.0, 0.0, 3), ("a", None, 1.0, 1.0, 3), ("a", 1, None, 1.0, 3)]
    spec = ModelSpec("y", (("treat",),), codes={"treat": BOTH}, weight="weight")
    a, b = (fit(small(spark, d), Model(spec, "logit", (Coefficients(only=("treat",)),))).first() for d in (base, base + extra))
    assert b.estimate == pytest.approx(a.estimate, abs=1e-12) and b.n == a.n == 20
    x, y = (saturated.linear_effects(small(spark, d), "y", weight="weight").first() for d in (base, base + extra))
    assert y.estimate == pytest.approx(x.estimate, abs=1e-12) and y.std_error == pytest.approx(x.std_error, abs=1e-12) and y.n == 20


def test_unlisted_party_and_empty_subgroup(spark):
    df = small(spark, [("a", 1, 1.0, 1.0, 4), ("a", 1, 0.0, 1.0, 4), ("a", 0, 1.0, 1.0, 3), ("a", 0, 0.0, 1.0, 5)])
    only_none = df.withColumn("party", F.lit(None).cast("string"))
    assert saturated.logit_contrasts(only_none, "y", "party").count() == 0
    spec = ModelSpec("y", crossed("treat", "party"), levels={"party": ("Dem", "Rep")}, codes={"treat": BOTH})
    unlisted = df.withColumn("party", F.lit("Other"))
    assert fit(unlisted, Model(spec, "logit", (Coefficients(),))).count() == 0
    one = fit(df.withColumn("party", F.lit("Dem")), Model(spec, "logit", (Coefficients(),))).first()
    assert not one.converged and one.error == "singular information"


def test_duplicated_respondents_count_twice(spark):
    df = small(spark, [("a", 1, 1.0, 1.0, 4), ("a", 1, 0.0, 1.0, 2), ("a", 0, 1.0, 1.0, 3), ("a", 0, 0.0, 1.0, 5)])
    a, b = (saturated.saturated_logit(d, "y", "treat").where("term = 'treat'").first() for d in (df, df.unionAll(df)))
    assert a.estimate == pytest.approx(b.estimate) and a.std_error == pytest.approx(b.std_error * math.sqrt(2)) and b.n == 2 * a.n


def test_constant_control_is_dropped(spark):
    df = small(spark, [("a", 1, 1.0, 1.0, 4), ("a", 1, 0.0, 1.0, 2), ("a", 0, 1.0, 1.0, 3), ("a", 0, 0.0, 1.0, 5)]).withColumn("s", F.lit(1.0))
    a, b = (saturated.linear_effects(df, "y", control=c, reference="t").first() for c in (None, "s"))
    assert (a.estimate, a.std_error, a.df) == (b.estimate, b.std_error, b.df)


def test_user_function_errors_are_captured(spark):
    cells = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "question string, v double")

    def fn(frame):
        return [{"term": "inverse", "estimate": 1 // int(frame["v"].iloc[0]), "converged": True}]

    got = {r.question: (r.converged, r.error) for r in fit_by(cells, ["question"], fn, bounded=True).collect()}
    assert got["a"] == (True, None) and got["b"][0] is False and "ZeroDivisionError" in got["b"][1]


def test_agrees_with_mllib(rows):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    one = rows.where("question = 'q6'").select("agree", "treat", "saw", F.col("weight").cast("double").alias("weight")).dropna()
    data = VectorAssembler(inputCols=["treat", "saw"], outputCol="features").transform(one)
    glm = GeneralizedLinearRegression(family="binomial", labelCol="agree", weightCol="weight", tol=1e-12, maxIter=60).fit(data)
    spec = ModelSpec("agree", (("treat",), ("saw",)), codes={"treat": BOTH, "saw": BOTH}, weight="weight")
    got = table(fit(rows, Model(spec, "logit", (Coefficients(),))), "question", "term")
    assert got["q6", "treat"].estimate == pytest.approx(glm.coefficients[0], abs=1e-8)
    assert got["q6", "treat"].std_error == pytest.approx(glm.summary.coefficientStandardErrors[0], abs=1e-7)
