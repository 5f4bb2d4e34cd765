"""Numbers far from zero, awkward weights and units, and the guards around the fits."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyfx.functions import dist
from surveyfx.operators import saturated
from surveyfx.operators.cells import cell_totals, compress, is_compressed
from surveyfx.operators.fit import AverageSlope, Coefficients, Contrast, Model, fit, fit_by, fit_many
from surveyfx.operators.inference import with_inference
from surveyfx.operators.linear import fit_linear
from surveyfx.operators.spec import ModelSpec
from surveyfx.operators.ttest import welch
from surveyfx.sources.longform import read_long, write_long

BOTH = (0, 1)


@pytest.fixture(scope="module")
def far(spark):
    rng = random.Random(4)
    rows = [("q", i % 2, 1e8 + rng.gauss(0, 1) + 0.3 * (i % 2), 1.7e9 + rng.gauss(0, 1e6), rng.choice((0.5, 0.7, 1.3)), rng.random() * 1e-9) for i in range(4000)]
    return spark.createDataFrame(rows, "question string, treat int, y double, seconds double, weight double, tiny double").repartition(6).cache()


def centred(df, weight=None, control=None):
    d = df.toPandas()
    w = d[weight].to_numpy() if weight else np.ones(len(d))
    x = np.column_stack([np.ones(len(d)), d["treat"], *([(d[control] - d[control].mean()) / d[control].std()] if control else [])])
    y = d["y"].to_numpy() - d["y"].mean()
    inverse = np.linalg.inv((x * w[:, None]).T @ x)
    beta = inverse @ (x * w[:, None]).T @ y
    s2 = np.sum(w * (y - x @ beta) ** 2) / (len(d) - x.shape[1])
    return beta[1], math.sqrt(s2 * inverse[1, 1])


@pytest.mark.parametrize(("weight", "control"), [(None, None), ("weight", None), ("weight", "seconds")])
def test_large_means_do_not_cancel(far, weight, control):
    estimate, error = centred(far, weight, control)
    closed = saturated.linear_effects(far, "y", weight=weight, control=control).first()
    spec = ModelSpec("y", (("treat",), *(((control,),) if control else ())), weight=weight)
    general = fit_linear(far, spec, [Coefficients(only=("treat",))]).first()
    for r in (closed, general):
        assert r.converged and r.estimate == pytest.approx(estimate, rel=1e-6) and r.std_error == pytest.approx(error, rel=1e-6)


def test_welch_on_compressed_rows_far_from_zero(spark):
    rows = [("q", i % 2, 1e8 + i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "question string, treat int, y double")
    a, b = welch(df, "y", "treat").first(), welch(compress(df, ["question", "treat", "y"]), "y", "treat").first()
    assert a.std_error == pytest.approx(b.std_error, rel=1e-9) and a.difference == pytest.approx(b.difference, rel=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_constant_control_costs_nothing(spark, seed):
    rng = random.Random(seed)
    rows = [("q", i % 2, float(rng.random() < 0.4), rng.choice((0.1, 0.3, 0.7)) * rng.random(), 0.7) for i in range(500)]
    df = spark.createDataFrame(rows, "question string, treat int, y double, weight double, same double").repartition(5)
    a, b = saturated.linear_effects(df, "y", weight="weight").first(), saturated.linear_effects(df, "y", weight="weight", control="same").first()
    assert (b.std_error, b.estimate) == pytest.approx((a.std_error, a.estimate), rel=1e-12)


def test_constant_control_on_very_many_rows(spark):
    rows = [("q", t, float(y), 0.7) for t in BOTH for y in BOTH for _ in range(3)]
    cells = compress(spark.createDataFrame(rows, "question string, treat int, y double, same double"), ["question", "treat", "y", "same"])
    many = cells.withColumns({c: F.col(c) * 123_456_789 for c in ("_n_known", "_n_used")}).withColumn("_n", (F.col("_n") * 123_456_789).alias("_n", metadata=cells.schema["_n"].metadata))
    a, b = saturated.linear_effects(many, "y").first(), saturated.linear_effects(many, "y", control="same").first()
    assert a.n == 12 * 123_456_789 and a.std_error == pytest.approx(b.std_error, rel=1e-14)


def test_perfect_fit_is_not_called_converged(spark):
    df = spark.createDataFrame([("q", i % 2, float(i % 2)) for i in range(20)], "question string, treat int, y double")
    r = fit_linear(df, ModelSpec("y", (("treat",),)), [Coefficients()]).first()
    assert not r.converged and r.error == "no residual variance"


def test_units_of_a_covariate_do_not_matter(spark, far):
    df = far.withColumns({"z": (F.col("y") > 1e8).cast("double"), "unit": F.col("tiny") * 1e9})
    small, plain = (fit(df, Model(ModelSpec("z", ((c,),)), "logit", (Coefficients(only=(c,)),))).first() for c in ("tiny", "unit"))
    assert small.converged and small.estimate * 1e-9 == pytest.approx(plain.estimate, rel=1e-6)


@pytest.mark.parametrize(("level", "df", "want"), [(0.9999, 1, 6366.1976713), (0.999, 1, 636.6192488), (0.95, 4, 2.7764451052), (0.9999, 2, 99.9924991), (0.99, 199, 2.6007603), (0.95, 0.5, None)])
def test_t_quantile_in_the_tail(spark, level, df, want):
    got = spark.range(1).select(F.lit(float(df)).alias("df")).select(dist.t_quantile(level, "df").alias("q"), "df").withColumn("p", dist.t_p("q", "df")).first()
    assert got.p == pytest.approx(1 - level, rel=1e-6)
    assert want is None or got.q == pytest.approx(want, rel=1e-7)


def coded(spark):
    rows = [(q, i % 2, i % 5 if q == "wide" else i % 4, float((i * 7 + i // 3) % 5 < 2)) for q in ("wide", "fine") for i in range(400)]
    return spark.createDataFrame(rows, "question string, treat int, code int, y double")


@pytest.mark.parametrize("by_rows", [False, True])
def test_numbers_outside_the_list_are_reported(spark, by_rows):
    spec = ModelSpec("y", (("treat",), ("code",)), codes={"treat": BOTH, "code": (0, 1, 2, 3)})
    model = Model(spec, "logit", (Coefficients(),))
    got = {}
    for r in fit(coded(spark), model, by_rows=by_rows).collect():
        got.setdefault(r.question, r)
    assert (got["wide"].converged, got["wide"].error, got["wide"].n) == (False, "values outside the list of code", 400)
    assert got["fine"].converged
    kept = fit(coded(spark), model, by_rows=by_rows, drop_failed=True).select("question").distinct().collect()
    assert [r.question for r in kept] == ["fine"]
    assert {r.n for r in fit_linear(coded(spark), spec, [Coefficients()]).collect()} == {400}


def test_drop_failed_of_several_models(spark):
    spec = ModelSpec("y", (("treat",),), codes={"treat": BOTH})
    df = coded(spark).withColumn("y", F.when(F.col("question") == "wide", F.col("treat").cast("double")).otherwise(F.col("y")))
    models = {"a": Model(spec, "logit", (Coefficients(),)), "b": Model(spec, "logit", (Contrast("treat", "treat"),), max_steps=60)}
    assert {r.question for r in fit_many(df, models, drop_failed=True).collect()} == {"fine"}


def test_step_limit_is_a_parameter(spark):
    spec = ModelSpec("y", (("treat",),), codes={"treat": BOTH})
    assert fit(coded(spark), Model(spec, "logit", (Coefficients(),), max_steps=1)).first().error == "no convergence"


def test_hooks_take_reduced_input_only(spark):
    df = coded(spark)
    fn = lambda frame: [{"estimate": float(frame["n"].sum()), "converged": True}]
    with pytest.raises(ValueError):
        fit_by(df, ["question"], fn)
    assert {r.estimate for r in fit_by(cell_totals(df, ["question", "treat"]), ["question"], fn).collect()} == {400.0}
    assert fit_by(df.groupBy("question").agg(F.count("*").alias("n")), ["question"], fn, bounded=True).count() == 2


def test_a_column_called_n_is_no_mark(spark):
    df = coded(spark).withColumn("_n", F.lit(7))
    assert not is_compressed(df) and is_compressed(compress(df, ["question", "treat"]))
    assert saturated.linear_effects(df, "y").first().n == 400


def test_one_level_for_all_bounds(spark):
    spec = ModelSpec("y", (("treat",),), codes={"treat": BOTH})
    fits = fit(coded(spark), Model(spec, "logit", (Coefficients(profile=True, level=0.9), AverageSlope("treat"))))
    with pytest.raises(ValueError):
        with_inference(fits, ["question"], level=0.95)
    slope = with_inference(fits, ["question", "term"]).where("term = 'slope(treat)'").first()
    assert (slope.conf_high - slope.conf_low) / slope.std_error == pytest.approx(2 * 1.6448536, rel=1e-6)


def test_snapshot_prunes_and_splits(spark, tmp_path):
    df = coded(spark).repartition(20)
    write_long(df, str(tmp_path / "snap"))
    assert len(list((tmp_path / "snap").glob("question=*/*.parquet"))) <= 4
    one = read_long(spark, str(tmp_path / "snap"), ["fine"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 400 and re.search(r"PartitionFilters: \[[^]]*question#\d+ = fine", plan)
