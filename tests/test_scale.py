"""Plan shape: what decides whether a query holds at a thousand times the data."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import surveyfx
from surveyfx.operators import rowsums, saturated
from surveyfx.operators.cells import cell_totals
from surveyfx.operators.fit import Coefficients, Model, fit
from surveyfx.operators.spec import ModelSpec, crossed
from surveyfx.plans.queries import REGISTRY
from surveyfx.plans.survey_view import survey_long

BOTH = (0, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stages(df):
    """Final adaptive plan, after running it."""
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_no_pairwise_plans_and_no_collected_groups(spark, sf_dir, key):
    text = plan(REGISTRY[key](spark, sf_dir))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "collect_list", "collect_set", "BatchEvalPython"):
        assert bad not in text


#: Queries that write and reread, and fits that pass over stored rows more than once.
OTHER_SCANS = {"snapshot_question", "snapshot_replace", "direction_open_covariate"}


@pytest.mark.parametrize("key", sorted(set(REGISTRY) - OTHER_SCANS))
def test_answers_are_scanned_once(spark, sf_dir, key):
    text = stages(REGISTRY[key](spark, sf_dir))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", text)) <= 1


def test_scan_reads_needed_columns_and_pushes_filters(spark, sf_dir):
    df = REGISTRY["did_party_ztest"](spark, sf_dir)
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "l_extendedprice" not in text and "o_totalprice" not in text
    filters = [line for line in text.splitlines() if line.startswith("PushedFilters")]
    assert any("GreaterThanOrEqual(l_linenumber,1)" in line for line in filters)


def test_python_step_sees_reduced_cells(spark, sf_dir):
    """Rows are partially aggregated before any shuffle that leads to Python."""
    text = plan(REGISTRY["ordinal_party"](spark, sf_dir))
    python = text.index("FlatMapGroupsInPandas")
    below = text[python:]
    assert "partial_count" in below
    # group shuffle, cell shuffle, answers shuffle; orders may add a join shuffle when nothing is broadcast
    assert len(re.findall(r"Exchange hashpartitioning\(question", below)) == 2


def test_cell_count_does_not_grow_with_rows(spark):
    keys = ["question", "treat", "pid7_baseline", "saw", "response"]
    a, b = (cell_totals(survey_long(spark, f"/root/testdata/sf{sf}"), keys, "weight").count() for sf in ("0.01", "0.1"))
    assert a == b <= 8 * 2 * 8 * 3 * 3


def test_cell_bound_comes_from_the_specification():
    spec = ModelSpec("y", crossed("t", "p"), levels={"p": ("a", "b", "c")}, codes={"t": BOTH})
    assert spec.cell_bound() == 12
    assert spec.with_terms([*spec.terms, ("age",)]).cell_bound() is None


@pytest.fixture(scope="module")
def skewed(spark):
    """One question holds more than a third of all rows, and one treated cell most of that question."""
    rows = spark.range(120_000).select(
        F.when(F.col("id") % 5 < 3, "hot").otherwise(F.concat(F.lit("q"), F.col("id") % 40)).alias("question"),
        F.when(F.col("id") % 11 < 9, 1).otherwise(0).alias("treat"),
        (F.col("id") * 7 % 3 == 0).cast("double").alias("y"),
    )
    return rows


def test_hot_question_equals_brute_force(skewed):
    got = {r.question: r for r in saturated.linear_effects(skewed, "y", reference="t").collect()}
    frame = skewed.where("question = 'hot'").toPandas()
    means = frame.groupby("treat")["y"].mean()
    assert got["hot"].estimate == pytest.approx(means[1] - means[0], abs=1e-12)
    assert got["hot"].n == len(frame)
    assert len(got) == skewed.select("question").distinct().count()


def test_hot_question_reaches_python_as_cells(skewed):
    spec = ModelSpec("y", (("treat",),), codes={"treat": BOTH})
    df = fit(skewed, Model(spec, "logit", (Coefficients(),)))
    text = stages(df)
    assert "partial_count" in text
    assert {r.question for r in df.collect() if r.converged} == {r.question for r in skewed.select("question").distinct().collect()}


def test_no_local_checkpoints():
    root = Path(surveyfx.__file__).parent
    assert all("localCheckpoint" not in p.read_text() for p in root.rglob("*.py"))


@pytest.mark.parametrize("family", sorted(rowsums.FAMILY_SUMS))
def test_open_steps_have_no_python_below_their_sums(spark, family):
    data = spark.createDataFrame([("q", 1.0, 1.0, 1.0, [True], 1.0, 0.3)], "question string, _y double, _w double, _rows double, _use array<boolean>, _x0 double, _x1 double")
    tasks = spark.createDataFrame([("q", 0, 0, [1, 2, 3], [0.0] * 6)], "question string, task int, model int, classes array<int>, candidate array<double>")
    text = plan(rowsums.newton_sums(data, tasks, ["question"], rowsums.FAMILY_SUMS[family](2, ("a", "b", "c"))))
    assert "partial_sum" in text and "Python" not in text and "Pandas" not in text


def test_slopes_have_no_python_below_their_sums(spark):
    data = spark.createDataFrame([("q", 1.0, 1.0, 1.0, [True], 0.3, 1.0)], "question string, _y double, _w double, _rows double, _use array<boolean>, _x0 double, _d0_0 double")
    tasks = spark.createDataFrame([("q", 0, 0, [0, 1], [0.5])], "question string, task int, model int, classes array<int>, candidate array<double>")
    text = plan(rowsums.slope_sums(data, tasks, ["question"], 1, [0]))
    assert "partial_sum" in text and "Python" not in text and "Pandas" not in text
