"""Null rules and value rules of the recodes."""

from pyspark.sql import functions as F

from surveyfx.functions import recode as R
from surveyfx.operators import reshape


def values(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def test_null_propagation(spark):
    got = values(
        spark, [(1,), (2,), (None,)], "x int",
        R.flag(F.col("x") == 1), R.flag_in("x", (1,)), R.indicator("x", 1), R.member("x", (1,)),
    )
    assert got == [(1, 1, 1.0, True), (0, 0, 0.0, False), (None, 0, None, False)]


def test_value_sets(spark):
    got = values(
        spark, [(1,), (4,), (9,), (None,)], "x int",
        R.recode("x", {"low": (1, 2), "mid": (4,)}), R.recode("x", {"low": (1,)}, default="other"),
        R.level_rank("x", (4, 1)), R.known_level("x", (1,)),
    )
    assert got == [("low", "low", 2, 1), ("mid", "other", 1, None), (None, "other", None, None), (None, "other", None, None)]


def test_labels(spark):
    got = values(
        spark, [("Strong",), ("Weak",), ("Other",), (None,)], "x string",
        R.collapse("x", {"Any": ("Strong", "Weak")}), R.relabel("x", {"Weak": "Soft"}), R.lookup("x", {"Weak": "w"}),
    )
    assert got == [("Any", "Strong", None), ("Any", "Soft", "w"), ("Other", "Other", None), (None, None, None)]


def test_suffix_first_match_only(spark):
    assert values(spark, [("Yes prob prob",), ("No",)], "x string", R.strip_suffix("x", " prob")) == [("Yes prob",), ("No",)]


def test_reverse_coding(spark):
    got = values(
        spark, [("a", 1), ("a", 3), ("a", None), ("b", 1)], "question string, response int",
        R.swap_codes("question", "response", ["a"], {1: 2, 2: 1, 3: 3}),
    )
    assert got == [(2,), (3,), (None,), (1,)]


def test_stars(spark):
    got = values(spark, [(0.0005,), (0.005,), (0.03,), (0.07,), (0.5,), (None,)], "p double", R.stars("p"))
    assert [g[0] for g in got] == ["***", "**", "*", "†", "", ""]


def test_weighted_mean(spark):
    data = [("a", 1.0, 2.0), ("a", 0.0, 1.0), ("a", None, 9.0), ("b", 1.0, None), ("c", None, None)]
    df = spark.createDataFrame(data, "g string, x double, w double")
    got = {r.g: r.m for r in df.groupBy("g").agg(R.weighted_mean(F.col("x"), F.col("w")).alias("m")).collect()}
    assert got == {"a": 2 / 3, "b": None, "c": None}


def test_spread_absent_cell_is_null(spark):
    df = spark.createDataFrame([("q", "x", 1.0, 2.0), ("r", "y", 3.0, 4.0)], "k string, t string, a double, b double")
    got = {r.k: tuple(r)[1:] for r in reshape.spread(df, ["k"], "t", {"x": "x", "y": "y"}, ["a", "b"]).collect()}
    assert got == {"q": (1.0, 2.0, None, None), "r": (None, None, 3.0, 4.0)}


def test_order_by_mean(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("b", 2.0), ("c", 0.0)], "k string, v double")
    got = {r.k: r.position for r in reshape.order_by_mean(df, "k", F.col("v")).collect()}
    assert got == {"c": 1, "b": 2, "a": 3}


def test_rename_helpers(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert reshape.rename_at(reshape.rename(df, {"b": "y"}), 0, "x").columns == ["x", "y"]
