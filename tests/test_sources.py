"""Readers, writers, codebooks."""

import re

import pytest

from surveyfx.operators.report import write_table
from surveyfx.plans.survey_view import CODEBOOK, survey_wide
from surveyfx.sources import codebook as C
from surveyfx.sources.longform import read_long, read_wide, to_long, treatment_from_zero, write_long


def test_snapshot_round_trip_and_pruning(spark, long, tmp_path):
    path = str(tmp_path / "long")
    write_long(long, path)
    back = read_long(spark, path)
    key = ["caseid", "question", "response"]
    assert sorted(map(str, back.select(key).collect())) == sorted(map(str, long.select(key).collect()))
    one = read_long(spark, path, ["q3"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*question", plan)
    assert {r.question for r in one.select("question").distinct().collect()} == {"q3"}


def test_csv_needs_schema(spark, tmp_path):
    path = str(tmp_path / "csv")
    spark.createDataFrame([(1, None, 0), (2, 3, None)], "id int, q1 int, treat_raw int").write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        read_wide(spark, path, "csv")
    wide = read_wide(spark, path, "csv", "id int, q1 int, treat_raw int")
    got = sorted(tuple(r) for r in wide.select("id", "q1", treatment_from_zero("treat_raw").alias("t")).fillna(-1).collect())
    assert got == [(1, -1, 1), (2, 3, -1)]


def test_unpivot_keeps_null_answers(spark):
    wide = spark.createDataFrame([(1, 2, None)], "id int, q1 int, q2 int")
    assert sorted((r.question, r.response) for r in to_long(wide, ["q1", "q2"]).collect()) == [("q1", 2), ("q2", None)]


def test_labels_travel_in_metadata(spark, sf_dir):
    wide = survey_wide(spark, sf_dir)
    book = C.codebook_from_metadata(wide)
    assert book.count() == 24
    assert {r.var_name: r.label for r in book.collect()} == {q.name: q.label for q in CODEBOOK.questions}
    assert CODEBOOK.frame(spark).count() == 24
    decoded = C.decode_labelled(wide)
    answers = {r.q6 for r in decoded.select("q6").distinct().collect()}
    assert answers == {"Was justified", "Was not justified", "Not sure", None}


def test_code_without_label_keeps_digits(spark):
    df = C.with_labels(spark.createDataFrame([(1,), (7,)], "x int"), {"x": ("X", {1: "one"})})
    assert [r.x for r in C.decode_labelled(df).collect()] == ["one", "7"]


def test_write_result_table(spark, tmp_path):
    path = str(tmp_path / "table")
    write_table(spark.createDataFrame([("a", 1.5)], "k string, v double"), path)
    assert spark.read.option("header", True).csv(path).collect()[0].v == "1.5"


def test_question_dimension(spark):
    df = spark.createDataFrame([("q1",), ("q8",), ("zz",)], "question string")
    got = [tuple(r) for r in df.select(CODEBOOK.rank(), CODEBOOK.rank(descending=True), CODEBOOK.kind("question", "Factual", "Policy"), CODEBOOK.label()).collect()]
    assert got == [(1, 8, "Factual", "First delivery was complete"), (8, 1, "Policy", "Support ending the contract"), (None, None, "Policy", None)]
