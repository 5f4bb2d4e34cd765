"""Toxicity, the pipeline, reference SQL and the entry points."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from surveyfx.llm import decontaminate, jaccard, lines, oracle, queries, toxicity

SMALL = "/root/testdata/sf0.01"


def test_toxicity_on_rows_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/../sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SMALL}/../sf0.1/labels.parquet")
    learnt = toxicity.labelled_rows(docs, labels)
    scored = toxicity.score(docs, learnt).join(labels, "doc_id").toPandas()
    assert learnt.count() == sum(zlib.crc32(str(d).encode()) % 3 != 1 for d in scored["doc_id"])
    test = scored[[zlib.crc32(str(d).encode()) % 3 == 1 for d in scored["doc_id"]]]
    said, true = test["score"] >= toxicity.THRESHOLD, test["toxic"] == 1
    assert (said & true).sum() / said.sum() > 0.85 and (said & true).sum() / true.sum() > 0.8
    assert test["score"].between(0, 1).all()


def test_toxicity_of_awkward_rows(spark):
    rows = [(i, "fine words here and there" if i % 2 else "you vile fool of words") for i in range(40)] + [(90, None), (91, ""), (92, "vile " * 9000), (92, "vile " * 9000), (None, "vile fool")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(90, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.labelled_rows(docs, labels)).collect()}
    assert got[0] > 0.7 > 0.3 > got[1] and got[None] > 0.7 and got[92] > 0.7 and got[90] == got[91] < 0.5
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        flat = {r["score"] for r in toxicity.score(docs, toxicity.labelled_rows(docs, some)).collect()}
        assert len(flat) == 1 and 0 <= flat.pop() <= 0.5
    assert toxicity.score(docs.limit(0), toxicity.labelled_rows(docs, labels)).count() == 0


def test_label_model_weighs_correlated_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.9, y, rng.random(4000) < 0.05) for _ in range(3)]
    bad = np.where(rng.random(4000) < 0.5, y, rng.random(4000) < 0.5)
    votes = np.stack([*good, *[bad] * 6], axis=1).astype(bool)
    q = toxicity.posterior(votes, np.where(rng.random(4000) < 0.1, 1 - y, y).astype(float))
    assert ((q > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_reference_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.execute(oracle.SQL[name]).fetchdf()
    got = queries.REGISTRY[name](spark, SMALL).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda f: sorted(tuple(str(x) for x in r) for r in f[sorted(want.columns)].astype(object).where(lambda v: v.notna(), None).itertuples(index=False))
    assert [tuple(x.removesuffix(".0") for x in r) for r in rows(want)] == [tuple(x.removesuffix(".0") for x in r) for r in rows(got)]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    labels, items = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.labelled_rows(docs, labels)).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {d for d, s in scores.items() if s < toxicity.THRESHOLD}
    cleaned = stages["lines"](spark, docs, SMALL)
    want = {r["doc_id"]: r["text"] for r in lines.remove_boilerplate(docs).collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in cleaned.collect()} == {d: (t, len(t)) for d, t in want.items()}
    one = stages["near-copies"](spark, docs, SMALL)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in jaccard.join_components(docs).collect()})
    clean = stages["benchmark"](spark, docs, SMALL)
    bad = {r["doc_id"] for r in decontaminate.contaminated(docs, items).collect()}
    assert bad and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    coded = stages["tokens"](spark, docs.limit(50), SMALL)
    assert all(r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in coded.collect())


def test_pipeline_runs_whole(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < out.count() <= 200
    assert out.filter("not round_trip").count() == 0


def test_pipeline_on_awkward_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "some words in a text here", None, "t", None), (None, "some words in a text here", None, "t", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in docs.collect())[:3] and docs.count() == 3


def test_every_operator_is_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries() and set(oracle.SQL) <= set(__spark_entry__.oracle_sql())
