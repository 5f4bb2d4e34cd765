"""A corpus cleaned from raw documents to token ids, each stage written before the next begins.

Toxic documents go; boilerplate lines go; of each group of near copies the document with the smallest id stays; documents that hold benchmark passages
go; the rest is encoded, and decoded again as a proof. Null texts count as empty; an empty document passes every stage. Of near copies the row is kept
whose id is the component's name; exact repeats of a row keep one row. Where a whole group has no id, one row of each of its texts stays.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyfx.llm import bpe, decontaminate, jaccard, lines, toxicity
from surveyfx.llm.common import row_key, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.labelled_rows(docs, labels), out="__toxicity")
    return scored.filter(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = jaccard.join_components(docs)
    # documents without words are near copies of nothing
    kept = named.filter((F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("key").alias("__key"))
    kept = written(kept.distinct(), "kept-rows")
    rows = docs.withColumn("__key", row_key("doc_id", "text")[0]).join(kept, "__key")
    first = F.row_number().over(Window.partitionBy("__key").orderBy("source", "lang"))
    return rows.withColumn("__row", first).filter("__row = 1").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(docs, tokenizer), tokenizer)
    back = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return coded.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), back.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("lines", drop_boilerplate),
    ("near-copies", keep_one_of_near_copies),
    ("benchmark", drop_contaminated),
    ("tokens", encode),
]

#: The learnt toxicity score and byte-pair merging are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
