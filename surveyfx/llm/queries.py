"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyfx.llm import bpe, chosenpath, decontaminate, idfiles, jaccard, lines, merkle, negatives, secrets, substrings, topk, toxicity, warc, words
from surveyfx.llm.common import shared_folder

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    docs = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer), tokenizer)
    ids_text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return docs.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "ids")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id", F.xxhash64("text"))
    idfiles.write_ids(words.encode(docs, public_tokenizers.path("word_bpe_49k.json")), folder, end_id=2)
    return idfiles.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: F.when(span["kind"] == kind, 1)


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets.spans", lambda s: s["depth"] == 0)
    counts = [F.size(F.array_compact(F.transform(base, is_kind(k)))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return docs.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets.spans")).alias("spans"), F.col("secrets.too_large").alias("too_large"))


@query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = lines.remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.stretches(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("first_doc_id"), "start", "end", "n_sentences")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op11_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chosenpath.near_copies(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.prove(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], {"text": lower}, tampered)


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
