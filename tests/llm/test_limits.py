"""What operators hold at a time: batches by bytes, rows that grow with the input and not with its square."""

import random
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from surveyfx.llm import bpe, chosenpath, common, idfiles, jaccard, substrings, words


def test_written_tables_are_made_from_batches_of_few_bytes(spark):
    def sizes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64()), pa.array([batch.num_rows], pa.int64())], names=["size", "rows"])

    before = spark.conf.get(common.BATCH_SETTING)
    texts = spark.range(400, numPartitions=1).select(F.repeat(F.lit("0123456789"), 5_000).alias("text"))
    got = common.written(texts.mapInArrow(sizes_of, "size long, rows long"), "sizes").agg(F.max("size").alias("most"), F.sum("rows").alias("rows")).first()
    assert got["rows"] == 400 and got["most"] <= 2 * common.BATCH_BYTES
    assert spark.conf.get(common.BATCH_SETTING) == before


def long_texts(spark):
    return spark.range(400, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("0123456789"), 5_000).alias("text"))


def test_repeats_are_looked_for_in_batches_of_few_bytes(spark, monkeypatch):
    most, schema = 2 * common.BATCH_BYTES, substrings.RUN

    def run_table(df, text, doc):
        def task(batches):
            for batch in batches:
                if batch.nbytes > most:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield pa.RecordBatch.from_pylist([], schema=pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in schema.split(", ")]))

        return df.mapInArrow(task, schema)

    monkeypatch.setattr(substrings, "run_table", run_table)
    assert substrings.stretches(long_texts(spark)).count() == 0


def test_token_files_are_made_from_batches_of_few_bytes(spark, tmp_path):
    most = 2 * common.BATCH_BYTES

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        if texts.nbytes > most:
            raise ValueError(f"a batch of {texts.nbytes} bytes")
        return pa.array([[1, 2]] * len(texts), pa.list_(pa.int32()))

    docs = long_texts(spark).select("doc_id", ids_of("text").alias("ids"))
    assert idfiles.write_ids(docs, f"file://{tmp_path}").agg(F.sum("n_ids")).first()[0] == 800


def test_separators_that_only_python_takes_for_white_space():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = words.WordEncoder(path)
    texts = ["a\x1cb c\x1d \x1e", "x\x1fy", "Ελλάς a\x1cb", "a\x85b\xa0c"]
    want = [array("I", encoder.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert encoder.encode(texts) == want


def test_new_words_of_latin_letters_cost_no_more_than_their_merging():
    encoder = words.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    letters = "abcdeéßøĀst'!?-09 \n\x01\x7f×÷ÀɎ"
    texts = ["", "l'été<|endoftext|>They'RE 1x2", *("".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2000))]
    want = [array("I", encoder.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    encoder.library = None
    assert encoder.encode(texts) == want


def test_tables_of_tokenizers_do_not_stay_in_a_worker_that_does_other_work():
    class Rows:
        def select(self, *_):
            return self

        def mapInArrow(self, task, _):  # noqa: N802
            return task

    task = jaccard.pack(Rows(), 5, 75, np.zeros(0, np.uint64), 4)
    bpe.tables(public_tokenizers.path("byte_bpe_50k.json")), words.encoder(public_tokenizers.path("word_bpe_49k.json"))
    made = list(task(iter([pa.RecordBatch.from_pydict({"text": ["one two three four five six", None]})])))
    assert sum(b.num_rows for b in made) > 0
    assert not bpe.tables.cache_info().currsize and not words.encoder.cache_info().currsize


def test_rows_of_a_large_mixed_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(chosenpath, "NODE_CLASSES", 12)
    rows_of = {}

    def counted(df, name):
        out = common.written(df, name)
        rows_of[name] = max(rows_of.get(name, 0), out.count())
        return out

    monkeypatch.setattr(chosenpath, "written", counted)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def edited(words, changes):
        words = list(words)
        for at in rng.sample(range(len(words)), changes):
            words[at] = f"e{rng.randrange(10**9)}"
        return words

    # any two are much alike, but only the last pair is alike enough
    texts = [edited(base, 8) for _ in range(120)]
    texts.append(edited(texts[7], 1))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in chosenpath.near_copies(df).collect()}
    assert got == {k: 7 if k == 120 else k for k in range(121)}
    # what is settled at the end has each class once, not once for every block of its node
    assert max(rows_of.get(name, 0) for name in ("dense-members", "open-classes")) <= 121 and "open-texts" in rows_of
