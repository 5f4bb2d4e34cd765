"""A snapshot of a long table that a failed write leaves as it was.

Every write goes to a folder of its own, partitioned by question. A manifest says which folder holds each question, and
becomes visible in one step when all data lie there; readers go by the newest manifest alone. So a write that dies leaves
no trace for readers, single questions can be replaced, and readers that have begun keep the files they began with.

    path/data/version=<name>/question=<question>/*.parquet
    path/manifest/<number>.json
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _newest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    numbers = [int(n.split(".")[0]) for n in _names(spark, f"{path}/manifest") if n.endswith(".json")]
    if not numbers:
        return 0, None
    text = spark.read.text(f"{path}/manifest/{max(numbers):08d}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Show a manifest under its number; an error if another writer took the number first."""
    fs, hidden = _file_system(spark, f"{path}/manifest/{uuid.uuid4().hex}.tmp")
    _, final = _file_system(spark, f"{path}/manifest/{number:08d}.json")
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise RuntimeError(f"another write took number {number} of {path}; this one is not part of the snapshot")


def write_snapshot(long: DataFrame, path: str, question: str = "question", merge: bool = False) -> int:
    """Write a new state of the snapshot and return its number. With `merge`, only the questions that `long` holds are
    replaced, and the columns must be the snapshot's own. A question without rows is not part of a snapshot."""
    spark = long.sparkSession
    number, old = _newest(spark, path)
    schema = json.loads(long.schema.json())
    if merge and old and sorted((f["name"], str(f["type"])) for f in old["schema"]["fields"]) != sorted((f["name"], str(f["type"])) for f in schema["fields"]):
        raise ValueError("the columns differ from the snapshot's")
    version = uuid.uuid4().hex
    folder = f"{path}/data/version={version}"
    long.hint("rebalance", question).write.partitionBy(question).parquet(folder)
    written = [n for n in _names(spark, folder) if n.startswith(f"{question}=")]
    kept = old["folders"] if merge and old else {}
    _commit(spark, path, number + 1, {"question": question, "schema": schema, "folders": {**kept, **dict.fromkeys(written, version)}})
    return number + 1


def read_snapshot(spark: SparkSession, path: str, questions: Sequence[str] | None = None) -> DataFrame:
    """The newest complete state; only the folders of the wanted questions are listed and read."""
    _, manifest = _newest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no complete snapshot at {path}")
    question = manifest["question"]
    wanted = {f: v for f, v in manifest["folders"].items() if questions is None or unquote(f.split("=", 1)[1]) in questions}
    schema = T.StructType.fromJson(manifest["schema"])
    if not wanted:
        return spark.createDataFrame([], schema)
    whole = T.StructType([f for f in schema.fields if f.name != question] + [T.StructField("version", T.StringType()), schema[question]])
    paths = [f"{path}/data/version={v}/{f}" for f, v in sorted(wanted.items())]
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*paths).select(*schema.names)
