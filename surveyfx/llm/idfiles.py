"""Token-id files with shuffled planes.

Documents are sorted by id over the whole table and their token ids run on from one document to the next. Ids are cut into blocks of a fixed
size; a block is transposed so that equal bytes (or bits) of all its ids lie together, and each such plane is compressed by itself, because the
high planes hardly vary. A plane of zeros takes no room. The chunk index holds place and size of every plane, so one block can be read alone.

    file   = MAGIC, planes of block 0, planes of block 1, ..., document table, chunk index, footer (JSON), its length (4 bytes), MAGIC

A task rolls to the next file after `file_ids` ids. A file is written under a temporary name and renamed, under a name made of its task and
number: a repeated task writes the same names with the same content. The manifest, a table beside the files, lists what belongs together.

Null document ids come first; a null id list counts as empty; repeated ids keep their rows, ordered by content. An empty table gives no file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyfx.llm.common import small_batches

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
FILE_IDS = 1 << 23
SUFFIX = ".idp"
MANIFEST = "file string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, bits: bool) -> np.ndarray:
    """(planes, bytes) of a block of unsigned 32-bit ids: 4 byte planes, or 32 bit planes padded to whole bytes."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(octets.T)


def from_planes(planes: np.ndarray, n: int, bits: bool) -> np.ndarray:
    octets = np.packbits(np.unpackbits(planes, axis=1, count=n).T, axis=1, bitorder="little") if bits else planes[:, :n].T
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class IdFile:
    """Collects one file: complete blocks are compressed at once, so only a block of ids waits in memory."""

    def __init__(self, bits: bool, level: int, block: int):
        self.bits, self.block = bits, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.body, self.at, self.index = [MAGIC], len(MAGIC), []
        self.waiting, self.n_waiting, self.docs, self.sizes, self.n_ids = [], 0, [], [], 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            flat = np.concatenate(self.waiting)
            whole = len(flat) // self.block * self.block
            for at in range(0, whole, self.block):
                self._flush(flat[at : at + self.block])
            self.waiting, self.n_waiting = [flat[whole:]], len(flat) - whole

    def _put(self, data: bytes) -> tuple[int, int]:
        self.body.append(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self, ids: np.ndarray) -> None:
        self.index.append([self._put(self.zip.compress(p.tobytes()) if p.any() else b"") for p in to_planes(ids, self.bits)])

    def finish(self) -> bytes:
        if self.n_waiting:
            self._flush(np.concatenate(self.waiting))
        known = np.array([d is not None for d in self.docs], dtype=np.uint8)
        docs = np.array([0 if d is None else d for d in self.docs], dtype="<i8")
        table = self._put(self.zip.compress(docs.tobytes() + np.array(self.sizes, dtype="<i8").tobytes() + known.tobytes()))
        index = self._put(self.zip.compress(np.array(self.index, dtype="<i8").tobytes()))
        footer = json.dumps({"bits": self.bits, "block": self.block, "docs": len(self.docs), "ids": self.n_ids, "table": table, "index": index}).encode()
        return b"".join([*self.body, footer, len(footer).to_bytes(4, "little"), MAGIC])


def read_file(data: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file in order, block by block."""
    if data[: len(MAGIC)] != MAGIC or data[-len(MAGIC) :] != MAGIC:
        raise ValueError("not a complete token-id file")
    unzip, view = zstandard.ZstdDecompressor(), memoryview(data)
    end = len(data) - len(MAGIC) - 4
    size = int.from_bytes(view[end : end + 4], "little")
    foot = json.loads(bytes(view[end - size : end]))
    cut = lambda place: unzip.decompress(view[place[0] : place[0] + place[1]])
    table, n = cut(foot["table"]), foot["docs"]
    docs, sizes, known = np.frombuffer(table, "<i8", n), np.frombuffer(table, "<i8", n, 8 * n), np.frombuffer(table, np.uint8, n, 16 * n)
    planes = 32 if foot["bits"] else 4
    index = np.frombuffer(cut(foot["index"]), "<i8").reshape(-1, planes, 2)

    def block(k: int) -> np.ndarray:
        ids = min(foot["block"], foot["ids"] - k * foot["block"])
        width = -(-ids // 8) if foot["bits"] else ids
        rows = [np.frombuffer(cut(p), np.uint8) if p[1] else np.zeros(width, np.uint8) for p in index[k].tolist()]
        return from_planes(np.stack(rows), ids, foot["bits"])

    k, have = 0, np.zeros(0, dtype="<u4")
    for d, s, there in zip(docs.tolist(), sizes.tolist(), known.tolist()):
        parts, need = [], s
        while need > len(have):
            parts.append(have)
            need -= len(have)
            have, k = block(k), k + 1
        parts.append(have[:need])
        have = have[need:]
        yield (d if there else None), np.concatenate(parts) if len(parts) > 1 else parts[0]


def store(folder: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return arrow_fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def rename(system: arrow_fs.FileSystem, waiting: str, final: str) -> None:
    """Give a complete file its name. A repeated task replaces what it wrote before, also where a file system renames onto no existing file."""
    try:
        system.move(waiting, final)
    except OSError:
        if system.get_file_info(final).type == arrow_fs.FileType.NotFound:
            raise
        system.delete_file(final)
        system.move(waiting, final)


def commit(folder: str, name: str, data: bytes) -> None:
    """Write a file under a temporary name, then rename it: readers never meet half a file."""
    system, root = store(folder)
    system.create_dir(root, recursive=True)
    waiting = f"{root}/.{name}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(waiting) as out:
        out.write(data)
    rename(system, waiting, f"{root}/{name}")


def write_ids(df: DataFrame, folder: str, doc: str = "doc_id", ids: str = "ids", end_id: int | None = None, bits: bool = False, level: int = 3, block_ids: int = BLOCK_IDS, file_ids: int = FILE_IDS) -> DataFrame:
    """Write a table that is sorted over all its partitions; give the manifest, itself written under `folder`.

    `end_id` is put behind every document. `bits` chooses bit planes in place of byte planes.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        tail = np.array([] if end_id is None else [end_id], dtype="<u4")
        out = None

        def close() -> pa.RecordBatch:
            data, name = out.finish(), f"ids-{part:06d}-{number:06d}{SUFFIX}"
            commit(f"{folder}/files", name, data)
            return pa.RecordBatch.from_pylist([{"file": name, "n_docs": len(out.docs), "n_ids": out.n_ids, "n_bytes": len(data)}], schema=schema)

        schema = pa.schema([("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
        for batch in batches:
            lists = batch.column(1)
            flat, ends = np.asarray(lists.values).view("<u4"), np.asarray(lists.offsets)
            for d, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                if out is None:
                    out = IdFile(bits, level, block_ids)
                out.add(d, np.concatenate([flat[a:b], tail]))
                if out.n_ids >= file_ids:
                    yield close()
                    out, number = None, number + 1
        if out is not None:
            yield close()

    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc"), F.coalesce(F.col(f"`{ids}`"), F.array()).cast("array<int>").alias("ids"))
    # a task's ids may be made by a second worker, from texts: batches of few bytes in both
    with small_batches(df.sparkSession):
        rows.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of all files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit, binary)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for files in batches:
            for path, data in zip(files.column(0), files.column(1)):
                name, at, rows, held = path.as_py().rsplit("/", 1)[-1], 0, [], 0
                for d, ids in read_file(data.as_py()):
                    rows.append((name, d, at, len(ids), ids.tobytes()))
                    at += len(ids)
                    held += 4 * len(ids)
                    if held > 1 << 23 or len(rows) >= 5000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row a file: the running total needs them in one place, the documents stay where they are
    before = manifest.select("file", (F.sum("n_ids").over(Window.orderBy("file")) - F.col("n_ids")).alias("before"))
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(f"{folder}/files").select("path", "content")
    docs = files.mapInArrow(task, "file string, doc_id long, at long, n_tokens long, ids binary")
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
