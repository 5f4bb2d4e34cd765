"""WARC archives written in parallel, the same bytes whatever the cluster does, and read back.

Records are sorted by page id over the whole table and cut into shards, ranges of ids whose bounds follow from the sizes of the payloads alone: the
id range is laid out in `SLOTS` equal slots, and a shard ends with the slot in which it reaches `shard_bytes`. A page id is never cut. Of pages with
equal payloads the one with the largest id becomes a response, the others revisit it. Who revisits whom is found on ids and digests alone; these notes
are then sorted in among the pages, so page texts move once and no group of equal payloads ever meets in one task. A task compresses each record by
itself (one gzip member), regenerates its headers, lengths and digests from the bytes it writes, and rolls to the next file with a new shard or once the
compressed size is reached. Files are named by shard and number, get temporary names and are renamed; a repeated task writes the same names and bytes.
The manifest, a table beside the files, lists what belongs together; the reader reads what it lists, whatever else lies in the folder.

A null text is an empty payload, and empty payloads revisit each other too (`least_bytes`). Null ids sort first, count as the smallest id and read
back as null. Among rows of the same id and payload the first (by address, nulls first) is the response. Control characters and spaces in an
address are percent-encoded. An empty table gives no file and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyfx.llm.common import tasks_for, written
from surveyfx.llm.idfiles import rename, store

SUFFIX = ".warc.gz"
FILE_BYTES = 1 << 25
#: Payload bytes that fill a shard, and the most shards there can be.
SHARD_BYTES, SLOTS = 1 << 25, 1 << 13
#: Records carry a date that is the same in every run.
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, n_records long, n_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page: int | None, copy: int = 0) -> str:
    return f"urn:page:{'none' if page is None else page}" + (f":{copy}" if copy else "")


def page_of(name: str) -> int | None:
    part = name.strip("<>").split(":")[2]
    return None if part == "none" else int(part)


def record(page: int | None, copy: int, url: str | None, payload: bytes, refers: tuple[int | None] | None) -> bytes:
    """One record; `refers` holds the response's page id if this one revisits it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    address = "".join(c if "!" <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else urn(page)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{urn(page, copy)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{urn(*refers)}>", "WARC-Truncated: length"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """One file under its temporary name until it is closed."""

    def __init__(self, folder: str, name: str, level: int):
        self.system, root = store(folder)
        self.system.create_dir(root, recursive=True)
        self.waiting, self.final, self.name = f"{root}/.{name}.{uuid.uuid4().hex}.tmp", f"{root}/{name}", name
        self.out, self.level, self.size, self.records = self.system.open_output_stream(self.waiting), level, 0, 0

    def add(self, data: bytes) -> None:
        zipper = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = zipper.compress(data) + zipper.flush()
        self.out.write(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        rename(self.system, self.waiting, self.final)
        return self.name, self.records, self.size


def sharded(keys: DataFrame, shard_bytes: int) -> tuple[Column, DataFrame]:
    """The slot of a page id, and the shard of each slot that holds pages: slot, shard. Null ids have a slot before all others."""
    least, most = keys.agg(F.min("page"), F.max("page")).first()
    wide = F.lit(float(most or 0) - float(least or 0) or 1.0)
    slot = F.coalesce(F.floor((F.col("page").cast("double") - float(least or 0)) / wide * (SLOTS - 1)), F.lit(-1)).cast("int")
    # a row a slot, at most SLOTS + 1
    sizes = keys.groupBy(slot.alias("slot")).agg(F.sum("size").alias("size"))
    before = F.sum("size").over(Window.orderBy("slot")) - F.col("size")
    return slot, written(sizes.select("slot", F.floor(before / shard_bytes).alias("shard")), "shards")


def write_warc(df: DataFrame, folder: str, page: str = "page_id", url: str = "url", text: str = "html", file_bytes: int = FILE_BYTES, level: int = 3, least_bytes: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write a record for every row; give the manifest, itself written under `folder`."""
    pages = df.select(F.col(f"`{page}`").cast("long").alias("page"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    every = pages.select("page", F.sha1(F.encode("text", "UTF-8")).alias("sha"), F.octet_length("text").alias("size"))
    every = written(every, "payloads")
    slot, shards = sharded(every, shard_bytes)
    keys = every.filter(F.col("size") >= least_bytes)
    equal = written(keys.groupBy("sha").agg(F.max("page").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n"), "equal-payloads")
    # the rows that share the response's id too are told apart by the writer
    notes = keys.join(equal, "sha").select("page", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("text"), "sha", "response")
    rows = pages.select("page", "url", "text", F.lit(None).cast("string").alias("sha"), F.lit(None).cast("long").alias("response"))
    placed = notes.unionByName(rows).withColumn("slot", slot).join(F.broadcast(shards), "slot").select("page", "url", "text", "sha", "response", "shard")
    order = F.col("shard"), F.col("page").asc_nulls_first(), F.col("sha").asc_nulls_last(), F.col("url").asc_nulls_first(), F.xxhash64("text")
    # a number of partitions of their own, or small shards would be put together again
    tasks = tasks_for(shards, shards.select("shard").distinct().count(), 1)
    ordered = placed.repartition(tasks, "shard").sortWithinPartitions(*order)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out = None, 0, None
        schema = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
        at, known, done, copies = (), {}, set(), 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(out.close(), schema)], schema=schema)

        for batch in batches:
            for here, address, content, sha, response, shard in zip(*[c for c in batch.columns]):
                here, sha, shard = here.as_py(), sha.as_py(), shard.as_py()
                if shard != part:
                    if out is not None:
                        yield closed()
                    part, number, out = shard, 0, None
                if at != (here,):
                    at, known, done, copies = (here,), {}, set(), 0
                if sha is not None:
                    known[sha] = response.as_py()
                    continue
                payload = content.as_py().encode()
                own = hashlib.sha1(payload).hexdigest()
                refers = None
                if own in known and (known[own] != here or own in done):
                    refers = (known[own],)
                done.add(own)
                out = out or Archive(f"{folder}/files", f"pages-{part:06d}-{number:06d}{SUFFIX}", level)
                out.add(record(here, copies, address.as_py(), payload, refers))
                copies += 1
                if out.size >= file_bytes:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    ordered.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file one by one; what is read ahead is small."""
    view, at = memoryview(data), 0
    while at < len(view):
        unzip, parts = zlib.decompressobj(31), []
        while not unzip.eof:
            chunk = view[at : at + 65536]
            if not chunk:
                raise ValueError("archive ends within a record")
            parts.append(unzip.decompress(chunk))
            at += len(chunk)
        at -= len(unzip.unused_data)
        yield b"".join(parts)


def parse(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of a record; its length and block digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"broken record {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind = fields["WARC-Type"]
    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, refers, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), payload if kind == "response" else None


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files in the manifest, in the columns of `RECORD`; payload is null for revisits. A file that differs from the manifest is an error."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    tasks = tasks_for(manifest, manifest.count(), 8)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in RECORD.split(", ")]
        system, root = store(f"{folder}/files")
        for files in batches:
            for name, n_records, n_bytes in zip(*[c.to_pylist() for c in files.columns]):
                with system.open_input_file(f"{root}/{name}") as source:
                    data = source.read()
                if len(data) != n_bytes:
                    raise ValueError(f"{name} has {len(data)} bytes, the manifest says {n_bytes}")
                rows, held, count = [], 0, 0
                for member in members(data):
                    rows.append(parse(member))
                    held += len(member)
                    count += 1
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
                if count != n_records:
                    raise ValueError(f"{name} has {count} records, the manifest says {n_records}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    # names are spread by hash, so that a task reads some files; round robin would have to be sorted
    return manifest.repartition(tasks, "file").mapInArrow(task, RECORD)
