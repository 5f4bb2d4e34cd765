"""Exact n-gram Jaccard join that makes use of how sets relate.

A document's set holds its distinct n-word shingles (64-bit hashes). Documents of equal sets form a class; everything below works on classes.

1. Order. Shingles are counted over all classes: hashes go to token buckets as compact blocks, are counted there, and those in two classes or more go
   back to their classes. Very common shingles, found beforehand with counts summed in each task, stay at home: they come last in the order.
2. Index. Two sets that are similar enough share one of their rarest `n - ceil(t n) + 1` shingles, so only these are indexed, without those that stand
   in one class alone. A list entry knows its set's size and its position in the order.
3. Set relations. A list's pivot is the set with the least share of shingles of its own: of many copies, the one the others derive from. Each set is
   verified against the pivot it meets in most lists. What is found similar forms components, and a set's answers then follow from its pivot's:
   entries of one component need not meet again, and a list of one component alone is skipped whole. Later rounds try the pivots not tried yet.
4. The rest. In lists that still hold several components, entries meet in blocks: a block holds entries of one size range, only blocks whose sizes allow
   the threshold meet, and within them a pair whose positions leave too few shingles is skipped. Every pair that remains is verified exactly.

Words are maximal runs of bytes other than ASCII white space, with A-Z in lower case. A text of fewer than n words is one shingle, the whole sequence;
null texts and texts without words have the empty set and no links. Repeated rows keep their rows. A null id counts as no id: a component is named by the
smallest id in it. Other columns are not read, whatever their names; a row comes out as its key, `doc_id`, `n_shingles` and `component_id`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import lean, row_key, tasks_for, written
from surveyfx.llm.wordhash import NOT_SPACE, Words, chunks, mixed

N, PERCENT = 5, 75
#: Share of a task's sets from which a shingle counts as common there, and of all sets from which it is treated as common; most shingles so treated.
COMMON_SHARE, COMMON_LEAST, COMMON_MOST = 0.005, 64, 200_000
#: Shingles that a token bucket may hold, and shingles that a task packs at a time.
BUCKET_TOKENS, PACK_TOKENS = 4_000_000, 600_000
STAR_ROUNDS = 3
BROADCAST_ROWS = 500_000
LOW = np.uint64((1 << 40) - 1)
WEIGHTS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(64)]


def sets_of(words: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    h = words.hashes()
    with np.errstate(over="ignore"):
        s = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
        for k in range(n):
            s += h[k : k + len(s)] * WEIGHTS[k]
        s = mixed(s)
        for a, b in zip(words.first[:-1], words.first[1:]):
            if b - a >= n:
                yield np.unique(s[a : b - n + 1])
            elif b > a:
                short = sum((h[a + k] * WEIGHTS[k] for k in range(b - a)), np.uint64(b - a))
                yield mixed(np.array([short], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def class_of(u: np.ndarray) -> int:
    """A number for the set as a whole, whatever its order: equal for equal sets."""
    with np.errstate(over="ignore"):
        pair = np.array([u.sum() + np.uint64(len(u)), mixed(u * WEIGHTS[1]).sum()], dtype=np.uint64)
        return int(mixed(pair[:1] * WEIGHTS[2] + mixed(pair[1:])).view(np.int64)[0])


def texts_to_sets(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, words in chunks(batch.column(column), NOT_SPACE):
        yield from enumerate(sets_of(words, n), at)


def required(size: int, percent: int) -> int:
    """Least overlap of a set with any set similar to it."""
    return -(-percent * size // 100)


def describe(rows: DataFrame, n: int) -> DataFrame:
    """One row for each document (key, doc_id, n, cid), and rows of shingles that are common within a task (token, seen)."""
    schema = "key long, doc_id long, n int, cid long, token long, seen long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        held, size, known = [], 0, set()

        def common() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            often = seen >= max(8, COMMON_SHARE * len(held))
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([*[pa.nulls(k, t) for t in types[:4]], pa.array(token[often].view(np.int64)), pa.array(seen[often].astype(np.int64))], names=names)

        for batch in batches:
            sizes, classes = [], []
            for _, u in texts_to_sets(batch, 2, n):
                cid = class_of(u) if len(u) else None
                sizes.append(len(u))
                classes.append(cid)
                if cid is not None and cid not in known:
                    known.add(cid)
                    held.append(u)
                    size += len(u)
                    if size > PACK_TOKENS:
                        yield common()
                        held, size, known = [], 0, set()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, types[2]), pa.array(classes, types[3]), pa.nulls(len(sizes), types[4]), pa.nulls(len(sizes), types[5])], names=names)
        if held:
            yield common()

    return written(rows.mapInArrow(lean(task), schema), "shingle-sets")


PACKED = "bucket int, docs binary, tokens binary"
DOC = np.dtype([("cid", "<i8"), ("n", "<i4"), ("rare", "<i4"), ("count", "<i4")])


def pack(rows: DataFrame, n: int, percent: int, common: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of shingles by token bucket. A class's common shingles go, if its rarest reach into them, to buckets of classes behind the others."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens, plain, size, known = [], [], [], 0, set()

        def block(bucket: int, d: np.ndarray, t: bytes) -> tuple:
            return bucket, d.tobytes(), t

        def flush() -> pa.RecordBatch:
            rows = list(plain)
            if tokens:
                t = np.concatenate(tokens)
                of = np.repeat(np.arange(len(docs)), [len(x) for x in tokens])
                bucket = ((t >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                t, of, bucket = t[order], of[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                info = np.array(docs, dtype=DOC)
                low = np.ascontiguousarray(t & LOW).view(np.uint8).reshape(-1, 8)[:, :5]
                for b in np.flatnonzero(np.diff(edges)):
                    i, j = edges[b], edges[b + 1]
                    first = np.flatnonzero(np.concatenate([[True], of[i + 1 : j] != of[i : j - 1]]))
                    d = info[of[i:j][first]]
                    d["count"] = np.diff(np.append(first, j - i))
                    rows.append(block(int(b), d, low[i:j].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))] if rows else [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())], names=["bucket", "docs", "tokens"])

        for batch in batches:
            for _, u in texts_to_sets(batch, 0, n):
                if not len(u) or (cid := class_of(u)) in known:
                    continue
                known.add(cid)
                at = np.minimum(np.searchsorted(common, u), max(len(common) - 1, 0))
                often = common[at] == u if len(common) else np.zeros(len(u), bool)
                own = u[~often]
                prefix = len(u) - required(len(u), percent) + 1
                # shingles that meet in one token number within a set shorten it: look as much further
                name = ((own >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24) << np.uint64(40)) | (own & LOW)
                lost = len(own) - len(np.unique(name))
                rare = len(own) - 2 * lost
                docs.append((cid, len(u), rare, 0))
                tokens.append(own)
                size += len(own)
                if prefix + lost > len(own):
                    last = u[often][: prefix + lost - len(own)]
                    d = np.array([(cid, len(u), len(own), len(last))], dtype=DOC)
                    plain.append(block(buckets + cid % buckets, d, last.tobytes()))
                if size > PACK_TOKENS or len(plain) > 20_000:
                    yield flush()
                    docs, tokens, plain, size, known = [], [], [], 0, set()
        yield flush()

    return rows.select("text").mapInArrow(lean(task), PACKED)


BACK = "part int, body binary"
ENTRY = np.dtype([("cid", "<i8"), ("n", "<i4"), ("rare", "<i4"), ("token", "<i8"), ("df", "<i4")])
COMMON_DF = (1 << 31) - 1


def count_bucket(buckets: int, parts: int):
    """A token bucket to what its classes must know: the tokens that stand in two classes or more, with their counts, by class part."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        d = np.concatenate([np.frombuffer(x.as_py(), DOC) for x in table.column("docs")])
        raw = b"".join(x.as_py() for x in table.column("tokens"))
        of = np.repeat(np.arange(len(d)), d["count"])
        if bucket >= buckets:
            token, df, keep = np.frombuffer(raw, np.int64), np.full(len(of), COMMON_DF, np.int64), slice(None)
        else:
            # token and place in one word each, sorted where they lie
            wide = np.zeros((len(of), 8), np.uint8)
            wide[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
            both = wide.view(np.uint64).ravel()
            _, same = np.unique(d["cid"], return_inverse=True)
            if len(d) >= 1 << 24:
                raise ValueError("a token bucket holds too many blocks; make BUCKET_TOKENS smaller")
            both |= same.astype(np.uint64)[of]
            del raw, of
            both.sort()
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]  # copies of a class that several tasks packed
            start = np.flatnonzero(np.concatenate([[True], (both[1:] ^ both[:-1]) >> np.uint64(24) != 0]))
            times = np.diff(np.append(start, len(both)))
            keep = np.repeat(times > 1, times)
            df = np.repeat(times[times > 1], times[times > 1])
            both = both[keep]
            token = (both >> np.uint64(24)).view(np.int64) | bucket << 40
            # one entry of the class will do: they say the same
            any_of = np.zeros(int(same.max(initial=-1)) + 1, np.int64)
            any_of[same] = np.arange(len(d))
            of, keep = any_of[(both & np.uint64((1 << 24) - 1)).astype(np.int64)], slice(None)
        e = np.zeros(len(token), dtype=ENTRY)
        for f in ("cid", "n", "rare"):
            e[f] = d[f][of[keep]]
        e["token"], e["df"] = token, df
        part = e["cid"] % parts
        order = np.lexsort((e["cid"], part))
        e, part = e[order], part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        full = np.flatnonzero(np.diff(edges))
        # columns lie together, so that what repeats compresses
        body = [b"".join(np.ascontiguousarray(e[f][edges[p] : edges[p + 1]]).tobytes() for f in ENTRY.names) for p in full]
        return pa.table({"part": pa.array(full.astype(np.int32)), "body": pa.array(body, pa.binary())})

    return run


INDEX = "token long, cid long, n int, pos int, alone float"


def index_part(percent: int):
    """A part of the classes to the index entries of their rarest tokens."""

    def run(table: pa.Table) -> pa.Table:
        blocks = []
        for x in table.column("body"):
            raw = x.as_py()
            m, at = len(raw) // ENTRY.itemsize, 0
            e = np.zeros(m, dtype=ENTRY)
            for f in ENTRY.names:
                kind = ENTRY[f]
                e[f] = np.frombuffer(raw, kind, m, at)
                at += m * kind.itemsize
            blocks.append(e)
        e = np.concatenate(blocks)
        e = e[np.lexsort((e["token"], e["df"], e["cid"]))]
        # copies of a class that several tasks packed
        same = np.concatenate([[False], (e["cid"][1:] == e["cid"][:-1]) & (e["token"][1:] == e["token"][:-1]) & (e["df"][1:] == e["df"][:-1])])
        e = e[~same]
        start = np.flatnonzero(np.concatenate([[True], e["cid"][1:] != e["cid"][:-1]]))
        size = np.diff(np.append(start, len(e)))
        often = e["df"] == COMMON_DF
        counted = np.add.reduceat((~often).astype(np.int64), start)
        rank = np.arange(len(e)) - np.repeat(start, size)
        n = e["n"].astype(np.int64)
        # tokens of one class alone come first in the order
        alone = e["rare"] - np.repeat(counted, size)
        pos = np.maximum(alone, 0) + rank
        share = np.maximum(alone, 0) / n
        prefix = n - -(-percent * n // 100) + 1
        keep = np.where(often, True, alone + rank < prefix)
        return pa.table({"token": e["token"][keep], "cid": e["cid"][keep], "n": e["n"][keep].astype(np.int32), "pos": pos[keep].astype(np.int32), "alone": share[keep].astype(np.float32)})

    return run


def blobs(rows: DataFrame, sets: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(cid, shingles) of every class in the index."""
    # one row a class before anything meets on it: a third of all documents may be one class
    one = sets.filter("cid is not null").groupBy("cid").agg(F.min("key").alias("key"))
    wanted = written(one.join(index.select("cid").distinct(), "cid", "left_semi"), "candidate-sets")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [u.tobytes() for _, u in texts_to_sets(batch, 1, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], names=["cid", "shingles"])

    few = wanted.count() <= BROADCAST_ROWS
    # one text a class, also where its row is repeated
    texts = rows.join(F.broadcast(wanted) if few else wanted, "key").groupBy("cid").agg(F.min("text").alias("text"))
    return written(texts.mapInArrow(lean(task), "cid long, shingles binary"), "candidate-shingles")


def verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, as a written table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = shingles.select(F.col("cid").alias("a"), F.col("shingles").alias("u"))
    right = shingles.select(F.col("cid").alias("b"), F.col("shingles").alias("v"))
    return written(pairs.join(right, "b").join(left, "a").select("a", "b", "u", "v").mapInArrow(lean(task), "a long, b long"), "similar-pairs")


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) of all ends of links: labels sink to the smallest neighbour's, then to their own label's, until nothing moves."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("cid"), "comp"), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"cid": "b"}), "b").groupBy("a").agg(F.min("comp").alias("near"))
        sunk = labels.join(near.withColumnRenamed("a", "cid"), "cid").select("cid", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        over = labels.select(F.col("cid").alias("low"), F.col("comp").alias("lower"))
        new = written(sunk.join(over, "low").select("cid", "old", F.least("low", "lower").alias("comp")), "labels")
        if new.filter("old <> comp").isEmpty():
            return labels
        labels = new.select("cid", "comp")


def mixed_lists(index: DataFrame) -> DataFrame:
    """The lists that hold more than one component, each with its pivot: the class with the least share of shingles of its own, which is likest to
    be what the others are copies of."""
    first = F.min(F.struct("alone", "cid", "comp", "n")).alias("f")
    lists = index.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), first).filter("low <> high")
    return written(lists.select("token", F.col("f.cid").alias("b"), F.col("f.comp").alias("b_comp"), F.col("f.n").alias("b_n")), "mixed-lists")


def similar_sizes(x: str, y: str, percent: int):
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def link_components(index: DataFrame, shingles: DataFrame, percent: int, links: DataFrame | None = None, comps: DataFrame | None = None) -> DataFrame:
    """(cid, comp) of all classes that are similar to another; `links` (a, b) known before, with the components they make, are kept."""

    def labelled() -> DataFrame:
        return index.withColumn("comp", F.col("cid")) if comps is None else index.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    own, tried = labelled(), None
    for final in [False] * STAR_ROUNDS + [True]:
        lists = mixed_lists(own)
        if final:
            step = math.log(100 / percent)
            block = F.floor(F.log("n") / step).cast("int")
            here = own.join(lists.select("token"), "token", "left_semi")
            a = here.select("token", block.alias("block"), F.col("cid").alias("a"), F.col("comp").alias("a_comp"), F.col("n").alias("a_n"), F.col("pos").alias("a_pos"))
            near = F.explode(F.array(block - 1, block, block + 1)).alias("block")
            b = here.select("token", near, F.col("cid").alias("b"), F.col("comp").alias("b_comp"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos"))
            # of two sets' rarest common shingles on, no more than what follows it in either can be common
            left = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
            enough = left * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent
            fit = (F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & similar_sizes("a_n", "b_n", percent) & enough
            pairs = a.join(b, ["token", "block"]).filter(fit).select("a", "b").distinct()
        else:
            apart = (F.col("comp") != F.col("b_comp")) & similar_sizes("n", "b_n", percent)
            stars = own.join(lists, "token").filter(apart).groupBy(F.col("cid").alias("a"), "b").agg(F.count("*").alias("shared"))
            if tried is not None:
                stars = stars.join(tried, ["a", "b"], "left_anti")
            best = stars.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
            pairs = written(best, "star-pairs")
            tried = pairs if tried is None else tried.unionByName(pairs)
        found = verified(pairs, shingles, percent)
        if found.isEmpty():
            continue
        links = found if links is None else written(links.unionByName(found), "all-links")
        comps = components(links)
        own = labelled()
    return comps if links is not None else index.select("cid", F.col("cid").alias("comp")).limit(0)


def link_sets(rows: DataFrame, described: DataFrame, n: int, percent: int, links: DataFrame | None = None, comps: DataFrame | None = None) -> DataFrame:
    """(cid, comp) of all classes of `rows` (key, doc_id, text) that are similar to another, beside what is known before."""
    sets = described.filter("n is not null").select("key", "n", "cid")
    size = sets.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    least = max(COMMON_LEAST, COMMON_SHARE * size["docs"])
    common = described.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).filter(F.col("seen") >= least).orderBy(F.col("seen").desc(), "token").limit(COMMON_MOST)
    # bounded by COMMON_MOST; which shingles are treated as common decides the order only
    often = np.sort(common.select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))
    buckets = tasks_for(rows, size["tokens"], BUCKET_TOKENS)
    packed = pack(rows, n, percent, often, buckets)
    back = packed.groupBy("bucket").applyInArrow(count_bucket(buckets, buckets), BACK)
    index = written(back.groupBy("part").applyInArrow(index_part(percent), INDEX), "prefix-index")
    return link_components(index, blobs(rows, sets, index, n), percent, links, comps)


def join_components(df: DataFrame, text: str = "text", doc: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Add `n_shingles` and `component_id` (smallest id reachable over links, the row's own included)."""
    rows = df.select(row_key(doc, text)[0].alias("key"), F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    described = describe(rows, n)
    sets = described.filter("n is not null").select("key", "doc_id", "n", "cid")
    comps = link_sets(rows, described, n, percent)
    labelled = sets.join(comps, "cid", "left").select("key", "doc_id", "n", F.coalesce("comp", "cid").alias("comp"))
    labelled = written(labelled, "labelled-sets")
    names = written(labelled.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "component-names")
    return labelled.join(names, "comp", "left").select("key", "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
