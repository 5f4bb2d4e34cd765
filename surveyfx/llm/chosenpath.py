"""Near copies by a chosen-path set similarity join.

A document's set holds its distinct n-word shingles (64-bit hashes); documents of equal sets form a class, and everything below works on classes.
A class keeps `SIGNATURE` minwise tokens: for each of so many hash orders the first shingle of its set.

Trees. A tree branches classes by selected minwise tokens: a node selects two of the orders, and classes with the same first shingle in a selected
order share a child node. A pair of similarity s stays together in a child with probability s, so a node of two or more children loses a similar pair
seldom, and independent trees make up for what one loses (`survival` gives the chance). The first two levels, too wide to compare, are grown at once.

Nodes. A node of few classes is compared exhaustively: every pair of its classes is compared by sketches of their minwise tokens, and of the pairs that
may meet the threshold all, where they are few, and otherwise a spanning forest, the likeliest first, are checked on the full sets. Nodes of which only
a forest was checked wait until the trees have ended: most hang together by then. The classes of those that do not are joined exactly, each class once:
by the prefix index and the pivots of `jaccard.py`, with the components known so far. So all pairs are compared, but never emitted. A node of several
blocks of classes is compared pair of blocks by pair of blocks. A larger node branches further; its classes are also dealt into
blocks that are compared, so that a large group of near copies soon hangs together. Links join classes to components after each level, and a node within one component is
finished: what it could still link is linked already. The classes of a node that is still large and mixed at the last depth are joined exactly, too.
`sketch_loss` gives the chance that a sketch hides a similar pair.

Words are maximal runs of bytes other than ASCII white space, with A-Z in lower case. A text of fewer than n words is one shingle, the whole sequence;
null texts and texts without words have the empty set, no links, and are kept. Repeated rows keep their rows. A null id counts as no id: a component is
named by the smallest id in it, and only rows with that id are kept; a row whose component has no id at all is kept. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import row_key, tasks_for, written
from surveyfx.llm.jaccard import class_of, components, describe, link_sets, texts_to_sets

N, PERCENT = 5, 85
#: Minwise tokens of a class; trees that are grown together, one after the other.
SIGNATURE, BATCHES = 48, ((0,), (1, 2, 3, 4))
#: Children of a node down to `WIDE` and below it; depth at which what is left is joined exactly.
WIDE, CHILDREN, DEEP_CHILDREN, DEPTH = 3, 2.0, 1.3, 12
#: Classes and shingles of a block, and blocks of a node that is compared exhaustively rather than branched.
NODE_CLASSES, NODE_TOKENS, PAIR_BLOCKS = 700, 2_000_000, 16
#: Members of a comparing task; pairs a class that are checked one by one.
TASK_MEMBERS, FEW = 100_000, 4
#: Rows up to which the classes whose texts are wanted are broadcast; beyond, the same join is shuffled.
BROADCAST_ROWS = 500_000
#: Largest chance that a sketch may hide a pair just at the threshold.
SKETCH_LOSS = 1e-6
ORDERS = [(np.uint64((k * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % (1 << 64) | 1), np.uint64((k * 0xA0761D6478BD642F + 0x8EBC6AF09C88C6E3) % (1 << 64))) for k in range(1, SIGNATURE + 1)]


def survival(similarity: float, depth: int, trees: int) -> float:
    """Chance that a pair of this similarity meets in a node `depth` levels down in one tree or more."""
    lost = 0.0  # below the last level nothing is lost any more
    for level in range(depth, 0, -1):
        children = CHILDREN if level <= WIDE else DEEP_CHILDREN
        gone = 1 - similarity * (1 - lost)
        lost = gone ** int(children) * (1 - (children - int(children)) * (1 - gone))
    return 1 - lost**trees


def sketch_loss(similarity: float, least: int) -> float:
    """Chance that fewer than `least` of the minwise tokens of a pair of this similarity are equal."""
    return sum(comb(SIGNATURE, k) * similarity**k * (1 - similarity) ** (SIGNATURE - k) for k in range(least))


def least_equal(percent: int) -> int:
    """Equal minwise tokens from which a pair may meet the threshold."""
    return max(k for k in range(SIGNATURE) if sketch_loss(percent / 100, k) <= SKETCH_LOSS)


def minwise(sets: Sequence[np.ndarray]) -> np.ndarray:
    """(sets, SIGNATURE) 32 bits of the first tokens of non-empty sets."""
    u = np.concatenate(sets)
    start = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SIGNATURE), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(ORDERS):
            # an odd factor and a fold order the tokens anew without making two of them equal
            h = (u + b) * a
            h ^= h >> np.uint64(32)
            first = np.minimum.reduceat(h * a, start)
            out[:, k] = (first ^ (first >> np.uint64(32))).astype(np.uint32)
    return out


DESCRIBED = "key long, doc_id long, n int, cid long, minwise binary, sketch binary"


def described(rows: DataFrame, n: int) -> DataFrame:
    """One row a document; the first document of a class within a task carries its minwise tokens."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()

        def out(part: pa.RecordBatch, sets: list[np.ndarray]) -> pa.RecordBatch:
            classes = [class_of(u) if len(u) else None for u in sets]
            new = []
            for k, cid in enumerate(classes):
                if cid is not None and cid not in known:
                    known.add(cid)
                    new.append(k)
            tokens = dict(zip(new, minwise([sets[k] for k in new]))) if new else {}
            blobs = [[tokens[k].astype(kind).tobytes() if k in tokens else None for k in range(len(sets))] for kind in (np.uint32, np.uint8)]
            columns = [part.column(0), part.column(1), pa.array([len(u) for u in sets], pa.int32()), pa.array(classes, pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]]
            return pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n", "cid", "minwise", "sketch"])

        for batch in batches:
            held, size, at = [], 0, 0
            for k, u in texts_to_sets(batch, 2, n):
                held.append(u)
                size += len(u)
                if size > 200_000:
                    yield out(batch.slice(at, len(held)), held)
                    held, size, at = [], 0, k + 1
            if held:
                yield out(batch.slice(at, len(held)), held)

    return written(rows.mapInArrow(task, DESCRIBED), "described")


def child(node: Column, order: Column) -> Column:
    return F.xxhash64(node, order, F.substring("minwise", 4 * order + 1, F.lit(4)))


def roots(signatures: DataFrame, trees: Sequence[int]) -> DataFrame:
    """(node, cid, n): the nodes two levels down, of orders that differ between the trees."""
    first = 2 * sum(map(len, BATCHES))
    nodes = [
        child(child(F.lit(t), F.lit((2 * t + k) % SIGNATURE)), F.lit((first + 4 * t + 2 * k + j) % SIGNATURE)) for t in trees for k in (0, 1) for j in (0, 1)
    ]
    return signatures.select(F.explode(F.array(*nodes)).alias("node"), "cid", "n")


def branches(large: DataFrame, signatures: DataFrame, depth: int) -> DataFrame:
    """The children of large nodes: one or two orders selected by the node itself, so that all its classes agree on them."""
    first = F.pmod(F.xxhash64("node", F.lit(depth), F.lit("first")), F.lit(SIGNATURE)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit(depth), F.lit("second")), F.lit(SIGNATURE - 1)), F.lit(SIGNATURE)).cast("int")
    children = CHILDREN if depth < WIDE else DEEP_CHILDREN
    both = F.pmod(F.xxhash64("node", F.lit(depth), F.lit("both")), F.lit(1000)) < int(1000 * (children - 1))
    orders = F.when(both, F.array(first, second)).otherwise(F.array(first))
    rows = large.select("node", "cid", "n").join(signatures.select("cid", "minwise"), "cid")
    return rows.withColumn("order", F.explode(orders)).select(child(F.col("node"), F.col("order")).alias("node"), "cid", "n")


def forest(weight: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph, the heaviest where there is a choice; a negative weight is no edge."""
    m = len(weight)
    out, best, by, new = [], np.full(m, -1.0), np.full(m, -1), np.ones(m, dtype=bool)
    for _ in range(m):
        i = int(np.argmax(np.where(new, best, -2.0)))
        new[i] = False
        if best[i] >= 0:
            out.append((int(by[i]), i))
        better = new & (weight[i] > best)
        best[better], by[better] = weight[i][better], i
    return out


PAIRS = "cell long, a long, b long"


def by_cell(members: DataFrame, columns: Sequence[str], tasks: int, pairs_of) -> DataFrame:
    """Apply `pairs_of` to the members of each cell, one cell in memory at a time; (cell, a, b) as a written table."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def finish() -> pa.RecordBatch:
            found = pairs_of(*zip(*held)) if len(held) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array([cell] * len(found), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["cell", "a", "b"])

        for batch in batches:
            for name, *member in zip(*(c.to_pylist() for c in batch.columns)):
                if name != cell:
                    yield finish()
                    cell, held = name, []
                held.append(member)
        yield finish()

    rows = members.select("cell", *columns).repartition(tasks, "cell").sortWithinPartitions("cell")
    return written(rows.mapInArrow(task, PAIRS), "pairs")


def likely(percent: int):
    """Pairs of different components in a cell that may be similar by their sketches and sizes: all where they are few, or a forest of them.

    A pair of nulls says that there are more.
    """
    least = least_equal(percent)

    def pairs_of(cids: Sequence[int], comps: Sequence[int], sizes: Sequence[int], sketches: Sequence[bytes]) -> list[tuple]:
        m = len(cids)
        comp, n = np.array(comps), np.array(sizes)
        same = comp[:, None] == comp[None, :]
        if same.all():
            return []
        equal = np.zeros((m, m), dtype=np.uint8)
        for row in np.stack([np.frombuffer(x, np.uint8) for x in sketches], axis=1):
            equal += (row[:, None] == row[None, :]).view(np.uint8)
        maybe = (equal >= least) & ~same
        shortest = -(-percent * n // 100)
        maybe &= (n[:, None] >= shortest[None, :]) & (n[None, :] >= shortest[:, None])
        total = int(maybe.sum()) // 2
        if total <= FEW * m:
            return [(cids[i], cids[j]) for i, j in zip(*np.nonzero(np.triu(maybe)))]
        weight = np.where(maybe, equal.astype(np.int16), -1)
        weight[same] = SIGNATURE + 1
        return [*((cids[i], cids[j]) for i, j in forest(weight) if comp[i] != comp[j]), (None, None)]

    return pairs_of


def cells(mixed_nodes: DataFrame) -> DataFrame:
    """Members by the cell in which they are compared: a pair of the node's blocks, or one block of a node of more than `PAIR_BLOCKS`."""
    block = F.pmod(F.xxhash64("cid", "node"), F.col("blocks"))
    whole = F.col("blocks") <= PAIR_BLOCKS
    other = F.when(whole, F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).otherwise(F.array(F.col("block").cast("int")))
    pairs = mixed_nodes.withColumn("block", block).withColumn("other", F.explode(other))
    return pairs.withColumn("cell", F.xxhash64("node", F.least("block", "other"), F.greatest("block", "other")))


def cells_of_nodes(nodes: DataFrame) -> DataFrame:
    """(node, cell): the same cells, from the nodes alone."""
    rows = nodes.select("node", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("a"))
    rows = rows.select("node", "a", F.explode(F.when(F.col("blocks") <= PAIR_BLOCKS, F.sequence("a", F.col("blocks") - 1)).otherwise(F.array("a"))).alias("b"))
    return rows.select("node", F.xxhash64("node", "a", "b").alias("cell"))


class Linker:
    """Links found so far and the components they make."""

    def __init__(self, texts: DataFrame, signatures: DataFrame, n: int, percent: int):
        self.texts, self.signatures, self.n, self.percent = texts, signatures, n, percent
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None
        self.tried: DataFrame | None = None

    def with_comp(self, rows: DataFrame) -> DataFrame:
        if self.comps is None:
            return rows.withColumn("comp", F.col("cid"))
        return rows.join(self.comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cid, shingles) of the wanted classes, each once."""
        n = self.n

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, u in texts_to_sets(batch, 1, n):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([u.view(np.int64)], pa.list_(pa.int64()))], names=["cid", "shingles"])

        wanted = written(self.signatures.select("cid", "key").join(wanted.distinct(), "cid", "left_semi"), "wanted")
        few = wanted.count() <= BROADCAST_ROWS
        # one text a class, also where its row is repeated
        texts = self.texts.join(F.broadcast(wanted) if few else wanted, "key").groupBy("cid").agg(F.min("text").alias("text"))
        return written(texts.mapInArrow(task, "cid long, shingles array<long>"), "wanted-sets")

    def add(self, found: DataFrame) -> None:
        if not found.isEmpty():
            self.links = found if self.links is None else written(self.links.unionByName(found), "links")
            self.comps = components(self.links)

    def check(self, pairs: DataFrame) -> None:
        """Verify pairs on the full sets, each once."""
        low, high = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
        new = pairs.filter("a is not null").select(low, high).distinct()
        new = written(new if self.tried is None else new.join(self.tried, ["a", "b"], "left_anti"), "new-pairs")
        if new.isEmpty():
            return
        self.tried = new if self.tried is None else self.tried.unionByName(new)
        sets = self.sets(new.select(F.explode(F.array("a", "b")).alias("cid")))
        left, right = (sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("a", "b"))
        # a row at a time, so that long sets never pile up in a batch
        both = F.size(F.array_intersect("a_set", "b_set"))
        similar = both * 100 >= (F.size("a_set") + F.size("b_set") - both) * self.percent
        self.add(written(new.join(right, "b").join(left, "a").filter(similar).select("a", "b"), "similar-pairs"))

    def compare(self, members: DataFrame, size: int) -> DataFrame:
        """Find links within the cells of `members` (cell, cid, n); returns the cells with more pairs than were checked."""
        rows = self.with_comp(members.join(self.signatures.select("cid", "sketch"), "cid"))
        pairs = by_cell(rows, ("cid", "comp", "n", "sketch"), tasks_for(members, size, TASK_MEMBERS), likely(self.percent))
        self.check(pairs)
        return written(pairs.filter("a is null").select("cell"), "dense-cells")

    def finish(self, waiting: list[tuple[DataFrame, DataFrame]]) -> None:
        """Join the classes of unsettled nodes that still hold several components exactly, each class once in however many nodes it stands."""
        parts = []
        for members, unsettled in waiting:
            rows = self.with_comp(members.join(unsettled, "node"))
            mixed = rows.groupBy("node").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("node")
            parts.append(rows.join(mixed, "node").select("cid"))
        if not parts:
            return
        wanted = written(self.signatures.select("cid", "key").join(reduce(DataFrame.unionByName, parts).distinct(), "cid", "left_semi"), "open-classes")
        if (size := wanted.count()) == 0:
            return
        texts = self.texts.join(F.broadcast(wanted) if size <= BROADCAST_ROWS else wanted, "key").groupBy("cid").agg(F.min("text").alias("text"))
        rows = written(texts.select(F.col("cid").alias("key"), F.col("cid").alias("doc_id"), "text"), "open-texts")
        self.comps = link_sets(rows, describe(rows, self.n), self.n, self.percent, self.links, self.comps)


def link_classes(signatures: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame | None:
    """(cid, comp) of all classes that are similar to another; None where none is."""
    linker, waiting = Linker(texts, signatures, n, percent), []
    for batch in BATCHES:
        frontier, depth = roots(signatures, batch), 2
        while True:
            rows = linker.with_comp(frontier)
            stats = rows.groupBy("node").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high")
            blocks = F.greatest(F.ceil(F.col("m") / NODE_CLASSES), F.ceil(F.col("tokens") / NODE_TOKENS)).alias("blocks")
            nodes = written(stats.select("node", blocks), "mixed-nodes")
            members = written(rows.join(nodes, "node").drop("comp"), "mixed-members")
            last = depth == DEPTH
            copies = F.when(F.col("blocks") <= PAIR_BLOCKS, F.col("blocks")).otherwise(1)
            total = members.agg(F.sum(copies).alias("size"), F.max("blocks").alias("blocks")).first()
            if not total["size"]:
                break
            dense = linker.compare(cells(members).select("cell", "cid", "n"), total["size"])
            unsettled = cells_of_nodes(nodes).join(dense, "cell", "left_semi").select("node")
            if last:  # no branches follow that would compare what stands in different blocks
                unsettled = unsettled.unionByName(nodes.filter(F.col("blocks") > PAIR_BLOCKS).select("node"))
            waiting.append((members, written(unsettled.distinct(), "unsettled-nodes")))
            if last or total["blocks"] <= PAIR_BLOCKS:
                break
            frontier = written(branches(members.filter(F.col("blocks") > PAIR_BLOCKS), signatures, depth), "children")
            depth += 1
    linker.finish(waiting)
    return linker.comps


def near_copies(df: DataFrame, text: str = "text", doc: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row `doc_id`, `n_shingles`, `component_id` (smallest id reachable over links, its own included) and `kept`."""
    rows = df.select(row_key(doc, text)[0].alias("key"), F.col(f"`{doc}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    all_rows = described(rows, n)
    docs, classes = all_rows.select("doc_id", "n", "cid"), all_rows.filter("minwise is not null")
    signatures = written(classes.groupBy("cid").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.min("minwise").alias("minwise"), F.min("sketch").alias("sketch")), "signatures")
    comps = link_classes(signatures, rows.select("key", "text"), n, percent)
    # one row a class before anything is joined to it
    named = docs.filter("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    if comps is not None:
        named = written(named.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "classes")
        least = named.groupBy("comp").agg(F.min("least").alias("name"))
        named = named.join(least, "comp").select("cid", F.col("name").alias("least"))
    named = written(named, "class-names")
    out = docs.join(named, "cid", "left").withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
