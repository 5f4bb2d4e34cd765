"""A Merkle manifest of a dataset, with proofs made by the Octopus multiproof.

Every row is a leaf. Each group's leaves ascend by id; runs of consecutive nodes are hashed until one node, the group's root, remains; the groups'
roots, in the order of the groups, make a tree of their own whose last node is the root of the dataset.

Numbering. Leaves are range-partitioned by group, id and leaf, so that a hot group is spread over tasks; a row's number is its place in its task plus
the rows of earlier tasks, which takes one count per task and group. Levels are built by grouping nodes sixteen at a time.

Proofs. Leaves are dealt into leaf partitions by their number in the whole order. From the spans of its groups alone, a leaf partition works out the
minimal union of node coordinates that its leaves need and that cannot be derived from them: the rest of the runs at its two edges, level by level,
then those of the top tree. All of them are fetched in one join. A leaf partition then hashes its leaves and the fetched nodes upwards, once for
nodes that many leaves share, and expands each leaf's own proof from what it holds.

Null values are written as `-`. Rows without an id or a group have one all the same: null groups come first and null ids first within a group. Rows
with equal ids are ordered by their leaves, so that the trees do not depend on the order of the rows; equal rows are leaves of their own. An empty
table has no rows and no root. Columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyfx.llm.common import tasks_for, written

RUN = 16
#: Leaves of a sorting task, and of a leaf partition for which proofs are made together.
SORT_ROWS, PART = 100_000, 4096
TOP = ""


def digest(columns: Sequence[Column]) -> Column:
    """Leaf: hex sha256 of each value's byte count, `:` and text, `-` for a null."""
    def field(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def numbered(df: DataFrame, order: Sequence[str], name: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with `idx`, their place in their `tree` of `n` rows, and `at`, their place among all; and per tree its first place and `n`.

    `order` begins with "tree". Rows that are equal in it may change places.
    """
    spread = F.rand(11)  # equal rows, even a third of all, go to many tasks
    placed = df.withColumn("__spread", spread).repartitionByRange(tasks_for(df, rows, SORT_ROWS), *order, "__spread").sortWithinPartitions(*order)
    placed = placed.drop("__spread").withColumn("__row", F.monotonically_increasing_id())
    placed = written(placed.withColumn("__task", F.shiftright("__row", 33)), name)
    runs = placed.groupBy("__task", "tree").agg(F.count("*").alias("here"), F.min("__row").alias("first"))
    # one row a sorting task, and one row a sorting task and tree
    tasks = runs.groupBy("__task").agg(F.sum("here").alias("rows")).withColumn("start", F.sum("rows").over(Window.orderBy("__task")) - F.col("rows"))
    earlier = F.sum("here").over(Window.partitionBy("tree").orderBy("__task")) - F.col("here")
    low = F.col("start") + F.col("first") - F.shiftleft(F.col("__task"), 33)
    size = F.sum("here").over(Window.partitionBy("tree")).alias("n")
    runs = written(runs.join(tasks, "__task").select("__task", "tree", "first", "here", size, earlier.alias("before"), low.alias("low")), f"{name}-runs")
    out = placed.join(runs, ["__task", "tree"]).withColumns({"idx": F.col("before") + F.col("__row") - F.col("first"), "at": F.col("low") + F.col("__row") - F.col("first")})
    trees = runs.groupBy("tree").agg(F.min("low").alias("start"), F.sum("here").alias("n"))
    return out.drop("__task", "__row", "first", "here", "before", "low"), trees


def levels(nodes: DataFrame) -> DataFrame:
    """All nodes of all trees, (tree, level, idx, hash, n), from those of level 0; `n` is the size of the node's tree at its level."""
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"]))
    out, level = nodes, 0
    while not nodes.filter("n > 1").isEmpty():
        level += 1
        above = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / RUN).alias("idx")).agg(F.sha2(joined, 256).alias("hash"), F.ceil(F.min("n") / RUN).alias("n"))
        nodes = written(above.select("tree", F.lit(level).alias("level"), "idx", "hash", "n"), "nodes")
        out = out.unionByName(nodes)
    return out


def edges(low: int, high: int, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Level by level up to the root: the known nodes [low, high) and the runs [first, last) around them that a proof of each needs."""
    level = 0
    while size > 1:
        first, last = low // RUN * RUN, min(size, -(-high // RUN) * RUN)
        yield level, low, high, first, last
        low, high, size, level = low // RUN, -(-high // RUN), -(-size // RUN), level + 1


ASKED = "part long, tree string, level int, idx long"


def missing(key: tuple, spans: pa.Table) -> pa.Table:
    """The nodes that a leaf partition's leaves need and cannot give: its union of coordinates, each once."""
    part, out = key[0].as_py(), []
    rows = spans.to_pylist()
    for s in rows:
        for level, low, high, first, last in edges(s["low"], s["high"], s["n"]):
            out += [(s["tree"], level, i) for i in (*range(first, low), *range(high, last))]
    # the groups of a leaf partition follow each other in the top tree
    tops = [s["top"] for s in rows]
    for level, low, high, first, last in edges(min(tops), max(tops) + 1, rows[0]["n_trees"]):
        out += [(TOP, level, i) for i in (*range(first, low), *range(high, last))]
    tree, level, idx = zip(*out) if out else ((), (), ())
    return pa.table({"part": pa.array([part] * len(out), pa.int64()), "tree": pa.array(tree, pa.string()), "level": pa.array(level, pa.int32()), "idx": pa.array(idx, pa.int64())})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Tree:
    """What a leaf partition knows of one tree: per level the first node held and the nodes from there on, as whole runs."""

    def __init__(self, known: list[str], low: int, size: int, fetched: dict[tuple[int, int], str]):
        self.held: list[tuple[int, list[str]]] = []
        for level, a, b, first, last in edges(low, low + len(known), size):
            known = [fetched[level, i] for i in range(first, a)] + known + [fetched[level, i] for i in range(b, last)]
            self.held.append((first, known))
            known = [sha("".join(known[i : i + RUN])) for i in range(0, len(known), RUN)]
        self.root = known[0]
        self._above: dict[tuple[int, int], list[tuple[str, str]]] = {}

    def sides(self, idx: int, level: int = 0) -> list[tuple[str, str]]:
        """What stands left and right of a node in its run, and so on upwards; shared by the leaves below."""
        if level == len(self.held):
            return []
        known = self._above.get((level, idx))
        if known is None:
            first, nodes = self.held[level]
            at = idx - first
            a = at // RUN * RUN
            known = [("".join(nodes[a:at]), "".join(nodes[at + 1 : a + RUN])), *self.sides(idx // RUN, level + 1)]
            if level:
                self._above[level, idx] = known
        return known


PROVED = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def expand(with_proofs: bool):
    """Leaf partitions (left) with the spans and fetched nodes they asked for (right) to proved leaves."""

    def run(leaves: pa.Table, known: pa.Table) -> pa.Table:
        spans, fetched = {}, {}
        for k in known.to_pylist():
            if k["hash"] is None:
                spans[k["tree"]] = k
            else:
                fetched.setdefault(k["tree"], {})[k["level"], k["idx"]] = k["hash"]
        leaves = leaves.sort_by([("at", "ascending")])
        trees, hashes, idx = (leaves.column(c).to_pylist() for c in ("tree", "leaf", "idx"))
        mine: dict[str, list[str]] = {}
        for tree, h in zip(trees, hashes):
            mine.setdefault(tree, []).append(h)
        built = {t: Tree(h, spans[t]["low"], spans[t]["n"], fetched.get(t, {})) for t, h in mine.items()}
        first = min(spans.values(), key=lambda s: s["top"])
        top = Tree([t.root for t in built.values()], first["top"], first["n_trees"], fetched.get(TOP, {}))
        uppers = {t: top.sides(spans[t]["top"]) for t in built}
        out, paths = [], []
        for tree, i, leaf, altered in zip(trees, idx, hashes, leaves.column("altered").to_pylist()):
            path = built[tree].sides(i) + uppers[tree]
            h = leaf if altered is None else altered
            for left, right in path:
                h = sha(f"{left}{h}{right}")
            out.append((built[tree].root, top.root, sha("".join([x for side in path for x in side])), h, h == top.root))
            paths.append([{"left": left, "right": right} for left, right in path] if with_proofs else None)
        table = leaves.drop_columns(["part", "tree", "at", "idx", "n", "altered"])
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()]
        for f, column, kind in zip(PROVED.split(", "), zip(*out), kinds):
            table = table.append_column(f.split()[0], pa.array(column, kind))
        if with_proofs:
            side = pa.struct([("left", pa.string()), ("right", pa.string())])
            table = table.append_column("proof", pa.array(paths, pa.list_(side)))
        return table

    return run


def prove(
    df: DataFrame, columns: Sequence[str], altered: dict[str, Column] | None = None, when: Column | None = None, group: str = "source",
    doc: str = "doc_id", with_proofs: bool = False,
) -> DataFrame:
    """One row a leaf: id, `leaf`, `subroot`, `root`, `proof_sha256`, and what folding the proof again gives: `folded_root`, `verified`.

    The fold starts from the leaf, or, where `when` holds, from the leaf of the row with the `altered` columns. `with_proofs` adds the proof
    itself: per level up to the dataset's root the digests left and right of the node on the way.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    cols = {c: F.col(f"`{c}`") for c in columns}
    other = digest([(altered or {}).get(c, x) for c, x in cols.items()])
    changed = F.when(when, other) if when is not None else F.lit(None).cast("string")
    leaves = written(df.select(tree.alias("tree"), F.col(f"`{doc}`").alias("doc_id"), digest(list(cols.values())).alias("leaf"), changed.alias("altered")), "leaves")
    placed, trees = numbered(leaves, ["tree", "doc_id", "leaf"], "sorted-leaves", leaves.count())
    placed = written(placed.withColumn("part", F.floor(F.col("at") / PART)), "numbered-leaves")
    trees = written(trees, "trees")

    nodes = levels(placed.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("hash"), "n"))
    subroots = nodes.filter("n = 1").select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "hash")
    roots, _ = numbered(subroots, ["tree", "name"], "sorted-roots", trees.count())
    roots = written(roots.drop("at"), "roots")
    nodes = nodes.unionByName(levels(roots.select("tree", F.lit(0).alias("level"), "idx", "hash", "n")))

    start, end = F.col("start"), F.col("start") + F.col("n")
    part = F.explode(F.sequence(F.floor(start / PART), F.floor((end - 1) / PART))).alias("part")
    low, high = F.greatest(start, F.col("part") * PART) - start, F.least(end, (F.col("part") + 1) * PART) - start
    numbers = roots.select(F.col("name").alias("tree"), F.col("idx").alias("top"))
    spans = trees.join(numbers, "tree").select("tree", "start", "n", "top", part)
    n_trees = F.broadcast(trees.agg(F.count("*").alias("n_trees")))  # one row
    spans = written(spans.crossJoin(n_trees).select("part", "tree", "n", "top", "n_trees", low.alias("low"), high.alias("high")), "spans")

    asked = written(spans.groupBy("part").applyInArrow(missing, ASKED), "asked-nodes")
    got = asked.join(nodes.drop("n"), ["tree", "level", "idx"])
    known = spans.unionByName(got, allowMissingColumns=True)
    id_type = dict(placed.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, leaf string, {PROVED}" + (", proof array<struct<left: string, right: string>>" if with_proofs else "")
    return placed.groupBy("part").cogroup(known.groupBy("part")).applyInArrow(expand(with_proofs), schema)
