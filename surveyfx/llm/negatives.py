"""Hard negatives by a vertical scan with branch and bound (BOND).

Vectors are turned into integers, so that scores and ties are exact, and packed into cells that hold one dimension after the other, with each
row's id and label, by label. An anchor reads a cell's dimensions in the order of its own descending magnitudes, a block of them at a time. What the
dimensions not read yet can still add lies between sums of the cell's least and largest contributions; after each block the bitmap of candidates
shrinks to those whose range still meets a wanted window, and partial sums are moved together. The anchors of a block go through a strip of
candidates at once, each in its own order: what it does not read in a step counts nought. Once few pairs are left, those alone go on.

Two scans: the first finds an anchor's positives, the best rows of its own label; a candidate stays while it can reach the worst of the positives
known so far. The second finds the negatives: every positive's score opens a window of scores, and a candidate of another label stays while it can
fall into a window above the worst negative known for it. Both end with exact scores. What is known for an anchor goes on from cell to cell of a task.

Anchors are a stated query set that meets all rows in blocks over a grid of tasks (`grid.py`), whatever their labels; no other pair of rows is ever
made.

Rows without an id or a label and vectors that are null, empty or hold null or non-finite components take no part. Vectors meet only vectors of as
many dimensions. Rows with the anchor's own id are no candidates of it; other repeated rows each count, so a positive that stands twice is reported
twice. An anchor id that repeats asks once, with its smallest vector and that vector's smallest label. Scores times the percentages must fit 64 bits.
Without anchors, positives or rows in a window there are no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyfx.llm.common import written
from surveyfx.llm.grid import NONE, SPARSE, STRIP, first_k, met, narrow, packing, wide

#: Rows of a cell, anchors of a block, dimensions read between two looks at the bounds.
CELL, ANCHORS, DIMS = 4096, 512, 16
CELLS = "dim int, ids binary, labels binary, parts binary, wanted binary"
MOST = np.iinfo(np.int64).max


def vertical(per_cell: int, scale: float, windows: int = 0):
    """Rows (id, label, vector[, positives' scores]) to cells of one dimension count each, dimension by dimension."""

    def cell(dim: int, parts: list) -> tuple:
        ids, labels, values, wanted = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(labels, kind="stable")
        return dim, ids[order].tobytes(), narrow(labels[order]), narrow(values[order].T), wanted[order].tobytes()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["dim", "ids", "labels", "parts", "wanted"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            lists = batch.column(2)
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(lists.offsets)
            wanted = np.full((len(ids), windows), NONE)
            if windows:
                for i, scores in enumerate(batch.column(3).to_pylist()):
                    wanted[i, : len(scores)] = scores
            for dim in np.unique(np.diff(ends)).tolist():
                rows = np.flatnonzero(np.diff(ends) == dim)
                whole = np.floor(values[ends[:-1][rows][:, None] + np.arange(dim)] * scale).astype(np.int64)
                parts = held.setdefault(dim, [])
                for a in range(0, len(rows), per_cell):
                    b = slice(a, a + per_cell)
                    parts.append((ids[rows[b]], labels[rows[b]], whole[b], wanted[rows[b]]))
                    if sum(len(p[0]) for p in parts) >= per_cell:
                        yield out([cell(dim, parts)])
                        parts.clear()
        for dim, parts in held.items():
            if parts:
                yield out([cell(dim, parts)])

    return pack


def scan_block(anchors: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, keep: Callable, dims: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor numbers, row numbers and exact scores of the pairs that `keep` lets through.

    `keep` sees anchor numbers and the least and the largest score that each pair can still reach. Unless `every` look is wanted, looks that a
    partial score of nought would pass for most anchors are left out: they would drop few rows.
    """
    dim, n = anchors.shape
    real = np.float32 if anchors.dtype == np.float32 else np.float64
    order = np.argsort(-np.abs(anchors), axis=0, kind="stable")
    place = np.argsort(order, axis=0)
    exact = anchors.astype(np.float64)
    ends = np.take_along_axis(np.sort(np.stack([exact * low[:, None], exact * high[:, None]]), axis=0), order[None], axis=1)
    rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1, n))], axis=1)
    slack = 2 + 1e-6 * np.abs(rest)  # more than what rounding takes
    least, most = (rest[0] - slack[0]).astype(real), (rest[1] + slack[1]).astype(real)
    j = np.arange(n)
    looks = [e for e in range(dims, dim, dims) if every or keep(j, least[e], most[e]).mean() < 0.5] + [dim]
    steps = [np.where((place >= a) & (place < e), anchors, 0).T for a, e in zip([0, *looks], looks)]
    found = []
    for a in range(0, cell.shape[1], STRIP):
        at = np.arange(a, min(a + STRIP, cell.shape[1]))
        strip, score = cell[:, at], 0
        for e, step in zip(looks, steps):
            score = score + step @ strip
            alive = keep(j[:, None], score + least[e][:, None], score + most[e][:, None])
            if e == dim or np.count_nonzero(alive) * SPARSE < alive.size:
                break
            some = alive.any(axis=0)
            if np.count_nonzero(some) < 0.75 * len(at):
                at, strip, score = at[some], strip[:, some], score[:, some]
        jj, i = np.nonzero(alive)
        score, i = score[jj, i], at[i]
        for e in range(e, dim, dims):
            d = order[e : e + dims, jj]
            score = score + (anchors[d, jj] * cell[d, i]).sum(axis=0)
            stay = keep(jj, score + least[min(e + dims, dim), jj], score + most[min(e + dims, dim), jj])
            jj, i, score = jj[stay], i[stay], score[stay]
        found.append((jj, i, score.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found))


def scan(anchor: np.ndarray, cell: np.ndarray, low: np.ndarray, high: np.ndarray, bitmap: np.ndarray, keep: Callable, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and exact scores of one anchor's candidates that `keep` lets through; it sees the least and the largest score each can still reach."""
    rows = np.flatnonzero(bitmap)
    _, i, score = scan_block(anchor[:, None], cell[:, rows], low, high, lambda _, lo, hi: keep(lo.ravel(), hi.ravel()).reshape(lo.shape), dims, every=True)
    return rows[i], score


def merged(known: np.ndarray, j: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The best scores of each anchor known so far, the smallest of them first, with new ones (at most as many, by anchor)."""
    new = np.full_like(known, NONE)
    new[j, np.arange(len(j)) - np.searchsorted(j, j)] = score
    return np.sort(np.concatenate([known, new], axis=1), axis=1)[:, known.shape[1] :]


def between(floor: np.ndarray, roof: np.ndarray, real: type) -> Callable:
    """Whether scores from the least to the largest given meet the span from an anchor's floor to its roof, or come very near."""
    floor, roof = ((x + side * (2 + 1e-6 * np.abs(x.astype(np.float64)))).astype(real) for x, side in ((floor, -1), (roof, 1)))
    return lambda j, lo, hi: (hi >= floor[j]) & (lo <= roof[j])


def searcher(k: int, windows: int, low: int, high: int, dims: int):
    """Pairs of an anchor block and a cell to hits (anchor_id, window, id, score). Without windows: the k best of the anchor's label."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in zip(*batch.columns):
                dim, name, a_labels, anchors, wanted, ids, labels, cell = (x.as_py() for x in row)
                a_ids, ids = np.frombuffer(name, np.int64), np.frombuffer(ids, np.int64)
                a_labels, labels = wide(a_labels, 1, len(a_ids))[0], wide(labels, 1, len(ids))[0]
                anchors, cell = wide(anchors, dim, len(a_ids)), wide(cell, dim, len(ids))
                # no sum over some of the dimensions, in whatever order, passes the product of the lengths: below these bounds each kind is exact
                longest = [float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=0).max(initial=0))) for x in (anchors, cell)]
                top = longest[0] * longest[1] * (1 + 1e-9) + 1
                kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
                real = np.float32 if kind == np.float32 else np.float64
                anchors, cell = anchors.astype(kind), cell.astype(kind)
                best = known.setdefault(name, np.full((max(windows, 1), len(a_ids), k), NONE))
                if windows:
                    scores = np.frombuffer(wanted, np.int64).reshape(len(a_ids), windows).T
                    whole = np.where(scores == NONE, 0, scores)
                    floor, roof = -(-low * whole // 100), high * whole // 100
                    open_ = (scores != NONE) & (floor <= roof)
                    floor, roof = np.where(open_, np.maximum(floor, best[:, :, 0]), MOST), np.where(open_, roof, NONE)
                    keep = between(floor.min(axis=0), roof.max(axis=0), real)
                    j, i, score = scan_block(anchors, cell, cell.min(axis=1), cell.max(axis=1), keep, dims)
                    stay = (labels[i] != a_labels[j]) & (ids[i] != a_ids[j])
                    j, i, score = j[stay], i[stay], score[stay]
                else:
                    floor, roof = best[:, :, 0].copy(), np.full((1, len(a_ids)), MOST)
                    own = [(np.empty(0, np.int64),) * 3]
                    for label in np.intersect1d(a_labels, labels):
                        # both sides lie by label
                        a, b = (slice(*(int(np.searchsorted(x, label, side)) for side in ("left", "right"))) for x in (a_labels, labels))
                        keep = between(floor[0, a], roof[0, a], real)
                        j, i, score = scan_block(anchors[:, a], cell[:, b], cell[:, b].min(axis=1), cell[:, b].max(axis=1), keep, dims)
                        stay = ids[b][i] != a_ids[a][j]
                        j, i, score = first_k(j[stay], i[stay], score[stay], ids[b], k)
                        own.append((j + a.start, i + b.start, score))
                    j, i, score = (np.concatenate(x) for x in zip(*own))
                hits = []
                for p in range(len(best)):
                    at = (score >= floor[p, j]) & (score <= roof[p, j])
                    jj, ii, found = first_k(j[at], i[at], score[at], ids, k)
                    best[p] = merged(best[p], jj, found)
                    hits.append((a_ids[jj], np.full(len(jj), p, np.int32), ids[ii], found))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*hits)], names=["anchor_id", "window", "id", "score"])

    return task


HIT = "anchor_id long, window int, id long, score long"


def first_rows(hits: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", scale: float = 256.0,
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, dims: int = DIMS,
) -> DataFrame:
    """Per anchor and positive the first `negatives` rows of another label whose score is `low` to `high` percent of the positive's."""
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    named = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_anchor.alias("asks"))
    whole = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & whole)
    asked = rows.filter("asks").groupBy("id").agg(F.min(F.struct("v", "label")).alias("m")).select("id", "m.label", "m.v")
    cells = written(rows.select("id", "label", "v").mapInArrow(vertical(CELL, scale), CELLS).drop("wanted"), "cells")
    asked = written(asked, "anchors")
    n_rows, n_asked = (cells.agg(F.sum(F.length("ids"))).first()[0] or 0) // 8, asked.count()

    def pairs(anchors: DataFrame, task: Callable, windows: int) -> DataFrame:
        blocks = packing(anchors, n_asked).mapInArrow(vertical(ANCHORS, scale, windows), CELLS)
        pairs = met(blocks, cells, n_asked, n_rows, ANCHORS, CELL)
        return pairs.select("dim", "q_ids", "q_labels", "q_parts", "q_wanted", "ids", "labels", "parts").mapInArrow(task, HIT)

    found = first_rows(pairs(asked, searcher(positives, 0, low, high, dims), 0), ["anchor_id"], positives)
    kept = written(found.select("anchor_id", (F.col("rank") - 1).cast("int").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    scores = kept.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    wanting = asked.join(scores.withColumnRenamed("anchor_id", "id").hint("merge"), "id").select("id", "label", "v", "scores")
    hits = first_rows(pairs(wanting, searcher(negatives, positives, low, high, dims), positives), ["anchor_id", "window"], negatives)
    hits = written(hits, "negatives")  # for its batches of few bytes
    return hits.join(kept.hint("merge"), ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
