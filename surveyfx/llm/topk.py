"""Exact top-k search by inner product: columnar branch and bound.

Vectors are turned into integers, so that scores and ties are exact, and packed into cells that hold one dimension after the other. A block of
queries meets a cell, a strip of candidates at a time: partial scores are accumulated a block of dimensions at a time; after each block a candidate's
score can grow by no more than the product of the remaining lengths of the two vectors. Candidates that can no longer reach the k-th best score of any
query are dropped and the rest moved together; once few pairs are left, those alone go on. A task carries the best known k-th score of each query on
from cell to cell, so later cells give few rows.

The queries are a stated set that meets all rows in blocks over a grid of tasks (`grid.py`); no other pair of rows is ever made.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part; nor do empty vectors. Vectors meet only
vectors of as many dimensions. Rows with the query's own id are no candidates of it; other repeated rows each count. A query id that repeats is
searched once, with its smallest vector. Scores must fit 64 bits. Without queries or candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyfx.llm.common import written
from surveyfx.llm.grid import NONE, SPARSE, STRIP, first_k, met, narrow, packing, wide

CELL, QUERIES, DIMS = 4096, 512, 16
PACK = "dim int, n int, ids binary, parts binary"
HIT = "query_id long, vec_id long, score long"


def packer(per_cell: int, scale: float):
    """Rows (id, vector) to cells of one dimension count each: ids, and the integer components dimension by dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def cell(dim: int, rows: list) -> pa.RecordBatch:
            parts = np.stack([v for _, v in rows], axis=1)
            ids = np.array([i for i, _ in rows], dtype=np.int64)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(rows)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "parts": pa.array([narrow(parts)], pa.binary())})

        for batch in batches:
            lists = batch.column(1)
            values, ends = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(lists.offsets)
            for i, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                rows = waiting.setdefault(b - a, [])
                rows.append((i, np.floor(values[a:b] * scale).astype(np.int64)))
                if len(rows) == per_cell:
                    yield cell(b - a, waiting.pop(b - a))
        for dim, rows in waiting.items():
            yield cell(dim, rows)

    return pack


def remaining(parts: np.ndarray, dims: int) -> np.ndarray:
    """(blocks + 1, vectors): each vector's length over the dimensions after the first 0, 1, ... blocks."""
    squares = np.add.reduceat(parts.astype(np.float64) ** 2, np.arange(0, len(parts), dims), axis=0)
    return np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, parts.shape[1]))]))


def search_cell(queries: np.ndarray, cells: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, least: np.ndarray, k: int, dims: int, rests: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, candidate number, score) of what may be among the k best; raises `least`, the known lower bounds of the k-th scores."""
    q_rest, c_rest = rests or (remaining(queries, dims), remaining(cells, dims))
    # no sum over some of the dimensions, in whatever order, passes the product of the lengths: below these bounds each kind is exact
    top = float(q_rest[0].max(initial=0)) * float(c_rest[0].max(initial=0)) * (1 + 1e-9) + 1
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    q, c = queries.astype(kind), cells.astype(kind)
    if (least == NONE).any():
        # the longest candidates give a first bound
        seed = np.argsort(-c_rest[0], kind="stable")[: max(4 * k, STRIP)]
        scores = (q.T @ c[:, seed]).astype(np.int64)
        scores[query_ids[:, None] == ids[seed][None, :]] = NONE
        if scores.shape[1] >= k:
            np.maximum(least, np.partition(scores, -k, axis=1)[:, -k], out=least)
    real = np.float32 if kind == np.float32 else np.float64
    reach, c_rest = (q_rest * (1 + 1e-6)).astype(real), c_rest.astype(real)  # more than what rounding takes
    found, first = [], 1
    for a in range(0, c.shape[1], STRIP):
        at = np.arange(a, min(a + STRIP, c.shape[1]))
        strip = c[:, at]
        enough = (least - (2 + 1e-9 * np.abs(least.astype(np.float64)))).astype(real)[:, None]
        # looks that dropped few of the last strip are left out, one fewer if the first that is taken drops nearly all
        b = first
        score = q[: b * dims].T @ strip[: b * dims]
        while True:
            # after b blocks of dimensions
            alive = score + reach[b][:, None] * c_rest[b, at] >= enough
            n = np.count_nonzero(alive)
            if b == len(q_rest) - 1 or n * SPARSE < alive.size:
                break
            some = alive.any(axis=0)
            if np.count_nonzero(some) < 0.75 * len(at):
                at, strip, score = at[some], strip[:, some], score[:, some]
            block = slice(b * dims, (b + 1) * dims)
            score += q[block].T @ strip[block]
            b += 1
        first = max(1, b - (n * SPARSE * SPARSE < alive.size))
        if n > 8 * k * len(least) and top * STRIP < 2**62:
            # copies: many of a strip reach the bound, of which the first k by score and id stay
            place = np.argsort(np.argsort(ids[at], kind="stable"), kind="stable")
            key = np.where(alive & (query_ids[:, None] != ids[at]), score.astype(np.int64) * len(at) - place, NONE)
            alive = np.zeros_like(alive)
            np.put_along_axis(alive, np.argpartition(key, -k, axis=1)[:, -k:], True, axis=1)
            alive &= key != NONE
        j, i = np.nonzero(alive)
        score, i = score[j, i], at[i]
        for b in range(b, len(q_rest) - 1):
            block = slice(b * dims, (b + 1) * dims)
            score = score + (q[block][:, j] * c[block][:, i]).sum(axis=0)
            keep = score + reach[b + 1, j] * c_rest[b + 1, i] >= enough[j, 0]
            j, i, score = j[keep], i[keep], score[keep]
        score = score.astype(np.int64)
        keep = (score >= least[j]) & (ids[i] != query_ids[j])
        found.append((j[keep], i[keep], score[keep]))
    j, i, score = first_k(*(np.concatenate(x) for x in zip(*found)), ids, k)
    last = np.flatnonzero(np.arange(len(j)) - np.searchsorted(j, j) == k - 1)
    np.maximum.at(least, j[last], score[last])
    return j, i, score


def top_k(df: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, dims: int = DIMS) -> DataFrame:
    """The k best rows for each row that `is_query` picks: query_id, rank (from 1; ties to the smaller id), vec_id, score."""
    whole = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    named = df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = named.filter(F.col("id").isNotNull() & (F.size("v") > 0) & whole)
    asked = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    cells = rows.select("id", "v").mapInArrow(packer(CELL, scale), PACK)
    blocks = packing(asked, n_asked).mapInArrow(packer(QUERIES, scale), PACK)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        last = None
        for batch in batches:
            for row in zip(*batch.columns):
                dim, name, q_parts, c_ids, c_parts = (x.as_py() for x in row)
                qi, ci = np.frombuffer(name, np.int64), np.frombuffer(c_ids, np.int64)
                q, c = wide(q_parts, dim, len(qi)), wide(c_parts, dim, len(ci))
                if (dim, c_parts) != last:
                    last, c_rest = (dim, c_parts), remaining(c, dims)
                if name not in known:
                    known[name] = np.full(len(qi), NONE), remaining(q, dims)
                least, q_rest = known[name]
                j, i, score = search_cell(q, c, qi, ci, least, k, dims, (q_rest, c_rest))
                yield pa.RecordBatch.from_arrays([pa.array(qi[j]), pa.array(ci[i]), pa.array(score)], names=["query_id", "vec_id", "score"])

    pairs = met(blocks, cells, n_asked, n_rows, QUERIES, CELL).select("dim", "q_ids", "q_parts", "ids", "parts")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = pairs.mapInArrow(task, HIT).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return written(best, "best")  # for its batches of few bytes
