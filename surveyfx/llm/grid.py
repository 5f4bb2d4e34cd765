"""Every block of queries with every cell of rows, dealt over a grid of tasks.

Blocks and cells hold integer vectors one dimension after the other, in the narrowest type that holds them. A cell has one salt and goes to every
group of blocks; a block has one group and goes to every salt. The grid's sides are chosen so that both together move least: about the square root of
tasks times queries a row, in cells. The number of tasks is bounded by queries a row as well, so that what is moved stays in proportion to the cells
however many there are.

Both sides are shuffled, whatever their estimated sizes: a planner that takes blocks for a small table does not see that they stand for as many
copies as there are salts, and would send all of those through the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks for as many rows a query as one; cells that a task should see, as what it knows after one spares work on the next; queries that one task packs.
TASKS, CELLS, QUERIES = 10, 4, 4096
KEYS = ["dim", "salt", "part"]
#: Candidates that are looked at together; below one of so many pairs alive the rest are looked at one by one.
STRIP, SPARSE = 512, 64
NONE = np.iinfo(np.int64).min


def narrow(values: np.ndarray) -> bytes:
    """Integers in the narrowest type that holds them all."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    kind = next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def wide(blob: bytes, dim: int, n: int) -> np.ndarray:
    """(dim, n) integers as `narrow` left them."""
    return np.frombuffer(blob, f"i{len(blob) // (dim * n)}").reshape(dim, n)


def first_k(j: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (query number, candidate number, score) the k best of each query, ties to smaller ids; by query, the best first."""
    n = int(j.max(initial=-1)) + 1
    if len(j) > 8 * k * n and int(np.abs(score).max()) < 2**62 // len(ids):
        # many are equal or no bound is known yet: only the k best of each are sorted
        place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        key = np.full((n, len(ids)), NONE)
        key[j, i] = score * len(ids) - place[i]
        keep = key[j, i] >= np.partition(key, -k, axis=1)[j, -k]
        j, i, score = j[keep], i[keep], score[keep]
    order = np.lexsort((ids[i], -score, j))
    j, i, score = j[order], i[order], score[order]
    best = np.arange(len(j)) - np.searchsorted(j, j) < k
    return j[best], i[best], score[best]


def sides(tasks: int, queries: int, rows: int, per_block: int, per_cell: int, cores: int = 1) -> tuple[int, int]:
    """(groups of blocks, salts of cells)."""
    tasks = max(1, min(tasks, TASKS * rows // max(queries, 1)))
    groups = max(1, min(math.ceil(queries / per_block), round(math.sqrt(tasks * queries / max(rows, 1)))))
    cells = math.ceil(rows / per_cell)
    return groups, max(1, min(math.ceil(tasks / groups), cells, max(math.ceil(cells / CELLS), math.ceil(cores / groups))))


def packing(asked: DataFrame, queries: int) -> DataFrame:
    """The queries in so few partitions that their blocks are full."""
    return asked.coalesce(max(1, math.ceil(queries / QUERIES)))


def met(blocks: DataFrame, cells: DataFrame, queries: int, rows: int, per_block: int, per_cell: int) -> DataFrame:
    """Pairs of a block, its columns named q_..., and a cell of as many dimensions."""
    spark = cells.sparkSession
    groups, salts = sides(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), queries, rows, per_block, per_cell, spark.sparkContext.defaultParallelism)

    def dealt(df: DataFrame, own: str, of: int, other: str, to: int) -> DataFrame:
        df = df.withColumn(own, F.pmod(F.xxhash64("ids"), F.lit(of)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(to - 1))))
        return df.repartition(4 * groups * salts, *KEYS)  # some more than there are keys, so that few meet in one

    sent = dealt(blocks, "part", groups, "salt", salts).select(*KEYS, *[F.col(c).alias(f"q_{c}") for c in blocks.columns if c != "dim"])
    return dealt(cells, "salt", salts, "part", groups).join(sent.hint("merge"), KEYS).drop("salt", "part")
