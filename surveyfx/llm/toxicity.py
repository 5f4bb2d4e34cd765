"""Toxicity by weak supervision.

1. Lexicon and patterns. Over all labelled rows that may be learnt from, words and word beginnings are counted by label; those that toxic texts hold
   far more often are kept, at most `FEATURES` of them.
2. Voters. A voter is the set of all words, or of all beginnings of one length, in one band of strength; it votes if a text holds one of them. More
   voters look at how many hits a text has, and how dense they are.
3. Label model. A generative model says how votes come about for each class: a class prior, an accuracy for each voter, and a tree of correlations,
   the maximum spanning tree of the voters' mutual information given the class. Expectation maximisation, begun from the labels, estimates it on at
   most `FIT_ROWS` labelled rows. Its posterior is the label from here on.
4. Classifier. A logistic regression of the posterior on the words and beginnings found, fitted on the same bounded rows, scores every text.

Scores depend on the text alone: language, source and id are never read. The tables that tasks get are of bounded size (`FEATURES`). Labels reach the
texts by broadcast if they are few (counted first), else by shuffle.

Null texts count as empty and get the score of a text without hits. Null labels and null ids are not learnt from; of labels that repeat an id the
largest holds. If one class has no labelled row, all texts get the share of toxic rows, one half without any. Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import drop_tables, lean, without
from surveyfx.llm.wordhash import LETTERS, LOWER, Words, chunks, mixed

#: Lengths in bytes of the beginnings that are tried; 0 stands for whole words.
LENGTHS = (0, 3, 4, 5, 6, 7, 8)
#: Words and beginnings kept; candidates counted on the other label; labelled rows of the fits; toxic rows that a candidate must be in.
FEATURES, CANDIDATES, FIT_ROWS, LEAST_ROWS = 768, 200_000, 40_000, 3
#: Bands of strength for each length, and steps of hits and of hits in a thousand words that are voters too.
BANDS, HIT_STEPS, DENSITY_STEPS = 4, (2, 3, 5, 8), (3, 10, 30)
#: Least ratio of a feature's share of toxic rows to its share of other rows.
RATIO = 4.0
#: Labels that are sent to every task instead of shuffling the texts.
BROADCAST_LABELS = 2_000_000
THRESHOLD = 0.7


def features(words: Words, which: np.ndarray | slice = slice(None)) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers of the words long enough, feature hashes) for each length."""
    numbers = np.arange(len(words.start))[which]
    size = words.end[numbers] - words.start[numbers]
    for length in LENGTHS:
        use = numbers[size >= max(3, length)]
        h = words.hashes(use, length or None)
        yield length, use, mixed(h ^ np.uint64(length * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def distinct_by_text(words: Words, count: np.ndarray) -> Iterator[np.ndarray]:
    """Feature hashes of each text in `count`, each once."""
    held = [(use, h) for _, use, h in features(words)]
    for t in np.flatnonzero(count):
        a, b = words.first[t], words.first[t + 1]
        yield np.unique(np.concatenate([h[np.searchsorted(use, a) : np.searchsorted(use, b)] for use, h in held]))


def counted(rows: DataFrame, only: np.ndarray | None = None) -> DataFrame:
    """(feature, n): rows that hold a feature; counts are summed in the task before they are shuffled."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])

        for batch in batches:
            for _, words in chunks(batch.column(0), LETTERS):
                for h in distinct_by_text(words, np.ones(len(words.first) - 1, dtype=bool)):
                    if only is not None:
                        h = h[only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h] if len(only) else h[:0]
                    held.append(h)
                    size += len(h)
                if size > 1_500_000:
                    yield out()
                    held, size = [], 0
        yield out()

    return rows.select("text").mapInArrow(lean(task), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Kept features, sorted: hash, voter, and a table of the first three bytes that any of them begins with."""

    hashes: np.ndarray
    voter: np.ndarray
    heads: np.ndarray
    n_voters: int

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, int, int]]:
        """(feature numbers, hit words, words) of each text."""
        size = words.end - words.start
        long = np.flatnonzero(size >= 3)
        likely = long[self.heads[head(words, long)]]
        parts = [(likely[:0], likely[:0])]
        for _, use, h in features(words, likely):
            at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
            known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
            parts.append((use[known], at[known]))
        word, feature = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        word, feature = word[order], feature[order]
        edges = np.searchsorted(word, words.first)
        for t in range(len(words.first) - 1):
            a, b = edges[t], edges[t + 1]
            yield np.unique(feature[a:b]), len(np.unique(word[a:b])), int(words.first[t + 1] - words.first[t])

    def votes(self, found: np.ndarray, hits: int, n: int) -> np.ndarray:
        v = np.zeros(self.n_voters, dtype=bool)
        v[self.voter[found]] = True
        counts = [hits >= s for s in HIT_STEPS] + [hits * 1000 >= s * max(n, 1) and hits > 0 for s in DENSITY_STEPS]
        v[self.n_voters - len(counts) :] = counts
        return v

    def columns(self, found: np.ndarray, hits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sparse row of the classifier: numbers and values. Behind the features stand the counts and the constant."""
        k = len(self.hashes)
        more = [np.log1p(hits), np.log1p(1000 * hits / max(n, 1)), float(hits > 0), 1.0]
        return np.concatenate([found, np.arange(k, k + len(more))]), np.concatenate([np.full(len(found), 0.5), more])


MORE_COLUMNS = 4


def head(words: Words, which: np.ndarray) -> np.ndarray:
    at, low = words.start[which], LOWER
    d = words.data
    return (low[d[at]].astype(np.uint32) | low[d[at + 1]].astype(np.uint32) << 8 | low[d[at + 2]].astype(np.uint32) << 16) * np.uint32(2654435761) >> np.uint32(12)


def learn_lexicon(labelled: DataFrame) -> Lexicon | None:
    """`labelled`: text, toxic (0 or 1). None if a class is missing."""
    size = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return None
    toxic = counted(labelled.filter("toxic = 1")).filter(F.col("n") >= LEAST_ROWS).orderBy(F.col("n").desc(), "feature").limit(CANDIDATES)
    # bounded by CANDIDATES
    ones = toxic.toPandas()
    only = np.sort(ones["feature"].to_numpy(np.int64).view(np.uint64))
    zeros = counted(labelled.filter("toxic = 0"), only).toPandas()
    table = ones.merge(zeros, on="feature", how="left", suffixes=("1", "0")).fillna({"n0": 0})
    ratio = (table["n1"] / n1) / ((table["n0"] + 0.5) / (n0 + 1))
    table["strength"] = np.log(ratio) * table["n1"]
    kept = table[ratio >= RATIO].sort_values(["strength", "feature"], ascending=[False, True]).head(FEATURES)
    hashes = kept["feature"].to_numpy(np.int64).view(np.uint64)
    lengths, heads = origins(labelled, np.sort(hashes))
    order = np.argsort(hashes)
    band = (np.arange(len(hashes)) * BANDS // max(len(hashes), 1))[order]
    hashes = hashes[order]
    voter = np.array([LENGTHS.index(lengths[int(h)]) * BANDS + b for h, b in zip(hashes, band)], dtype=np.int64)
    return Lexicon(hashes, voter, heads, len(LENGTHS) * BANDS + len(HIT_STEPS) + len(DENSITY_STEPS))


def origins(labelled: DataFrame, hashes: np.ndarray) -> tuple[dict[int, int], np.ndarray]:
    """The length of each kept feature, and which first three bytes (hashed) they begin with; a few rows for each feature."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in chunks(batch.column(0), LETTERS):
                for length, use, h in features(words):
                    at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                    known = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, np.int64)
                    _, one = np.unique(h[known], return_index=True)
                    known = known[one]
                    yield pa.RecordBatch.from_arrays([pa.array(h[known].view(np.int64)), pa.array(np.full(len(known), length, np.int32)), pa.array(head(words, use[known]).astype(np.int32))], names=["feature", "length", "head"])

    rows = labelled.filter("toxic = 1").select("text").mapInArrow(lean(task), "feature long, length int, head int").distinct()
    lengths, heads = {}, np.zeros(1 << 20, dtype=bool)
    for r in rows.toPandas().itertuples(index=False):
        lengths[int(np.int64(r.feature).view(np.uint64))] = int(r.length)
        heads[r.head] = True
    return lengths, heads


def posterior(votes: np.ndarray, begin: np.ndarray, steps: int = 5) -> np.ndarray:
    """Share of class 1 for each row of votes by a generative model whose correlations form a tree, estimated from `begin` on."""
    patterns, back = np.unique(votes, axis=0, return_inverse=True)
    back = back.ravel()
    weight = np.bincount(back)
    q = np.bincount(back, weights=begin) / weight
    v = patterns.astype(np.float64)
    parent = None
    for _ in range(steps):
        logs = []
        for share in (1 - q, q):
            w = weight * share
            total = w.sum() + 1e-9
            both = (v.T * w) @ v
            one = np.diag(both).copy()
            # joint frequencies of each pair, smoothed
            p11 = (both + 0.25) / (total + 1)
            p10 = (one[:, None] - both + 0.25) / (total + 1)
            p01 = (one[None, :] - both + 0.25) / (total + 1)
            p00 = (total - one[:, None] - one[None, :] + both + 0.25) / (total + 1)
            logs.append((total, p11, p10, p01, p00))
        if parent is None:
            info = np.zeros((v.shape[1],) * 2)
            for total, p11, p10, p01, p00 in logs:
                a, b = p11 + p10, p11 + p01
                for p, x, y in ((p11, a, b), (p10, a, 1 - b), (p01, 1 - a, b), (p00, 1 - a, 1 - b)):
                    info += total * p * np.log(p / (x * y))
            parent = spanning_tree(info)
        scores = []
        for total, p11, p10, p01, p00 in logs:
            s = np.full(len(v), np.log(total))
            for j, p in enumerate(parent):
                if p < 0:
                    own = p11[j, j] / (p11[j, j] + p00[j, j])
                    s += np.where(patterns[:, j], np.log(own), np.log1p(-own))
                else:
                    given1, given0 = p11[p, j] / (p11[p, j] + p10[p, j]), p01[p, j] / (p01[p, j] + p00[p, j])
                    on = np.where(patterns[:, p], given1, given0)
                    s += np.where(patterns[:, j], np.log(on), np.log1p(-on))
            scores.append(s)
        q = 1 / (1 + np.exp(np.clip(scores[0] - scores[1], -50, 50)))
    return q[back]


def spanning_tree(info: np.ndarray) -> list[int]:
    """Parents in the maximum spanning tree; -1 for its root."""
    parent, best, done = [-1] * len(info), info[0].copy(), {0}
    near = np.zeros(len(info), dtype=int)
    while len(done) < len(info):
        j = max((i for i in range(len(info)) if i not in done), key=lambda i: best[i])
        parent[j] = int(near[j])
        done.add(j)
        closer = info[j] > best
        best[closer], near[closer] = info[j][closer], j
    return parent


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, n_columns: int, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights of a logistic regression on soft labels by accelerated gradient steps over sparse rows."""
    at = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    column, value = (np.concatenate(x) for x in zip(*rows))
    curve = 0.25 * max(np.bincount(at, weights=value**2).max(), 1e-9) + ridge
    w, ahead, pace = np.zeros(n_columns), np.zeros(n_columns), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.bincount(at, weights=value * ahead[column], minlength=len(rows))))
        new = ahead - (np.bincount(column, weights=value * (p - target)[at], minlength=n_columns) / len(rows) + ridge * ahead) / curve
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    return w


def learn(labelled: DataFrame) -> tuple[Lexicon | None, np.ndarray, float]:
    """Lexicon, weights, and the score to give where nothing could be learnt."""
    lexicon = learn_lexicon(labelled)
    if lexicon is None:
        row = labelled.agg(F.coalesce(F.avg("toxic"), F.lit(0.5)).alias("s")).first()
        return None, np.zeros(0), float(row["s"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for at, words in chunks(batch.column(0), LETTERS):
                found, hits, n = zip(*lexicon.hits(words))
                yield pa.RecordBatch.from_arrays([pa.array([f.tolist() for f in found], pa.list_(pa.int32())), pa.array(hits, pa.int32()), pa.array(n, pa.int32()), pa.array(label[at : at + len(found)], pa.int32())], names=["found", "hits", "n", "toxic"])

    seen = labelled.select("text", "toxic").mapInArrow(lean(task), "found array<int>, hits int, n int, toxic int")
    # a bounded sample for the fits: FIT_ROWS rows by the order of a hash
    sample = seen.orderBy(F.xxhash64("found", "hits", "n"), "n").limit(FIT_ROWS).toPandas()
    rows = [(np.asarray(f, dtype=np.int64), int(h), int(n)) for f, h, n in zip(sample["found"], sample["hits"], sample["n"])]
    label = sample["toxic"].to_numpy(float)
    q = posterior(np.stack([lexicon.votes(*r) for r in rows]), 0.05 + 0.9 * label)
    weights = fit_logistic([lexicon.columns(*r) for r in rows], q, len(lexicon.hashes) + MORE_COLUMNS)
    return lexicon, weights, float(label.mean())


def score(df: DataFrame, labelled: DataFrame, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score (0 to 1) of each text, learnt from `labelled` (text, toxic)."""
    lexicon, weights, default = learn(labelled)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        drop_tables()
        if lexicon is None:
            return pa.array(np.full(len(texts), default))
        parts = [np.zeros(0)]
        for _, words in chunks(texts, LETTERS):
            rows = (lexicon.columns(*r) for r in lexicon.hits(words))
            parts.append(np.array([1 / (1 + np.exp(-np.clip(weights[c] @ v, -40, 40))) for c, v in rows]))
        return pa.array(np.concatenate(parts))

    result = scored(F.col(f"`{text}`"))
    return without(df.withColumn("__score", result), out).withColumnRenamed("__score", out)


def held_out(doc: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """text, toxic of the rows that may be learnt from."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col(doc))).groupBy(doc).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumnRenamed(doc, "__doc")
    rows = docs.select(F.col(f"`{doc}`").alias("__doc"), F.col(f"`{text}`").alias("text"))
    few = known.count() <= BROADCAST_LABELS
    return rows.join(F.broadcast(known) if few else known, "__doc").select("text", "toxic")
