"""Passages that repeat across documents, found as runs of sentences.

Sentences end at a mark or a line break. Those of more than `CUT_WORDS` words are cut into pieces at places that the words around decide, so that a
passage is cut alike wherever it is embedded. A run of pieces is complete when it lies in at least two sentences and holds `MIN_WORDS` words, or holds
`LONE_WORDS` words. At every piece of every document the shortest complete run that begins there and the shortest that ends there are hashed and joined
over all documents; the first place of a run, by document id and position, is kept, and the pieces that any other place of it covers are removed. Every
piece of a longer repeated run lies in one of these within it: the run forth from its first piece, the run back from its last, or the run forth from
the piece itself. Of a passage that begins or ends within a sentence, the words up to its first and from its last common cut stay.

Only hashes and places are shuffled, once: rows lie by run for the first places and for the join with them, and both stream through the sorted rows, so
that a run that very many documents share (one of a document's many) takes time in its task but no memory; one document's runs are what is ever
gathered. White space between words does not matter; letters of scripts
without spaces count as half a word each. Null and empty texts have no runs; texts of fewer words than a run are left alone. A null id sorts before all
others. Rows that repeat both id and text count as one document; with one id and different texts they are different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import row_key, written
from surveyfx.llm.wordhash import BASE, INVERSE, mixed, powers

MIN_WORDS, LONE_WORDS = 20, 25
#: Sentences of more words are cut further: before each word whose hash is the least among those up to `NEAR` words away.
CUT_WORDS, NEAR = 20, 2
#: Code points up to the last that is white space or ends a sentence.
CODES = 0x10000
SPACE = np.array([chr(c).isspace() for c in range(CODES)])
MARK, BREAK = np.zeros(CODES, dtype=bool), np.zeros(CODES, dtype=bool)
#: Sentence marks of Latin, Greek, Arabic, Armenian, Devanagari, Tibetan, Burmese, Ethiopic, Khmer, Mongolian, East Asian and other scripts, and line breaks.
MARK[[ord(c) for c in ".!?\u037e\u0589\u061f\u06d4\u0700\u0701\u0702\u0964\u0965\u0f0d\u0f0e\u104a\u104b\u1362\u1367\u1368\u166e\u17d4\u17d5\u1803\u1809\u2026\u203c\u203d\u2047\u2048\u2049\u3002\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61"]] = True
BREAK[[ord(c) for c in "\n\r\v\f\x1c\x1d\x1e\x85\u2028\u2029"]] = True
#: Letters of scripts that set no space between words count as half a word each; planes 2 and 3 hold more of them.
ALONE = np.zeros(CODES, dtype=bool)
for _first, _last in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)):
    ALONE[_first : _last + 1] = True
#: Letters of texts that are taken apart together; a text is never cut.
CHUNK_CHARS = 100_000
#: `place` and `upto` hold the number of a sentence in their upper half.
HALF = (1 << 32) - 1
RUN = "doc_id long, key long, place long, upto long, start int, end int, run long"


def sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Running sums of a polynomial modulo 2^64."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, len(values))[: len(values)], dtype=np.uint64)])


def between(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from `start` to `end`, wherever they stand."""
    with np.errstate(over="ignore"):
        return mixed((total[end] - total[start]) * powers(INVERSE, len(total))[start] + (end - start).astype(np.uint64))


def words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, size in half words, sentence, start and end of each word; ends include white space up to a sentence's own end."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    low = np.minimum(code, CODES - 1)
    space, mark = SPACE[low], MARK[low]
    body = ~mark & ~BREAK[low]
    # stretches between marks and breaks; a sentence begins at the first letter of one and takes the marks behind it
    edge = np.diff(np.concatenate([[0], body, [0]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters, other = np.flatnonzero(~space), np.append(np.flatnonzero(~mark), len(code))
    begin = np.append(letters, len(code))[np.searchsorted(letters, begin)]
    begin, end = begin[begin < end], end[begin < end]
    end = other[np.searchsorted(other, end)]
    held = np.zeros(len(code) + 1, dtype=np.int8)
    np.add.at(held, begin, 1)
    np.add.at(held, end, -1)
    solid = np.concatenate([[False], (np.cumsum(held[:-1]) > 0) & ~space, [False]])
    opens, closes = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    opens[begin] = True
    alone = (ALONE[low] | (code >= 0x20000) & (code < 0x40000)) & solid[1:-1]
    opens |= alone
    opens[1:] |= alone[:-1] & solid[1:-2] & ~mark[1:]
    closes[:-1] |= opens[1:] & solid[1:-2]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    of = np.searchsorted(begin, first, side="right") - 1
    hashes = between(sums(mixed(code.astype(np.uint64) + np.uint64(1))), first, last)
    upto = last.copy()
    upto[np.append(np.flatnonzero(np.diff(of)), len(of) - 1)[: len(begin)]] = end
    return hashes, np.where(alone[first], 1, 2), of, first, upto


def pieces(hashes: np.ndarray, size: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The first word of each piece. Cuts depend on a few words around them, so that copies are cut alike wherever they are embedded."""
    least = np.bincount(of, weights=size)[of] > 2 * CUT_WORDS
    for d in range(1, NEAR + 1):
        near = of[d:] == of[:-d]
        least[d:] &= ~near | (hashes[d:] <= hashes[:-d])
        least[:-d] &= ~near | (hashes[:-d] <= hashes[d:])
    least[0] = True
    least[1:] |= of[1:] != of[:-1]
    return np.flatnonzero(least)


def runs(texts: list[str], min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS) -> tuple[np.ndarray, ...]:
    """text, place, upto, start, end, hash of the shortest runs that begin at each piece and of those that end there; places count from each text's start."""
    hashes, size, of, start, end = words("\n".join(texts))
    if not len(hashes):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    first = pieces(hashes, size, of)
    n, sentence = len(first), of[first]
    offset = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = np.searchsorted(offset, start[first], side="right") - 1
    begin = np.minimum(np.searchsorted(inside, np.arange(len(texts))), n - 1)
    first = np.append(first, len(hashes))
    size = np.append(0, np.cumsum(size))[first]
    i = j = np.arange(n)
    # j: the first that completes the run from i on; the other way round, the last i from which a run up to j is complete
    forth = np.minimum(np.searchsorted(size, size[i] + 2 * lone_words) - 1, np.maximum(np.searchsorted(size, size[i] + 2 * min_words) - 1, np.searchsorted(sentence, sentence, side="right")))
    back = np.maximum(np.searchsorted(size, size[j + 1] - 2 * lone_words, side="right") - 1, np.minimum(np.searchsorted(size, size[j + 1] - 2 * min_words, side="right") - 1, np.searchsorted(sentence, sentence) - 1))
    pairs = np.unique(np.concatenate([(i * n + forth)[forth < n], (back * n + j)[back >= 0]]))
    i, j = pairs // n, pairs % n
    i, j = i[inside[i] == inside[j]], j[inside[i] == inside[j]]
    k = inside[i]
    run = between(sums(hashes), first[i], first[j + 1]).view(np.int64)
    place = (sentence[i] - sentence[begin[k]] << 32) + i - begin[k]
    upto = (sentence[j] - sentence[begin[k]] << 32) + j + 1 - begin[k]
    return k, place, upto, start[first[i]] - offset[k], end[first[j + 1] - 1] - offset[k], run


def run_table(df: DataFrame, text: str = "text", doc: str = "doc_id", min_words: int = MIN_WORDS, lone_words: int = LONE_WORDS) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in RUN.split(", ")]
        for batch in batches:
            texts, at, held = [], 0, 0
            for k, t in enumerate(batch.column(2), 1):
                texts.append(t.as_py() or "")
                held += len(texts[-1])
                if k == len(batch) or held > CHUNK_CHARS:
                    which, *found = runs(texts, min_words, lone_words)
                    rows = pa.array(which + at)
                    columns = [pa.array(c, t) for c, t in zip(found, types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *columns], names=names)
                    texts, at, held = [], k, 0

    rows = df.select(F.col(f"`{doc}`").cast("long").alias("doc_id"), row_key(doc, text)[0].alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(task, RUN)


def repeated_runs(df: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """The runs that stand elsewhere first: doc_id, key, place, upto, start, end, first_doc_id."""
    # one exchange by run serves the first places and the join with them; a struct of all columns keeps it the same for both
    table = run_table(df, text, doc, **options).repartition("run")
    where = F.struct("doc_id", "key", "place", "upto", "start", "end")
    # places counted twice, of rows that repeat, go below
    firsts = table.groupBy("run").agg(F.min(where).alias("first"), F.count("*").alias("times")).filter("times > 1").select("run", "first")
    later = table.join(firsts, "run").filter(~where.eqNullSafe(F.col("first")))
    return later.select("doc_id", "key", "place", "upto", "start", "end", F.col("first.doc_id").alias("first_doc_id"))


def stretches(df: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """One row for each stretch of removed text: doc_id, key, start, end (code points, end exclusive), n_sentences, first_doc_id."""

    @F.arrow_udf("array<struct<start int, end int, n_sentences int, first_doc_id long>>")
    def merged(lists: pa.Array) -> pa.Array:
        out = []
        for spans in lists.to_pylist():
            joined: list[dict] = []
            stop = above = -1
            for s in sorted(spans, key=lambda s: s["place"]):
                upto, sentence = s["upto"] & HALF, (s["upto"] >> 32) + 1
                if s["place"] & HALF <= stop:
                    last = joined[-1]
                    last["n_sentences"] += max(0, sentence - above)
                    last["end"] = max(last["end"], s["end"])
                    last["first_doc_id"] = min((x for x in (last["first_doc_id"], s["first_doc_id"]) if x is not None), default=None)
                    above = max(above, sentence)
                else:
                    joined.append({"start": s["start"], "end": s["end"], "n_sentences": sentence - (s["place"] >> 32), "first_doc_id": s["first_doc_id"]})
                    above = sentence
                stop = max(stop, upto)
            out.append(joined)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_sentences", pa.int32()), ("first_doc_id", pa.int64())])))

    # a document's own runs, at most two for each piece
    gathered = repeated_runs(df, text, doc, **options).groupBy("doc_id", "key").agg(F.collect_list(F.struct("place", "upto", "start", "end", "first_doc_id")).alias("spans"))
    # written here, so that texts and lists go to the workers in batches of few bytes
    return written(gathered.select("doc_id", "key", F.explode(merged("spans")).alias("s")).select("doc_id", "key", "s.*"), "stretches")


def remove_repeats(df: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """The frame with repeated sentences taken out of `text`; other columns pass through."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(texts.to_pylist(), lists.to_pylist()):
            for s in sorted(spans or [], key=lambda s: -s["start"]):
                t = t[: s["start"]] + t[s["end"] :]
            out.append(t)
        return pa.array(out, pa.string())

    gone = written(stretches(df, text, doc, **options).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("__spans")), "repeated-stretches")
    marked = df.withColumn("__key", row_key(doc, text)[0]).join(gone.withColumnRenamed("key", "__key"), "__key", "left")
    return marked.select(*[cut(F.col(f"`{c}`"), F.col("__spans")).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
