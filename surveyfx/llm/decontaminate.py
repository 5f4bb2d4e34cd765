"""Benchmark passages in training documents, by built-in functions only.

Fixed masks pick some of the token positions of a window and ignore the rest, so a window still hits where ignored tokens were replaced. All windows
of the benchmark items and of every document are hashed under every mask; equal hashes are hits. The masks are chosen so that some window hits wherever
the substitutions stand that `AGREE` allows in a stretch, at any position. A hit fixes how item and document lie to each other. Around it the tokens are compared one by one, and the pair counts if some stretch of `WINDOW` item tokens (the whole
item, if shorter) agrees in at least `AGREE` of its places: substitutions are allowed, chance hits are not.

A document's share of the work is its own tokens. Benchmark hashes go to every task if they are few (counted first) and are joined by shuffle if
not; the same holds for hits. Tokens are runs of letters and digits in lower case. Items of fewer tokens than a window find nothing, as do null
and empty texts; repeated rows are found alike. Items are told apart by id: of rows that repeat an item id each is compared, and
items without an id find nothing. Other columns are not read, whatever their names, and `decontaminate` passes all columns through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import row_key, written

#: Positions that count, by mask; every mask fits a window of `SPAN` tokens. Together they hit every placement of 2 substitutions in 9 to 11 tokens and of
#: 3 in 12 or 13.
MASKS = ((0, 1, 2, 6), (0, 1, 5, 7), (0, 3, 4, 8), (1, 3, 4, 8), (2, 5, 6, 7))
SPAN = 9
WINDOW, AGREE = 13, 0.75
#: Rows up to which a written table is sent to every task.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, seed): hashes under each mask of the windows of `hashed`, a column of hashed tokens; `pos` is a window's first token.

    Windows are laid side by side and become rows before anything is hashed, so that hashing is compiled code and no lambda.
    """
    beside = F.arrays_zip(*[F.slice("hashed", F.lit(o + 1), F.size("hashed")) for o in range(SPAN)])
    rows = df.filter(F.size("hashed") >= SPAN).select(*keys, F.posexplode(beside).alias("pos", "w")).filter(F.col("w")[str(SPAN - 1)].isNotNull())
    masked = [F.xxhash64(F.lit(m), *[F.col("w")[str(o)] for o in mask]) for m, mask in enumerate(MASKS)]
    return rows.select(*keys, "pos", F.explode(F.array(*masked)).alias("seed"))


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, agree: float = AGREE) -> DataFrame:
    """One row for each document row and item that overlap: key1, key2 (the row's key), doc, item, n_words, compared, n_equal, at (first token)."""
    tests = written(items.select(F.col(f"`{item}`").alias("item"), tokens(F.col(f"`{item_text}`")).alias("test")).distinct(), "benchmark-tokens")
    probe = seeds(tests.select("item", hashed(F.col("test")).alias("hashed")), "item").withColumnRenamed("pos", "there")
    seeded = sized(written(probe.distinct(), "benchmark-seeds"))
    keyed = docs.select(F.col(f"`{doc}`").alias("doc"), F.col(f"`{text}`").alias("text"), *[k.alias(f"key{i}") for i, k in enumerate(row_key(doc, text), 1)])
    # the text itself is not carried along its windows
    split = keyed.select("key1", "key2", hashed(tokens(F.col("text"))).alias("hashed"))
    found = seeds(split, "key1", "key2").join(seeded, "seed")
    places = found.select("key1", "key2", "item", (F.col("pos") - F.col("there")).alias("shift"))
    hits = written(places.distinct(), "benchmark-hits")
    rows = keyed.join(sized(hits), ["key1", "key2"]).select("key1", "key2", "doc", "item", "shift", tokens(F.col("text")).alias("words"))
    # the document's tokens beside the item, as far as the document goes; an argument of a higher-order function is evaluated once, a lambda's body each time
    first = F.greatest(F.col("shift"), F.lit(0))
    beside = F.slice("words", first + 1, F.greatest(F.size("test") + F.least(F.col("shift"), F.lit(0)), F.lit(0)))
    same = F.transform(beside, lambda w, j: F.when(F.get(F.col("test"), j + first - F.col("shift")) == w, 1).otherwise(0))
    sums = F.aggregate(same, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    compared = F.least(F.size("test"), F.lit(window))
    both = rows.join(sized(tests), "item").select("key1", "key2", "doc", "item", F.size("test").alias("n_words"), compared.alias("compared"), first.alias("at"), sums.alias("sums"))
    wide = F.greatest(F.size("sums") - F.col("compared"), F.lit(1))
    windows = F.zip_with(F.slice("sums", F.size("sums") - wide + 1, wide), F.slice("sums", F.lit(1), wide), lambda b, a: b - a)
    best = both.select("key1", "key2", "doc", "item", "n_words", "compared", "at", F.array_max(windows).alias("n_equal"))
    kept = best.filter(F.col("n_equal") >= F.ceil(F.col("compared") * agree))
    return kept.groupBy("key1", "key2", "doc", "item").agg(F.max(F.struct("n_equal", (-F.col("at")).alias("back"), "n_words", "compared")).alias("b")).select(
        "key1", "key2", "doc", "item", F.col("b.n_words").alias("n_words"), F.col("b.compared").alias("compared"), F.col("b.n_equal").alias("n_equal"), (-F.col("b.back")).alias("at")
    )


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_words, compared, n_equal, at: the pairs that overlap, once for repeated rows."""
    found = overlaps(docs, items, **options)
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_words", "compared", "n_equal", "at").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """The documents that overlap with no item."""
    found = overlaps(docs, items, text=text, doc=doc, **options).select(F.col("key1").alias("__key1"), F.col("key2").alias("__key2"))
    bad = sized(written(found.distinct(), "contaminated"))
    k1, k2 = row_key(doc, text)
    return docs.select("*", k1.alias("__key1"), k2.alias("__key2")).join(bad, ["__key1", "__key2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
