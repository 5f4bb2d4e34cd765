"""Removal of lines that stand on many sites, by built-in functions only.

Every line's sites are gathered in a HyperLogLog sketch; sketches of one line merge by partial aggregation, so a line that a third of all documents
share costs one small sketch a task. A line well above the threshold is boilerplate, one well below is not, and the lines whose estimate lies within
the sketch's error of the threshold get their sites counted exactly. Boilerplate lines are then taken out of every document.

Lines are compared without the blanks around them, by two hashes (96 bits). Blank lines are never boilerplate. A null site is no site. A null text
stays null and has no lines; an empty text is one blank line. Repeated rows are cleaned alike. `n_lines` and `n_removed` replace columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import written

MIN_SITES = 10
#: Size of the sketches; their relative standard error is 1.04 / sqrt(2 ** LG_K). Estimates within `ERRORS` of them from the threshold are checked.
LG_K, ERRORS = 12, 4
#: Removed lines up to which they are sent to every task instead of shuffling the documents.
BROADCAST_LINES = 2_000_000


def line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.hash(line, F.length(line)).alias("h2")]


def lines_of(df: DataFrame, text: str, *more: Column) -> DataFrame:
    """One row for each line that is not blank: its place (from 0) and hashes."""
    placed = df.select(*more, F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("place", "line")).withColumn("line", F.trim("line"))
    kept = [c for c in placed.columns if c != "line"]
    return placed.filter(F.col("line") != "").select(*kept, *line_hashes(F.col("line")))


def boilerplate(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """The hashes of lines that stand on at least `min_sites` distinct sites, as a written table."""
    lines = lines_of(df, text, F.col(f"`{site}`").cast("string").alias("site")).filter(F.col("site").isNotNull())
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    margin = math.ceil(min_sites * ERRORS * 1.04 / math.sqrt(2**lg_k))
    spread = sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites - margin)
    wide = written(spread, "line-spread")
    near = wide.filter(F.col("sites") < min_sites + margin).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("sites")).filter(F.col("sites") >= min_sites)
    sure = wide.filter(F.col("sites") >= min_sites + margin)
    return written(sure.select("h1", "h2").unionByName(exact.select("h1", "h2")), "boilerplate")


def remove_boilerplate(df: DataFrame, text: str = "text", site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The frame with boilerplate lines taken out of `text`, and the numbers of lines before (`n_lines`) and of lines removed (`n_removed`)."""
    common = boilerplate(df, text, site, min_sites)
    keyed = df.select("*", F.xxhash64(F.col(f"`{text}`")).alias("__key1"), F.hash(F.col(f"`{text}`"), F.length(F.col(f"`{text}`"))).alias("__key2"))
    lines = lines_of(keyed, text, F.col("__key1"), F.col("__key2"))
    # what is removed depends on the text alone: copies share one entry
    gone = written(lines.join(common, ["h1", "h2"], "left_semi").groupBy("__key1", "__key2").agg(F.collect_set("place").alias("__gone")), "removed-lines")
    size = gone.agg(F.coalesce(F.sum(F.size("__gone") + 4), F.lit(0)).alias("n")).first()["n"]
    marked = keyed.join(F.broadcast(gone) if size <= BROADCAST_LINES else gone, ["__key1", "__key2"], "left")
    # the lines that stay, by set difference of places: linear in the lines of a text
    marked = marked.withColumn("__parts", F.split(F.col(f"`{text}`"), "\n", -1))
    parts = F.col("__parts")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("__parts"), i)), "\n")
    removed = F.coalesce(F.when(F.col("__gone").isNotNull(), F.size("__gone")), F.lit(0)).cast("long")
    n_lines = F.when(F.col(f"`{text}`").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return marked.select(*[F.when(F.col("__gone").isNull(), F.col(f"`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_lines", "n_removed")], n_lines.alias("n_lines"), removed.alias("n_removed"))
