"""Joins, searches and removals against brute force, with awkward rows."""

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyfx.llm import decontaminate, grid, jaccard, lines, substrings, topk
from surveyfx.llm.wordhash import NOT_SPACE, chunks

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ra se ti no pu la me si to nu".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


# --- top k ---


def test_top_k_with_ties_and_gaps(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=20), 1).tolist()) for i in range(300)] + [(300 + i, [0.5] * 20) for i in range(30)]
    odd = [(1000, None), (1100, [None] * 20), (1200, [float("nan")] * 20), (1300, [float("inf")] * 20), (1400, []), (None, [1.0] * 20), (1500, [1.0, 2.0]), (1501, [3.0, -1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).repartition(4)
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=7, dims=6).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in rows} | {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in odd[-2:]}
    asked = [i for i in whole if i % 50 == 0]
    assert sorted(got) == sorted(asked)
    for q in asked:
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:7]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_of_queries_are_never_broadcast(spark, monkeypatch):
    """However small they look: they stand for a copy for each salt."""
    monkeypatch.setattr(topk, "written", lambda df, name: df)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    found = topk.top_k(df, F.col("vec_id") % 50 == 0, k=3)
    assert len(found.collect()) == 12
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_what_is_dealt_out_stays_in_proportion_to_the_cells():
    for rows in (10**3, 10**5, 10**7, 10**9):
        for queries in (1, rows // 100, rows):
            groups, salts = grid.sides(100 * rows // 10**6 + 12, queries, rows, 512, 4096)
            assert 1 <= salts <= -(-rows // 4096) and 1 <= groups <= -(-queries // 512)
            assert rows * groups + queries * salts <= 8 * rows + queries


@pytest.mark.parametrize("size", [30, 1000, 10**7, 10**9])
def test_cells_one_after_the_other_give_the_best(size):
    rng = np.random.default_rng(size)
    q_ids, q = np.arange(0, 300, 10), rng.integers(-size, size, (20, 30))
    least, hits, cells, ids = np.full(30, topk.NONE), [], [], []
    for c in range(4):
        cell = rng.integers(-size, size, (20, 700))
        cell[:, 300:600] = cell[:, [c * 10]] if c % 2 else q[:, [3]]  # more copies than are asked for
        own = rng.permutation(700) + 700 * c
        j, i, score = topk.search_cell(q, grid.wide(grid.narrow(cell), 20, 700), q_ids, own, least, 6, 8)
        hits += zip(q_ids[j].tolist(), (-score).tolist(), own[i].tolist())
        cells.append(cell), ids.append(own)
    cell, own = np.concatenate(cells, axis=1), np.concatenate(ids)
    for a, v in zip(q_ids, q.T):
        best = sorted((-int(x), int(i)) for x, i in zip(v @ cell, own) if i != a)[:6]
        assert sorted(h[1:] for h in hits if h[0] == a)[:6] == best


# --- lines ---


def test_line_spread_around_the_threshold(spark):
    rows = []
    for spread in (3, 4, 5, 6, 7, 12):
        rows += [(f"d{spread}-{s}", f"s{s}", f"own {spread} {s}\n  line of {spread} \n\nlast {s} {spread}") for s in range(spread)]
    rows += [("same", "s0", "many\nmany\nmany")] * 40 + [("null", None, "nosite"), ("none", "s1", None), ("empty", "s1", ""), ("blank", "s2", "\n\n")]
    rows += [(f"n{i}", None, "without a site") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id string, source string, text string").withColumn("n_lines", F.lit("clash")).repartition(5)
    got = collections.defaultdict(list)
    for r in lines.remove_boilerplate(df, min_sites=5).collect():
        got[r["doc_id"]].append((r["text"], r["n_lines"], r["n_removed"]))
    for d, _, text in rows:
        spread = int(d[1:].split("-")[0]) if "-" in d else 0
        want = text
        if spread >= 5:
            want = "\n".join(x for x in text.split("\n") if x.strip() != f"line of {spread}")
        assert set(got[d]) == {(want, 0 if text is None else len(text.split("\n")), int(spread >= 5))}
    assert lines.remove_boilerplate(df.limit(0)).count() == 0


def test_line_removal_without_broadcast(spark, monkeypatch):
    rows = [(i, f"s{i}", f"shared\nown {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    monkeypatch.setattr(lines, "BROADCAST_LINES", -1)
    assert {r["text"] for r in lines.remove_boilerplate(df).collect()} == {f"own {i}" for i in range(12)}


# --- benchmark ---


@pytest.mark.parametrize("few", [True, False])
def test_passages_with_substitutions_are_found(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate([15, 18, 24, 30, 40, 55])] + [(50, "too short"), (51, None), (52, ""), (3, prose(rng, 25))]
    docs, planted = [], set()
    for k in range(60):
        item, text = items[k % 6]
        w = text.split()
        for s in range(k // 12):  # every twelfth word replaced in the later ones
            if 6 + 12 * s < len(w):
                w[6 + 12 * s] = "qqqq"
        docs.append((k, prose(rng, 40 + k) + "\n" + " ".join(w).upper() + ", " + prose(rng, 30)))
        planted.add((k, item))
    docs += [(100 + k, prose(rng, 200)) for k in range(40)] + [(200, None), (201, ""), (0, docs[0][1]), (None, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == planted | {(None, 1)}
    kept = {r["doc_id"] for r in decontaminate.decontaminate(df, bench).collect()}
    assert kept == {*range(100, 140), 200, 201}
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_every_allowed_substitution_is_found(spark):
    """All placements of the substitutions that a stretch may hold, at even and odd positions of the document."""
    item = {n: [f"t{n}x{i}" for i in range(n)] for n in (9, 10, 11, 12, 13)}
    docs, want = [], set()
    for n, words in item.items():
        for places in [(), *itertools.combinations(range(n), 3 if n > 11 else 2)]:
            for head in (4, 5):
                copy = ["qqqq" if i in places else w for i, w in enumerate(words)]
                want.add((len(docs), n))
                docs.append((len(docs), " ".join(["ff"] * head + copy + ["gg"] * 3)))
    bench = spark.createDataFrame([(n, " ".join(words)) for n, words in item.items()], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


# --- sentence runs ---


def brute_repeats(rows):
    seen, gone = {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        parts = [(m.start(), m.end(), m[0].split()) for m in re.finditer(r"[^\s.!?][^.!?\n]*[.!?]*", rows[i][1] or "")]
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                n = sum(len(p[2]) for p in parts[a : b + 1])
                if n >= 20 and b > a or n >= 25:
                    run = tuple(tuple(p[2]) for p in parts[a : b + 1])
                    if run in seen:
                        gone.setdefault(rows[i][0], set()).update(range(parts[a][0], parts[b][1]))
                    else:
                        seen[run] = i
                    break
    return gone


def test_repeated_passages(spark):
    rng = random.Random(7)
    passage = ". ".join(prose(rng, 12) for _ in range(5)) + "."
    long = prose(rng, 60)
    rows = [(i, ". ".join(prose(rng, 8) for _ in range(6)) + ".") for i in range(20)]
    rows += [(20 + i, f"{prose(rng, 15)}. {passage} {prose(rng, 9)}.\n{prose(rng, 30)}") for i in range(30)]
    rows += [(60 + i, f"{prose(rng, 3)}!\n{long}\n{prose(rng, 4)}?") for i in range(4)] + [(90, None), (91, ""), (92, "..."), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit("clash")).repartition(4)
    want = brute_repeats(rows)
    got = {}
    text = {d: t or "" for d, t in rows}
    for r in substrings.stretches(df).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    blank = lambda d, at: {i for i in at if not text[d][i].isspace()}
    assert {d: blank(d, at) for d, at in got.items()} == {d: blank(d, at) for d, at in want.items()}
    assert set(got) == {*range(20, 50), 61, 62, 63}
    cleaned = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(df).collect()}
    assert cleaned[None] == passage and cleaned[0] == text[0] and passage[:60] not in cleaned[25] and cleaned[90] is None
    assert substrings.stretches(df.limit(0)).count() == 0


def test_every_run_length_counts(spark):
    """Runs of all lengths by brute force, with lone sentences beside short ones at the ends of what repeats."""
    rng = random.Random(17)
    rows = []
    for g in range(12):
        shared = [prose(rng, n) for n in rng.choice([(30, 19), (19, 30), (12, 26, 5), (30, 3, 3), (8, 7, 6, 27, 19), (4, 30, 15, 2)])]
        rows += [(10 * g + k, ". ".join([prose(rng, rng.randint(1, 12)), *shared, prose(rng, rng.randint(1, 12))]) + ".") for k in range(3)]
    seen, want = {}, {}
    for d, t in rows:
        parts = [(m.start(), m.end(), m[0].split()) for m in re.finditer(r"[^\s.!?][^.!?\n]*[.!?]*", t)]
        for a in range(len(parts)):
            for b in range(a, len(parts)):
                run = tuple(w for p in parts[a : b + 1] for w in p[2])
                if (len(run) >= 20 and b > a or len(run) >= 25) and seen.setdefault(run, (d, a)) != (d, a):
                    want.setdefault(d, set()).update(i for i in range(parts[a][0], parts[b][1]) if not t[i].isspace())
    got, text = {}, dict(rows)
    for r in substrings.stretches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(i for i in range(r["start"], r["end"]) if not text[r["doc_id"]][i].isspace())
    assert got == want and len(got) == 24


def test_runs_are_exchanged_once(spark):
    passage = " ".join(f"w{n}." if n % 10 == 9 else f"w{n}" for n in range(60))
    found = substrings.repeated_runs(spark.createDataFrame([(n, passage) for n in range(9)], "doc_id long, text string"))
    assert {r["doc_id"] for r in found.collect()} == set(range(1, 9))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("MapInArrow") == 1


def test_passages_within_long_sentences(spark):
    """Passages embedded in text without marks are covered but for a few words at their ends; other scripts' marks end sentences."""
    rng = random.Random(23)
    rows, where = [], {}
    for g in range(40):
        passage = prose(rng, 60)
        for k in range(2):
            head = prose(rng, 200 + rng.randint(0, 50)) + " "
            rows.append((2 * g + k, head + passage + " " + prose(rng, 150)))
            where[2 * g + k] = (len(head), len(head) + len(passage))
    chinese = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(24)) + mark for mark in "。！？。"]
    own = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(24)) + "。" for _ in range(6)]
    rows += [(100, "".join([*own[:2], *chinese, own[2]])), (101, "".join([own[3], *chinese, *own[4:]])), (102, "। ".join([prose(rng, 9), *["क ख ग घ ङ च छ ज झ ञ ट"] * 2, "ठ"])), (103, "क ख ग घ ङ च छ ज झ ञ ट। क ख ग घ ङ च छ ज झ ञ ट।")]
    got, text = {}, dict(rows)
    for r in substrings.stretches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    for d in range(1, 80, 2):
        (start, end), = got[d]
        first, last = where[d]
        assert first <= start and end <= last + 1 and len(text[d][start:end].split()) > 36
    assert sum(len(text[d][s:e].split()) for d in range(1, 80, 2) for s, e in got[d]) > 0.85 * 60 * 40
    assert [text[101][s:e] for s, e in got[101]] == ["".join(chinese)] and 103 in got
    assert not set(got) & {100, 102, *range(0, 80, 2)}


# --- shingle sets ---


def shingles(text, n=5):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("common", [64, 3])
def test_components_of_near_copies(spark, monkeypatch, common):
    """Groups with edits around the threshold, chains, a passage shared by many, exact copies; with and without common shingles kept at home."""
    monkeypatch.setattr(jaccard, "COMMON_LEAST", common)
    if common == 3:
        monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    rng = random.Random(11)
    shared = prose(rng, 60)
    rows = []
    for g in range(12):
        base = prose(rng, rng.randint(30, 200))
        rows += [(rng.randint(0, 10**9), edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))) for _ in range(12)]
    rows += [(rng.randint(0, 10**9), f"{prose(rng, rng.randint(5, 80))} {shared} {prose(rng, rng.randint(5, 80))}") for _ in range(60)]
    chain = prose(rng, 120).split()
    rows += [(rng.randint(0, 10**9), " ".join(chain[k : k + 80])) for k in range(0, 40, 4)]
    rows += [(5, "A b"), (6, "a\tB"), (7, "a b c"), (8, ""), (9, None), (10, "  \n"), (None, "a b c"), (None, "lone words"), (5, "A b"), (3, shared.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_components(df).collect()), key=str)
    assert got == brute_components(rows)


def test_components_of_nothing(spark):
    assert jaccard.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard.join_components(one).collect()) == [1, 2]


def test_word_hashes_are_those_of_words():
    import pyarrow as pa

    texts = ["a b", None, "", "A\tbb é\n", "b", "bb  é", "x" * 5_000_000 + " a"]
    by = {}
    for at, w in chunks(pa.array(texts), NOT_SPACE):
        h = w.hashes().tolist()
        for t in range(len(w.first) - 1):
            for word, value in zip((texts[at + t] or "").lower().split(), h[w.first[t] : w.first[t + 1]], strict=True):
                assert by.setdefault(word, value) == value
    assert len(set(by.values())) == len(by) == 5
