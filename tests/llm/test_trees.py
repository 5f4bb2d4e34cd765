"""Near copies by chosen paths, Merkle proofs and hard negatives against brute force, with awkward rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveyfx.llm import chosenpath, merkle, negatives
from surveyfx.llm.grid import narrow

WORDS = [a + b for a in "ba ce di fo gu ha je ki lo mu".split() for b in "ra se ti no pu la me si to nu".split()]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, changes):
    words = text.split(" ")
    for at in rng.sample(range(len(words)), changes):
        words[at] = rng.choice(WORDS).upper()
    return " ".join(words)


# --- near copies ---


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def components(rows, percent):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= percent * (len(x) + len(sets[j]) - both):
                comp[find(i)] = find(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    name = [d if not sets[i] else min(ids[find(i)], default=None) for i, (d, _) in enumerate(rows)]
    return sorted((repr(d), len(sets[i]), repr(name[i]), d == name[i]) for i, (d, _) in enumerate(rows))


def found(df, **how):
    return sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"]), r["kept"]) for r in chosenpath.near_copies(df, **how).collect())


@pytest.mark.parametrize("node_classes, pair_blocks, depth", [(700, 16, 12), (6, 16, 12), (6, 2, 12), (4, 1, 3)])
def test_near_copies_whatever_the_node_size(spark, monkeypatch, node_classes, pair_blocks, depth):
    monkeypatch.setattr(chosenpath, "NODE_CLASSES", node_classes)
    monkeypatch.setattr(chosenpath, "PAIR_BLOCKS", pair_blocks)
    monkeypatch.setattr(chosenpath, "DEPTH", depth)
    rng = random.Random(5)
    rows = []
    shared = prose(rng, 60)
    for g in range(12):
        base = prose(rng, rng.choice([30, 120, 400]))
        rows += [(len(rows), base)] + [(len(rows) + k, edited(rng, base, rng.randint(0, 4))) for k in range(1, 6)]
    big = prose(rng, 300)
    rows += [(1000 + k, edited(rng, big, 3)) for k in range(60)]
    # one passage in many documents that are no copies, and a chain of which only neighbours are similar
    rows += [(2000 + k, f"{shared} {prose(rng, 70)}") for k in range(40)]
    chain = prose(rng, 200)
    for k in range(8):
        rows.append((3000 + k, chain))
        chain = edited(rng, chain, 2)
    rows += [(None, big), (None, "one two"), (None, "One  TWO\n"), (4000, "one two"), (4001, None), (4002, ""), (4003, " \t "), (5, rows[5][1]), (5, rows[5][1]), (4004, "x")]
    rows += [(None, "alone without id a b c"), (None, "Alone without id a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'x' as cid", "0 as n").repartition(6)
    assert found(df) == components(rows, 85)


def test_near_copies_of_one_text_many_times(spark):
    rng = random.Random(7)
    a = prose(rng, 200)
    rows = [(k, a) for k in range(2000)] + [(5000 + k, edited(rng, a, 2)) for k in range(5)] + [(1, a)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df)
    assert len(got) == len(rows) and {r[2] for r in got} == {"0"} and sum(r[3] for r in got) == 1


def test_near_copies_of_nothing(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []
    rows = [(1, None), (2, ""), (3, "only this one here now")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == components(rows, 85)


def test_near_copies_with_very_long_texts(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(chosenpath, "NODE_TOKENS", 50_000)
    base = prose(rng, 60_000)
    rows = [(1, base), (2, edited(rng, base, 300)), (3, edited(rng, base, 4000)), (4, prose(rng, 50))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == components(rows, 85)


def test_survival_is_that_of_simulated_trees():
    rng = random.Random(1)

    def alive(depth, level=1):
        if level > depth:
            return True
        children = 2 if level <= chosenpath.WIDE else 1 + (rng.random() < chosenpath.DEEP_CHILDREN - 1)
        return any(rng.random() < 0.85 and alive(depth, level + 1) for _ in range(children))

    for depth in (1, 3, 7):
        share = np.mean([alive(depth) for _ in range(20_000)])
        assert abs(share - chosenpath.survival(0.85, depth, 1)) < 0.015
    assert chosenpath.survival(0.85, 1, 8) > 0.999999


# --- Merkle manifest ---


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def up(nodes):
    """All levels of a tree."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def climb(tree, idx, h, proof):
    for nodes in tree[:-1]:
        a = idx // 16 * 16
        left, right = nodes[a:idx], nodes[idx + 1 : a + 16]
        proof += left + right
        h, idx = sha(*left, h, *right), idx // 16
    return h


def manifest(rows, tampers):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {g: up([leaf_of(r) for r in groups[g]]) for g in order}
    top = up([trees[g][-1][0] for g in order])
    out = []
    for t, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            changed = (*r[:4], r[4] and r[4].translate(LOWER)) if tampers(r) else r
            proof = []
            folded = climb(top, t, climb(trees[g], i, leaf_of(changed), proof), proof)
            out.append((repr(r[0]), leaf_of(r), trees[g][-1][0], top[-1][0], sha(*proof), folded, folded == top[-1][0]))
    return sorted(out)


def tampered(row):
    return row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0


def proved(df, **how):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.prove(df, ["doc_id", "source", "lang", "n_chars", "text"], {"text": lower}, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, **how)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LEAF = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("part, sorting", [(4096, 100_000), (7, 40), (16, 25)])
def test_merkle_proofs_with_groups_of_all_sizes(spark, monkeypatch, part, sorting):
    monkeypatch.setattr(merkle, "PART", part)
    monkeypatch.setattr(merkle, "SORT_ROWS", sorting)
    rows = []
    for size in (1, 2, 15, 16, 17, 33, 256, 257, 700):
        rows += [(3 * len(rows) + k, f"s{size}", None if k % 7 == 0 else "en", None if k % 5 == 0 else k, f"Text {k} é") for k in range(size)]
    rows += [(10**7 + k, None, "x", 1, None if k % 2 else "") for k in range(20)] + [(None, "s2", "x", 1, "NULL ID"), (None, None, None, None, None)]
    rows += [(5, "repeated", "en", 2, "SAME")] * 60 + [(5, "repeated", "en", 2, f"Other {k}") for k in range(9)]
    rows += [(9000 + k, f"é{k}", "l", 3, "Long " * (30_000 if k == 3 else 1)) for k in range(40)] + [(1, "", "l", 3, "x"), (2, "-", "l", 3, "X")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as tree", "'p' as part", "0 as idx", "'h' as hash").repartition(5)
    got = sorted((repr(r["doc_id"]), *(r[c] for c in LEAF)) for r in proved(df).collect())
    assert got == manifest(rows, tampered)


def test_merkle_proofs_can_be_folded_by_hand(spark):
    rows = [(k, "ab"[k % 3 == 0], "en", k, f"text {k}") for k in range(300)]
    for r in proved(spark.createDataFrame(rows, SCHEMA), with_proofs=True).collect():
        h = r["leaf"]
        for side in r["proof"]:
            h = sha(side["left"], h, side["right"])
        assert h == r["root"] and r["proof_sha256"] == sha(*[x for side in r["proof"] for x in side])


def test_merkle_manifest_of_little(spark):
    assert proved(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", "en", 1, "only")]
    got = proved(spark.createDataFrame(rows, SCHEMA)).first()
    assert got["root"] == got["leaf"] == got["subroot"] and got["proof_sha256"] == sha() and got["verified"] is True


def test_a_leaf_partition_asks_for_little():
    """A leaf partition within a large tree asks for less than two runs a level, however many leaves it has."""
    for low, high in ((0, 4096), (5, 4101), (123_457, 127_553)):
        asked = [(level, i) for level, a, b, first, last in merkle.edges(low, high, 10**6) for i in (*range(first, a), *range(b, last))]
        assert len(asked) == len(set(asked)) <= 30 * 5


# --- hard negatives ---


def mined(rows, anchors, low=80, high=100, k=5, scale=256):
    whole = [(i, lab, np.floor(np.array(v, float) * scale).astype(int)) for i, lab, v in rows]
    out = []
    for a in anchors:
        _, label, v = next(r for r in whole if r[0] == a)
        scored = sorted((-int(v @ w), i, lab) for i, lab, w in whole if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [(t, i) for t, i, lab in scored if lab != label and low * -s <= 100 * -t <= high * -s][:k]
            out += [(a, p, n, i, -s, -t) for n, (t, i) in enumerate(fit, 1)]
    return sorted(out)


def test_hard_negatives_with_ties_and_gaps(spark):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 3)) if i % 3 else 0, np.round(rng.normal(0.3, 1, 24), 1).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, [0.5] * 24) for i in range(40)] + [(1001, 2, rows[7][2]), (1001, 2, rows[7][2]), (50, 1, [9.0, 1.0]), (51, 1, [8.0, 1.0]), (52, 2, [7.5, 1.0])]
    odd = [(1100, 0, None), (1150, 0, [None] * 24), (1200, 0, [float("nan")] * 24), (1250, 1, [float("-inf")] * 24), (1300, None, [1.0] * 24), (None, 1, [1.0] * 24), (1350, 1, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' as rank", "1 as id", "2 as score").repartition(5)
    # vector 50 stands twice and asks with its smallest vector
    asked = min((v, lab) for i, lab, v in rows if i == 50)
    anchors = sorted({i for i, _, _ in rows if i % 50 == 0})
    ordered = sorted(rows, key=lambda r: (r[0] == 50 and (r[2], r[1]) != asked))
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") % 50 == 0, dims=5).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == mined(ordered, anchors)
    assert negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_hard_negatives_in_other_windows(spark):
    rng = np.random.default_rng(13)
    rows = [(i, i % 4, rng.normal(size=16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.mine(df, F.col("vec_id") % 20 == 0, low=30, high=95, positives=3, negatives=3, scale=1e5)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined(rows, range(0, 300, 20), 30, 95, 3, 1e5)


def test_the_scan_drops_no_candidate_of_a_window():
    rng = np.random.default_rng(17)
    cell = rng.integers(-300, 300, (32, 500)).astype(float)
    anchor = rng.integers(-300, 300, 32).astype(float)
    scores = anchor @ cell
    low, high = np.quantile(scores, [0.9, 0.95])
    seen = []

    def keep(least, most):
        seen.append(len(least))
        return (most >= low) & (least <= high)

    at, score = negatives.scan(anchor, cell, cell.min(axis=1), cell.max(axis=1), np.ones(500, bool), keep, 4)
    inside = np.flatnonzero((scores >= low) & (scores <= high))
    assert set(inside) <= set(at) and (score == scores[at]).all() and seen[-1] < seen[0]


def test_blocks_of_anchors_are_never_broadcast(spark, monkeypatch):
    """However small they look: they stand for a copy for each salt."""
    monkeypatch.setattr(negatives, "written", lambda df, name: df)
    rng = np.random.default_rng(19)
    df = spark.createDataFrame([(i, i % 3, rng.normal(0.5, 1, 8).tolist()) for i in range(200)], "vec_id long, label int, embedding array<double>")
    found = negatives.mine(df, F.col("vec_id") % 50 == 0)
    assert len(found.collect()) > 0
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_known_scores_of_one_cell_spare_work_on_the_next():
    """What a task gives for a second cell is little, as the first cell's best scores bound it; with many copies as well."""
    rng = np.random.default_rng(23)
    anchors, labels = rng.integers(-90, 90, (16, 60)), np.sort(rng.integers(0, 3, 60))
    blobs = lambda ids, labels, parts, wanted: (ids.astype(np.int64).tobytes(), narrow(labels), narrow(parts), wanted.tobytes())
    for windows in (0, 2):
        pairs, cells = [], []
        for c in range(4):
            cell, own, lab = rng.integers(-90, 90, (16, 900)), 1000 + rng.permutation(900) + 900 * c, np.sort(rng.integers(0, 3, 900))
            cell[:, 100:500] = cell[:, [0]]
            cells.append((own, lab, cell))
        scores = anchors.T @ np.concatenate([c for _, _, c in cells], axis=1)
        wanted = -np.sort(-scores, axis=1)[:, [3, 400]][:, :windows].astype(np.int64)
        for own, lab, cell in cells:
            a, c = blobs(np.arange(60), labels, anchors, wanted), blobs(own, lab, cell, wanted[:0])
            row = (16, *a, *c[:3])
            pairs.append(pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if n == 0 else pa.binary()) for n, x in enumerate(row)], names=[f"c{n}" for n in range(8)]))
        got = [b.to_pylist() for b in negatives.searcher(5, windows, 80, 100, 4)(iter(pairs))]
        assert len(got[3]) < len(got[0]) * 0.8
        ids, labs = np.concatenate([x[0] for x in cells]), np.concatenate([x[1] for x in cells])
        for j in range(60):
            for w in range(max(windows, 1)):
                fit = labs != labels[j] if windows else labs == labels[j]
                if windows:
                    fit &= (100 * scores[j] >= 80 * wanted[j, w]) & (100 * scores[j] <= 100 * wanted[j, w])
                best = sorted((-int(s), int(i)) for s, i in zip(scores[j][fit], ids[fit]))[:5]
                assert sorted((-h["score"], h["id"]) for b in got for h in b if h["anchor_id"] == j and h["window"] == w)[:5] == best
