"""Spelling variants, ball k-means and tree search against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import ball_kmeans, spelling, tree_search

DOCS = "doc_id long, text string, word string, n long, form string, key string"
STEMS = "garden gardens gardxn gardn wonderful wonderfull wondrful étoilée étoilées etoilée stationary stationery Übermut ÜBERMUT abcdef abcdeg abcdfe abcabcabc abcabcabcd".split()


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def slow_groups(rows, min_count=5, times=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= min_count}
    out, form = {}, {}
    for w in n:
        near = [x for x in n if edit_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= times * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def spelling_rows():
    rng = np.random.default_rng(5)
    p = 1 / np.arange(1, len(STEMS) + 1) ** 1.5
    rows = [(i, " ".join(rng.choice(STEMS, 80, p=p / p.sum()))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "... 12 é"), (None, "garden Garden GARDEN garden garden garden"), (103, "wonderful,wonderfull;" * 5000), (104, "x" * 3000), (104, "x" * 3000)]
    return rows + rows[:3] + [(i, "wonderful " * 40) for i in range(200, 420)]


@pytest.mark.parametrize("most_pairs", [0, 6, 20_000])
def test_spelling_groups(spark, most_pairs):
    rows = spelling_rows()
    docs = spark.createDataFrame([(*r, "w", 1, "f", "k") for r in rows], DOCS).repartition(5)
    found = spelling.spelling_groups(docs, most_pairs=most_pairs).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == slow_groups(rows)


def test_spelling_chain_of_forms(spark):
    words = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb", "zzzzzz"]
    counts = [3125, 625, 125, 25, 5, 7]
    docs = spark.createDataFrame([(i, f"{w} " * n) for i, (w, n) in enumerate(zip(words, counts, strict=True))], "doc_id long, text string")
    found = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_groups(docs, drop_every=None).collect()}
    assert found == {w: (words[i - 1] if 0 < i < 5 else None, words[0] if i < 5 else w) for i, w in enumerate(words)}


def test_near_words_refines_hot_segments(spark):
    rng = np.random.default_rng(2)
    words = sorted({"prefix" + "".join(rng.choice(list("abé"), rng.integers(3, 7))) for _ in range(300)} | {"a|bcde", "a|bcd", "|abcde"})
    table = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    wanted = {tuple(sorted((a, b))) for a in words for b in words if a < b and edit_one(a, b)}
    for most_pairs in (10, 10**9):
        links = spelling.near_words(table, most_pairs=most_pairs).collect()
        assert len(links) == len(wanted)
        assert {tuple(sorted((r["u"], r["v"]))) for r in links} == wanted


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c")]])
def test_spelling_of_nothing(spark, rows):
    assert spelling.spelling_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect() == []


# Ball k-means


def slow_kmeans(rows, k, rounds, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in first]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for n in range(rounds + 1):
        own = [min((d2(v, c), j) for j, c in enumerate(centers)) for _, v in kept]
        if n < rounds:
            for j in range(len(centers)):
                mine = [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]
                if mine:
                    centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = sum(d for d, _ in own)
    by = Counter()
    for d, j in own:
        by[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, by[j], total, name[j]) for (i, _), (d, j) in zip(kept, own, strict=True)), key=str)


def vectors(n=300, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, 64))
    rows = [(i, (base[i % 6] * (i % 5 + 1) / 3 + rng.normal(size=64) * 0.1 * (i % 4)).astype("float32").tolist()) for i in range(n)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(150)]  # a third of all rows
    rows += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [float("nan")] + [0.1] * 63), (2004, [float("inf")] + [0.1] * 63), (2005, [None] + [0.1] * 63), (2006, [0.0] * 64)]
    return rows + [rows[3], (None, rows[4][1]), (2020, [0.0] * 64)]


VECTORS = "vec_id long, embedding array<float>, label int, cluster string, v int, distance string"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", 2, "d") for r in rows], VECTORS).repartition(3)


@pytest.mark.parametrize(("k", "rounds"), [(40, 5), (3, 2), (1, 1)])
def test_ball_kmeans(spark, k, rounds):
    rows = vectors()
    found = ball_kmeans.ball_kmeans(vector_table(spark, rows), k=k, rounds=rounds).collect()
    assert sorted((tuple(r) for r in found), key=str) == slow_kmeans(rows, k, rounds)


def test_ball_bounds_are_exact():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, size=(500, 3))  # many ties
    centroids = np.unique(rng.integers(-3, 4, size=(12, 3)), axis=0)
    d2 = np.square(x[:, None, :] - centroids[None]).sum(axis=2)
    cluster, least = ball_kmeans.next_clusters(x, rng.integers(0, len(centroids), 500), centroids)
    assert (cluster == d2.argmin(axis=1)).all() and (least == d2.min(axis=1)).all()


def test_ball_kmeans_of_little(spark):
    assert ball_kmeans.ball_kmeans(vector_table(spark, [(1, None)])).collect() == []
    few = vectors()[:3]
    assert sorted((tuple(r) for r in ball_kmeans.ball_kmeans(vector_table(spark, few)).collect()), key=str) == slow_kmeans(few, 40, 5)
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.ball_kmeans(vector_table(spark, [(1, [1e9] * 64)])).collect()


# Tree search


def true_top(rows, k, every=20):
    kept = [(i, np.array(v)) for i, v in rows if i is not None and v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in kept:
        if i % every == 0:
            out[i] = sorted((-float(np.multiply(q, v).sum()), j) for j, v in kept if j != i)[:k]
    return out


def listed(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_all_leaves_give_the_true_neighbours(spark):
    rows = vectors()
    table = vector_table(spark, rows)
    found = tree_search.nearest_neighbours(table, table.where("vec_id % 20 = 0"), recall=1.1, leaf_rows=20, block_rows=32).collect()
    assert listed(found) == true_top(rows, 20)


def test_recall_is_reached(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 64))
    rows = [(i, (base[i % 40] + rng.normal(size=64) * 0.4).astype("float32").tolist()) for i in range(4000)]
    table = vector_table(spark, rows)
    index = tree_search.build(table, leaf_rows=60, block_rows=128)
    queries = tree_search.usable(table.where("vec_id % 20 = 0"), dims=64)[0]
    visits, share = tree_search.calibrated_visits(index, queries, 20, 0.95, 64)
    assert share >= 0.95 and visits <= index.tree.n_leaves // 3
    truth = true_top(rows, 20)
    got = listed(tree_search.nearest_neighbours(table, table.where("vec_id % 20 = 0"), leaf_rows=60, block_rows=128, calibrate=64).collect())
    assert set(got) == set(truth) and all(len(x) == 20 for x in got.values())
    assert np.mean([len(set(got[q]) & set(truth[q])) / 20 for q in truth]) >= 0.9


def test_best_bin_first_visits_every_leaf_once():
    rng = np.random.default_rng(3)
    tree = tree_search.grow(rng.normal(size=(500, 5)), 3.0, 20)
    assert sorted(tree.visits(rng.normal(size=5), tree.n_leaves)) == list(range(tree.n_leaves))
    assert tree.visits(rng.normal(size=5), 3) and tree.n_leaves > 20


def test_search_of_little(spark):
    table = vector_table(spark, [(1, None), (20, [0.0] * 64)])
    assert tree_search.nearest_neighbours(table, table).collect() == []
    table = vector_table(spark, vectors()[18:23])
    found = tree_search.nearest_neighbours(table, table.where("vec_id % 20 = 0")).collect()
    assert len(found) == 4
    assert tree_search.nearest_neighbours(table, table.where("vec_id < 0")).collect() == []
