"""Clusters, blocks and keys beyond the limits of a task: same links as brute force, whatever the limits."""

import random

import numpy as np
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm import rtree_join  # noqa: E402
from kindred.llm.components import components  # noqa: E402

SMALL = rtree_join.Limits(hot=3, block_sets=4, chunk_sets=3, fine_bytes=1500, shingles=900)


def brute(texts, k, num):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if a and sets[j] and 100 * len(a & sets[j]) >= num * len(a | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    return label, sets


def corpus():
    """Near copies of short and long texts, one large group, a passage in many texts, and exact copies."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for n, copies, edits in ((40, 30, 0.04), (900, 7, 0.03), (1500, 5, 0.02), (300, 6, 0.08)):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for c in range(copies):
            copy = list(base)
            for _ in range(int(rng.random() * edits * n)):
                copy[rng.randrange(n)] = f"e{rng.randrange(5000)}"
            texts.append(" ".join(copy + [f"end{c % 3}"]))
    for _ in range(12):
        texts.append(" ".join(passage + [f"s{rng.randrange(5000)}" for _ in range(rng.randrange(10, 120))]))
    return texts + texts[:3] + [None, "", "one", "One", "two words"]


@pytest.mark.parametrize(("k", "num"), [(5, 80), (3, 90)])
def test_small_limits_lose_no_link(spark, k, num):
    texts = corpus()
    label, sets = brute(texts, k, num)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in rtree_join.classes(df, k, num, 100, limits=SMALL).collect()}
    assert got == {i: (label[i], len(sets[i])) for i in range(len(texts))}


def test_one_of_each_group_stays_and_columns_survive(spark):
    """Names that clash with the operator's own, nulls in any column, repeats."""
    texts = corpus()[:40] + ["a b c d e f g", None]
    rows = [(k, t, None if k % 2 else "x", k, "own", -1.5, "dot") for k, t in enumerate(texts)] + [(0, texts[0], None, 0, "own", -1.5, "dot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, _id long, _text_key string, row double, `a.b` string")
    label, sets = brute(texts, 5, 80)
    kept = rtree_join.keep_one(df, limits=SMALL).collect()
    assert sorted(r.doc_id for r in kept) == sorted({label[i] for i in range(len(texts))})
    assert {(r["_text_key"], r["row"], r["a.b"]) for r in kept} == {("own", -1.5, "dot")} and all(r["_id"] == r.doc_id for r in kept)
    assert rtree_join.keep_one(df.limit(0)).count() == 0


def test_a_point_bounds_the_overlap_at_every_fineness():
    rng = np.random.default_rng(3)
    for n in (5, 600, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 1 << 63, n).astype(np.uint64)])
        for g in (128, 256, 512):
            p, q = (rtree_join.fine_point(x)[None] for x in (a, b))
            if min(p.shape[1], q.shape[1]) >= g:
                assert np.minimum(rtree_join.fold(p, g), rtree_join.fold(q, g)).sum() >= rtree_join.overlap(a, b)


def test_components_of_hubs_chains_and_loops(spark):
    edges = [(0, k) for k in range(1, 50)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (200, 200), (300, 299), (None, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(50)} | {k: 100 for k in range(100, 141)} | {200: 200, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
