"""strangers do not become candidates by groups that hold nothing, nor by common lines where a set may leave them out."""

import random
from collections import Counter

import numpy as np
import pytest

from kindred.llm import rtree_join as R


def keys_of(keys, s):
    found = keys.of(s)
    return found[0] if isinstance(found, tuple) else found


@pytest.mark.parametrize("n", [60, 300, 900])
def test_strangers_share_no_empty_group(n):
    rng = np.random.default_rng(n)
    keys = R.Keys(80, 100)
    held = Counter(k for _ in range(1500) for k in set(keys_of(keys, np.unique(rng.integers(0, 2**64, n, np.uint64))).tolist()))
    pairs = sum(c * (c - 1) // 2 for c in held.values())
    assert pairs < 1500, pairs  # before: strangers with many groups of one shingle or none kept all of them


def component(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("common", "most"), [(1, 8000), (3, 4)])
def test_common_groups_lose_no_link(spark, common, most):
    rng = random.Random(common)
    lines = [" ".join(f"c{j}x{i}" for i in range(12)) for j in range(4)]
    texts = []
    for k in range(40):
        own = " ".join(f"w{k}y{i}" for i in range(rng.randrange(5, 60)))
        base = " ".join(rng.sample([*lines, own], rng.randrange(2, 6)))
        for _ in range(rng.randrange(1, 4)):
            words = base.split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    sets = [set(s.tolist()) for s in R.shingle_sets([t.encode() for t in texts], 3)]
    linked = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 70 * len(sets[i] | sets[j])]
    want = component(range(len(texts)), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.component_id for r in R.classes(df, 3, 70, 100, limits=R.Limits(block_sets=most, common=common)).collect()}
    assert got == want and len(linked) > 20
