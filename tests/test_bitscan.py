"""Segments from bit sets against a scan of each pair's states, marker by marker."""

import random
from itertools import combinations

import numpy as np
import pytest

from kindred.operators import bitscan, sgs


def states(a, b):
    if None in a or None in b:
        return 64
    return 2 if sorted(a) == sorted(b) else int(bool(set(a) & set(b)))


def by_pair(people, bp, seed, length, density, missing):
    """people: {id: {marker: (a0, a1)}} of one chromosome."""
    out = []
    for p, q in combinations(sorted(people), 2):
        at = sorted(set(people[p]) & set(people[q]))
        state = {m: states(people[p][m], people[q][m]) for m in at}
        level = {}
        for least in (1, 2):
            runs, now = [], []
            for m in [*at, None]:
                if m is not None and state[m] >= least:
                    now.append(m)
                    continue
                if now and now[-1] - now[0] >= seed:
                    runs.append([now[0], now[-1]])
                now = []
            joined = []
            for a, z in runs:
                if joined and a - joined[-1][1] <= 2:
                    joined[-1][1] = z
                else:
                    joined.append([a, z])
            for a, z in joined:
                size = (bp[z] - bp[a]) / 1e6
                lost = sum(state[m] == 64 for m in at if a <= m < z)
                if size >= length and z - a >= density * size and lost <= missing * (z - a):
                    for m in range(a, z + 1):
                        level[m] = max(level.get(m, 0), least)
        for ibd in (1, 2):
            now = []
            for m in range(max(level, default=0) + 2):
                if level.get(m, 0) >= ibd:
                    now.append(m)
                    continue
                if len(now) > 1:
                    out.append((p, q, ibd, now[0], now[-1]))
                now = []
    return sorted(out)


def made(rng, n, markers, alleles, typed, lost):
    base = [{m: (rng.choice(alleles), rng.choice(alleles)) for m in range(markers)} for _ in range(3)]
    people = {}
    for i in range(n):
        kind, own = rng.choice(base), {}
        for m in range(markers):
            if rng.random() > typed:
                continue
            g = kind[m] if rng.random() < 0.97 else (rng.choice(alleles), rng.choice(alleles))
            own[m] = (None, g[1]) if rng.random() < lost else g
        people[f"p{i:03d}"] = own
    return people


@pytest.mark.parametrize(("markers", "seed", "alleles", "typed", "tile"), [
    (70, 4, ["A", "C"], 0.9, 256), (150, 6, ["A", "C", "G", "T", "X"], 0.6, 5), (900, 130, ["1", "2"], 0.995, 7), (700, 127, ["1"], 1.0, 3),
])
def test_segments_of_all_pairs(spark, markers, seed, alleles, typed, tile):
    rng = random.Random(markers)
    people = made(rng, 18, markers, alleles, typed, 0.02)
    bp = [1000 * m + rng.randrange(900) for m in range(markers)]
    rows = [(f"f{i % 3}", p, 4, m, *g) for i, (p, own) in enumerate(people.items()) for m, g in own.items()]
    g = spark.createDataFrame(rows, "fam string, id string, chrom_idx int, marker_idx int, a0 string, a1 string")
    place = spark.createDataFrame([(4, m, b) for m, b in enumerate(bp)], "chrom_idx int, marker_idx int, bp long")
    limits = dict(seed_size=seed, min_length=seed / 1500, min_density=900.0, max_missing=0.03, tile=tile)
    want = by_pair(people, bp, seed, seed / 1500, 900, 0.03)
    got = sorted((r.id1, r.id2, r.ibd, r.start, r.stop) for r in sgs.detect(g, place, **limits).collect())
    assert got == want and want
    fam = {p: i % 3 for i, p in enumerate(people)}
    inside = sorted((r.id1, r.id2, r.ibd, r.start, r.stop) for r in sgs.detect(g, place, within="fam", **limits).collect())
    assert inside == [w for w in want if fam[w[0]] == fam[w[1]]]
    assert sgs.detect(g.limit(0), place, **limits).count() == 0


def test_both_ways_to_find_runs_agree():
    rng = np.random.default_rng(3)
    for density in (0.0, 0.002, 0.01):
        fail, typed = (np.packbits(rng.random((20, 1280)) < p, axis=1, bitorder="little").view(np.uint64) for p in (density, 0.9))
        fail &= typed
        row, start, stop = bitscan.runs_between(fail, typed, 100)  # bit by bit
        long = stop - start >= 140
        assert [x.tolist() for x in bitscan.runs_between(fail, typed, 140)] == [x[long].tolist() for x in (row, start, stop)]


def test_too_many_alleles_raise(spark):
    g = spark.range(1100).selectExpr("id", "0 as chrom_idx", "0 as marker_idx", "id as a0", "id as a1")
    with pytest.raises(ValueError):
        bitscan.sharing(g, 3)


def test_points_in_segments_of_every_length(spark):
    from kindred.operators.intervals import covering, points_inside

    rng = random.Random(6)
    segs = []
    for _ in range(300):
        a = rng.randrange(-50, 3000) if rng.random() < 0.8 else rng.randrange(10**11)
        segs.append((rng.randrange(2), a, a + rng.choice([0, 1, 63, 64, 65, 511, 512, 4096, 10**6, 10**11])))
    points = [(c, p) for c in (0, 1, 2) for p in sorted({rng.choice(segs)[rng.choice([1, 2])] + rng.choice([-1, 0, 1]) for _ in range(60)})]
    got = covering(spark.createDataFrame(points, "c int, pos long"), spark.createDataFrame(segs, "c int, start long, stop long"), ["c"])
    want = sorted((c, p, a, z) for c, p in points for d, a, z in segs if c == d and a <= p <= z)
    assert sorted((r.c, r.pos, r.start, r.stop) for r in got.collect()) == want and want
    inside = points_inside(spark.createDataFrame(points, "c int, pos long"), spark.createDataFrame(segs, "c int, start long, stop long"), ["c"])
    assert sorted((r.c, r.pos, r.start, r.stop) for r in inside.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
