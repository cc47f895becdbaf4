"""Families laid together by the covariances of those with a dose: the same sums, and rows that do not grow with the families."""

import pickle

import numpy as np
import pytest

from kindred.stats import lmm, patterns
from test_scan import sibs

KEYS = ["chrom_idx", "marker_idx"]


def test_patterns_do_not_grow_with_families(spark):
    held = []
    for families in (60, 240):
        model, doses = sibs(spark, families)
        found = patterns.gather(model, patterns.known_doses(model, doses, KEYS), KEYS)
        held.append(sum(len(r["rows"]) for r in found.collect()))
        counted = found.groupBy("marker_idx").agg({"n": "sum"}).collect()
        assert {r[1] for r in counted if r[0] != 2} == {families}
    assert held[1] < 1.5 * held[0]  # a row for each family and marker would be four times as much


def test_rows_laid_together_have_the_same_squares():
    rng = np.random.default_rng(3)
    group, z = rng.integers(0, 7, 400) ** 2, rng.normal(size=(400, 6))
    z[:, 1] = 1.0
    got = {g: (n, r) for g, n, r in patterns.together(group, z)}
    assert set(got) == set(group.tolist())
    for g, (n, r) in got.items():
        mine = z[group == g]
        assert n == len(mine) and len(r) <= 6 and np.allclose(r.T @ r, mine.T @ mine)


@pytest.mark.parametrize("step, row, cells", [(7, 11, 40), (1 << 16, 1 << 16, 1 << 22)])
def test_association_equals_the_dense_score(spark, monkeypatch, step, row, cells):
    for name, value in (("STEP", step), ("ROW", row), ("CELLS", cells)):
        monkeypatch.setattr(patterns, name, value)
    model, doses = sibs(spark, 15)
    null = lmm.Fit(model.names(), np.array([0.7, 0.5]), np.array([0.3, -0.2]), 0.0, 0, 0, "given")
    got = {r.marker_idx: r for r in lmm.association(model, null, doses).collect()}
    told = {}
    for r in doses.dropna().collect():
        told.setdefault(r.marker_idx, {}).setdefault(r.fam, []).append((r.id, float(r.dose)))
    blocks = {r.fam: pickle.loads(r.block) for r in model.blocks().collect()}
    assert set(got) == {0, 1, 2}  # the last has one kind of dose
    for m, r in got.items():
        s, n, total = np.zeros((4, 4)), 0, 0.0
        for fam, some in told[m].items():
            y, x, mats = blocks[fam]
            who = [i for i, _ in sorted(some)]
            z = np.column_stack([x[who], [g for _, g in sorted(some)], y[who] - x[who] @ null.beta])
            v = sum(c * k for c, k in zip(null.components, mats))[np.ix_(who, who)]
            s, n, total = s + z.T @ np.linalg.inv(v) @ z, n + len(who), total + z[:, 2].sum()
        c = np.linalg.pinv(s[:2, :2])
        gg, gr = s[2, 2] - s[2, :2] @ c @ s[:2, 2], s[2, 3] - s[2, :2] @ c @ s[:2, 3]
        assert r.n == n and abs(r.frequency - total / (2 * n)) < 1e-12
        assert abs(r.beta - gr / gg) < 1e-9 and abs(r.chi2 - gr * gr / gg) < 1e-9
