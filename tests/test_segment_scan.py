"""the segment scan reads its genotypes once. F13: a pair is settled where it is found, and far-reaching pairs are found early."""

import random

import numpy as np
import pytest
from test_bitscan import by_pair, made

from kindred import catalog as C
from kindred.operators import bitscan, sgs


def test_genotypes_are_worked_out_once(spark):
    """What is left to run starts from the table of planes, not from orders and their lines again."""
    for name in ("sgs_segments", "sgs_population"):
        text = C.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "words" in text and "l_orderkey" not in text


def test_found_pairs_are_not_moved_again(spark):
    text = C.QUERIES["sgs_population"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in text and "Window" not in text


@pytest.mark.parametrize("least", [0, 1, 5, 30, 62, 63, 64, 200])
def test_runs_of_one_word(least):
    rng = np.random.default_rng(least)
    for density in (0.0, 0.02, 0.3):
        fail, typed = (np.packbits(rng.random((400, 64)) < p, axis=1, bitorder="little").view(np.uint64) for p in (density, 0.7))
        fail &= typed
        zero = np.zeros_like(fail)
        wide = bitscan.runs_between(np.hstack([fail, zero]), np.hstack([typed, zero]), least) if least < 120 else ([], [], [])
        assert [x.tolist() for x in bitscan.runs_between(fail, typed, least)] == [list(x) for x in wide]


@pytest.mark.parametrize("width", [1, 3])
@pytest.mark.parametrize("most", [1, 7, 50, 10_000])
def test_blocks_hold_every_pair_once(width, most):
    rng = np.random.default_rng(most)
    typed = np.packbits(rng.random((40, 64 * width)) < 0.03, axis=1, bitorder="little").view(np.uint64)
    groups, own = np.repeat([0, 1, 2, 3], [25, 1, 4, 10]), rng.random(40) < 0.4
    spot = [[m for m in range(64 * width) if int(typed[i, m // 64]) >> m % 64 & 1] for i in range(40)]
    both = lambda i, j: sorted({*spot[i]} & {*spot[j]})
    fits = lambda i, j: (b := both(i, j)) and (width > 1 or b[-1] - b[0] >= 20)
    for sides, meet in ((None, lambda i, j: groups[i] == groups[j]), (own, lambda i, j: own[i] != own[j])):
        got = [x for i, j in bitscan.blocks_of(groups, sides, most) for x in zip(*(c.tolist() for c in bitscan.common(typed, i, j, sides is None, 20)), strict=True)]
        assert sorted(got) == [(i, j) for i in range(40) for j in range(i + 1, 40) if meet(i, j) and fits(i, j)]


@pytest.mark.parametrize("missing", [0.02, 0.15])
def test_tracts_of_two_where_those_of_one_fail(spark, missing):
    rng = random.Random(5)
    people = made(rng, 16, 60, ["A", "C", "G"], 0.9, 0.06)
    bp = [1000 * m + rng.randrange(900) for m in range(60)]
    g = spark.createDataFrame([(p, 4, m, *x) for p, own in people.items() for m, x in own.items()], "id string, chrom_idx int, marker_idx int, a0 string, a1 string")
    place = spark.createDataFrame([(4, m, b) for m, b in enumerate(bp)], "chrom_idx int, marker_idx int, bp long")
    found = sgs.detect(g, place, seed_size=3, min_length=0.002, min_density=900.0, max_missing=missing)
    want = by_pair(people, bp, 3, 0.002, 900, missing)
    alone = {w[:2] + w[3:] for w in want if w[2] == 1} & {w[:2] + w[3:] for w in want if w[2] == 2}
    assert sorted((r.id1, r.id2, r.ibd, r.start, r.stop) for r in found.collect()) == want and alone


def test_rows_are_moved_as_often_however_many_the_people(spark):
    """with tiles of one size, 900,000 people were moved 220 times."""
    for n in (3000, 40_000, 900_000):
        people = spark.range(n).selectExpr("id", "1 as chrom_idx", "array(named_struct('w', 0)) as words")
        assert -(-n // bitscan.tile_of(people, None, 1)) <= 8
    wide = spark.range(3000).selectExpr("id", "1 as chrom_idx", "array(named_struct('w', 9999)) as words")
    assert bitscan.tile_of(wide, None, 1) == 256  # their planes are large
