"""Segments far from the only point of a chromosome, and the states of a single locus."""

from kindred.operators import intervals as I
from kindred.operators import sgs


def test_a_single_point_far_from_the_ends(spark):
    segments = [(0, -(10**12), 10**12), (0, 5, 25_000), (0, 101, 10**15), (0, 100, 100), (1, 0, 10**9)]
    got = I.points_inside(spark.createDataFrame([(0, 100)], "c int, pos long"), spark.createDataFrame(segments, "c int, start long, stop long"), ["c"])
    assert sorted((r.start, r.stop) for r in got.collect()) == [(-(10**12), 10**12), (5, 25_000), (100, 100)]


def test_matrix_of_one_locus_over_long_segments(spark):
    segments = spark.createDataFrame([(0, 1, 1, 75, 1900), (0, 1, 1, 100, 125), (1, 2, 1, 200, 10**10)], "id1 long, id2 long, chrom int, start long, stop long")
    got = sgs.ibd_matrix(spark.createDataFrame([(0,)], "id long"), segments, 1, 100)
    assert sorted(map(tuple, got.collect())) == [(0, 0, 1.0), (0, 1, 1.0)]
