import pytest
from pyspark.sql import functions as F

from kindred.functions import sequences as S
from kindred.operators import genotype as T
from kindred.operators import intervals as I
from kindred.operators import sgs


def levels(spark, text):
    return spark.createDataFrame([("k", i, int(c)) for i, c in enumerate(text)], "k string, i long, v int")


def test_runs_need_one_more_element_than_their_length(spark):
    found = I.runs(levels(spark, "00001111100000111"), ["k"], "i", F.col("v") >= 1, 2).collect()
    assert sorted((r.start, r.stop) for r in found) == [(4, 8), (14, 16)]
    assert I.runs(levels(spark, "0" * 10 + "1" * 11 + "0" * 79), ["k"], "i", F.col("v") >= 1, 20).count() == 0


def test_levels_to_intervals_and_back(spark):
    got = I.make_intervals(levels(spark, "011222110"), ["k"], "i", "v").collect()
    assert sorted((r.ibd, r.start, r.stop) for r in got) == [(1, 1, 7), (2, 3, 5)]
    spans = spark.createDataFrame([("k", 2, 4), ("k", 6, 10), ("k", 3, 3)], "k string, start long, stop long")
    cover = {r.i: r.value for r in I.rasterise(spans, ["k"]).collect()}
    assert cover == {2: 1, 3: 2, 4: 1, **{i: 1 for i in range(6, 11)}}


def test_join_gaps_takes_nested_intervals(spark):
    spans = spark.createDataFrame([("k", 0, 20), ("k", 3, 5), ("k", 21, 22), ("k", 30, 31)], "k string, start long, stop long")
    assert sorted((r.start, r.stop) for r in I.join_gaps(spans, ["k"], 1).collect()) == [(0, 22), (30, 31)]


def test_nearest_marker(spark):
    markers = spark.createDataFrame([(0, i - 1, i * 1_000_000) for i in range(1, 100)], "chrom_idx int, marker_idx int, bp long")
    probes = spark.createDataFrame([(0, p) for p in (0, 5_000_001, 5_999_999, 10**10, 5_500_000)], "chrom_idx int, pos long")
    got = {r.pos: r.marker_idx for r in I.nearest(probes, markers, ["chrom_idx"]).collect()}
    assert got == {0: 0, 5_000_001: 4, 5_999_999: 5, 10**10: 98, 5_500_000: 4}


def test_ibs_states(spark):
    rows = [((2, 2), (2, 2), 2), ((2, 1), (2, 2), 1), ((1, 1), (2, 2), 0), ((1, 1), (None, None), None), ((1, 2), (2, 1), 2), ((1, None), (1, 1), None)]
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b, _) in enumerate(rows)], "k int, a int, b int, c int, d int")
    got = {r.k: r.s for r in df.select("k", T.ibs(*[F.col(c) for c in "abcd"]).alias("s")).collect()}
    assert got == {i: s for i, (_, _, s) in enumerate(rows)}
    with pytest.raises(ValueError):
        T.ibs_arrays(F.lit(1), F.lit(1), F.lit(1), F.lit(1), 256)


def test_frequencies(spark):
    g = spark.createDataFrame([(0, 0, i, 1, 1) if i < 600 else (0, 0, i, 2, 1) for i in range(1000)] + [(0, 0, 2000, None, None)], "chrom_idx int, marker_idx int, id int, a0 int, a1 int")
    assert {r.allele: r.frequency for r in T.allele_frequency(g).collect()} == {1: 0.8, 2: 0.2}
    assert T.major_allele(g).first().allele == 1
    assert T.missingness(g).first().rate == 1 / 1001


def test_array_functions(spark):
    df = spark.sql("select array(1, 2, 3, 4, 5) as x, array(6, 7, 8, 9, 10) as y, map('a', 1, 'b', 1, 'c', 2) as m, cast(array() as array<int>) as e")
    got = df.select(S.grouper(F.col("x"), 2, F.lit(0)).alias("g"), S.interleave(F.col("x"), F.col("y")).alias("i"), S.invert_map(F.col("m")).alias("v"), S.product(F.col("x")).alias("p"), S.product(F.col("e")).alias("q"), S.grouper(F.col("e"), 2, F.lit(0)).alias("h")).first()
    assert got.g == [[1, 2], [3, 4], [5, 0]] and got.i == [1, 6, 2, 7, 3, 8, 4, 9, 5, 10] and got.v == {1: "b", 2: "c"} and got.p == 120 and got.q == 1 and got.h == []
    with pytest.raises(Exception, match="lengths"):
        df.select(S.interleave(F.col("x"), F.slice("y", 1, 2))).collect()


def test_sparse_arrays(spark):
    df = spark.sql("select array(0, 0, 5, 0, 7) as x").select(S.sparse_from_dense(F.col("x"), F.lit(0)).alias("m"))
    got = df.select(S.sparse_get(F.col("m"), F.lit(2), F.lit(0)).alias("a"), S.sparse_get(F.col("m"), F.lit(1), F.lit(0)).alias("b"), S.sparse_slice(F.col("m"), 1, 4).alias("s"), S.sparse_clear(F.col("m"), 2, 4).alias("c"), S.sparse_set(F.col("m"), F.lit(2), F.lit(0), F.lit(0)).alias("r"), S.sparse_to_dense(F.col("m"), F.lit(5), F.lit(0)).alias("d")).first()
    assert (got.a, got.b, got.s, got.c, got.r, got.d) == (5, 0, {1: 5}, {4: 7}, {4: 7}, [0, 0, 5, 0, 7])


def test_segments_found_and_filtered(spark):
    genotypes = spark.createDataFrame([("f", i, 0, m, 1 if i < 2 or 10 <= m < 30 else 2, 1) for i in range(3) for m in range(40)], "fam string, id int, chrom_idx int, marker_idx int, a0 int, a1 int")
    markers = spark.createDataFrame([(0, m, m * 100_000) for m in range(40)], "chrom_idx int, marker_idx int, bp long")
    found = {(r.id1, r.id2, r.ibd): (r.start, r.stop) for r in sgs.detect(genotypes, markers, seed_size=5, min_length=1, min_density=1, within="fam").collect()}
    assert found[(0, 1, 2)] == (0, 39) and found[(0, 2, 2)] == (10, 29) and found[(0, 2, 1)] == (0, 39)
    matrix = sgs.ibd_matrix(spark.createDataFrame([(0,), (1,)], "id int"), spark.createDataFrame([(0, 1, 0, 5, 9)], "id1 int, id2 int, chrom int, start long, stop long"), 0, 7)
    assert {(r.id1, r.id2): r.value for r in matrix.collect()} == {(0, 1): 0.5, (0, 0): 1, (1, 1): 1}


def test_slices_give_what_one_window_gives(spark):
    from pyspark.sql import functions as F

    from kindred.operators import intervals as I

    rows = spark.range(3000).select((F.col("id") % 3).alias("k"), F.floor(F.col("id") / 3).alias("i"), (F.hash("id") % 5).alias("v"))
    spans = rows.select("k", F.col("i").alias("start"), (F.col("i") + F.abs("v") * 7).alias("stop")).filter("start % 11 < 4")
    same = lambda a, b: a.exceptAll(b.select(a.columns)).count() == 0 and b.count() == a.count()
    assert same(I.running(rows, ["k"], "i", F.col("v"), "s"), I.running(rows, ["k"], "i", F.col("v"), "s", 37))
    assert same(I.runs(rows, ["k"], "i", F.col("v") > -2, 1), I.runs(rows, ["k"], "i", F.col("v") > -2, 1, 37))
    assert same(I.coverage(spans, ["k"]), I.coverage(spans, ["k"], 37))
    assert I.coverage(spans.limit(0), ["k"], 37).count() == 0
