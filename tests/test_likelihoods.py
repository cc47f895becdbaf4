import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import genealogy as G
from kindred.simulation import drop as D
from kindred.simulation import population as N
from kindred.stats import lmm

BLOCK = np.array([[1, 0, 0.5, 0.5, 0.5], [0, 1, 0.5, 0.5, 0.5], [0.5, 0.5, 1, 0.5, 0.5], [0.5, 0.5, 0.5, 1, 0.5], [0.5, 0.5, 0.5, 0.5, 1]])


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(11)
    rows, cells = [], []
    for f in range(30):
        y = rng.multivariate_normal(np.full(5, 2.0), 0.6 * BLOCK + 0.4 * np.eye(5))
        rows += [(f, i, float(y[i]), i // 2, float(rng.normal())) for i in range(5)]
        cells += [(f, i, j, float(BLOCK[i, j])) for i in range(5) for j in range(5) if BLOCK[i, j]]
    data = spark.createDataFrame(rows, "fam long, id long, y double, room int, x double")
    return lmm.MixedModel(data, "y", ("x",)).with_effect("additive", spark.createDataFrame(cells, "fam long, id1 long, id2 long, value double"))


@pytest.mark.parametrize("restricted", [False, True])
def test_information_is_the_second_derivative(model, restricted):
    blocks = model.blocks()
    at = np.array([0.5, 0.6])

    def gradient(s):
        _, beta, c, _ = lmm.loglikelihood(blocks, s, restricted)
        return lmm.derivatives(blocks, s, beta, c, restricted)[0]

    _, beta, c, _ = lmm.loglikelihood(blocks, at, restricted)
    observed = lmm.observed_information(blocks, at, beta, c, restricted)
    expected = lmm.expected_information(blocks, at, c, restricted)
    assert lmm.is_positive_definite(expected)
    for k in range(2):
        e = np.eye(2)[k] * 1e-4
        assert np.abs(-(gradient(at + e) - gradient(at - e)) / 2e-4 - observed[k]).max() < 1e-3


def test_methods_and_starts_agree(model):
    want = model.fit(method="ai", tol=1e-7)
    for method, starts in (("nr", "ols"), ("fs", "em"), ("fs", "equal")):
        got = model.fit(method=method, starts=starts, tol=1e-7)
        assert np.abs(got.components - want.components).max() < 1e-3
        assert abs(got.loglikelihood - want.loglikelihood) < 1e-5
    with pytest.raises(ValueError):
        model.fit(method="other")


def test_levels_are_shared_within_families(model):
    cells = {(r.id1, r.id2) for r in model.with_levels("room", "room").effects[1][1].filter("fam = 3").collect()}
    assert cells == {(i, j) for i in range(5) for j in range(5) if i // 2 == j // 2}


def test_linkage_by_family_fits_each_by_itself(spark, model):
    rng = np.random.default_rng(3)
    rows, cells, shared = [], [], []
    for f in range(3):
        n = 2 if f == 2 else 12
        kin = 0.5 + 0.5 * np.eye(n)
        ibd = np.kron(np.eye(n // 2), np.ones((2, 2)))
        y = rng.multivariate_normal(np.zeros(n), 0.3 * kin + 2 * ibd + 0.3 * np.eye(n))
        rows += [(f, i, float(y[i])) for i in range(n)]
        cells += [(f, i, j, float(kin[i, j])) for i in range(n) for j in range(n)]
        shared += [(f, i, j, float(ibd[i, j])) for i in range(n) for j in range(n) if ibd[i, j]]
    kind = "fam long, id1 long, id2 long, value double"
    base = lmm.MixedModel(spark.createDataFrame(rows, "fam long, id long, y double"), "y").with_effect("additive", spark.createDataFrame(cells, kind))
    ibd = spark.createDataFrame(shared, kind)
    got = {r.fam: r for r in lmm.linkage_by_family(base, ibd).collect()}
    assert got[2].lod is None and got[0].lod >= 0
    alone = lmm.MixedModel(base.data.filter("fam = 0"), "y", (), base.effects)
    _, _, ratio = lmm.linkage(alone, ibd)
    assert abs(ratio.chi2 - got[0].chi2) < 5e-3


def test_descent_constraints_hold(spark):
    rows = [(0, 0, None, None, 0), (0, 1, None, None, 1), (0, 2, 0, 1, 0), (0, 3, None, None, 1), (0, 4, 0, 1, 1), (0, 5, None, None, 0), (0, 6, 2, 3, 0), (0, 7, 5, 4, 1), (0, 8, 6, 7, 0)]
    people = spark.createDataFrame(rows, "fam long, id long, father long, mother long, sex int")
    markers = spark.range(6).select(F.lit(0).alias("chrom_idx"), F.col("id").cast("int").alias("marker_idx"), (F.col("id") * 20.0).alias("cm"))
    asked = spark.createDataFrame([(0, 8, 1, 0, 3, 1)], "fam long, id long, ancestor long, chrom_idx int, marker_idx int, chromatid int")
    dropped = D.descent_drop(people, markers, asked, 5, reps=20).cache()
    at = dropped.filter("id = 8 and marker_idx = 3 and allele = '1/1'")
    assert at.select("rep").distinct().count() == 20
    free = dropped.filter("id = 8 and marker_idx = 0 and allele = '1/1'").select("rep").distinct().count()
    assert free < 20  # other markers recombine
    from kindred.errors import SimulationError

    with pytest.raises(SimulationError):
        D.descent_pins(people, asked.withColumn("ancestor", F.lit(3)).withColumn("id", F.lit(4)))
    both = asked.unionByName(asked.withColumn("chromatid", F.lit(0)))
    with pytest.raises(SimulationError):
        D.descent_pins(people, both)
    assert D.descent_pins(people, asked.limit(0)).count() == 0


def test_population_moves_forward(spark):
    people = N.add_founders(None, spark, 40, 3)
    assert N.add_founders(people, spark, 5, 3, sex=1).agg(F.max("id")).first()[0] == 44
    with pytest.raises(ValueError):
        N.register(people, people)
    markers = spark.createDataFrame([(0, 0, 0.0, 0.5), (0, 1, 50.0, 0.5)], "chrom_idx int, marker_idx int, cm double, maf double")
    from kindred.simulation.drop import monogamous_mating

    for mating in (N.random_mating, monogamous_mating):
        last, haplotypes = N.advance(people, N.founder_haplotypes(people, markers, seed=4), markers, [30, 20], mating, 9)
        assert last.count() == 20 and haplotypes.count() == 20 * 2 * 2
    pool, size = N.pool_of(haplotypes, ["id"])
    assert size == 40 and pool.agg(F.countDistinct("hap_id")).first()[0] == 40


def test_constrained_replicates_write_their_files(spark, tmp_path):
    from kindred.plans import programs

    people = spark.createDataFrame([(0, 0, None, None, 0), (0, 1, None, None, 1), (0, 2, 0, 1, 0)], "fam long, id long, father long, mother long, sex int")
    markers = spark.createDataFrame([(0, 0, 0.0, 0.5), (0, 1, 10.0, 0.5)], "chrom_idx int, marker_idx int, cm double, maf double")
    asked = spark.createDataFrame([(0, 2, 0, 0, 1, 0)], "fam long, id long, ancestor long, chrom_idx int, marker_idx int, chromatid int")
    path = f"file://{tmp_path}/out"
    programs.constrained_replicates(people, markers, asked, 3, path, 7, with_ibd=True)
    assert spark.read.csv(path + "/genotypes", header=True).count() == 3 * 3 * 2
    ibd = spark.read.csv(path + "/ibd", header=True, inferSchema=True)
    assert ibd.count() == 3 * 2 * 6  # three pairs, and each person alone
    assert ibd.filter("id1 = 0 and id2 = 2 and shared <> 1").count() == 0


def test_alleles_are_tested_each_against_the_rest(spark, model):
    from kindred.plans import programs

    people = spark.createDataFrame([(f, i, None if i < 2 else 0, None if i < 2 else 1, i % 2) for f in range(30) for i in range(5)], "fam long, id long, father long, mother long, sex int")
    genotypes = people.select("fam", "id", F.lit(0).alias("chrom_idx"), F.lit(4).alias("marker_idx"), (1 + (F.col("fam") + F.col("id")) % 2).cast("int").alias("a0"), F.when((F.col("fam") + F.col("id")) % 7 == 0, 3).otherwise(1).alias("a1"))
    got = {r.allele: r for r in programs.association_of_alleles(model.data, people, genotypes, "y").collect()}
    assert set(got) == {2, 3} and all(r.chi2 >= 0 for r in got.values())
