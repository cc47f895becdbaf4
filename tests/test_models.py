import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import genealogy as G
from kindred.simulation import drop as D
from kindred.simulation import trait as Q
from kindred.stats import lmm


@pytest.fixture(scope="module")
def family(spark):
    rows = []
    for f in range(25):
        rows += [(f, 0, None, None, 0), (f, 1, None, None, 1), (f, 2, 0, 1, 0), (f, 3, 0, 1, 1), (f, 4, 0, 1, 0)]
    return spark.createDataFrame(rows, "fam long, id long, father long, mother long, sex int")


def dense(data, matrix):
    """Outcomes and relationship matrix of each family, families and members in order."""
    n = 5
    a, y = np.zeros((25, n, n)), np.zeros((25, n))
    for r in matrix:
        a[r.fam, r.id1, r.id2] = r.value
    for r in data:
        y[r.fam, r.id] = r.y
    return y, a


def log_likelihood(y, a, sigma, restricted):
    """Intercept-only likelihood, written out (small matrices only: large ones would start BLAS threads)."""
    logdet = xwx = xwy = ywy = 0.0
    for yf, af in zip(y, a):
        v = sigma[0] * af + sigma[1] * np.eye(len(yf))
        w = np.linalg.inv(v)
        logdet += np.linalg.slogdet(v)[1]
        xwx += w.sum()
        xwy += (w @ yf).sum()
        ywy += yf @ w @ yf
    rss = ywy - xwy**2 / xwx
    if restricted:
        return -0.5 * (logdet + np.log(xwx) + rss + (y.size - 1) * np.log(2 * np.pi))
    return -0.5 * (y.size * np.log(2 * np.pi) + logdet + rss)


@pytest.mark.parametrize("restricted", [False, True])
def test_fit_is_the_maximum_of_the_dense_likelihood(spark, family, restricted):
    a = G.cut(G.additive(family))
    rng = np.random.default_rng(5)
    block = np.array([[1, 0, 0.5, 0.5, 0.5], [0, 1, 0.5, 0.5, 0.5], [0.5, 0.5, 1, 0.5, 0.5], [0.5, 0.5, 0.5, 1, 0.5], [0.5, 0.5, 0.5, 0.5, 1]])
    y = [rng.multivariate_normal(np.full(5, 3.0), 0.6 * block + 0.4 * np.eye(5)) for _ in range(25)]
    data = spark.createDataFrame([(f, i, float(y[f][i])) for f in range(25) for i in range(5)], "fam long, id long, y double")
    model = lmm.MixedModel(data, "y").with_effect("additive", a)
    fit = model.fit(restricted)
    dy, da = dense(data.collect(), a.collect())
    best = log_likelihood(dy, da, fit.components, restricted)
    assert abs(best - fit.loglikelihood) < 1e-8
    for k in range(2):
        for step in (-0.02, 0.02):
            moved = fit.components.copy()
            moved[k] = max(1e-6, moved[k] + step)
            assert log_likelihood(dy, da, moved, restricted) <= best + 1e-4
    blocks = model.blocks()
    value, beta, c, _ = lmm.loglikelihood(blocks, fit.components * 1.1, restricted)
    gradient = lmm.derivatives(blocks, fit.components * 1.1, beta, c, restricted)[0]
    for k in range(2):
        e = np.zeros(2)
        e[k] = 1e-5
        numeric = (log_likelihood(dy, da, fit.components * 1.1 + e, restricted) - log_likelihood(dy, da, fit.components * 1.1 - e, restricted)) / 2e-5
        assert abs(numeric - gradient[k]) < 1e-3
    if not restricted:
        u = {(r.fam, r.id): r.blup for r in lmm.blup(model, fit).collect()}
        v = fit.components[0] * da[3] + fit.components[1] * np.eye(5)
        exact = fit.components[0] * da[3] @ np.linalg.solve(v, dy[3] - fit.beta[0])
        assert abs(u[(3, 2)] - exact[2]) < 1e-8
        assert 0 <= fit.heritability <= 1 and "residual" in fit.summary()


def test_chi_squared_tail():
    assert abs(lmm.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(lmm.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(lmm.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9
    assert lmm.chi2_sf(0, 3) == 1


def test_gene_drop_follows_descent(spark, family):
    markers = spark.range(5).select(F.lit(0).alias("chrom_idx"), F.col("id").cast("int").alias("marker_idx"), (F.col("id") * 20.0).alias("cm"), F.lit(0.5).alias("maf"))
    founders = D.founder_labels(D.founders_of(family), ["fam", "id"], markers)
    dropped = D.gene_drop(family, markers, founders, 3, reps=2).cache()
    assert dropped.count() == 2 * 25 * 5 * 2 * 5
    assert dropped.filter("id > 1 and hap = 0 and not allele like '0/%'").count() == 0
    again = D.gene_drop(family, markers, founders, 3, reps=2)
    assert dropped.exceptAll(again).count() == 0
    back = D.delabel(D.spans(dropped, ["rep", "fam", "id"]).filter("rep = 0 and fam = 0"), founders.filter("fam = 0"), ["fam", "id"])
    assert back.select("fam", "id", "hap", "chrom_idx", "marker_idx", "allele").exceptAll(dropped.filter("rep = 0 and fam = 0").select("fam", "id", "hap", "chrom_idx", "marker_idx", "allele")).count() == 0
    share = D.ibd_sharing(dropped, family.filter("id > 1")).agg(F.avg("shared")).first()[0]
    assert 0.8 < share < 1.2  # sibs share one allele on average


def test_rejection_and_errors(spark, family):
    from kindred.errors import SimulationError

    markers = spark.createDataFrame([(0, 0, 0.0, 0.5)], "chrom_idx int, marker_idx int, cm double, maf double")
    founders = D.equilibrium_haplotypes(D.founders_of(family).filter("fam = 0"), ["fam", "id"], markers, 2)
    with pytest.raises(SimulationError):
        D.constrained_drop(family.filter("fam = 0"), markers, founders, lambda h: h.filter(F.lit(False)), reps=1, attempts=2)
    with pytest.raises(ValueError):
        D.equilibrium_haplotypes(family, ["fam", "id"], markers.withColumn("maf", F.lit(-1.0)), 1)


def test_trait_moments(spark):
    markers = spark.createDataFrame([(0, 0, 0.3)], "chrom_idx int, marker_idx int, maf double")
    effects = spark.createDataFrame([(0, 0, 1.0, 0.0)], "chrom_idx int, marker_idx int, a double, k double")
    trait = Q.Trait(effects, markers, mean=0.0, h2=0.5)
    assert abs(trait.totals()[0] - 0.6) < 1e-12 and abs(trait.total_variance() - 2 * 0.42) < 1e-12
    assert abs(trait.rescaled(0, 2).total_variance() - 4) < 1e-9
    genotypes = spark.range(4000).select(F.lit("f").alias("fam"), "id", F.lit(0).alias("chrom_idx"), F.lit(0).alias("marker_idx"), F.when(F.col("id") % 10 < 3, 2).otherwise(1).alias("a0"), F.when(F.floor(F.col("id") / 10) % 10 < 3, 2).otherwise(1).alias("a1"))
    row = trait.predict(genotypes, 1).agg(F.avg("value").alias("m"), F.var_pop("value").alias("v")).first()
    assert abs(row.m) < 0.1 and abs(row.v - 0.84) < 0.1
    with pytest.raises(ValueError):
        trait.with_threshold(1.0)
