"""Marker scan with refitted components, against a fit of each marker by itself."""

import numpy as np
from pyspark.sql import functions as F

from kindred.plans import programs
from kindred.stats import lmm, scan

KIND = "fam long, id1 long, id2 long, value double"


def sibs(spark, families=24):
    rng = np.random.default_rng(5)
    rows, cells, doses = [], [], []
    for f in range(families):
        n = 3 + f % 3
        kin = 0.5 + 0.5 * np.eye(n)
        g = rng.integers(0, 3, (4, n))
        y = rng.multivariate_normal(0.8 * g[1], 0.7 * kin + 0.5 * np.eye(n))
        rows += [(f, i, float(y[i]), float(rng.normal())) for i in range(n)]
        cells += [(f, i, j, float(kin[i, j])) for i in range(n) for j in range(n)]
        for m in range(4):
            doses += [(f, i, 0, m, None if m == 2 and (f + i) % 4 == 0 else 1 if m == 3 else int(g[m, i])) for i in range(n)]
    data = spark.createDataFrame(rows, "fam long, id long, y double, x double")
    model = lmm.MixedModel(data, "y", ("x",)).with_effect("additive", spark.createDataFrame(cells, KIND))
    return model, spark.createDataFrame(doses, "fam long, id long, chrom_idx int, marker_idx int, dose int")


def test_each_marker_equals_its_own_fit(spark):
    model, doses = sibs(spark)
    null = model.fit(tol=1e-7)
    got = {r.marker_idx: r for r in scan.association_refit(model, null, doses, tol=1e-7).collect()}
    assert set(got) == {0, 1, 2}  # the last has one kind of dose
    for m, r in got.items():
        own = model.data.join(doses.filter(F.col("marker_idx") == m).dropna().select("fam", "id", F.col("dose").cast("double")), ["fam", "id"])
        alone = lmm.MixedModel(own, "y", ("x",), model.effects)
        with_dose = alone.with_fixed("dose").fit(tol=1e-7)
        want = lmm.likelihood_ratio(alone.fit(tol=1e-7), with_dose)
        assert r.converged and r.n == with_dose.n
        assert abs(r.chi2 - want.chi2) < 1e-4 and abs(r.pvalue - lmm.chi2_sf(want.chi2, 1)) < 1e-4
        assert abs(r.beta - with_dose.beta[-1]) < 1e-3 and np.abs(np.array(r.components) - with_dose.components).max() < 2e-3
    assert got[1].pvalue < 1e-4 and got[2].n < null.n


def test_defined_results(spark):
    model, doses = sibs(spark, 9)
    null = model.fit()
    assert scan.association_refit(model, null, doses.limit(0)).count() == 0
    same = doses.filter("marker_idx = 0").join(model.data.select("fam", "id", (F.col("fam") % 2).alias("half")), ["fam", "id"])
    halves = lmm.MixedModel(model.data.withColumn("half", (F.col("fam") % 2).cast("double")), "y", ("half",), model.effects)
    told = same.select("fam", "id", "chrom_idx", "marker_idx", F.col("half").alias("dose"))
    assert scan.association_refit(halves, halves.fit(), told).count() == 0  # a fixed effect explains the dose
    short = scan.refit(model, np.array([5.0, 0.01]), doses.filter("marker_idx < 2"), ("chrom_idx", "marker_idx"), most=1).collect()
    assert len(short) == 2 and not any(r.converged for r in short)
    strangers = doses.withColumn("id", F.col("id") + 100)
    assert scan.association_refit(model, null, doses.unionByName(strangers)).count() == 3


def test_minor_alleles_and_regions(spark):
    model, _ = sibs(spark, 12)
    people = model.data.select("fam", "id", F.lit(None).cast("long").alias("father"), F.lit(None).cast("long").alias("mother"), F.lit(0).alias("sex"))
    genotypes = people.select("fam", "id", F.lit(0).alias("chrom_idx"), F.explode(F.array(F.lit(1), F.lit(2))).alias("marker_idx"))
    genotypes = genotypes.select("*", (1 + (F.col("fam") + F.col("id") + F.col("marker_idx")) % 2).cast("int").alias("a0"), F.when((F.col("fam") + F.col("id")) % 5 == 0, 3).otherwise(1).alias("a1"))
    markers = spark.createDataFrame([(0, 1, 100, "rs1"), (0, 2, 900, "rs2")], "chrom_idx int, marker_idx int, bp long, label string")
    families = lmm.MixedModel(model.data, "y").with_effect("family", model.effects[0][1])
    run = lambda **k: programs.refit_association(families, genotypes, markers, **k).collect()
    got = run()
    assert {(r.label, r.major, r.allele) for r in got} == {(f"rs{m}", 1, a) for m in (1, 2) for a in (2, 3)}
    assert [r.chi2 for r in got] == sorted((r.chi2 for r in got), reverse=True)
    assert {r.label for r in run(regions=[(0, 50, 100)])} == {"rs1"} and {r.label for r in run(only=["rs2"])} == {"rs2"}
