"""Drops in spans, drops with several pins of a gamete, and drops until a trait fits."""

import math

import pytest
from pyspark.sql import functions as F

from kindred.errors import SimulationError
from kindred.simulation import drop as D
from kindred.simulation import spans as S
from kindred.simulation.trait import Trait

COUSINS = [(0, 0, None, None, 0), (0, 1, None, None, 1), (0, 2, 0, 1, 0), (0, 3, None, None, 1), (0, 4, 0, 1, 1), (0, 5, None, None, 0), (0, 6, 2, 3, 0), (0, 7, 5, 4, 1), (0, 8, 6, 7, 0)]


@pytest.fixture(scope="module")
def cousins(spark):
    return spark.createDataFrame(COUSINS, "fam long, id long, father long, mother long, sex int").cache()


def line(spark, n, step):
    return spark.range(n).select(F.lit(0).alias("chrom_idx"), F.col("id").cast("int").alias("marker_idx"), (F.col("id") * step).alias("cm"))


def test_spans_tile_every_chromosome(spark, cousins):
    markers = line(spark, 5000, 0.05)
    spans = S.drop_spans(cousins, markers, 3, reps=40).cache()
    rows = {}
    for r in spans.collect():
        rows.setdefault((r.rep, r.id, r.hap), []).append((r.start, r.stop, r.anc))
    assert len(rows) == 40 * 9 * 2
    for (_, who, hap), own in rows.items():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] == math.inf and all(a[1] == b[0] and a[2] != b[2] for a, b in zip(own, own[1:], strict=False))
        if who == 2:
            assert {x[2].split("/")[0] for x in own} == {str(hap)}
    # one crossover in 100 cM of each gamete on average: children of founders show all of theirs
    counts = [len(own) - 1 for (_, who, _), own in rows.items() if who in (2, 4)]
    assert 2.1 < sum(counts) / len(counts) < 2.9
    placed = S.at_markers(spans, markers)
    assert placed.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] == 40 * 9 * 2 * 5000
    founders = D.founder_labels(D.founders_of(cousins), ["fam", "id"], markers)
    filled = D.delabel(placed.filter("rep = 0"), founders, ["fam", "id"])
    back = D.spans(filled, ["fam", "id"])
    want = placed.filter("rep = 0").select("fam", "id", "hap", "chrom_idx", "anc", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
    assert back.count() == want.count() and back.select(*want.columns).exceptAll(want).count() == 0


def test_ends_meet_uneven_markers(spark):
    cms = [0.0, 0.0, 0.5, 7.0, 7.0, 7.0, 7.1, 40.0] + [50 + k / 100 for k in range(50)]
    markers = spark.createDataFrame([(2, k, c) for k, c in enumerate(cms)], "chrom_idx int, marker_idx int, cm double")
    ends = [0.0, 0.2, 0.5, 0.50001, 6.9, 7.0, 7.05, 39.0, 41.0, 50.2, 50.49, 90.0]
    spans = spark.createDataFrame([(2, "x", a, z) for a in ends for z in [*ends, math.inf] if a < z], "chrom_idx int, anc string, start double, stop double")
    place = lambda x: sum(c < x for c in cms)
    want = sorted((place(a), place(z)) for a in ends for z in [*ends, math.inf] if a < z and place(a) < place(z))
    assert sorted((r.start, r.stop) for r in S.at_markers(spans, markers).collect()) == want


def test_spans_of_founders_only(spark):
    people = spark.createDataFrame([(0, 1, None, None, 0)], "fam long, id long, father long, mother long, sex int")
    assert sorted(tuple(r) for r in S.drop_spans(people, line(spark, 2, 10.0), 1).collect()) == [(0, 0, 1, h, 0, f"1/{h}", 0.0, math.inf) for h in (0, 1)]


def test_several_pins_draw_as_rejection_does(spark):
    """A gamete pinned at markers 1, 3 and 4 of six, uneven map: every strand pattern as often as among free ones that fit."""
    cms = [0.0, 12.0, 40.0, 55.0, 90.0, 97.0]
    markers = spark.createDataFrame([(0, k, c) for k, c in enumerate(cms)], "chrom_idx int, marker_idx int, cm double")
    people = spark.createDataFrame([(0, 0, None, None, 0), (0, 1, None, None, 1), (0, 2, 0, 1, 0)], "fam long, id long, father long, mother long, sex int")
    asked = spark.createDataFrame([(0, 2, 0, 0, m, s) for m, s in ((1, 1), (3, 0), (4, 0))], "fam long, id long, ancestor long, chrom_idx int, marker_idx int, chromatid int")
    n = 6000

    def patterns(dropped):
        own = dropped.filter("id = 2 and hap = 0").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("marker_idx", "allele"))).alias("m"))
        own = own.select(F.concat_ws("", F.transform("m", lambda x: F.substring(x["allele"], 3, 1))).alias("p"))
        return {r.p: r["count"] for r in own.groupBy("p").count().collect()}

    got = patterns(D.descent_drop(people, markers, asked, 5, reps=n))
    assert sum(got.values()) == n and all(p[1] == "1" and p[3] == p[4] == "0" for p in got)
    q = [(1 - math.exp(-(b - a) / 50)) / 2 for a, b in zip(cms, cms[1:], strict=False)]
    chance = {}
    for k in range(64):
        p = f"{k:06b}"
        if p[1] == "1" and p[3] == p[4] == "0":
            chance[p] = math.prod(x if a != b else 1 - x for a, b, x in zip(p, p[1:], q, strict=False))
    total = sum(chance.values())
    chi2 = sum((got.get(p, 0) - n * c / total) ** 2 / (n * c / total) for p, c in chance.items())
    assert len(chance) == 8 and chi2 < 24.3  # 7 degrees of freedom, 0.1 %
    at_one_place = markers.withColumn("cm", F.lit(1.0))
    with pytest.raises(SimulationError):
        D.descent_drop(people, at_one_place, asked, 5).count()


def test_drop_until_the_trait_fits(spark, cousins):
    two = cousins.unionByName(cousins.withColumn("fam", F.lit(1).cast("long")))
    markers = spark.createDataFrame([(0, 0, 0.0, 0.5)], "chrom_idx int, marker_idx int, cm double, maf double")
    effects = spark.createDataFrame([(0, 0, 1.0, 0.0)], "chrom_idx int, marker_idx int, a double, k double")
    trait = Trait(effects, markers, dichotomous=True).with_threshold(2.0)  # two copies
    founders = D.equilibrium_haplotypes(D.founders_of(two), ["fam", "id"], markers, 8).withColumn("allele", F.when((F.col("id") == 0) & (F.col("hap") == 0), 2).otherwise(1))
    affected = two.select("fam", "id", F.when(F.col("id") == 8, 1).when(F.col("id") == 3, None).otherwise(0).alias("affected"))
    got = D.drop_until_trait(two, markers, founders, trait, affected, 4, reps=3, accuracy=1.0, first=200).cache()
    assert got.groupBy("rep", "fam", "id").count().count() == 3 * 2 * 9
    # only a child with the allele from both sides is affected: a free drop shows that once in 64 tries
    copies = {(r.rep, r.fam, r.id): (r.a0 == 2) + (r.a1 == 2) for r in D.genotypes_of(got, ["rep", "fam", "id"]).collect()}
    assert {copies[r, f, 8] for r in range(3) for f in (0, 1)} == {2} and max(v for k, v in copies.items() if k[2] != 8) == 1
    never = founders.withColumn("allele", F.lit(1))
    with pytest.raises(SimulationError):
        D.drop_until_trait(two, markers, never, trait, affected, 4, attempts=6)
    with pytest.raises(SimulationError):
        D.drop_until_trait(two, markers, founders, trait, affected.filter("fam = 0"), 4)


def test_first_accepted_try_is_that_of_a_brute_force(spark, cousins):
    markers = line(spark, 2, 30.0)
    founders = D.founder_labels(D.founders_of(cousins), ["fam", "id"], markers)
    fits = lambda h: h.filter("id = 8 and hap = 0 and marker_idx = 1 and allele = '0/1'")
    got = D.constrained_drop(cousins, markers, founders, fits, 6, reps=4, attempts=64, first=8)
    every = D.gene_drop(cousins, markers, founders, 6, 4 * 64).cache()
    first = {}
    for r in sorted(r.rep for r in fits(every).select("rep").distinct().collect()):
        first.setdefault(r // 64, r)
    assert len(first) == 4
    pick = spark.createDataFrame(list(first.items()), "r int, rep int")
    want = every.join(pick, "rep").withColumn("rep", F.col("r")).drop("r")
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()
