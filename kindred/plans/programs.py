"""Whole programs as compositions of operators: each takes DataFrames and gives a DataFrame or a fit."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import genealogy as G
from ..operators import genotype as T
from ..operators import individuals as P
from ..simulation import drop as D
from ..simulation.trait import Trait
from ..stats import lmm, scan
from .tables import cut


def bit_sizes(people: DataFrame) -> DataFrame:
    return P.bit_size(people).orderBy("fam")


def kinships(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(related pairs, inbreeding)"""
    paths = cut(G.descent(people))
    return G.kinship(people, paths), G.inbreeding(people, paths)


def frequencies(genotypes: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """(locus, allele, n, frequency, major): alleles of each marker from the most frequent on."""
    chosen = genotypes if markers is None else genotypes.join(markers.select(*T.LOCUS), T.LOCUS, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*T.LOCUS).orderBy(F.desc("n"), "allele"))
    return T.allele_frequency(chosen).withColumn("major", rank == 1)


def sharing_null(people: DataFrame, markers: DataFrame, affected: DataFrame, reps: int, seed: int | str = 1, drop_marry_ins: bool = True) -> DataFrame:
    """One row: least, mean, sd and greatest sharing among affected pairs over replicates of a labelled gene drop; for
    the total of shared alleles and for the share of pairs that share any."""
    if drop_marry_ins:
        affected = affected.join(P.marry_in_founders(people, G.depth(people)), ["fam", "id"], "left_anti")
    dropped = D.gene_drop(people, markers, D.founder_labels(P.founders(people), ["fam", "id"], markers), seed, reps)
    per = D.ibd_sharing(dropped, affected).groupBy("rep").agg(F.sum("shared").alias("spairs"), F.avg((F.col("shared") > 0).cast("double")).alias("sbool"))
    stats = [f(c).alias(f"{c}_{n}") for c in ("spairs", "sbool") for n, f in (("min", F.min), ("mean", F.avg), ("sd", F.stddev_pop), ("max", F.max))]
    return per.agg(*stats)


def polygenic(data: DataFrame, people: DataFrame, outcome: str, fixed: tuple[str, ...] = (), dominance: bool = False, restricted: bool = False) -> lmm.Fit:
    """Variance components of a trait."""
    model = lmm.MixedModel(data, outcome, fixed).with_effect("additive", cut(G.additive(people)))
    if dominance:
        model = model.with_effect("dominance", cut(G.dominance(people)))
    return model.fit(restricted)


def measured_genotypes(data: DataFrame, people: DataFrame, genotypes: DataFrame, outcome: str, fixed: tuple[str, ...] = (), minor: int = 2, chrom_idx: int | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Association of each marker, in order of chi-squared; a region may be named."""
    here = genotypes
    if chrom_idx is not None:
        here = here.filter(F.col("chrom_idx") == chrom_idx)
    if start is not None and stop is not None:
        here = here.filter(F.col("marker_idx").between(start, stop))
    model = lmm.MixedModel(data, outcome, fixed).with_effect("additive", cut(G.additive(people)))
    dose = (F.col("a0") == minor).cast("int") + (F.col("a1") == minor).cast("int")
    return lmm.association(model, model.fit(), here.select("fam", "id", *T.LOCUS, dose.alias("dose"))).orderBy(F.desc("chi2"))


def pedigree_replicates(people: DataFrame, markers: DataFrame, trait: Trait, reps: int, seed: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """(genotypes, phenotypes) of replicates, keyed by rep."""
    founders = D.equilibrium_haplotypes(P.founders(people), ["fam", "id"], markers, f"{seed}/f")
    genotypes = cut(D.genotypes_of(D.gene_drop(people, markers, founders, seed, reps), ["rep", "fam", "id"]))
    tagged = genotypes.withColumn("fam", F.concat_ws(":", F.col("rep").cast("string"), F.col("fam").cast("string")))
    return genotypes, trait.predict(tagged, f"{seed}/e")


def write_replicates(people: DataFrame, markers: DataFrame, dropped: DataFrame, founders: DataFrame, path: str, with_ibd: bool = False, compression: str | None = None) -> None:
    """Replicates of a labelled drop as files: genotypes by founder alleles (and states of pairs by descent), a folder
    rep=N for each replicate, all replicates in one job. ``founders``: (fam, id, hap, locus, allele)."""
    options = {"compression": compression} if compression else {}
    real = D.delabel(D.spans(dropped, ["rep", "fam", "id"]), founders.select("id", "hap", *T.LOCUS, "allele"), ["rep", "fam", "id"])
    D.genotypes_of(real, ["rep", "fam", "id"]).write.partitionBy("rep").options(**options).csv(path + "/genotypes", header=True)
    G.edges(people).write.options(**options).csv(path + "/pedigree", header=True)
    markers.write.options(**options).csv(path + "/map", header=True)
    if with_ibd:
        D.ibd_states(dropped, people).write.partitionBy("rep").options(**options).csv(path + "/ibd", header=True)


def constrained_replicates(people: DataFrame, markers: DataFrame, constraints: DataFrame, reps: int, path: str, seed: int | str = 1, with_ibd: bool = False) -> DataFrame:
    """Replicates in which all descent constraints hold, written to ``path``; gives the labelled haplotypes."""
    dropped = cut(D.descent_drop(people, markers, constraints, seed, reps))
    founders = cut(D.equilibrium_haplotypes(P.founders(people), ["fam", "id"], markers, f"{seed}/f"))
    write_replicates(people, markers, dropped, founders, path, with_ibd)
    return dropped


def association_of_alleles(data: DataFrame, people: DataFrame, genotypes: DataFrame, outcome: str, fixed: tuple[str, ...] = (), method: str = "ai") -> DataFrame:
    """(locus, allele, n, frequency, beta, chi2, lod): each allele of a marker but its most frequent one tested against
    all others, in order of chi-squared."""
    model = lmm.MixedModel(data, outcome, fixed).with_effect("additive", cut(G.additive(people)))
    rare = frequencies(genotypes).filter("not major").select(*T.LOCUS, "allele")
    codes = rare.withColumn("_k", F.dense_rank().over(Window.partitionBy(*T.LOCUS).orderBy("allele")).cast("int"))
    named = genotypes.filter("a0 is not null and a1 is not null").join(codes, T.LOCUS)
    dose = (F.col("a0") == F.col("allele")).cast("int") + (F.col("a1") == F.col("allele")).cast("int")
    most = codes.agg(F.max("_k")).first()[0] or 0  # alleles of one marker
    null = model.fit(method=method)
    tests = None
    for k in range(1, most + 1):
        one = lmm.association(model, null, named.filter(F.col("_k") == k).select("fam", "id", *T.LOCUS, dose.alias("dose"))).withColumn("_k", F.lit(k))
        tests = one if tests is None else tests.unionByName(one)
    if tests is None:
        raise ValueError("no marker has two alleles")
    return tests.join(codes, [*T.LOCUS, "_k"]).drop("_k").orderBy(F.desc("chi2"))


def refit_association(model: lmm.MixedModel, genotypes: DataFrame, markers: DataFrame, regions: list[tuple[int, int, int]] | None = None, only: list[str] | None = None, method: str = "ai") -> DataFrame:
    """(locus, bp, label, major, allele, n, frequency, beta, se, chi2, lod, pvalue, ...): each allele of a marker but its
    most frequent one, by likelihood ratio with components fitted again, in order of chi-squared. ``regions``: (chromosome,
    first bp, last bp); ``only``: labels of markers."""
    here = markers.select(*T.LOCUS, "bp", "label")
    if regions is not None:
        inside = [(F.col("chrom_idx") == c) & F.col("bp").between(a, b) for c, a, b in regions]
        here = here.filter(reduce(lambda p, q: p | q, inside, F.lit(False)))
    if only is not None:
        here = here.filter(F.col("label").isin(only))
    near = genotypes.join(here.select(*T.LOCUS), T.LOCUS, "left_semi")
    found = cut(frequencies(near))
    codes = found.filter("not major").select(*T.LOCUS, "allele").join(found.filter("major").select(*T.LOCUS, F.col("allele").alias("major")), T.LOCUS)
    named = near.filter("a0 is not null and a1 is not null").join(codes, T.LOCUS)
    dose = (F.col("a0") == F.col("allele")).cast("int") + (F.col("a1") == F.col("allele")).cast("int")
    tests = scan.association_refit(model, model.fit(method=method), named.select("fam", "id", *T.LOCUS, "allele", dose.alias("dose")), (*T.LOCUS, "allele"))
    return tests.join(codes, [*T.LOCUS, "allele"]).join(here, T.LOCUS).orderBy(F.desc("chi2"), *T.LOCUS, "allele")


def grow_pool(markers: DataFrame, size: int, growth: Callable[[int], int], generations: int, seed: int | str = 1) -> tuple[DataFrame, int]:
    return D.pool_evolve(D.pool_start(markers.sparkSession, markers, size, seed), markers, size, growth, generations, seed)


def founder_sharing_constraints(people: DataFrame, affected: DataFrame, ancestor: str, chrom_idx: int, marker_idx: int, chromatid: str = "P") -> DataFrame:
    """(value): constraint lines that make every affected person carry one founder's allele by descent."""
    rows = people.join(affected.select("fam", "id"), ["fam", "id"], "left_semi")
    return rows.select(F.concat_ws(" ", F.lit("ibd"), "fam", "id", F.lit(ancestor), F.lit(str(chrom_idx)), F.lit(str(marker_idx)), F.lit(chromatid)).alias("value"))


def segment_accuracy(predicted: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """One row: share of places whose predicted state is the true one (absent states are 0)."""
    both = truth.withColumnRenamed("state", "_t").join(predicted.withColumnRenamed("state", "_p"), keys, "left")
    return both.agg(F.avg((F.col("_t") == F.coalesce("_p", F.lit(0))).cast("double")).alias("accuracy"))
