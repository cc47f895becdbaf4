"""Allele and genotype operators over long genotypes: one row for each individual and locus, missing alleles NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCUS = ["chrom_idx", "marker_idx"]


def at(genotypes: DataFrame, chrom_idx: int, marker_idx: int) -> DataFrame:
    """Genotypes at one locus (the filter reaches the scan)."""
    return genotypes.filter((F.col("chrom_idx") == chrom_idx) & (F.col("marker_idx") == marker_idx))


def is_missing() -> Column:
    return F.col("a0").isNull() & F.col("a1").isNull()


def has_allele(allele: Column) -> Column:
    """Whether the genotype has the allele; NULL where it is missing."""
    return F.when(~is_missing(), F.coalesce(F.col("a0") == allele, F.lit(False)) | F.coalesce(F.col("a1") == allele, F.lit(False)))


def allele_list(genotypes: DataFrame, constraint: Column | None = None) -> DataFrame:
    """(locus, id, hap, allele): every non-missing allele; ``constraint`` filters on the column ``allele``."""
    out = genotypes.select(*LOCUS, "id", F.posexplode(F.array("a0", "a1")).alias("hap", "allele")).filter("allele is not null")
    return out.filter(constraint) if constraint is not None else out


def distinct_alleles(genotypes: DataFrame, constraint: Column | None = None) -> DataFrame:
    return allele_list(genotypes, constraint).select(*LOCUS, "allele").distinct()


def allele_counts(genotypes: DataFrame, constraint: Column | None = None) -> DataFrame:
    """(locus, allele, n): genotypes are counted before their alleles are parted, so that rows do not double."""
    pairs = genotypes.groupBy(*LOCUS, "a0", "a1").agg(F.count("*").alias("_n"))
    each = pairs.select(*LOCUS, F.explode(F.array("a0", "a1")).alias("allele"), "_n").filter("allele is not null")
    each = each.filter(constraint) if constraint is not None else each
    return each.groupBy(*LOCUS, "allele").agg(F.sum("_n").alias("n"))


def allele_frequency(genotypes: DataFrame, constraint: Column | None = None) -> DataFrame:
    """(locus, allele, n, frequency): share among the non-missing alleles of the locus."""
    counted = allele_counts(genotypes, constraint)
    total = F.sum("n").over(Window.partitionBy(*LOCUS))
    return counted.withColumn("frequency", F.col("n") / total)


def major_allele(genotypes: DataFrame) -> DataFrame:
    """(locus, allele, n): the most frequent allele, of equals the least."""
    counted = allele_counts(genotypes)
    best = counted.groupBy(*LOCUS).agg(F.min(F.struct((-F.col("n")).alias("o"), "allele", "n")).alias("x"))
    return best.select(*LOCUS, "x.allele", "x.n")


def missingness(genotypes: DataFrame) -> DataFrame:
    """(locus, rate): share of genotypes missing, 0 if none is."""
    return genotypes.groupBy(*LOCUS).agg(F.avg(is_missing().cast("int")).alias("rate"))


def as_phenotype(individuals: DataFrame, genotypes: DataFrame, chrom_idx: int, marker_idx: int, minor: Column, label: str) -> DataFrame:
    """(fam, id, name, value): copies of the minor allele, NULL where missing or not typed."""
    here = at(genotypes, chrom_idx, marker_idx)
    copies = (F.col("a0") == minor).cast("int") + (F.col("a1") == minor).cast("int")
    dose = here.select("id", copies.cast("double").alias("value"))
    return individuals.select("fam", "id").join(dose, "id", "left").select("fam", "id", F.lit(label).alias("name"), "value")


def ibs(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Alleles that genotypes (a, b) and (c, d) share by value, 0 to 2; NULL if any of the four is missing."""
    known = a.isNotNull() & b.isNotNull() & c.isNotNull() & d.isNotNull()
    both = ((a == c) & (b == d)) | ((a == d) & (b == c))
    one = (a == c) | (a == d) | (b == c) | (b == d)
    return F.when(known, F.when(both, 2).when(one, 1).otherwise(0))


def ibs_pairs(genotypes: DataFrame, within: str | None = "fam") -> DataFrame:
    """(within, id1, id2, locus, ibs) of pairs id1 < id2 that are both typed at the locus. ``within`` is an equality
    that holds before pairs are made; None pairs everybody at a locus."""
    key = [*([within] if within else []), *LOCUS]
    x = genotypes.select(*key, F.col("id").alias("id1"), F.col("a0").alias("a"), F.col("a1").alias("b"))
    y = genotypes.select(*key, F.col("id").alias("id2"), F.col("a0").alias("c"), F.col("a1").alias("d"))
    pairs = x.join(y, key).filter("id1 < id2")
    return pairs.select(*key, "id1", "id2", ibs(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("ibs"))


def ibs_arrays(a: Column, b: Column, c: Column, d: Column, missing: int = 64) -> Column:
    """IBS of packed haplotype arrays, locus by locus; ``missing`` (0 to 255) stands for unknown."""
    if not 0 <= missing <= 255:
        raise ValueError("the missing value must be in 0 to 255")
    zipped = F.arrays_zip(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return F.transform(zipped, lambda z: F.coalesce(ibs(z["a"], z["b"], z["c"], z["d"]), F.lit(missing)))


def packed(genotypes: DataFrame) -> DataFrame:
    """(fam, id, chrom_idx, h0, h1): both haplotypes as arrays in marker order, one row for each chromosome."""
    rows = genotypes.groupBy("fam", "id", "chrom_idx").agg(F.sort_array(F.collect_list(F.struct("marker_idx", "a0", "a1"))).alias("g"))
    return rows.select("fam", "id", "chrom_idx", F.col("g.a0").alias("h0"), F.col("g.a1").alias("h1"))


def set_genotype(genotypes: DataFrame, chrom_idx: int, marker_idx: int, a0: Column, a1: Column, who: Column | None = None) -> DataFrame:
    """Overwrite the genotype at a locus, for rows where ``who`` holds."""
    here = (F.col("chrom_idx") == chrom_idx) & (F.col("marker_idx") == marker_idx) & (who if who is not None else F.lit(True))
    return genotypes.withColumns({"a0": F.when(here, a0).otherwise(F.col("a0")), "a1": F.when(here, a1).otherwise(F.col("a1"))})


def copy_span(template: DataFrame, other: DataFrame, start: int, stop: int) -> DataFrame:
    """Haplotype rows (id, hap, marker_idx, allele) with the half-open span taken from ``other``."""
    src = other.select("id", "hap", "marker_idx", F.col("allele").alias("_new"))
    inside = (F.col("marker_idx") >= start) & (F.col("marker_idx") < stop)
    return template.join(src, ["id", "hap", "marker_idx"], "left").withColumn("allele", F.when(inside, F.col("_new")).otherwise(F.col("allele"))).drop("_new")


def dense(markers: DataFrame, calls: DataFrame, who: DataFrame, reference: int = 0) -> DataFrame:
    """Dense haplotypes from sparse calls: a locus without a call is the reference, a call of NULL is missing."""
    grid = who.select("id").crossJoin(F.broadcast(markers.sparkSession.createDataFrame([(0,), (1,)], "hap int"))).join(markers.select(*LOCUS))
    seen = calls.select("id", "hap", *LOCUS, "allele", F.lit(True).alias("_called"))
    return grid.join(seen, ["id", "hap", *LOCUS], "left").withColumn("allele", F.when(F.col("_called"), F.col("allele")).otherwise(F.lit(reference))).drop("_called")
