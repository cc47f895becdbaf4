"""Quantitative traits: genotypic values, variances, scaling and prediction over long genotypes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .random import normal

LOCUS = ["chrom_idx", "marker_idx"]


def value_of(copies: Column, a: Column, k: Column) -> Column:
    """0, a (1 + k) or 2 a for 0, 1 or 2 copies of allele 2."""
    return F.when(copies == 0, F.lit(0.0)).when(copies == 1, a * (1 + k)).when(copies == 2, 2 * a)


def copies() -> Column:
    return (F.col("a0") == 2).cast("int") + (F.col("a1") == 2).cast("int")


def genotypic_values(genotypes: DataFrame, effects: DataFrame) -> DataFrame:
    """(fam, id, value): sum over effect loci; missing genotypes add nothing. Effects are one row for each locus."""
    joined = genotypes.join(effects, LOCUS)
    return joined.groupBy("fam", "id").agg(F.sum(F.coalesce(value_of(copies(), F.col("a"), F.col("k")), F.lit(0.0))).alias("value"))


def locus_parameters(effects: DataFrame, markers: DataFrame) -> DataFrame:
    """(locus, expected, alpha, additive, dominance): the value expected of random mating, the average effect of a
    substitution and both variances, from minor frequency q and p = 1 - q."""
    q, a, k = F.col("maf"), F.col("a"), F.col("k")
    p = 1 - q
    alpha = a * (1 + k * (p - q))
    return effects.join(markers.select(*LOCUS, "maf"), LOCUS).select(
        *LOCUS,
        (2 * p * q * a * (1 + k) + q * q * 2 * a).alias("expected"),
        alpha.alias("alpha"),
        (2 * p * q * alpha * alpha).alias("additive"),
        F.pow(2 * p * q * a * k, 2).alias("dominance"),
    )


@dataclass(frozen=True)
class Trait:
    """``effects``: (chrom_idx, marker_idx, a, k)."""

    effects: DataFrame
    markers: DataFrame
    mean: float = 0.0
    h2: float = 1.0
    threshold: float | None = None
    dichotomous: bool = False

    def totals(self) -> tuple[float, float]:
        """(expected genotypic value, additive variance)"""
        row = locus_parameters(self.effects, self.markers).agg(F.sum("expected").alias("e"), F.sum("additive").alias("v")).first()
        return row["e"] or 0.0, row["v"] or 0.0

    def environmental_variance(self) -> float:
        v = self.totals()[1]
        return v / self.h2 - v

    def total_variance(self) -> float:
        return self.totals()[1] + self.environmental_variance()

    def intercept(self) -> float:
        return self.mean - self.totals()[0] if self.h2 < 1 else 0.0

    def with_threshold(self, threshold: float) -> Trait:
        if not self.dichotomous:
            raise ValueError("only a dichotomous trait has a threshold")
        return replace(self, threshold=threshold)

    def with_effect(self, chrom_idx: int, marker_idx: int, a: float = 0.0, k: float = 0.0) -> Trait:
        row = self.effects.sparkSession.createDataFrame([(chrom_idx, marker_idx, a, k)], self.effects.schema)
        return replace(self, effects=self.effects.unionByName(row))

    def rescaled(self, mean: float, sd: float) -> Trait:
        """Effects scaled so that total variance is sd squared at the trait's heritability."""
        scale = (self.h2 * sd * sd / self.totals()[1]) ** 0.5
        return replace(self, effects=self.effects.withColumn("a", F.col("a") * scale), mean=mean)

    def predict(self, genotypes: DataFrame, seed: int | str = 1) -> DataFrame:
        """(fam, id, value): intercept, genotypic value and, below full heritability, noise; 0 or 1 with a threshold."""
        expected, additive = self.totals()
        base = self.mean - expected if self.h2 < 1 else 0.0
        noise = (additive / self.h2 - additive) ** 0.5 if self.h2 < 1 else 0.0
        value = F.lit(base) + F.col("value") + (normal(seed, "fam", "id") * noise if noise else F.lit(0.0))
        if self.threshold is not None:
            value = (value >= self.threshold).cast("double")
        return genotypic_values(genotypes, self.effects).select("fam", "id", value.alias("value"))


def polygene(spark, n: int, mean: float = 0.0, sd: float = 1.0, frequency: float = 0.5, chrom_idx: int = 1000, seed: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """(markers, effects) of ``n`` unlinked loci with normal effects."""
    loci = spark.range(n).select((F.col("id") + chrom_idx).cast("int").alias("chrom_idx"), F.lit(0).alias("marker_idx"), F.lit(0.0).alias("cm"), F.lit(frequency).alias("maf"))
    effects = loci.select(*LOCUS, (normal(f"{seed}/poly", "chrom_idx") * sd + mean).alias("a"), F.lit(0.0).alias("k"))
    return loci, effects
