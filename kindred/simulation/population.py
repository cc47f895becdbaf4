"""Populations that move forward by generations: people with haplotypes, children made of their parents' gametes.

People are (id, sex, father, mother), haplotypes (id, hap, locus, allele); a generation is one job whatever its size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import apart, cut, discard
from .drop import LOCUS, equilibrium_haplotypes, pool_founders, random_mating, strands
from .random import choice

Mating = Callable[[DataFrame, int, "int | str"], DataFrame]


def add_founders(people: DataFrame | None, spark, n: int, seed: int | str = 1, sex: int | None = None) -> DataFrame:
    """``people`` and ``n`` founders more, numbered on from the greatest id; sex by chance unless told."""
    first = 0
    if people is not None:
        greatest = people.agg(F.max("id")).first()[0]
        first = 0 if greatest is None else greatest + 1
    new = spark.range(first, first + n).select("id", (F.lit(sex) if sex is not None else choice(F.lit(2), f"{seed}/s", "id")).cast("int").alias("sex"), F.lit(None).cast("long").alias("father"), F.lit(None).cast("long").alias("mother"))
    return new if people is None else people.select(new.columns).unionByName(new)


def register(people: DataFrame, new: DataFrame) -> DataFrame:
    """Both tables; raises if an id is there already or comes twice."""
    out = people.unionByName(new.select(people.columns))
    if out.groupBy("id").count().filter("count > 1").head(1):
        raise ValueError("an id is in the population already")
    return out


def founder_haplotypes(people: DataFrame, markers: DataFrame, pool: DataFrame | None = None, pool_size: int = 0, seed: int | str = 1) -> DataFrame:
    """(id, hap, locus, allele) for everybody: from the pool, or in linkage equilibrium where there is none."""
    if pool is not None:
        return pool_founders(people, ["id"], pool, pool_size, seed)
    return equilibrium_haplotypes(people, ["id"], markers, seed)


def mate(children: DataFrame, haplotypes: DataFrame, markers: DataFrame, seed: int | str = 1) -> DataFrame:
    """(id, hap, locus, allele) of ``children`` (id, father, mother): a gamete of the father is hap 0, of the mother 1."""
    sides = F.array(F.struct(F.lit(0).alias("hap"), F.col("father").alias("_p")), F.struct(F.lit(1).alias("hap"), F.col("mother").alias("_p")))
    gametes = children.select("id", F.explode(sides).alias("_x")).select("id", "_x.hap", "_x._p")
    chosen = strands(gametes, ["id", "hap", "_p"], markers, f"{seed}/gamete")
    source = haplotypes.select(F.col("id").alias("_p"), F.col("hap").alias("strand"), *LOCUS, "allele")
    return chosen.join(source, ["_p", "strand", *LOCUS]).select("id", "hap", *LOCUS, "allele")


def next_generation(people: DataFrame, haplotypes: DataFrame, markers: DataFrame, size: int, mating: Mating = random_mating, seed: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """(people, haplotypes) of ``size`` children, numbered from 0; their parents are left behind."""
    children = mating(people, size, f"{seed}/mating").select(F.col("child").alias("id"), "sex", "father", "mother")
    return children, mate(children, haplotypes, markers, seed)


def advance(people: DataFrame, haplotypes: DataFrame, markers: DataFrame, sizes: list[int], mating: Mating = random_mating, seed: int | str = 1) -> tuple[DataFrame, DataFrame]:
    """As many generations as ``sizes`` has; each is written to the shared folder and the one before it removed."""
    for g, size in enumerate(sizes):
        old = people, haplotypes
        children = cut(mating(people, size, f"{seed}/{g}/mating").select(F.col("child").alias("id"), "sex", "father", "mother"))
        people, haplotypes = children, cut(mate(children, haplotypes, markers, f"{seed}/{g}"))
        if g:
            discard(*old)
    return people, haplotypes


def pool_of(haplotypes: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """(pool, size): every haplotype of a population, numbered from 0 in order of its keys."""
    order = F.struct(*keys, "hap")
    owners = haplotypes.select(order.alias("_o")).distinct()
    numbered = _number(owners)
    pool = haplotypes.withColumn("_o", order).join(numbered, "_o").select("hap_id", *LOCUS, "allele")
    return pool, owners.count()


def _number(owners: DataFrame) -> DataFrame:
    """(_o, hap_id): places in order, counted within sorted ranges and by the ranges before them."""
    ranged = cut(owners.repartitionByRange("_o").sortWithinPartitions("_o").select("_o", F.monotonically_increasing_id().alias("_m")))
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()  # a row for each partition
    starts, total = [], 0
    for r in sizes:
        starts.append((r["_part"], total))
        total += r["_n"]
    first = owners.sparkSession.createDataFrame(starts, "_part long, _s long")
    return ranged.withColumn("_part", part).join(first, "_part").select("_o", (F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).alias("hap_id"))


def mean_genotypic_value(people: DataFrame, haplotypes: DataFrame, trait, seed: int | str = 1) -> DataFrame:
    """One row: expected and observed mean and variance (population form) of a trait over the people."""
    from .drop import genotypes_of

    # only the loci of the trait become genotypes
    typed = haplotypes.join(trait.effects.select(*LOCUS).distinct(), LOCUS, "left_semi").join(apart(people.select("id")), "id", "left_semi")
    own = genotypes_of(typed, ["id"]).withColumn("fam", F.lit(""))
    expected, additive = trait.totals()
    return trait.predict(own, seed).agg(F.lit(expected).alias("expected_mean"), F.lit(additive).alias("expected_variance"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance"))
