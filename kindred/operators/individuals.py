"""Filters, counts, upserts and phenotype tables over individuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["fam", "id"]


def males(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sex") == 0)


def females(df: DataFrame) -> DataFrame:
    return df.filter(F.col("sex") == 1)


def is_founder() -> Column:
    return F.col("father").isNull() & F.col("mother").isNull()


def founders(df: DataFrame) -> DataFrame:
    return df.filter(is_founder())


def nonfounders(df: DataFrame) -> DataFrame:
    return df.filter(~is_founder())


def marry_in_founders(df: DataFrame, depths: DataFrame) -> DataFrame:
    """Founders with a child deeper than the first generation."""
    deep = df.join(depths.filter("depth > 1"), KEY)
    parents = deep.select("fam", F.explode(F.array("father", "mother")).alias("id")).filter("id is not null")
    return founders(df).join(parents, KEY, "left_semi")


def sex_ratio(df: DataFrame) -> DataFrame:
    """One row: males for each female; unknown sex counts as neither."""
    return df.agg((F.count_if(F.col("sex") == 0) / F.count_if(F.col("sex") == 1)).alias("sex_ratio"))


def bit_size(df: DataFrame) -> DataFrame:
    """(fam, bits): twice the non-founders less the founders."""
    return df.groupBy("fam").agg((2 * F.count_if(~is_founder()) - F.count_if(is_founder())).alias("bits"))


def connect(df: DataFrame) -> DataFrame:
    """Check that every named parent is in the family; the frame itself is the connected pedigree."""
    named = df.select("fam", F.explode(F.array("father", "mother")).alias("id")).filter("id is not null")
    lost = named.join(df.select(*KEY), KEY, "left_anti").head(1)
    if lost:
        raise KeyError(f"unknown parent {lost[0]['id']} in family {lost[0]['fam']}")
    return df


def remove_ancestry(df: DataFrame) -> DataFrame:
    return df.withColumns({"father": F.lit(None).cast(df.schema["father"].dataType), "mother": F.lit(None).cast(df.schema["mother"].dataType)})


def upsert_phenotypes(base: DataFrame, other: DataFrame) -> DataFrame:
    """(fam, id, name, value): the other's values win; individuals that are not in ``base`` are left out."""
    known = other.join(base.select(*KEY).distinct(), KEY, "left_semi").select(*KEY, "name", F.col("value").alias("_v"), F.lit(True).alias("_there"))
    merged = base.join(known, [*KEY, "name"], "full_outer")
    return merged.select(*KEY, "name", F.when(F.col("_there"), F.col("_v")).otherwise(F.col("value")).alias("value"))


def replace_genotypes(base: DataFrame, other: DataFrame, who: DataFrame) -> DataFrame:
    """Genotypes after an update: all of ``base``'s go, those of ``other`` for individuals ``who`` come."""
    return other.join(who.select(*KEY), KEY, "left_semi").select(*base.columns)


def delete_phenotype(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("name") != name)


def has_phenotype(df: DataFrame, name: str) -> DataFrame:
    """Individuals with a value of the trait."""
    return df.filter((F.col("name") == name) & F.col("value").isNotNull()).select(*KEY).distinct()


def phenotype_names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct()


def phenotype_table(df: DataFrame, names: list[str], only_phenotyped: bool = True) -> DataFrame:
    """Wide table, a column for each trait; rows without any value go by default."""
    wide = df.groupBy(*KEY).pivot("name", names).agg(F.first("value"))
    return wide.dropna(how="all", subset=names) if only_phenotyped else wide


def complete_cases(wide: DataFrame, outcome: str, fixed: list[str]) -> DataFrame:
    return wide.dropna(subset=[outcome, *fixed])


def incidence(df: DataFrame, variable: str) -> DataFrame:
    """(fam, id, level): sparse one-hot matrix, levels numbered from 0 in sorted order."""
    levels = df.select(variable).filter(F.col(variable).isNotNull()).distinct()
    from pyspark.sql import Window

    # levels of a factor are few: one small task ranks them
    ranked = levels.select(variable, (F.row_number().over(Window.orderBy(variable)) - 1).cast("long").alias("level"))
    return df.join(F.broadcast(ranked) if levels.limit(10_001).count() <= 10_000 else ranked, variable).select(*KEY, "level")
