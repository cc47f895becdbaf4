"""Relational data model: column types of every table, and missing codes made NULL at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INDIVIDUALS = "fam string, id string, father string, mother string, sex tinyint, affected tinyint"
PHENOTYPES = "fam string, id string, name string, value double, label string"
MARKERS = "chrom_idx int, chrom string, marker_idx int, label string, cm double, bp bigint, maf double, ref string, alts array<string>"
GENOTYPES = "fam string, id string, chrom_idx int, marker_idx int, a0 string, a1 string"
VARIANT_CALLS = "id string, chrom_idx int, marker_idx int, hap tinyint, allele tinyint"
SEGMENTS = "fam1 string, id1 string, fam2 string, id2 string, chrom string, start_idx bigint, stop_idx bigint, bp_start bigint, bp_stop bigint"
SPANS = "rep int, fam string, id string, chrom_idx int, hap tinyint, start bigint, stop bigint, anc_id string, anc_hap tinyint"
EFFECTS = "chrom_idx int, marker_idx int, a double, k double"
KINSHIP = "fam string, id1 string, id2 string, kinship double"

#: Value that stands for a missing state in packed identity arrays.
MISSING_STATE = 64

SEX_CODES = {"1": 0, "M": 0, "2": 1, "F": 1}
AFFECTION_CODES = {"1": 0, "2": 1, "A": 1, "U": 0}


def _lookup(code: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("tinyint")
    for k, v in table.items():
        out = F.when(code == k, F.lit(v).cast("tinyint")).otherwise(out)
    return out


def sex(code: Column) -> Column:
    """0 male, 1 female, NULL unknown."""
    return _lookup(code, SEX_CODES)


def affection(code: Column, labels: dict[str, int] | None = None) -> Column:
    """1 affected, 0 unaffected, NULL otherwise."""
    return _lookup(code, labels or AFFECTION_CODES)


def parent(code: Column) -> Column:
    """A parent's id; ``0`` is unknown."""
    return F.when(code != "0", code)


def allele(code: Column, missing: str = "0") -> Column:
    """An allele; the missing code and the empty string are NULL."""
    return F.when((code != missing) & (code != ""), code)
