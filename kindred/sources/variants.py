"""VCF, BEAGLE, GenomeSIMLA and GERMLINE files, trait files and constraint files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import FileFormatError
from ..plans.tables import apart
from .text import fields, placed, read_lines, rows


def _ids(header: DataFrame) -> list[str]:
    found = header.filter("value like '#CHROM%'").select(fields().alias("f")).head(1)
    if not found:
        raise FileFormatError("the file has no header of samples")
    return list(found[0]["f"][9:])


def info_frequency(info: Column, key: str) -> Column:
    """The first value of a frequency key of INFO, 0 if there is none."""
    return F.coalesce(F.split(F.element_at(info, key), ",")[0].try_cast("double"), F.lit(0.0))


def read_vcf_records(spark: SparkSession, path: str, require_pass: bool = False) -> DataFrame:
    """(chrom, bp, label, ref, alts, qual, pass, info, format, samples, file, line)"""
    lines = read_lines(spark, path).filter(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select("file", "line", fields().alias("f"))
    f = F.col("f")
    info = F.transform(F.split(f[7], ";"), lambda e: F.struct(F.split(e, "=")[0].alias("k"), F.coalesce(F.get(F.split(e, "=", 2), F.lit(1)), F.lit("True")).alias("v")))
    out = lines.select(
        f[0].alias("chrom"), f[1].cast("long").alias("bp"), f[2].alias("label"), f[3].alias("ref"),
        F.filter(F.split(f[4], ","), lambda a: a != ".").alias("alts"), f[5].try_cast("double").alias("qual"), (f[6] == "PASS").alias("pass"),
        F.map_from_entries(info).alias("info"), F.split(f[8], ":").alias("format"), F.slice(f, 10, F.size(f)).alias("samples"), "file", "line",
    )
    return out.filter("pass") if require_pass else out


def read_vcf(spark: SparkSession, path: str, require_pass: bool = False, frequency_key: str | None = None) -> tuple[list[str], DataFrame, DataFrame]:
    """(sample ids, markers, calls): calls that are the reference are left out, missing ones are NULL, a haploid call
    is one row. The parts of a folder are one file in order of name; a chromosome's records are numbered through wherever
    they stand."""
    ids = _ids(rows(spark, path))
    records = read_vcf_records(spark, path, require_pass)
    # chromosomes in order of their first records; they are few, and markers are numbered in two levels
    chroms = records.groupBy("chrom").agg(F.min(F.struct("file", "line")).alias("_at"))
    chroms = chroms.select("chrom", (F.row_number().over(Window.orderBy("_at")) - 1).cast("int").alias("chrom_idx"))
    found = placed(records, ["chrom"], "marker_idx").join(chroms, "chrom")
    maf = info_frequency(F.col("info"), frequency_key) if frequency_key else F.lit(None).cast("double")
    markers = found.select("chrom_idx", "chrom", "marker_idx", "label", F.lit(None).cast("double").alias("cm"), "bp", maf.alias("maf"), "ref", "alts")
    gt = F.array_position("format", "GT").cast("int")
    each = found.select("chrom_idx", "marker_idx", gt.alias("_gt"), F.posexplode("samples").alias("_s", "_v"))
    each = each.select("_s", "chrom_idx", "marker_idx", F.split(F.translate(F.get(F.split("_v", ":"), F.col("_gt") - 1), "/", "|"), "\\|").alias("_g"))
    calls = each.select("_s", "chrom_idx", "marker_idx", F.posexplode("_g").alias("hap", "_a")).select("_s", "chrom_idx", "marker_idx", F.col("hap").cast("tinyint").alias("hap"), F.col("_a").try_cast("tinyint").alias("allele"))
    # samples go by position until reference calls are gone; their names are rows of a table, not literals of the plan
    named = spark.createDataFrame(pa.table({"_s": pa.array(range(len(ids)), pa.int32()), "id": pa.array(ids, pa.string())}))
    calls = calls.filter("allele is null or allele <> 0").join(named, "_s", "left")
    return ids, markers, calls.select("id", "chrom_idx", "marker_idx", "hap", "allele")


def read_beagle_markers(spark: SparkSession, path: str) -> DataFrame:
    """(marker_idx, label, bp, ref, alts); positions must ascend strictly within a file. The files of a folder are numbered
    through in order of name."""
    raw = read_lines(spark, path).filter(F.length(F.trim("value")) > 0).select("file", "line", fields().alias("f"))
    f = F.col("f")
    out = placed(raw.select("file", "line", f[0].alias("label"), f[1].cast("long").alias("bp"), f[2].alias("ref"), F.slice(f, 4, F.size(f)).alias("alts")), [], "marker_idx")
    before = out.select("file", (F.col("marker_idx") + 1).alias("marker_idx"), F.col("bp").alias("_b"))
    if out.join(before, ["file", "marker_idx"]).filter("bp <= _b").head(1):
        raise FileFormatError("marker positions must ascend strictly")
    return out.select("marker_idx", "label", "bp", "ref", "alts")


def read_beagle(spark: SparkSession, genotypes: str, markers: str | None = None, missing: str = "0") -> tuple[DataFrame, DataFrame]:
    """(phenotypes, genotypes): two columns for each person; rows I hold ids, A affection (2: affected), C and T traits,
    M markers. Columns mean the people of their own file; files of a folder may share people (one for each chromosome, say),
    whose equal trait rows are one."""
    raw = read_lines(spark, genotypes).filter(F.length(F.trim("value")) > 0).select("file", "line", fields().alias("f"))
    f = F.col("f")
    # lines are wide and few: dealt out one by one, their columns paired before they become rows
    own = raw.repartition("file", "line").select("file", "line", f[0].alias("kind"), f[1].alias("name"), F.slice(f, 3, F.size(f)).alias("_v"))
    pairs = F.expr("transform(sequence(1, size(_v), 2), i -> struct(_v[i - 1] as a, get(_v, i) as b))")
    cells = own.filter(F.size("_v") > 0).select("file", "line", "kind", "name", F.posexplode(pairs).alias("who", "_x")).select("file", "line", "kind", "name", "who", "_x.a", "_x.b")
    people = cells.filter("kind = 'I'").select("file", "who", F.col("a").alias("id"))
    value = F.when(F.col("kind") == "A", (F.col("a") == "2").cast("double")).otherwise(F.col("a").try_cast("double"))
    traits = cells.filter("kind in ('A', 'C', 'T')").join(apart(people), ["file", "who"]).select("id", "name", value.alias("value")).distinct()
    clean = lambda c: F.when(F.col(c) != missing, F.col(c))
    out = cells.filter("kind = 'M'").join(apart(people), ["file", "who"]).select("id", F.col("name").alias("label"), clean("a").alias("a0"), clean("b").alias("a1"))
    if markers:
        out = out.join(read_beagle_markers(spark, markers).select("label", "marker_idx"), "label")
    return traits, out


def read_genomesimla(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, marker_idx, label, maf, cm, bp): a label line, a count line, then markers with cM steps. Each file of a folder is a
    chromosome of its own; files of one label are one chromosome, in order of name."""
    raw = read_lines(spark, path).select("file", "line", "value", fields().alias("f"))
    name = raw.filter("line = 0").select("file", F.trim("value").alias("chrom"))
    f = F.col("f")
    body = raw.filter("line > 1").filter(F.size("f") >= 5).join(name, "file")
    out = placed(body.select("chrom", "file", "line", f[0].alias("label"), f[2].cast("double").alias("maf"), f[3].cast("double").alias("_d"), f[4].cast("long").alias("bp")), ["chrom"], "marker_idx")
    # positions add up within slices of markers and by the slices before
    out = out.withColumn("_slice", F.floor(F.col("marker_idx") / 100_000))
    ahead = F.sum("_t").over(Window.partitionBy("chrom").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    first = out.groupBy("chrom", "_slice").agg(F.sum("_d").alias("_t")).select("chrom", "_slice", F.coalesce(ahead, F.lit(0.0)).alias("_s"))
    inner = F.sum("_d").over(Window.partitionBy("chrom", "_slice").orderBy("marker_idx").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_in", inner).join(first, ["chrom", "_slice"]).withColumn("cm", F.col("_s") + F.col("_in"))
    return out.select("chrom", "marker_idx", "label", "maf", "cm", "bp")


def read_germline(spark: SparkSession, path: str) -> DataFrame:
    """(fam1, id1, fam2, id2, chrom, bp_start, bp_stop, snp_start, snp_stop, n_snps, length, unit, mismatches, hom1, hom2);
    positions are kept for physical units only."""
    f = F.col("f")
    raw = rows(spark, path).filter(F.length(F.trim("value")) > 0).select(fields().alias("f"))
    physical = F.lower(f[11]) == "mb"
    number = F.when(F.lower(f[11]) == "cm", f[10].cast("double")).otherwise(f[10].cast("double"))
    return raw.select(
        f[0].alias("fam1"), f[1].alias("id1"), f[2].alias("fam2"), f[3].alias("id2"), f[4].alias("chrom"),
        F.when(physical, f[5].cast("long")).alias("bp_start"), F.when(physical, f[6].cast("long")).alias("bp_stop"),
        f[7].alias("snp_start"), f[8].alias("snp_stop"), f[9].cast("int").alias("n_snps"), number.alias("length"), f[11].alias("unit"),
        f[12].cast("int").alias("mismatches"), f[13].cast("int").alias("hom1"), f[14].cast("int").alias("hom2"),
    )


def germline_lines(segments: DataFrame, markers: DataFrame) -> DataFrame:
    """(value): GERMLINE lines with marker labels and size in Mb."""
    m = markers.select("chrom", F.col("bp").alias("_bp"), F.col("label").alias("_l"))
    out = segments.join(apart(m.withColumnsRenamed({"_bp": "bp_start", "_l": "_l1"})), ["chrom", "bp_start"], "left").join(apart(m.withColumnsRenamed({"_bp": "bp_stop", "_l": "_l2"})), ["chrom", "bp_stop"], "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    size = F.format_string("%.6f", (F.col("bp_stop") - F.col("bp_start")) / 1e6)
    n = (F.col("stop_idx") - F.col("start_idx")).cast("string")
    cells = [text("fam1"), text("id1"), text("fam2"), text("id2"), text("chrom"), text("bp_start"), text("bp_stop"), text("_l1"), text("_l2"), n, size, F.lit("MB"), F.lit("0"), F.lit("0"), F.lit("0")]
    return out.orderBy("fam1", "id1", "fam2", "id2", "chrom", "bp_start").select(F.concat_ws("\t", *cells).alias("value"))


def read_effects(spark: SparkSession, path: str) -> DataFrame:
    """(name, chrom_idx, marker_idx, a, k): trait effects; a line has trait, type, chromosome, marker, a and k."""
    f = F.col("f")
    raw = rows(spark, path).filter(F.length(F.trim("value")) > 0).select(fields().alias("f")).filter(F.size("f") == 6)
    return raw.select(f[0].alias("name"), f[2].cast("int").alias("chrom_idx"), f[3].cast("int").alias("marker_idx"), f[4].cast("double").alias("a"), f[5].cast("double").alias("k"))


def read_trait(spark: SparkSession, path: str) -> tuple[str, str, DataFrame]:
    """(name, type, effects): the first line holds type and name, the others an effect each; raises on lines of other
    lengths (epistatic effects)."""
    f = F.col("f")
    raw = read_lines(spark, path).filter(F.length(F.trim("value")) > 0).select("line", fields().alias("f"))
    head = raw.orderBy("line").first()
    if head is None or len(head["f"]) != 2:
        raise FileFormatError("a trait file starts with type and name")
    body = raw.filter(F.col("line") > head["line"])
    if body.filter(F.size("f") != 6).head(1):
        raise FileFormatError("an effect line has six fields; epistatic effects are not read")
    return head["f"][1], head["f"][0], body.select(f[0].cast("int").alias("chrom_idx"), f[1].cast("int").alias("marker_idx"), f[4].cast("double").alias("a"), f[5].cast("double").alias("k"))


def read_constraints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(genotype constraints, descent constraints); lines that start with # are comments."""
    f = F.col("f")
    raw = rows(spark, path).filter((F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("#")).select(fields().alias("f"))
    geno = raw.filter(F.lower(f[0]) == "genotype").select(f[1].alias("fam"), f[2].alias("id"), f[3].cast("int").alias("chrom_idx"), f[4].cast("int").alias("marker_idx"), f[5].cast("int").alias("allele"), f[6].alias("chromatid"), F.get("f", F.lit(7)).alias("method"))
    ibd = raw.filter(F.lower(f[0]) == "ibd").select(f[1].alias("fam"), f[2].alias("id"), f[3].alias("ancestor"), f[4].cast("int").alias("chrom_idx"), f[5].cast("int").alias("marker_idx"), f[6].alias("chromatid"))
    return geno, ibd
