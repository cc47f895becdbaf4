"""Gene drop in spans: haplotypes as stretches of founder haplotypes along the map.

A gamete's crossovers are exponential gaps along the chromosome (one in 100 cM on average, without interference), so what
is written grows with the crossovers, not with the markers. A child's haplotype is its gamete's pieces joined to the
parent's spans where they overlap. Markers and alleles come in at the end only: :func:`at_markers` turns ends in cM into
places of markers, :func:`.drop.delabel` fills alleles in.

Spans are rows (rep, fam, id, hap, chrom_idx, anc, start, stop): half-open in cM, the last of a chromosome ends at
infinity, ``anc`` is ``id/hap`` of the founder haplotype."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.genealogy import depth, edges
from ..operators.individuals import is_founder
from ..operators.intervals import rank_bins, ranks
from ..plans.tables import cut
from .random import uniform

#: Chromosomes of a map at most.
MOST_CHROMOSOMES = 10_000
KEYS = ["rep", "fam", "id", "hap", "chrom_idx"]


def lengths(markers: DataFrame) -> list[tuple[int, float, float]]:
    """(chromosome, first cM, last cM), one for each chromosome of the map."""
    rows = markers.groupBy("chrom_idx").agg(F.min("cm").alias("a"), F.max("cm").alias("z")).limit(MOST_CHROMOSOMES + 1).collect()
    if len(rows) > MOST_CHROMOSOMES:
        raise ValueError(f"more than {MOST_CHROMOSOMES} chromosomes")
    return sorted((r["chrom_idx"], float(r["a"]), float(r["z"])) for r in rows)


def each_chromosome(df: DataFrame, chromosomes: list[tuple[int, float, float]]) -> DataFrame:
    """``df`` with (chrom_idx, first, last): a row for each chromosome."""
    chrom = F.array(*[F.struct(F.lit(c).alias("chrom_idx"), F.lit(a).alias("first"), F.lit(z).alias("last")) for c, a, z in chromosomes])
    return df.withColumn("_c", F.explode(chrom)).select(*df.columns, "_c.*")


def gamete_pieces(gametes: DataFrame, keys: list[str], chromosomes: list[tuple[int, float, float]], seed: int | str) -> DataFrame:
    """(keys, chrom_idx, strand, start, stop): the pieces of each gamete and the parental haplotype that each is taken from."""
    grid = each_chromosome(gametes.select(*keys), chromosomes)
    # far more gaps than a chromosome of this length ever takes; no more of them are drawn than it needs
    most = F.lit(60) + F.ceil((F.col("last") - F.col("first")) / 5).cast("int")
    gap = lambda k: F.lit(-100.0) * F.ln(F.lit(1.0) - uniform(f"{seed}/gap", *keys, "chrom_idx", k))
    step = lambda ends, k: F.when(F.element_at(ends, -1) > F.col("last"), ends).otherwise(F.array_append(ends, F.element_at(ends, -1) + gap(k)))
    ends = F.aggregate(F.sequence(F.lit(1), most), F.array("first"), step)
    whole = F.when(F.element_at("ends", -1) > F.col("last"), F.col("ends")).otherwise(F.raise_error(F.lit("a gamete took more crossovers than its length allows for")).cast("array<double>"))
    first = (uniform(f"{seed}/first", *keys, "chrom_idx") < 0.5).cast("int")
    drawn = grid.withColumn("ends", ends).withColumns({"ends": whole, "_s": first})
    pieces = drawn.select(*keys, "chrom_idx", "_s", "ends", F.explode(F.sequence(F.lit(1), F.size("ends") - 1)).alias("_k"))
    beyond = F.when(F.col("_k") == F.size("ends") - 1, F.lit(float("inf"))).otherwise(F.element_at("ends", F.col("_k") + 1))
    return pieces.select(*keys, "chrom_idx", ((F.col("_s") + F.col("_k") + 1) % 2).cast("int").alias("strand"), F.element_at("ends", F.col("_k")).alias("start"), beyond.alias("stop"))


def drop_spans(individuals: DataFrame, markers: DataFrame, seed: int | str = 1, reps: int = 1) -> DataFrame:
    """Founder haplotypes dropped through the pedigree, all replicates in one pass, one join for each generation."""
    chromosomes = lengths(markers)
    replicated = F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))
    two = F.explode(F.array(F.lit(0), F.lit(1)))
    founders = individuals.filter(is_founder()).select(replicated.alias("rep"), "fam", "id").withColumn("hap", two)
    label = F.concat_ws("/", F.col("id").cast("string"), F.col("hap").cast("string")).alias("anc")
    known = cut(each_chromosome(founders, chromosomes).select(*KEYS, label, F.col("first").alias("start"), F.lit(float("inf")).alias("stop")), "spans")
    levels = cut(depth(individuals), "depth")
    ways = cut(edges(individuals).join(levels, ["fam", "id"]).join(levels.select("fam", F.col("id").alias("parent"), F.col("depth").alias("above")), ["fam", "parent"]), "ways")
    # which earlier generations the parents of a generation belong to: at most a row for two generations
    steps: dict[int, set[int]] = {}
    for r in ways.select("depth", "above").distinct().collect():
        steps.setdefault(r["depth"], set()).add(r["above"])
    made = {0: known}
    for level in sorted(steps):
        gametes = ways.filter(F.col("depth") == level).select(replicated.alias("rep"), "fam", "id", F.col("via").alias("hap"), "parent")
        pieces = gamete_pieces(gametes, ["rep", "fam", "id", "hap", "parent"], chromosomes, f"{seed}/drop")
        source = None
        for above in sorted(steps[level]):
            source = made[above] if source is None else source.unionByName(made[above])
        source = source.select("rep", "fam", F.col("id").alias("parent"), "chrom_idx", F.col("hap").alias("strand"), "anc", F.col("start").alias("_a"), F.col("stop").alias("_z"))
        met = pieces.join(source, ["rep", "fam", "parent", "chrom_idx", "strand"]).filter((F.col("start") < F.col("_z")) & (F.col("_a") < F.col("stop")))
        made[level] = cut(met.select(*KEYS, "anc", F.greatest("start", "_a").alias("start"), F.least("stop", "_z").alias("stop")), "spans")
    out = made.pop(0)
    for level in sorted(made):
        out = out.unionByName(made[level])
    return merged(out)


def merged(spans: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Neighbouring spans of one founder haplotype as one (a parent may have it on both strands)."""
    own = keys or KEYS
    w = Window.partitionBy(*own).orderBy("start")
    new = F.when(F.lag("anc").over(w).eqNullSafe(F.col("anc")), 0).otherwise(1)
    marked = spans.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w))
    return marked.groupBy(*own, "_g").agg(F.first("anc").alias("anc"), F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_g")


def at_markers(spans: DataFrame, markers: DataFrame) -> DataFrame:
    """``spans`` with ``start`` and ``stop`` as places of markers in map order (half-open); spans without a marker are left out.

    An end meets the markers of one small bin of its chromosome, so no row is made for a span and a marker."""
    own = [c for c in spans.columns if c not in ("start", "stop")]
    bins = cut(rank_bins(markers.withColumn("cm", F.col("cm").cast("double")), ["chrom_idx"], "cm"), "bins")
    placed = ranks(spans, bins, ["chrom_idx"], {"_from": ("start", False), "_to": ("stop", False)})
    return placed.filter("_from < _to").select(*own, F.col("_from").alias("start"), F.col("_to").alias("stop"))
