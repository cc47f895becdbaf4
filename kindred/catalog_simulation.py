"""Queries of simulation in spans, with SQL over the same draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import views as V
from .catalog import _small_map, _u, query
from .operators import individuals as P
from .simulation import drop as D
from .simulation import spans as S

#: Two chromosomes of 0 to 50 cM; pieces of every gamete by walking from crossover to crossover, then spans by generation.
_PIECES = f"""w as (
  select fam, id, hap, parent, chrom_idx, 0 as k, 0.0::double as pos from (select fam, id, via as hap, parent, unnest([0, 1]) as chrom_idx from edges) q
  union all
  select fam, id, hap, parent, chrom_idx, k + 1, pos + -100.0::double * ln(1.0::double - {_u("9/drop/gap", "0", "fam", "id", "hap", "parent", "chrom_idx", "(k + 1)")}) from w where pos <= 50.0),
pieces as (
  select fam, id, hap, parent, chrom_idx, (case when {_u("9/drop/first", "0", "fam", "id", "hap", "parent", "chrom_idx")} < 0.5 then 1 else 0 end + k) % 2 as strand, pos as start,
         case when lead(pos) over g > 50.0 then 'inf'::double else lead(pos) over g end as stop, lead(pos) over g as after
  from w window g as (partition by fam, id, hap, parent, chrom_idx order by k))"""


def _level(level: int, where: str) -> str:
    source = f"g{level - 1}"
    return f"""g{level} as (select * from {source} union all
  select p.fam, p.id, p.hap, p.chrom_idx, s.anc, greatest(p.start, s.start) as start, least(p.stop, s.stop) as stop
  from pieces p join {source} s on s.fam = p.fam and s.id = p.parent and s.chrom_idx = p.chrom_idx and s.hap = p.strand and p.start < s.stop and s.start < p.stop
  where p.after is not null and p.id % 9 in {where})"""


V.SQL["span_drop"] = ",\n".join([
    _PIECES,
    "g0 as (select fam, id, hap, chrom_idx, cast(id as varchar) || '/' || cast(hap as varchar) as anc, 0.0::double as start, 'inf'::double as stop from (select fam, id, unnest([0, 1]) as hap from individuals where father is null and mother is null) q, (select unnest([0, 1]) as chrom_idx) c)",
    _level(1, "(2, 4)"), _level(2, "(6, 7)"), _level(3, "(8)"),
    """joined as (select fam, id, hap, chrom_idx, anc, min(start) as start, max(stop) as stop from (select *, sum(n) over (partition by fam, id, hap, chrom_idx order by start) as k from
  (select *, case when lag(anc) over (partition by fam, id, hap, chrom_idx order by start) = anc then 0 else 1 end as n from g3) q) q group by fam, id, hap, chrom_idx, anc, k)""",
    """placed as (select fam, id, hap, chrom_idx, anc, cast(least(6, ceil(start / 10)) as bigint) as start, cast(least(6, ceil(stop / 10)) as bigint) as stop from joined
  where least(6, ceil(start / 10)) < least(6, ceil(stop / 10)))""",
])


def _spans(s, d):
    return S.drop_spans(V.individuals(s, d), _small_map(s), 9)


@query("gene_drop_spans", V.sql("select fam, id, hap, chrom_idx, anc, start, stop from placed", "recursive", "individuals", "edges", "span_drop"))
def gene_drop_spans(s, d):
    return S.at_markers(_spans(s, d), _small_map(s)).drop("rep")


@query("crossovers", V.sql("select fam, id, hap, chrom_idx, cast(count(*) as bigint) as n, cast(round(coalesce(max(case when stop < 1000 then stop end), 0) * 1000) as bigint) as last from joined group by fam, id, hap, chrom_idx", "recursive", "individuals", "edges", "span_drop"))
def crossovers(s, d):
    inner = F.max(F.when(F.col("stop") < 1000, F.col("stop")))
    return _spans(s, d).groupBy("fam", "id", "hap", "chrom_idx").agg(F.count("*").alias("n"), F.round(F.coalesce(inner, F.lit(0.0)) * 1000).cast("long").alias("last"))


@query("gene_drop_alleles", V.sql(f"""select p.fam, p.id, p.hap, p.chrom_idx, cast(m as int) as marker_idx,
  case when {_u("3", "p.fam", "split_part(p.anc, '/', 1)", "split_part(p.anc, '/', 2)", "p.chrom_idx", "m")} < 0.3 then 2 else 1 end as allele
from (select *, unnest(range(start, stop)) as m from placed) p""", "recursive", "individuals", "edges", "span_drop"))
def gene_drop_alleles(s, d):
    founders = D.equilibrium_haplotypes(P.founders(V.individuals(s, d)), ["fam", "id"], _small_map(s), 3)
    filled = D.delabel(gene_drop_spans(s, d), founders, ["fam", "id"])
    return filled.withColumn("marker_idx", F.col("marker_idx").cast("int"))
