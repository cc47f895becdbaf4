"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import views as V
from .functions import sequences as S
from .operators import genealogy as G
from .operators import genotype as T
from .operators import individuals as P
from .operators import intervals as I
from .operators import sgs
from .simulation import drop as D
from .simulation import random as R
from .simulation import trait as Q
from .plans.tables import apart, shared_dir
from .sources import pedigrees, variants
from .stats import lmm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


# alleles and genotypes

ALLELES = "alleles as (select chrom_idx, marker_idx, id, a0 as allele from genotypes where a0 is not null union all select chrom_idx, marker_idx, id, a1 from genotypes where a1 is not null)"
V.SQL["alleles"] = ALLELES


@query("allele_frequency", V.sql("""select chrom_idx, marker_idx, allele, cast(count(*) as bigint) as n, round(count(*) / sum(count(*)) over (partition by chrom_idx, marker_idx), 9) as frequency
from alleles group by chrom_idx, marker_idx, allele""", "genotypes", "alleles"))
def allele_frequency(s, d):
    return T.allele_frequency(V.genotypes(s, d)).withColumn("frequency", F.round("frequency", 9))


@query("major_allele", V.sql("""select chrom_idx, marker_idx, allele, n from (select chrom_idx, marker_idx, allele, cast(count(*) as bigint) as n,
row_number() over (partition by chrom_idx, marker_idx order by count(*) desc, allele) as k from alleles group by chrom_idx, marker_idx, allele) q where k = 1""", "genotypes", "alleles"))
def major_allele(s, d):
    return T.major_allele(V.genotypes(s, d))


@query("allele_list", V.sql("select chrom_idx, marker_idx, id, allele from alleles", "genotypes", "alleles"))
def allele_list(s, d):
    return T.allele_list(V.genotypes(s, d)).drop("hap")


@query("alleles_distinct", V.sql("select distinct chrom_idx, marker_idx, allele from alleles where allele > 1", "genotypes", "alleles"))
def alleles_distinct(s, d):
    return T.distinct_alleles(V.genotypes(s, d), F.col("allele") > 1)


@query("genotype_missingness", V.sql("select chrom_idx, marker_idx, round(avg(case when a0 is null and a1 is null then 1.0 else 0.0 end), 9) as rate from genotypes group by chrom_idx, marker_idx", "genotypes"))
def genotype_missingness(s, d):
    return T.missingness(V.genotypes(s, d)).withColumn("rate", F.round("rate", 9))


@query("genotype_as_phenotype", V.sql("""select i.fam, i.id, 'dose' as name, cast(case when g.a0 is not null then (case when g.a0 = 2 then 1 else 0 end) + (case when g.a1 = 2 then 1 else 0 end) end as double) as value
from individuals i left join (select * from genotypes where chrom_idx = 1 and marker_idx = 7) g on i.id = g.id""", "individuals", "genotypes"))
def genotype_as_phenotype(s, d):
    return T.as_phenotype(V.individuals(s, d), V.genotypes(s, d), 1, 7, F.lit(2), "dose")


@query("has_allele", V.sql("select id, case when a0 is null and a1 is null then null else (a0 = 2 or a1 = 2) end as has from genotypes where chrom_idx = 2 and marker_idx = 3", "genotypes"))
def has_allele(s, d):
    return T.at(V.genotypes(s, d), 2, 3).select("id", T.has_allele(F.lit(2)).alias("has"))


IBS_SQL = """case when x.a0 is null or x.a1 is null or y.a0 is null or y.a1 is null then null
  when (x.a0 = y.a0 and x.a1 = y.a1) or (x.a0 = y.a1 and x.a1 = y.a0) then 2
  when x.a0 = y.a0 or x.a0 = y.a1 or x.a1 = y.a0 or x.a1 = y.a1 then 1 else 0 end"""


@query("ibs_pairs", V.sql(f"""select x.fam, x.chrom_idx, x.marker_idx, x.id as id1, y.id as id2, {IBS_SQL} as ibs from genotypes x join genotypes y
on x.fam = y.fam and x.chrom_idx = y.chrom_idx and x.marker_idx = y.marker_idx and x.id < y.id""", "genotypes"))
def ibs_pairs(s, d):
    return T.ibs_pairs(V.genotypes(s, d))


@query("ibs_array", """select vec_id, string_agg(cast(case when a = c and b = d2 or a = d2 and b = c then 2 when a = c or a = d2 or b = c or b = d2 then 1 else 0 end as varchar), ',' order by k) as states
from (select vec_id, k, e1[k] > 0 as a, e1[k + 1] > 0 as b, e2[k] > 0 as c, e2[k + 1] > 0 as d2 from
 (select x.vec_id, x.embedding as e1, y.embedding as e2, unnest(range(1, len(x.embedding))) as k from embeddings x join embeddings y on y.vec_id = x.vec_id + 1) q) r group by vec_id""")
def ibs_array(s, d):
    e = V.load(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v > 0).cast("int")).alias("h"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("h").alias("g")), "vec_id")
    n = F.size("h") - 1
    states = T.ibs_arrays(F.slice("h", F.lit(1), n), F.slice("h", F.lit(2), n), F.slice("g", F.lit(1), n), F.slice("g", F.lit(2), n))
    return both.select("vec_id", F.array_join(F.transform(states, lambda v: v.cast("string")), ",").alias("states"))


# counts and sequences


@query("table_count", "select event_type, cast(count(*) as bigint) as n from events group by event_type")
def table_count(s, d):
    return V.load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("mode", """select user_id, event_type from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type desc) as k from events group by user_id, event_type) q where k = 1""")
def mode(s, d):
    counted = V.load(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counted.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("event_type"))


@query("count_value", "select o_custkey, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as n from orders group by o_custkey")
def count_value(s, d):
    return V.load(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"))


@query("product", "select l_orderkey, round(product(1 - l_discount), 6) as product from lineitem group by l_orderkey")
def product(s, d):
    return V.load(s, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.coalesce(F.product(1 - F.col("l_discount")), F.lit(1.0)), 6).alias("product"))


@query("cumsum", """select l_orderkey, l_linenumber, l_partkey, l_quantity, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity rows between unbounded preceding and current row) as running from lineitem""")
def cumsum(s, d):
    rows = V.load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return I.cumsum(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], "l_quantity")


@query("is_sorted", """select l_orderkey, bool_and(ok) as is_sorted from (select l_orderkey, coalesce(l_partkey >= lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_quantity, l_partkey), true) as ok from lineitem) q group by l_orderkey""")
def is_sorted(s, d):
    return I.is_sorted(V.load(s, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_quantity", "l_partkey"], "l_partkey")


RUNS = """r as (select user_id, i, level, case when level >= 1 then 1 else 0 end as h1, case when level >= 2 then 1 else 0 end as h2 from levels),
g as (select user_id, i, h1, h2, sum(1 - h1) over (partition by user_id order by i) as g1, sum(1 - h2) over (partition by user_id order by i) as g2 from r),
t1 as (select user_id, min(i) as start, max(i) as stop from g where h1 = 1 group by user_id, g1),
t2 as (select user_id, min(i) as start, max(i) as stop from g where h2 = 1 group by user_id, g2)"""
V.SQL["runs"] = RUNS


@query("runs_gte", V.sql("select user_id, start, stop from t1 where stop - start >= 2", "levels", "runs"))
def runs_gte(s, d):
    return I.runs(V.levels(s, d), ["user_id"], "i", F.col("level") >= 1, 2)


@query("join_gaps", V.sql("""select user_id, min(start) as start, max(stop) as stop from (select user_id, start, stop, sum(o) over (partition by user_id order by start) as k from
(select user_id, start, stop, case when lag(stop) over (partition by user_id order by start) is null or start - lag(stop) over (partition by user_id order by start) > 2 then 1 else 0 end as o from t1) q) q group by user_id, k""", "levels", "runs"))
def join_gaps(s, d):
    found = I.runs(V.levels(s, d), ["user_id"], "i", F.col("level") >= 1, 0)
    return I.join_gaps(found, ["user_id"], 2)


@query("make_intervals", V.sql("select user_id, start, stop, 1 as ibd from t1 where stop - start >= 1 union all select user_id, start, stop, 2 from t2 where stop - start >= 1", "levels", "runs"))
def make_intervals(s, d):
    return I.make_intervals(V.levels(s, d), ["user_id"], "i", "level")


@query("rasterise", V.sql("select user_id, unnest(range(start, stop + 1)) as i, cast(1 as bigint) as value from t1", "levels", "runs"))
def rasterise(s, d):
    return I.rasterise(I.runs(V.levels(s, d), ["user_id"], "i", F.col("level") >= 1, 0), ["user_id"])


@query("chromwide_coverage", V.sql("""select chrom, i as start, nxt - 1 as stop, value from (select chrom, i, cast(sum(sum(d)) over (partition by chrom order by i) as bigint) as value, lead(i) over (partition by chrom order by i) as nxt
from (select chrom, start_idx as i, 1 as d from segments union all select chrom, stop_idx + 1, -1 from segments) q group by chrom, i) r where value > 0""", "segments"))
def chromwide_coverage(s, d):
    return sgs.chromosome_coverage(V.segments(s, d).withColumnsRenamed({"start_idx": "start", "stop_idx": "stop"}))


def _spans(s, d):
    return V.segments(s, d).withColumnsRenamed({"start_idx": "start", "stop_idx": "stop"})


@query("range_join_ibd_state", V.sql("""select id1, id2, l.chrom, l.pos, cast(count(*) as bigint) as state from (select distinct cast(p_partkey % 5 as int) as chrom, p_partkey as pos from part) l
join segments on segments.chrom = l.chrom and l.pos between start_idx and stop_idx group by id1, id2, l.chrom, l.pos""", "segments"))
def range_join_ibd_state(s, d):
    loci = V.load(s, d, "part").select((F.col("p_partkey") % 5).cast("int").alias("chrom"), F.col("p_partkey").alias("pos"))
    return sgs.ibd_state(loci, _spans(s, d), ["chrom"])


@query("ibd_matrix", V.sql("""select id1, id2, count(*) / 2.0 as value from segments where chrom = 1 and 100 between start_idx and stop_idx group by id1, id2
union all select c_custkey, c_custkey, 1.0 from customer""", "segments"))
def ibd_matrix(s, d):
    return sgs.ibd_matrix(V.individuals(s, d), _spans(s, d), 1, 100)


@query("closest_marker", """with probe as (select event_id, cast(floor(value * 1000) as bigint) % 300000 as pos from events where value is not null and value >= 0),
m as (select p_partkey * 1000 as bp, p_partkey as i from part),
l as (select event_id, pos, (select max(bp) from m) as top from probe)
select event_id, pos, cast(case when pos >= top then top / 1000 when pos % 1000 > 500 then floor(pos / 1000) + 1 else floor(pos / 1000) end as bigint) as marker_idx from l""")
def closest_marker(s, d):
    probes = V.load(s, d, "events").filter("value is not null and value >= 0").select("event_id", (F.floor(F.col("value") * 1000).cast("long") % 300000).alias("pos"), F.lit(0).alias("chrom_idx"))
    return I.nearest(probes, V.markers(s, d), ["chrom_idx"]).select("event_id", "pos", "marker_idx")


def _sgs(pairs: str, seed: int, length: float, density: float, missing: float) -> str:
    """Runs of sharing as gaps and islands over the states of pairs, by level, joined, filtered and laid together."""
    return V.sql(f"""
select id1, id2, chrom_idx, ibd, cast(min(start) as bigint) as start, cast(max(stop) as bigint) as stop
from (select *, sum(o) over (partition by id1, id2, chrom_idx, ibd order by start, stop) as k
      from (select *, case when start - max(stop) over (partition by id1, id2, chrom_idx, ibd order by start, stop rows between unbounded preceding and 1 preceding) <= 1 then 0 else 1 end as o
            from (select id1, id2, chrom_idx, unnest(case when least = 2 then [1, 2] else [1] end) as ibd, start, stop from kept) q) q) q
group by id1, id2, chrom_idx, ibd, k having max(stop) - min(start) >= 1""", "genotypes").replace("\nselect id1", f""",
st as (select x.id as id1, y.id as id2, x.chrom_idx, x.marker_idx as i, case when x.a0 is null or x.a1 is null or y.a0 is null or y.a1 is null then 64
  when x.a0 = y.a0 and x.a1 = y.a1 or x.a0 = y.a1 and x.a1 = y.a0 then 2 when x.a0 = y.a0 or x.a0 = y.a1 or x.a1 = y.a0 or x.a1 = y.a1 then 1 else 0 end as state
  from genotypes x join genotypes y on {pairs} and x.chrom_idx = y.chrom_idx and x.marker_idx = y.marker_idx and x.id < y.id),
lv as (select *, unnest([1, 2]) as least from st),
isl as (select *, sum(case when state >= least then 0 else 1 end) over (partition by id1, id2, chrom_idx, least order by i) as g from lv),
rn as (select id1, id2, chrom_idx, least, min(i) as start, max(i) as stop from isl where state >= least group by id1, id2, chrom_idx, least, g having max(i) - min(i) >= {seed}),
op as (select *, case when start - lag(stop) over (partition by id1, id2, chrom_idx, least order by start) <= 2 then 0 else 1 end as o from rn),
tr as (select id1, id2, chrom_idx, least, min(start) as start, max(stop) as stop from (select *, sum(o) over (partition by id1, id2, chrom_idx, least order by start) as k from op) q group by id1, id2, chrom_idx, least, k),
kept as (select tr.id1, tr.id2, tr.chrom_idx, least, start, stop from tr left join st on st.id1 = tr.id1 and st.id2 = tr.id2 and st.chrom_idx = tr.chrom_idx and st.i >= start and st.i < stop and st.state = 64
  where (stop - start) / 10.0 >= {length} and (stop - start) >= {density} * ((stop - start) / 10.0)
  group by tr.id1, tr.id2, tr.chrom_idx, least, start, stop having count(st.i) <= {missing} * (stop - start))
select id1""", 1)


def _loci(s):
    """Places of the loci of every chromosome, 0.1 Mb apart."""
    return s.range(V.LOCI).crossJoin(s.range(1, 8).withColumnRenamed("id", "c")).select(F.col("c").cast("int").alias("chrom_idx"), F.col("id").cast("int").alias("marker_idx"), (F.col("id") * 100_000).alias("bp"))


@query("sgs_segments", _sgs("x.fam = y.fam", 3, 0.2, 1.0, 0.5))
def sgs_segments(s, d):
    return sgs.detect(V.genotypes(s, d), _loci(s), seed_size=3, min_length=0.2, min_density=1.0, max_missing=0.5, within="fam")


@query("sgs_population", _sgs("true", 30, 3.0, 1.0, 0.02))
def sgs_population(s, d):
    return sgs.detect(V.genotypes(s, d), _loci(s), seed_size=30, min_length=3.0, min_density=1.0, max_missing=0.02)


@query("autozygosity", V.sql("""select id, chrom_idx, min(marker_idx) as start, max(marker_idx) as stop from (select *, sum(case when e then 0 else 1 end) over (partition by id, chrom_idx order by marker_idx) as k
from (select id, chrom_idx, marker_idx, (a0 is not distinct from a1) as e from genotypes) q) q where e group by id, chrom_idx, k having max(marker_idx) - min(marker_idx) >= 2""", "genotypes"))
def autozygosity(s, d):
    return sgs.autozygous(V.genotypes(s, d), 2)


# individuals


def _people(name: str, f, where: str) -> None:
    query(name, V.sql(f"select fam, id, father, mother, sex from individuals where {where}", "individuals"))(lambda s, d: f(V.individuals(s, d)))


_people("males", P.males, "sex = 0")
_people("females", P.females, "sex = 1")
_people("founders", P.founders, "father is null and mother is null")
_people("nonfounders", P.nonfounders, "father is not null or mother is not null")


@query("sex_ratio", V.sql("select round(sum(case when sex = 0 then 1 else 0 end) / sum(case when sex = 1 then 1 else 0 end), 9) as sex_ratio from individuals", "individuals"))
def sex_ratio(s, d):
    return P.sex_ratio(V.individuals(s, d)).withColumn("sex_ratio", F.round("sex_ratio", 9))


@query("bit_size", V.sql("select fam, cast(sum(case when father is null and mother is null then -1 else 2 end) as bigint) as bits from individuals group by fam", "individuals"))
def bit_size(s, d):
    return P.bit_size(V.individuals(s, d))


@query("marryin_founders", V.sql("select fam, id, father, mother, sex from individuals where id % 9 in (3, 5) and (id - id % 9 + 3 + case when id % 9 = 3 then 3 else 4 end) in (select id from individuals)", "individuals"))
def marryin_founders(s, d):
    people = V.individuals(s, d)
    return P.marry_in_founders(people, G.depth(people))


GEN = ("recursive", "individuals", "edges", "closure")


@query("depth", V.sql("select fam, id, max(steps) as depth from closure group by fam, id", *GEN))
def depth(s, d):
    return G.depth(V.individuals(s, d))


@query("ancestors", V.sql("select distinct fam, id, anc as ancestor from closure where steps > 0", *GEN))
def ancestors(s, d):
    return G.ancestors(V.individuals(s, d))


@query("descendants", V.sql("select distinct fam, anc as id, id as descendant from closure where steps > 0", *GEN))
def descendants(s, d):
    return G.descendants(V.individuals(s, d))


def _pairs(people):
    """Every ordered pair of a family, everyone with themselves too."""
    return people.select("fam", F.col("id").alias("id1")).join(apart(people.select("fam", F.col("id").alias("id2"))), "fam")


@query("common_ancestors", V.sql("""select distinct x.fam, x.id as id1, y.id as id2, x.anc as ancestor from closure x join closure y on x.fam = y.fam and x.anc = y.anc
where x.steps > 0 and y.steps > 0""", *GEN))
def common_ancestors(s, d):
    people = V.individuals(s, d)
    return G.common_ancestors(people, _pairs(people))


@query("siblings", V.sql("select x.fam, x.id, y.id as sibling from individuals x join individuals y on x.fam = y.fam and x.father = y.father and x.mother = y.mother", "individuals"))
def siblings(s, d):
    return G.siblings(V.individuals(s, d))


@query("half_siblings", V.sql("""select x.fam, x.id, y.id as sibling from half x join half y on x.fam = y.fam and (x.father = y.father or x.mother = y.mother) and not (x.father = y.father and x.mother = y.mother)""", "individuals").replace("\nselect", ",\nhalf as (select fam, id, father, case when id % 9 = 4 then id - 1 else mother end as mother from individuals)\nselect", 1))
def half_siblings(s, d):
    people = V.individuals(s, d).withColumn("mother", F.when(F.col("id") % 9 == 4, F.col("id") - 1).otherwise(F.col("mother")))
    return G.half_siblings(people)


def _line(via: str) -> str:
    return V.sql(f"""select fam, id, line from (select c.fam, c.id, c.line, c.k, row_number() over (partition by c.fam, c.id order by c.k desc) as rn from chain c) q where rn = 1""", "recursive", "individuals").replace(
        "\nselect fam", f",\nchain as (select fam, id, id as line, 0 as k from individuals union all select c.fam, c.id, i.{via}, c.k + 1 from chain c join individuals i on c.fam = i.fam and c.line = i.id where i.{via} is not null)\nselect fam", 1)


@query("matriline", _line("mother"))
def matriline(s, d):
    return G.lineage(V.individuals(s, d), "mother")


@query("patriline", _line("father"))
def patriline(s, d):
    return G.lineage(V.individuals(s, d), "father")


PATHS = """down as (select fam, id as start, id as stop, cast(id as varchar) as path, 1 as n from individuals
 union all select p.fam, p.start, e.id, p.path || '>' || cast(e.id as varchar), p.n + 1 from down p join edges e on p.fam = e.fam and p.stop = e.parent)"""
V.SQL["down"] = PATHS


@query("path_downward", V.sql("select fam, start, stop as \"end\", path from down", "recursive", "individuals", "edges", "down"))
def path_downward(s, d):
    return G.paths_down(V.individuals(s, d)).withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


@query("paths_count", V.sql("select fam, id, anc, cast(count(*) as bigint) as n from closure where steps > 0 group by fam, id, anc", *GEN))
def paths_count(s, d):
    return G.descent(V.individuals(s, d)).filter("steps > 0").groupBy("fam", "id", "anc").agg(F.sum("n").alias("n"))


KIN = (*GEN, "kin")


@query("kinship_all", V.sql("select fam, id1, id2, a / 2 as kinship from amat where id1 <= id2", *KIN))
def kinship_all(s, d):
    return G.kinship(V.individuals(s, d))


@query("kinship_paths", V.sql("""select i.fam, i.id as id1, j.id as id2, coalesce(case when i.id = j.id then 0.5 else a.a / 2 end, 0.0) as kinship from individuals i join individuals j on i.fam = j.fam
left join amat a on a.fam = i.fam and a.id1 = i.id and a.id2 = j.id""", *KIN))
def kinship_paths(s, d):
    people = V.individuals(s, d)
    return G.path_kinship(people, _pairs(people), G.inbreeding(people))


@query("kinship_asked", V.sql("""select i.fam, i.id as id1, j.id as id2, coalesce(a.a / 2, 0.0) as kinship from individuals i join individuals j on i.fam = j.fam
left join amat a on a.fam = i.fam and a.id1 = i.id and a.id2 = j.id""", *KIN))
def kinship_asked(s, d):
    people = V.individuals(s, d)
    return G.kinship_of(people, _pairs(people))


@query("inbreeding", V.sql("select i.fam, i.id, coalesce(a.a / 2, 0.0) as inbreeding from individuals i left join amat a on a.fam = i.fam and a.id1 = i.father and a.id2 = i.mother", *KIN))
def inbreeding(s, d):
    return G.inbreeding(V.individuals(s, d))


FRAT = """k as (select fam, id1, id2, a / 2 as t from amat),
frat as (select p.fam, p.id1, p.id2, coalesce(mm.t, 0) * coalesce(ff.t, 0) + coalesce(mf.t, 0) * coalesce(fm.t, 0) as fraternity
from (select fam, id1, id2 from amat where id1 < id2) p join individuals x on x.id = p.id1 join individuals y on y.id = p.id2
left join k mm on mm.id1 = x.mother and mm.id2 = y.mother left join k ff on ff.id1 = x.father and ff.id2 = y.father
left join k mf on mf.id1 = x.mother and mf.id2 = y.father left join k fm on fm.id1 = x.father and fm.id2 = y.mother)"""
V.SQL["frat"] = FRAT


@query("fraternity", V.sql("select fam, id1, id2, cast(fraternity as double) as fraternity from frat", *KIN, "frat"))
def fraternity(s, d):
    people = V.individuals(s, d)
    kin = G.cut(G.kinship(people))
    return G.fraternity(people, kin, kin.filter("id1 < id2").select("fam", "id1", "id2"))


@query("a_matrix", V.sql("select fam, id1, id2, a as value from amat", *KIN))
def a_matrix(s, d):
    return G.additive(V.individuals(s, d))


@query("d_matrix", V.sql("""select fam, id1, id2, cast(fraternity as double) as value from frat where fraternity > 0 union all select fam, id2, id1, cast(fraternity as double) from frat where fraternity > 0
union all select fam, id, id, cast(1 as double) from individuals""", *KIN, "frat"))
def d_matrix(s, d):
    return G.dominance(V.individuals(s, d))


@query("mt_matrix", _line("mother").replace("\nselect fam, id, line from", ",\nline as (select fam, id, line from", 1) + ")\nselect x.fam, x.id as id1, y.id as id2, cast(1 as double) as value from line x join line y on x.fam = y.fam and x.line = y.line")
def mt_matrix(s, d):
    return G.mitochondrial(V.individuals(s, d))


# relational tools


@query("update_merge", V.sql("""select coalesce(p.fam, o.fam) as fam, coalesce(p.id, o.id) as id, coalesce(p.name, o.name) as name, case when o.id is not null then o.v else p.value end as value from phenotypes p full join
(select fam, id, 'balance' as name, value + 1 as v from phenotypes where name = 'balance' and id % 3 = 0 union all select fam, id, 'extra', value from phenotypes where name = 'n_orders') o on p.fam = o.fam and p.id = o.id and p.name = o.name""", "phenotypes"))
def update_merge(s, d):
    base = V.phenotypes(s, d)
    changed = base.filter("name = 'balance' and id % 3 = 0").withColumn("value", F.col("value") + 1)
    extra = base.filter("name = 'n_orders'").withColumn("name", F.lit("extra"))
    return P.upsert_phenotypes(base, changed.unionByName(extra))


@query("phenotype_pivot", V.sql("""select fam, id, max(case when name = 'balance' then value end) as balance, max(case when name = 'n_orders' then value end) as n_orders, max(case when name = 'top_order' then value end) as top_order from phenotypes group by fam, id""", "phenotypes"))
def phenotype_pivot(s, d):
    return P.phenotype_table(V.phenotypes(s, d), ["balance", "n_orders", "top_order"])


@query("complete_cases", V.sql("""select * from (select fam, id, max(case when name = 'balance' then value end) as balance, max(case when name = 'n_orders' then value end) as n_orders from phenotypes group by fam, id) q where balance is not null and n_orders is not null""", "phenotypes"))
def complete_cases(s, d):
    return P.complete_cases(P.phenotype_table(V.phenotypes(s, d), ["balance", "n_orders"]), "balance", ["n_orders"])


@query("semi_join", V.sql("select fam, id, sex from individuals where id in (select o_custkey from orders where o_orderstatus = 'P')", "individuals"))
def semi_join(s, d):
    return V.individuals(s, d).join(V.load(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), "id", "left_semi").select("fam", "id", "sex")


@query("anti_join", V.sql("select fam, id, sex from individuals where id not in (select o_custkey from orders where o_custkey is not null)", "individuals"))
def anti_join(s, d):
    return V.individuals(s, d).join(V.load(s, d, "orders").select(F.col("o_custkey").alias("id")), "id", "left_anti").select("fam", "id", "sex")


@query("merge_segments", V.sql("select id1, id2, chrom, start_idx, stop_idx from segments where chrom < 2 and id1 not in (select id1 from segments where chrom >= 2) union all select id1, id2, chrom, start_idx, stop_idx from segments where chrom >= 2", "segments"))
def merge_segments(s, d):
    found = V.segments(s, d)
    return sgs.merge(found.filter("chrom < 2"), found.filter("chrom >= 2"), ["id1", "id2"])


@query("key_sets", "select p_partkey as k, 'union' as how from part where p_partkey < 50 or p_size < 5 union all select p_partkey, 'intersection' from part where p_partkey < 50 and p_size < 5 union all select p_partkey, 'range' from part where p_partkey >= 10 and p_partkey < 20")
def key_sets(s, d):
    part = V.load(s, d, "part").withColumnRenamed("p_partkey", "k")
    a, b = part.filter("k < 50"), part.filter("p_size < 5")
    return I.key_set(a, b, "union").withColumn("how", F.lit("union")).unionByName(I.key_set(a, b, "intersection").withColumn("how", F.lit("intersection"))).unionByName(I.key_range(part.select("k"), 10, 20).withColumn("how", F.lit("range")))


# arrays, maps and numbers


def _codes(s, d):
    return V.load(s, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 7), lambda v: (v > 0).cast("int")).alias("x"))


CODES = "codes as (select vec_id, label, list_transform(embedding[1:7], lambda v: case when v > 0 then 1 else 0 end) as x from embeddings)"
V.SQL["codes"] = CODES


def _text(c):
    return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")


@query("interleave", V.sql("select vec_id, string_agg(cast(case when k % 2 = 1 then x[cast((k + 1) // 2 as int)] else 1 - x[cast(k // 2 as int)] end as varchar), ',' order by k) as y from (select vec_id, x, unnest(range(1, 15)) as k from codes) q group by vec_id", "codes"))
def interleave(s, d):
    return _codes(s, d).select("vec_id", _text(S.interleave(F.col("x"), F.transform("x", lambda v: 1 - v))).alias("y"))


@query("grouper", V.sql("select vec_id, cast(floor((k - 1) / 3) as int) as chunk, string_agg(cast(case when k <= 7 then x[k] else -1 end as varchar), ',' order by k) as y from (select vec_id, x, unnest(range(1, 10)) as k from codes) q group by vec_id, floor((k - 1) / 3)", "codes"))
def grouper(s, d):
    chunks = _codes(s, d).select("vec_id", F.posexplode(S.grouper(F.col("x"), 3, F.lit(-1))).alias("chunk", "c"))
    return chunks.select("vec_id", "chunk", _text("c").alias("y"))


@query("invert_map", "select n_regionkey as region, cast(n_nationkey % 3 as int) as k, max(n_name) as v from nation group by n_regionkey, n_nationkey % 3")
def invert_map(s, d):
    rows = V.load(s, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_name").alias("k"), (F.col("n_nationkey") % 3).cast("int").alias("v")))).alias("m"))
    return rows.select("region", F.explode(S.invert_map(F.col("m"))).alias("k", "v"))


@query("log_base_change", "select o_orderkey, round(ln(o_totalprice + 1) / (ln(2.0) / ln(10.0)), 6) as y from orders")
def log_base_change(s, d):
    return V.load(s, d, "orders").select("o_orderkey", F.round(S.change_log_base(F.ln(F.col("o_totalprice") + 1), 2, 10), 6).alias("y"))


@query("logistic_growth", "select p_partkey, round(p_size * 500 / (p_size + (500 - p_size) * exp(-0.1 * (p_partkey % 30))), 6) as y from part where p_size > 0")
def logistic_growth(s, d):
    return V.load(s, d, "part").filter("p_size > 0").select("p_partkey", F.round(S.logistic_growth(F.col("p_size"), F.lit(0.1), F.lit(500), F.col("p_partkey") % 30), 6).alias("y"))


@query("exponential_growth", "select p_partkey, round(p_size * exp(0.05 * (p_partkey % 30)), 6) as y from part")
def exponential_growth(s, d):
    return V.load(s, d, "part").select("p_partkey", F.round(S.exponential_growth(F.col("p_size"), F.lit(0.05), F.col("p_partkey") % 30), 6).alias("y"))


@query("richards_growth", "select p_partkey, round(5 + 100 / power(1 + 0.5 * exp(-0.2 * ((p_partkey % 30) - 10)), 1 / 0.5), 6) as y from part")
def richards_growth(s, d):
    return V.load(s, d, "part").select("p_partkey", F.round(S.richards(F.lit(5.0), F.lit(100.0), F.lit(10.0), F.lit(0.2), F.lit(0.5), F.col("p_partkey") % 30), 6).alias("y"))


@query("sparse_arrays", V.sql("select vec_id, k - 1 as k, x[k] as v from (select vec_id, x, unnest(range(1, 8)) as k from codes) q where x[k] <> 0", "codes"))
def sparse_arrays(s, d):
    m = S.sparse_from_dense(F.col("x"), F.lit(0))
    back = _codes(s, d).withColumn("m", m).withColumn("x", S.sparse_to_dense(F.col("m"), F.lit(7), F.lit(0)))
    return back.select("vec_id", F.posexplode("x").alias("k", "v")).filter("v <> 0").select("vec_id", F.col("k").cast("long").alias("k"), "v")


# simulation: random numbers are a function of seed and keys, so SQL gives the same ones


def _u(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"cast({k} as varchar)" for k in keys]])
    return f"(cast('0x' || substr(md5({text}), 1, 8) as bigint) / 4294967296.0)"


def _small_map(s, n: int = 6):
    """Two chromosomes of ``n`` markers 10 cM apart."""
    return s.range(2 * n).select(F.floor(F.col("id") / n).cast("int").alias("chrom_idx"), (F.col("id") % n).cast("int").alias("marker_idx"), ((F.col("id") % n) * 10.0).alias("cm"), F.lit(0.3).alias("maf"))


MAP = "map as (select cast(floor(k / 6) as int) as chrom_idx, cast(k % 6 as int) as marker_idx, (k % 6) * 10.0 as cm, case when k % 6 = 0 then 0.5 else (1 - exp(-0.2)) / 2 end as r from (select unnest(range(0, 12)) as k) q)"
V.SQL["map"] = MAP


@query("le_haplotypes", V.sql(f"select fam, id, hap, chrom_idx, marker_idx, case when {_u('3', 'fam', 'id', 'hap', 'chrom_idx', 'marker_idx')} < 0.3 then 2 else 1 end as allele from (select fam, id, unnest([0, 1]) as hap from individuals where father is null and mother is null) q, map", "individuals", "map"))
def le_haplotypes(s, d):
    return D.equilibrium_haplotypes(P.founders(V.individuals(s, d)), ["fam", "id"], _small_map(s), 3)


@query("recombine", V.sql(f"""select fam, id, chrom_idx, marker_idx, cast(sum(case when {_u('4', 'fam', 'id', 'chrom_idx', 'marker_idx')} < r then 1 else 0 end) over (partition by fam, id, chrom_idx order by marker_idx) % 2 as int) as strand from individuals, map""", "individuals", "map"))
def recombine(s, d):
    return D.strands(V.individuals(s, d).select("fam", "id"), ["fam", "id"], _small_map(s), 4)


def _drop_level(level: str, source: str, where: str) -> str:
    return f"""s{level} as (select rep, fam, id, hap, parent, chrom_idx, marker_idx, sum(case when {_u('5/drop', 'rep', 'fam', 'id', 'hap', 'parent', 'chrom_idx', 'marker_idx')} < r then 1 else 0 end)
  over (partition by rep, fam, id, hap, parent, chrom_idx order by marker_idx) % 2 as strand from (select e.fam, e.id, e.parent, e.via as hap, 0 as rep from edges e where e.id % 9 in {where}) q, map),
d{level} as (select * from {source} union all select s.rep, s.fam, s.id, s.hap, s.chrom_idx, s.marker_idx, k.allele from s{level} s join {source} k
  on k.rep = s.rep and k.fam = s.fam and k.id = s.parent and k.hap = s.strand and k.chrom_idx = s.chrom_idx and k.marker_idx = s.marker_idx)"""


V.SQL["drop"] = ",\n".join([
    "d0 as (select 0 as rep, fam, id, hap, chrom_idx, marker_idx, cast(id as varchar) || '/' || cast(hap as varchar) as allele from (select fam, id, unnest([0, 1]) as hap from individuals where father is null and mother is null) q, map)",
    _drop_level("1", "d0", "(2, 4)"), _drop_level("2", "d1", "(6, 7)"), _drop_level("3", "d2", "(8)")])


def _dropped(s, d):
    people = V.individuals(s, d)
    m = _small_map(s)
    return people, D.gene_drop(people, m, D.founder_labels(P.founders(people), ["fam", "id"], m), 5)


@query("gene_drop", V.sql("select rep, fam, id, hap, chrom_idx, marker_idx, allele from d3", "individuals", "edges", "map", "drop"))
def gene_drop(s, d):
    return _dropped(s, d)[1]


@query("ibd_from_gene_drop", V.sql("""select x.rep, x.fam, x.chrom_idx, x.marker_idx, x.id as id1, y.id as id2, case when x.a0 = y.a0 and x.a1 = y.a1 or x.a0 = y.a1 and x.a1 = y.a0 then 2 when x.a0 = y.a0 or x.a0 = y.a1 or x.a1 = y.a0 or x.a1 = y.a1 then 1 else 0 end as shared
from gt x join gt y on x.rep = y.rep and x.fam = y.fam and x.chrom_idx = y.chrom_idx and x.marker_idx = y.marker_idx and x.id < y.id""", "individuals", "edges", "map", "drop").replace("\nselect x.rep", ",\ngt as (select rep, fam, id, chrom_idx, marker_idx, max(case when hap = 0 then allele end) as a0, max(case when hap = 1 then allele end) as a1 from d3 group by rep, fam, id, chrom_idx, marker_idx)\nselect x.rep", 1))
def ibd_from_gene_drop(s, d):
    people, dropped = _dropped(s, d)
    return D.ibd_sharing(dropped, people)


@query("inheritance_spans", V.sql("""select fam, id, hap, chrom_idx, allele as anc, min(marker_idx) as start, max(marker_idx) + 1 as stop from (select *, sum(n) over (partition by rep, fam, id, hap, chrom_idx order by marker_idx) as k from
(select *, case when lag(allele) over (partition by rep, fam, id, hap, chrom_idx order by marker_idx) = allele then 0 else 1 end as n from d3) q) q group by fam, id, hap, chrom_idx, allele, k""", "individuals", "edges", "map", "drop"))
def inheritance_spans(s, d):
    return D.spans(_dropped(s, d)[1], ["fam", "id"])


RANKED = "ranked as (select id, sex, row_number() over (partition by sex order by id) - 1 as k from individuals), n as (select cast(sum(case when sex = 0 then 1 else 0 end) as bigint) as n0, cast(sum(case when sex = 1 then 1 else 0 end) as bigint) as n1 from individuals)"


def _mating(ranked: str, f: str, m: str, seed: str, count0: str, count1: str) -> str:
    body = f"""select child, a.id as father, b.id as mother, q.sex from (select child, cast(floor({_u(f, 'child')} * {count0}) as bigint) as kf, cast(floor({_u(m, 'child')} * {count1}) as bigint) as km,
cast(floor({_u(seed + '/s', 'child')} * 2) as int) as sex from (select unnest(range(0, 500)) as child) c, n) q join ranked a on a.sex = 0 and a.k = q.kf join ranked b on b.sex = 1 and b.k = q.km"""
    return V.sql(body, "individuals").replace("\nselect child", f",\n{ranked}\nselect child", 1)


@query("random_mating", _mating(RANKED, "6/f", "6/m", "6", "n0", "n1"))
def random_mating(s, d):
    return D.random_mating(V.individuals(s, d), 500, 6)


@query("monogamous_mating", _mating(RANKED.replace("order by id", f"order by {_u('7/o', 'id')}, id"), "7/c", "7/c", "7", "least(n0, n1)", "least(n0, n1)"))
def monogamous_mating(s, d):
    return D.monogamous_mating(V.individuals(s, d), 500, 7)


@query("pool_iterate", f"""with {MAP}, p0 as (select h as hap_id, chrom_idx, marker_idx, case when {_u('8/p', 'h', 'chrom_idx', 'marker_idx')} < 0.3 then 2 else 1 end as allele from (select unnest(range(0, 60)) as h) q, map),
st as (select h as hap_id, chrom_idx, marker_idx, sum(case when {_u('8/0/x', 'h', 'chrom_idx', 'marker_idx')} < r then 1 else 0 end) over (partition by h, chrom_idx order by marker_idx) % 2 as strand from (select unnest(range(0, 80)) as h) q, map),
src as (select *, cast(floor(case when strand = 0 then {_u('8/0/0', 'hap_id', 'chrom_idx')} else {_u('8/0/1', 'hap_id', 'chrom_idx')} end * 60) as bigint) as f from st)
select s.hap_id, s.chrom_idx, s.marker_idx, p.allele from src s join p0 p on p.hap_id = s.f and p.chrom_idx = s.chrom_idx and p.marker_idx = s.marker_idx""")
def pool_iterate(s, d):
    m = _small_map(s)
    return D.pool_step(D.pool_start(s, m, 60, 8), m, 80, 60, 0, 8)


def _effects(s):
    return s.createDataFrame([(1, 7, 0.5, 0.2), (2, 3, -0.3, 0.0), (3, 11, 1.0, -0.5)], "chrom_idx int, marker_idx int, a double, k double")


V.SQL["effects"] = "effects as (select * from (values (1, 7, 0.5e0, 0.2e0, 0.3e0), (2, 3, -0.3e0, 0.0e0, 0.1e0), (3, 11, 1.0e0, -0.5e0, 0.25e0)) t(chrom_idx, marker_idx, a, k, q))"


def _effect_markers(s):
    return s.createDataFrame([(1, 7, 0.3), (2, 3, 0.1), (3, 11, 0.25)], "chrom_idx int, marker_idx int, maf double")


VALUE = "sum(coalesce(case (case when a0 = 2 then 1 when a0 is not null then 0 end) + (case when a1 = 2 then 1 when a1 is not null then 0 end) when 0 then 0.0 when 1 then a * (1 + k) when 2 then 2 * a end, 0.0))"


@query("genotypic_value", V.sql(f"select fam, id, round({VALUE}, 9) as value from genotypes join effects using (chrom_idx, marker_idx) group by fam, id", "genotypes", "effects"))
def genotypic_value(s, d):
    return Q.genotypic_values(V.genotypes(s, d), _effects(s)).withColumn("value", F.round("value", 9))


def _locus(name: str, sql: str) -> None:
    query(name, V.sql(f"select chrom_idx, marker_idx, round({sql}, 9) as value from effects", "effects"))(
        lambda s, d: Q.locus_parameters(_effects(s), _effect_markers(s)).select("chrom_idx", "marker_idx", F.round(column, 9).alias("value")) if (column := {"expected_genotypic_value": "expected", "additive_variance": "additive", "dominance_variance": "dominance"}[name]) else None
    )


_locus("expected_genotypic_value", "2 * (1 - q) * q * a * (1 + k) + q * q * 2 * a")
_locus("additive_variance", "2 * (1 - q) * q * power(a * (1 + k * (1 - 2 * q)), 2)")
_locus("dominance_variance", "power(2 * (1 - q) * q * a * k, 2)")


@query("predict_phenotype", V.sql(f"""select g.fam, g.id, round(1.5 - t.e + g.v + sqrt(t.va / 0.6 - t.va) * sqrt(-2 * ln(1 - {_u('9/u', 'g.fam', 'g.id')})) * cos(2 * pi() * {_u('9/v', 'g.fam', 'g.id')}), 6) as value
from (select fam, id, {VALUE} as v from genotypes join effects using (chrom_idx, marker_idx) group by fam, id) g, (select sum(2 * (1 - q) * q * a * (1 + k) + q * q * 2 * a) as e, sum(2 * (1 - q) * q * power(a * (1 + k * (1 - 2 * q)), 2)) as va from effects) t""", "genotypes", "effects"))
def predict_phenotype(s, d):
    trait = Q.Trait(_effects(s), _effect_markers(s), mean=1.5, h2=0.6)
    return trait.predict(V.genotypes(s, d), 9).withColumn("value", F.round("value", 6))


# mixed models


@query("incidence_matrix", V.sql("""select i.fam, i.id, cast(dense_rank() over (order by c_mktsegment) - 1 as bigint) as level from individuals i join customer on c_custkey = i.id where c_mktsegment is not null""", "individuals"))
def incidence_matrix(s, d):
    rows = V.individuals(s, d).join(V.load(s, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment"), "id")
    return P.incidence(rows, "c_mktsegment")


def _model(s, d):
    wide = P.phenotype_table(V.phenotypes(s, d), ["balance", "n_orders"])
    data = wide.select("fam", "id", (F.col("balance") / 1000).alias("y"), F.col("n_orders").alias("x"))
    return lmm.MixedModel(data, "y", ("x",)).with_effect("additive", G.cut(G.additive(V.individuals(s, d))))


@query("gls_beta", V.sql("""select k, round(case when k = 0 then (sxx * sy - sx * sxy) / (n * sxx - sx * sx) else (n * sxy - sx * sy) / (n * sxx - sx * sx) end, 6) as beta from (select unnest([0, 1]) as k, n, sx, sy, sxx, sxy from (
select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from (select max(case when name = 'balance' then value end) / 1000 as y, max(case when name = 'n_orders' then value end) as x from phenotypes group by fam, id) q where x is not null and y is not null) q) q""", "phenotypes"))
def gls_beta(s, d):
    wide = P.phenotype_table(V.phenotypes(s, d), ["balance", "n_orders"])
    model = lmm.MixedModel(wide.select("fam", "id", (F.col("balance") / 1000).alias("y"), F.col("n_orders").alias("x")), "y", ("x",))
    import numpy as np

    beta = lmm.gls(model.blocks(), np.array([1.0]))
    return s.createDataFrame([(k, round(float(b), 6)) for k, b in enumerate(beta)], "k int, beta double")


def _components(s, fit):
    rows = [(n, float(c)) for n, c in zip(fit.names, fit.components, strict=True)] + [("loglikelihood", float(fit.loglikelihood))]
    return s.createDataFrame(rows, "name string, value double")


@query("lmm_ml")
def lmm_ml(s, d):
    return _components(s, _model(s, d).fit())


@query("lmm_reml")
def lmm_reml(s, d):
    return _components(s, _model(s, d).fit(restricted=True))


@query("blup")
def blup(s, d):
    model = _model(s, d)
    return lmm.blup(model, model.fit())


@query("lrt")
def lrt(s, d):
    model = _model(s, d)
    small = lmm.MixedModel(model.data, model.outcome, (), model.effects)
    test = lmm.likelihood_ratio(small.fit(), model.fit())
    return s.createDataFrame([(float(test.chi2), test.df, float(test.pvalue), float(test.lod))], "chi2 double, df int, pvalue double, lod double")


@query("linkage")
def linkage(s, d):
    people, dropped = _dropped(s, d)
    shared = D.ibd_sharing(dropped.filter("chrom_idx = 0 and marker_idx = 0"), people).select("fam", "id1", "id2", (F.col("shared") / 2).alias("value")).filter("value > 0")
    turned = shared.select("fam", F.col("id2").alias("id1"), F.col("id1").alias("id2"), "value")
    own = people.select("fam", F.col("id").alias("id1"), F.col("id").alias("id2"), F.lit(1.0).alias("value"))
    null, alternative, test = lmm.linkage(_model(s, d), G.cut(shared.unionByName(turned).unionByName(own)))
    return s.createDataFrame([(float(null.loglikelihood), float(alternative.loglikelihood), float(test.chi2), float(test.lod))], "null_ll double, alternative_ll double, chi2 double, lod double")


@query("assoc_scan")
def assoc_scan(s, d):
    model = _model(s, d)
    doses = V.genotypes(s, d).select("fam", "id", "chrom_idx", "marker_idx", Q.copies().alias("dose"))
    return lmm.association(model, model.fit(), doses)


@query("drift", None)
def drift(s, d):
    m = s.createDataFrame([(0, 0, 0.0, 0.5)], "chrom_idx int, marker_idx int, cm double, maf double")
    pool, out, size = D.pool_start(s, m, 200, 10), None, 200
    for g in range(4):
        pool = D.cut(D.pool_step(pool, m, size, size, g, 10))
        row = pool.agg(F.lit(g).alias("generation"), F.avg((F.col("allele") == 2).cast("double")).alias("frequency"))
        out = row if out is None else out.unionByName(row)
    return out


@query("random_loci", f"select p_partkey from part order by md5('12:' || cast(p_partkey as varchar)), p_partkey limit 10")
def random_loci(s, d):
    return I.random_rows(V.load(s, d, "part").select("p_partkey"), 10, F.col("p_partkey"), 12)


@query("bootstrap", f"select k, cast(floor({_u('13', 'k')} * (select count(*) from nation)) as bigint) as picked from (select unnest(range(0, 100)) as k) q")
def bootstrap(s, d):
    n = V.load(s, d, "nation").count()
    return s.range(100).select(F.col("id").alias("k"), R.choice(F.lit(n), 13, "id").alias("picked"))


@query("marker_summary", "select 0 as chrom_idx, cast(count(*) as bigint) as n_markers, round(max(p_partkey / 10.0) - min(p_partkey / 10.0), 6) as length from part")
def marker_summary(s, d):
    return V.markers(s, d).groupBy("chrom_idx").agg(F.count("*").alias("n_markers"), F.round(F.max("cm") - F.min("cm"), 6).alias("length"))


@query("level_ranks", V.sql("select user_id, i, level, cast(lag(level) over (partition by user_id order by i) as int) as before from levels", "levels"))
def level_ranks(s, d):
    return V.levels(s, d).select("user_id", "i", "level", F.lag("level").over(Window.partitionBy("user_id").orderBy("i")).alias("before"))


# files: written to the shared folder from the views, and read back


def _folder(s) -> str:
    import uuid

    return f"{shared_dir(s)}/kindred-files-{uuid.uuid4().hex}"


def _text_people(s, d):
    people = V.individuals(s, d)
    return people.select(*[F.col(c).cast("string").alias(c) for c in ("fam", "id", "father", "mother")], F.col("sex").cast("tinyint").alias("sex"), F.lit(None).cast("tinyint").alias("affected"))


@query("plink_roundtrip", V.sql("""select cast(g.fam as varchar) as fam, cast(g.id as varchar) as id, chrom_idx - 1 as chrom_idx, marker_idx, cast(a0 as varchar) as a0, cast(a1 as varchar) as a1
from genotypes g join customer on c_custkey = g.id where a0 is not null""", "genotypes"))
def plink_roundtrip(s, d):
    typed = V.genotypes(s, d)
    m = s.range((typed.agg(F.max("chrom_idx")).first()[0] or 0) * V.LOCI).select(F.floor(F.col("id") / V.LOCI).cast("int").alias("chrom_idx"), (F.col("id") % V.LOCI).cast("int").alias("marker_idx"), (F.col("id") % V.LOCI).cast("double").alias("cm"))
    m = m.select("*", ((F.col("marker_idx") + 1) * 1000).cast("long").alias("bp"), (F.col("chrom_idx") + 1).cast("string").alias("chrom"), F.concat_ws("-", F.lit("rs"), "chrom_idx", "marker_idx").alias("label"))
    g = typed.select(F.col("fam").cast("string").alias("fam"), F.col("id").cast("string").alias("id"), (F.col("chrom_idx") - 1).alias("chrom_idx"), "marker_idx", "a0", "a1")
    prefix = _folder(s)
    pedigrees.ped_lines(_text_people(s, d), g, m).write.text(prefix + ".ped")
    pedigrees.map_lines(m).write.text(prefix + ".map")
    return pedigrees.read_plink(s, prefix=prefix)[2].filter("a0 is not null and a1 is not null")


@query("pedigree_roundtrip", V.sql("select cast(fam as varchar) as fam, cast(id as varchar) as id, cast(nullif(father, 0) as varchar) as father, cast(mother as varchar) as mother, sex from individuals", "individuals"))
def pedigree_roundtrip(s, d):
    people = V.individuals(s, d)
    path = _folder(s) + ".pedigrees"
    pedigrees.write_pedigree(people, G.depth(people), path)
    return pedigrees.read_ped(s, path).select("fam", "id", "father", "mother", F.col("sex").cast("int").alias("sex"))


@query("phenotype_roundtrip", V.sql("select cast(fam as varchar) as fam, cast(id as varchar) as id, name, value from phenotypes where value is not null", "phenotypes"))
def phenotype_roundtrip(s, d):
    path = _folder(s) + ".csv"
    pedigrees.write_phenotypes(V.phenotypes(s, d), path)
    return pedigrees.read_phenotypes(s, path).filter("value is not null").select("fam", "id", "name", "value")


@query("germline_roundtrip", V.sql("select cast(id1 as varchar) as id1, cast(id2 as varchar) as id2, cast(chrom as varchar) as chrom, start_idx * 1000 as bp_start, stop_idx * 1000 as bp_stop, round((stop_idx - start_idx) / 1000.0, 6) as length from segments", "segments"))
def germline_roundtrip(s, d):
    seg = V.segments(s, d).select(F.lit("1").alias("fam1"), F.col("id1").cast("string").alias("id1"), F.lit("1").alias("fam2"), F.col("id2").cast("string").alias("id2"), F.col("chrom").cast("string").alias("chrom"), "start_idx", "stop_idx", (F.col("start_idx") * 1000).alias("bp_start"), (F.col("stop_idx") * 1000).alias("bp_stop"))
    m = V.markers(s, d).select(F.explode(F.array(*[F.lit(str(c)) for c in range(5)])).alias("chrom"), "bp", F.concat(F.lit("m"), F.col("marker_idx").cast("string")).alias("label"))
    path = _folder(s) + ".germline"
    variants.germline_lines(seg, m).write.text(path)
    return variants.read_germline(s, path).select("id1", "id2", "chrom", "bp_start", "bp_stop", "length")


@query("vcf_scan", """select 'S' || cast(o_custkey % 3 as varchar) as id, cast(k as int) as marker_idx, h as hap, cast(case when (o_orderkey + h) % 4 = 0 then null else (o_orderkey + h) % 3 end as tinyint) as allele
from (select o_orderkey, c as o_custkey, rk - 1 as k, h from (select o_orderkey, row_number() over (order by o_orderkey) as rk from orders) a, (select unnest([0, 1, 2]) as c) b, (select unnest([0, 1]) as h) e) q
where (o_orderkey + h) % 4 = 0 or (o_orderkey + h) % 3 <> 0""")
def vcf_scan(s, d):
    orders = V.load(s, d, "orders")
    code = lambda h: F.when((F.col("o_orderkey") + h) % 4 == 0, ".").otherwise(((F.col("o_orderkey") + h) % 3).cast("string"))
    gt = F.concat(code(0), F.lit("|"), code(1), F.lit(":9"))
    line = F.concat_ws("\t", F.lit("1"), (F.col("o_orderkey") + 1).cast("string"), F.lit("."), F.lit("A"), F.lit("C,G"), F.lit("50"), F.lit("PASS"), F.lit("AF=0.5,0.1;DB"), F.lit("GT:DP"), gt, gt, gt)
    header = s.createDataFrame([("##fileformat=VCFv4.0", -2), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS0\tS1\tS2", -1)], "value string, k long")
    path = _folder(s) + ".vcf"
    header.unionByName(orders.select(line.alias("value"), F.col("o_orderkey").alias("k"))).orderBy("k").select("value").write.text(path)
    return variants.read_vcf(s, path, frequency_key="AF")[2].select("id", "marker_idx", F.col("hap").cast("int").alias("hap"), "allele")
