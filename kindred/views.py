"""Pedigree, genotype and sequence tables derived from the star schema of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Father and mother of each position of the nine-person family whose parents are first cousins.
FATHER = {2: 0, 4: 0, 6: 2, 7: 4, 8: 6}
MOTHER = {2: 1, 4: 1, 6: 3, 7: 5, 8: 7}
FAMILY, LOCI = 9, 50


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parent(table: dict[int, int]):
    p = F.col("c_custkey") % FAMILY
    out = F.lit(None).cast("long")
    for child, parent in table.items():
        out = F.when(p == child, F.col("c_custkey") - p + parent).otherwise(out)
    return out


def individuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fam, id, father, mother (long), sex (0, 1); ids are customer keys, families are runs of nine keys."""
    p = F.col("c_custkey") % FAMILY
    return load(spark, sf_dir, "customer").select(
        F.floor(F.col("c_custkey") / FAMILY).cast("long").alias("fam"),
        F.col("c_custkey").alias("id"),
        _parent(FATHER).alias("father"),
        _parent(MOTHER).alias("mother"),
        (p % 2).cast("int").alias("sex"),
    )


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fam, id, chrom_idx, marker_idx, a0, a1: one row for each individual and locus; missing calls are NULL.

    The first row in a fixed order wins; min over a struct combines map-side, which a ranking window would not."""
    keep = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    rows = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    first = rows.groupBy(
        F.col("o_custkey").alias("id"), F.col("l_linenumber").alias("chrom_idx"), (F.col("l_partkey") % LOCI).cast("int").alias("marker_idx")
    ).agg(F.min(keep).alias("x"))
    seen = F.col("x.l_discount") != 0
    return first.select(
        F.floor(F.col("id") / FAMILY).cast("long").alias("fam"),
        "id",
        "chrom_idx",
        "marker_idx",
        F.when(seen, (1 + F.col("x.l_suppkey") % 2).cast("int")).alias("a0"),
        F.when(seen, (1 + F.floor(F.col("x.l_quantity")).cast("int") % 2).cast("int")).alias("a1"),
    )


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom_idx, marker_idx, label, cm, bp: parts as markers of one chromosome."""
    return load(spark, sf_dir, "part").select(
        F.lit(0).alias("chrom_idx"),
        F.col("p_partkey").alias("marker_idx"),
        F.col("p_name").alias("label"),
        (F.col("p_partkey") / 10).alias("cm"),
        (F.col("p_partkey") * 1000).alias("bp"),
    )


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fam, id, name, value in long form: balance, number of orders, largest order."""
    who = load(spark, sf_dir, "customer")
    balance = who.select(F.col("c_custkey").alias("id"), F.lit("balance").alias("name"), F.col("c_acctbal").alias("value"))
    orders = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").cast("double").alias("n_orders"), F.max("o_totalprice").alias("top_order"))
    both = orders.unpivot(["id"], ["n_orders", "top_order"], "name", "value")
    return balance.unionByName(both).select(F.floor(F.col("id") / FAMILY).cast("long").alias("fam"), "id", "name", "value")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, i (0, 1, ... in order of time and event), level 0 to 2 from thresholds on the event value."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    level = F.when(F.col("value") >= 60, 2).when(F.col("value") >= 20, 1).otherwise(0)
    return load(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("i"), level.alias("level"), "value")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id1, id2 (id1 < id2), chrom, start_idx, stop_idx: the range of part keys of each order, as shared segments of
    the customer and the next one."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("start_idx"), F.max("l_partkey").alias("stop_idx"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias("id1"), (F.col("o_custkey") + 1).alias("id2"), (F.col("o_orderkey") % 5).cast("int").alias("chrom"), "start_idx", "stop_idx"
    )


# The same views as SQL common table expressions.
SQL = {
    "individuals": """individuals as (select cast(floor(c_custkey / 9) as bigint) as fam, c_custkey as id,
  case c_custkey % 9 when 2 then c_custkey - 2 when 4 then c_custkey - 4 when 6 then c_custkey - 4 when 7 then c_custkey - 3 when 8 then c_custkey - 2 end as father,
  case c_custkey % 9 when 2 then c_custkey - 1 when 4 then c_custkey - 3 when 6 then c_custkey - 3 when 7 then c_custkey - 2 when 8 then c_custkey - 1 end as mother,
  cast((c_custkey % 9) % 2 as int) as sex from customer)""",
    "genotypes": """genotypes as (select cast(floor(id / 9) as bigint) as fam, id, chrom_idx, marker_idx, case when l_discount <> 0 then cast(1 + l_suppkey % 2 as int) end as a0,
  case when l_discount <> 0 then cast(1 + cast(floor(l_quantity) as int) % 2 as int) end as a1
  from (select o_custkey as id, l_linenumber as chrom_idx, cast(l_partkey % 50 as int) as marker_idx, l_suppkey, l_quantity, l_discount,
    row_number() over (partition by o_custkey, l_linenumber, l_partkey % 50 order by l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) as rn
    from lineitem join orders on l_orderkey = o_orderkey) q where rn = 1)""",
    "markers": "markers as (select 0 as chrom_idx, p_partkey as marker_idx, p_name as label, p_partkey / 10.0 as cm, p_partkey * 1000 as bp from part)",
    "phenotypes": """phenotypes as (select cast(floor(id / 9) as bigint) as fam, id, name, value from (
  select c_custkey as id, 'balance' as name, c_acctbal as value from customer
  union all select o_custkey, 'n_orders', cast(count(*) as double) from orders group by o_custkey
  union all select o_custkey, 'top_order', max(o_totalprice) from orders group by o_custkey) q)""",
    "levels": """levels as (select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i,
  case when value >= 60 then 2 when value >= 20 then 1 else 0 end as level, value from events)""",
    "segments": """segments as (select o_custkey as id1, o_custkey + 1 as id2, cast(o_orderkey % 5 as int) as chrom, start_idx, stop_idx from
  (select l_orderkey, min(l_partkey) as start_idx, max(l_partkey) as stop_idx from lineitem group by l_orderkey) q join orders on l_orderkey = o_orderkey)""",
    "edges": "edges as (select fam, id, father as parent, 0 as via from individuals where father is not null union all select fam, id, mother, 1 from individuals where mother is not null)",
    "closure": """closure as (select fam, id, id as anc, 0 as steps from individuals
  union all select c.fam, c.id, e.parent, c.steps + 1 from closure c join edges e on c.fam = e.fam and c.anc = e.id)""",
    "kin": """lw as (select fam, id, anc, sum(power(0.5, steps)) as w from closure group by fam, id, anc),
d as (select fam, id, case when father is null and mother is null then 1.0 when father is null or mother is null then 0.75 else 0.5 end as d from individuals),
amat as (select x.fam, x.id as id1, y.id as id2, sum(x.w * d.d * y.w) as a from lw x join lw y on x.fam = y.fam and x.anc = y.anc join d on d.fam = x.fam and d.id = x.anc group by x.fam, x.id, y.id)""",
}


def sql(body: str, *names: str) -> str:
    """``body`` with the named views before it."""
    recursive = "recursive " if "closure" in names or "recursive" in names else ""
    return f"with {recursive}" + ",\n".join(SQL[n] for n in names if n != "recursive") + "\n" + body
