"""Tables written between rounds look small to Spark, as their files compress well: no join of a gene drop broadcasts them."""

from kindred import catalog as C
from kindred import views as V
from kindred.operators import genealogy as G
from kindred.operators import individuals as P
from kindred.simulation import drop as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_join_of_a_drop_is_broadcast(spark, monkeypatch):
    seen = []
    kept = D.cut
    monkeypatch.setattr(D, "cut", lambda df, *a: (seen.append(plan(df)), kept(df, *a))[1])
    people, m = V.individuals(spark, "/root/testdata/sf0.001"), C._small_map(spark)
    who = P.founders(people)
    dropped = D.gene_drop(people, m, D.founder_labels(who, ["fam", "id"], m), 5)
    filled = D.delabel(D.spans(dropped, ["fam", "id"]), D.equilibrium_haplotypes(who, ["fam", "id"], m, 24), ["fam", "id"])
    seen += [plan(D.ibd_states(dropped, people)), plan(filled)]
    assert len(seen) > 5 and not [p for p in seen if "BroadcastHashJoin" in p]


def test_no_join_of_the_kinship_is_broadcast(spark, monkeypatch):
    seen = []
    kept = G.cut
    monkeypatch.setattr(G, "cut", lambda df, *a: (seen.append(plan(df)), kept(df, *a))[1])
    people = V.individuals(spark, "/root/testdata/sf0.001")
    seen.append(plan(G.kinship_of(people, people.select("fam", "id").toDF("fam", "id1").withColumn("id2", C.F.col("id1")))))
    assert len(seen) > 5 and not [p for p in seen if "BroadcastHashJoin" in p]


def test_marker_tables_are_not_broadcast(spark):
    """a table of markers made by an explode is larger than Spark takes it for."""
    from kindred.operators import sgs
    from kindred.sources import variants

    s, d, lit = spark, "/root/testdata/sf0.001", C.F.lit
    seg = V.segments(s, d).select(lit("1").alias("fam1"), "id1", lit("1").alias("fam2"), "id2", C.F.col("chrom").cast("string").alias("chrom"), (C.F.col("start_idx") * 1000).alias("bp_start"), (C.F.col("stop_idx") * 1000).alias("bp_stop"))
    m = V.markers(s, d).select(C.F.explode(C.F.array(*[lit(str(c)) for c in range(5)])).alias("chrom"), "bp", "marker_idx", "label")
    lines = variants.germline_lines(seg.withColumns({"start_idx": lit(0), "stop_idx": lit(1)}), m)
    for df in (sgs.update_references(seg, m), lines):
        text = df._jdf.queryExecution().sparkPlan().toString()  # before it runs
        assert text.count("SortMergeJoin [chrom") == 2


def test_pairs_of_families_are_not_broadcast(spark, monkeypatch):
    """customers as pairs of a family grow with the table, and were sent through the driver three times."""
    from kindred import catalog_more as M

    seen = []
    kept = G.cut
    monkeypatch.setattr(G, "cut", lambda df, *a: (seen.append(plan(df)), kept(df, *a))[1])
    seen.append(plan(C.QUERIES["kinship_asked"](spark, "/root/testdata/sf0.001")))
    assert len(seen) > 5 and not [p for p in seen if "BroadcastHashJoin" in p]
    assert not [m for _, m in M._family_model(spark, "/root/testdata/sf0.001").effects if "Broadcast" in plan(m)]


def test_no_join_of_a_descent_drop_is_broadcast(spark, monkeypatch):
    """neither the pins nor the constrained drop send a table of people through the driver."""
    from kindred import catalog_more  # noqa: F401

    seen = []
    for module in (D, G):
        kept = module.cut
        monkeypatch.setattr(module, "cut", lambda df, *a, kept=kept: (seen.append(plan(df)), kept(df, *a))[1])
    seen.append(plan(C.QUERIES["descent_drop"](spark, "/root/testdata/sf0.001")))
    assert len(seen) > 10 and not [p for p in seen if "BroadcastHashJoin" in p]
