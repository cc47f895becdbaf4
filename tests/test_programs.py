from pyspark.sql import functions as F

from kindred.plans import programs
from kindred.streaming.sessions import session_runs

SIBS = [("f", "1", None, None, 0), ("f", "2", None, None, 1), ("f", "3", "1", "2", 0), ("f", "4", "1", "2", 1)]


def test_sharing_under_the_null(spark):
    people = spark.createDataFrame(SIBS, "fam string, id string, father string, mother string, sex int")
    markers = spark.createDataFrame([(0, 0, 0.0, 0.5)], "chrom_idx int, marker_idx int, cm double, maf double")
    row = programs.sharing_null(people, markers, people.filter("id in ('3', '4')"), 200, 5).first()
    assert row.spairs_min == 0 and row.spairs_max == 2 and 0.8 < row.spairs_mean < 1.2 and 0.6 < row.sbool_mean < 0.9
    assert [r.value for r in programs.founder_sharing_constraints(people, people.filter("id = '3'"), "1", 0, 0).collect()] == ["ibd f 3 1 0 0 P"]
    kin, inbred = programs.kinships(people)
    assert kin.filter("id1 = '3' and id2 = '4'").first().kinship == 0.25 and inbred.filter("inbreeding > 0").count() == 0


def test_pool_keeps_frequencies(spark):
    markers = spark.createDataFrame([(0, 0, 0.0, 0.5), (0, 1, 50.0, 0.5)], "chrom_idx int, marker_idx int, cm double, maf double")
    pool, size = programs.grow_pool(markers, 100, lambda g: 100 + 50 * g, 2, 3)
    assert size == 200 and pool.count() == 400
    assert 0.3 < pool.agg(F.avg((F.col("allele") == 2).cast("double"))).first()[0] < 0.7


def test_sessions_of_a_table_and_a_stream(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, m) as ts, u, v from values (0, 1, 9), (10, 1, 9), (200, 1, 9), (5, 2, 1) t(m, u, v)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = session_runs(spark.read.parquet(str(tmp_path / "in")), "u", "ts", F.col("v") > 5)
    assert [(r.u, r.n) for r in batch.collect()] == [(1, 2)]
    stream = session_runs(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "u", "ts", F.col("v") > 5)
    q = stream.writeStream.outputMode("append").format("memory").queryName("runs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    # the watermark, two hours before the last event, has passed the first session and not the second
    assert [(r.u, r.n, r.stop.minute) for r in spark.table("runs").collect()] == [(1, 2, 10)]
