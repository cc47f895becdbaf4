"""The nearest marker by buckets that follow the rows: equal probes are one row of the windows, few places share a bucket."""

import pytest

from kindred.operators import intervals as I


@pytest.mark.parametrize("held", [2, 4096])
def test_nearest_with_equal_and_missing_probes(spark, monkeypatch, held):
    monkeypatch.setattr(I, "HELD", held)
    marks = [(0, b, k) for k, b in enumerate((5, 10, 40, 90_000, 260_000))]
    at = [7, 8, 7, 7, -3, 25, 26, 400_000, 175_000, 175_001, None, 260_000]
    probes = spark.createDataFrame([(n, 0, p) for n, p in enumerate(at)] + [(99, 1, 7)], "n int, c int, pos long")
    found = I.nearest(probes, spark.createDataFrame(marks, "c int, bp long, marker_idx long"), ["c"])
    got = {r.n: r.marker_idx for r in found.collect()}
    want = {n: min((abs(b - p), b, k) for _, b, k in marks)[2] for n, p in enumerate(at) if p is not None} | {99: None}
    assert got == want


def test_rows_of_the_windows_do_not_grow_with_equal_probes(spark):
    probes = spark.range(20_000).selectExpr("id", "0 as c", "id % 10 as pos")
    found = I.nearest(probes, spark.range(3).selectExpr("0 as c", "id * 4 as bp", "id as marker_idx"), ["c"])
    assert found.count() == 20_000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [c#" in plan.split("Window")[-1]
