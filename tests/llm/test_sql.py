"""Queries of the corpus operators that SQL can express equal DuckDB on a small copy of the tables."""

import duckdb
import pandas as pd
import pytest

pytest.importorskip("kindred.llm")
from kindred.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda v: None if pd.isna(v) else str(v) if isinstance(v, str) else str(int(v))
    return sorted(str(tuple(map(one, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
