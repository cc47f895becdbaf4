"""Every registered query with SQL gives the same rows as DuckDB on a small copy of the tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from kindred import catalog_more, catalog_simulation  # noqa: F401
from kindred.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(frame):
    frame = frame[sorted(frame.columns)]

    def one(v):
        if v is None or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
            return None
        if isinstance(v, (float, np.floating)) and float(v).is_integer():
            return str(int(v))  # pandas makes whole numbers with nulls floats
        if isinstance(v, (bool, np.bool_)):
            return str(int(v))
        if isinstance(v, (float, np.floating)):
            return repr(round(float(v), 9))
        if isinstance(v, (int, np.integer)):
            return str(int(v))
        return v

    return sorted(str(tuple(map(one, row))) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", ["sgs_segments", "lmm_ml", "assoc_scan", "drift", "linkage_families"])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_imports_without_the_corpus_part():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
