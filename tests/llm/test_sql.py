"""Queries that have SQL, against it, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from siftspark.llm.queries import ORACLE, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, DIR).toPandas()
    if name in ORACLE:
        con = duckdb.connect()
        for f in glob.glob(f"{DIR}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        want = con.execute(ORACLE[name]).df()
        assert sorted(map(tuple, got[sorted(got.columns)].values)) == sorted(map(tuple, want[sorted(want.columns)].values))
    assert len(got) > 0
