"""Each query against its SQL."""

import glob
import os

import duckdb
import pytest

from cairnset.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    df = queries()[name](spark, SF)
    found = con.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    assert sorted(map(str, found.fetchall())) == sorted(map(str, rows))
