"""Registered corpus queries against their SQL."""

import glob
import os

import duckdb
import pytest

from larkspur.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    con.register("got", got.toArrow())
    columns = ", ".join(sorted(want.columns))
    con.sql(f"create table want as select {columns} from ({ORACLE_SQL[name]})")
    for a, b in (("want", "got"), ("got", "want")):
        assert con.sql(f"select {columns} from {a} except all select {columns} from {b}").fetchall() == []
    assert con.sql("select count(*) from want").fetchall()[0][0] > 0
