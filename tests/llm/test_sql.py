"""The queries of the subpackage that SQL expresses give the rows of their SQL."""

import glob
import os

import duckdb
import pytest

from evalloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    theirs = c.sql(queries.oracle_sql()[name])
    columns = sorted(theirs.columns)
    ours = queries.queries()[name](spark, SF)
    assert sorted(ours.columns) == columns
    want = sorted((dict(zip(theirs.columns, r, strict=True)) for r in theirs.fetchall()), key=str) if hasattr(theirs, "fetchall") else []
    got = [r.asDict() for r in ours.collect()]
    assert sorted([[r[k] for k in columns] for r in got], key=str) == sorted([[r[k] for k in columns] for r in want], key=str)
