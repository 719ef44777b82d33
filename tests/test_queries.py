"""Every query with SQL gives the rows that the SQL gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from evalloom import queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.queries(), queries.oracle_sql()


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, int | float | bool) else str(v)

    return sorted(repr([plain(v) for v in row]) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
