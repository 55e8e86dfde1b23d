"""Every query of the catalogue against its SQL."""

import math
import os

import duckdb
import pandas as pd
import pytest

from plumbframe.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows_of(df):
    df = df[sorted(df.columns)]
    return sorted([tuple(None if pd.isna(v) else v for v in r) for r in df.astype(object).itertuples(index=False)], key=repr)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (p is not None and q is not None and str(p) == str(q)) or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and math.isclose(p, q, rel_tol=1e-12)) for p, q in zip(x, y, strict=True)), (x, y)
