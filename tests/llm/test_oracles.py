"""Queries against their SQL, on the smallest tables and on odd texts."""

import os

import duckdb
import pytest

from plumbframe.llm.queries import ORACLES, QUERIES
from tests.test_catalogue import rows_of

SF = "/root/testdata/sf0.001"


def compare(spark, name, folder, pattern):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}{pattern}'")
    where = folder if folder.startswith("/root") else f"file://{folder}"
    got, want = QUERIES[name](spark, where).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = ([tuple(float(v) if isinstance(v, int | float) else v for v in r) for r in rows_of(df)] for df in (got, want))
    a, b = sorted(a, key=repr), sorted(b, key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ORACLES)
def test_on_the_smallest_tables(spark, name):
    compare(spark, name, SF, "")


def test_licenses_on_odd_texts(spark, tables):
    texts = ["GNU Lesser General Public License version 2.1 or later, under the MIT license", "Licensed under the GNU General Public License v3. Licensed under the Apache License, Version 2.0", "license: cc-by-nc-sa 4.0 CC BY NC SA license", "é licence MIT licence é", "spdx license identifier BSD 3 clause", "the the mit license under the mit license under the mit license", "Creative Commons Attribution NonCommercial", "mit", "", None, "x cc0 1.0 universal", "Boost Software License 1.0 licensed"]
    d = tables(documents=[(i, t) for i, t in enumerate(texts)])
    compare(spark, "op10_licenses", d.removeprefix("file://"), "/*.parquet")
