"""Every query of the library against its SQL, over the smallest tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from quillspark.plans import queries as plans  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    answer = duck.execute(plans.SQL[name])
    columns = [d[0] for d in answer.description]
    want = sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in answer.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)
