"""Each query of the catalogue against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from gleanline.plans.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v) if hasattr(v, "isoformat") else round(float(v), 9)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    want = con.execute(ORACLE_SQL[name])
    own = [d[0] for d in want.description]
    assert sorted(own) == columns
    want = [tuple(plain(r[own.index(c)]) for c in columns) for r in want.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(got, key=key) == sorted(want, key=key)
