import glob
import math
import os

import duckdb
import pytest

from lexmill.plans import catalog

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def one(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


def test_every_query_has_sql():
    assert catalog.QUERIES.keys() == catalog.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, D)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(r[:] for r in got.select(*columns).collect()) == plain(want.select(*columns).fetchall())
