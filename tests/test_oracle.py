"""Every registered query of the price model against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import pricerank.queries_storage  # noqa: F401
from pricerank.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(value(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert normal(map(tuple, got.collect()), got.columns) == normal(want.fetchall(), columns)
