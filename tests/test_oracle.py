"""Every registered query against its SQL twin in DuckDB, on the smallest tables."""

from pathlib import Path

import pytest

from hybridsearch.plans.oracle import ORACLE_SQL
from hybridsearch.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not there")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, str(DATA))
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda row: tuple((v is None, str(type(v)), v) for v in row)
    plain = lambda v: float(v) if isinstance(v, float) else v
    a = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(plain(v) for v in r) for r in want.select(*columns).fetchall()), key=key)
    assert a == b
