"""Each registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

from slidejobs.jobs.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in SF.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    assert got
    if name in SQL:
        cur = duck.execute(SQL[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        want = [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in cur.fetchall()]
        assert got == rows_of(want, columns)
