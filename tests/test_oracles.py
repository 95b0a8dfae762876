"""Every registered query of the core library that SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import pytest

from granary.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).removesuffix('.parquet')} as select * from '{p}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(tidy(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(registry.oracle_sql()[name])
    want = rows([c[0] for c in found.description], [tuple(float(v) if type(v).__name__ == "Decimal" else v for v in r) for r in found.fetchall()])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-5) for x, y in zip(a, b)), (a, b)
