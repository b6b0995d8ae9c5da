"""Every registered query with SQL against DuckDB, over the smallest tables."""

import duckdb
import pytest

from callgrid.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return con


def plain(rows, names):
    def one(v):
        return round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), names)
