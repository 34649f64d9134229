"""Every query of the catalogue runs; those with SQL equal DuckDB's result."""

import glob
import os

import duckdb
import pytest

from workrisk.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in ORACLES:
        assert df.columns
        return
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    assert got == want
