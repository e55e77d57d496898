"""Every registered query of the main catalogue against its DuckDB oracle."""

import hashlib

import duckdb
import pytest

from ledgerline.plans.catalogue import ORACLES, QUERIES
from ledgerline.sources.tables import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def digest(rows):
    return hashlib.md5("\n".join(sorted(map(repr, rows))).encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    if name not in ORACLES:
        assert got
        return
    result = duck.execute(ORACLES[name])
    named = [c[0] for c in result.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in result.fetchall()]
    assert len(got) == len(want)
    assert digest(got) == digest(want)
