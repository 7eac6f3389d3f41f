"""Every query that has SQL gives the rows of its SQL on the smallest tables."""

from __future__ import annotations

from datetime import date, datetime

import duckdb
import pytest

from tidemark.plans import catalogue, more, passes  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, datetime):
        return v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return f"{float(v):.6f}"


@pytest.mark.parametrize("key", sorted(catalogue.SQL))
def test_against_sql(spark, duck, key):
    df = catalogue.QUERIES[key](spark, DATA)
    names = sorted(df.columns)
    want = duck.sql(catalogue.SQL[key])
    assert sorted(want.columns) == names
    got = sorted(tuple(_plain(r[c]) for c in names) for r in df.collect())
    at = [want.columns.index(c) for c in names]
    assert got == sorted(tuple(_plain(r[i]) for i in at) for r in want.fetchall())
