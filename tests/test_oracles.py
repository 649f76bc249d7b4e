"""Every registered query of the reference's own operators against its SQL, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb
import pytest

from tidemark.plans import queries_checks, queries_corpus, queries_lineage

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {**queries_corpus.QUERIES, **queries_lineage.QUERIES, **queries_checks.QUERIES}
ORACLES = {**queries_corpus.ORACLES, **queries_lineage.ORACLES, **queries_checks.ORACLES}
EMPTY = {"w4_validate"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return None
    if isinstance(x, bool):
        return ("bool", x)
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, int):
        return float(x)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows, names = df.collect(), sorted(df.columns)
    r = duck.execute(ORACLES[name])
    cols = [x[0] for x in r.description]
    want = r.fetchall()
    assert names == sorted(cols)
    got = sorted((tuple(plain(x[c]) for c in names) for x in rows), key=repr)
    assert got == sorted((tuple(plain(x[cols.index(c)]) for c in names) for x in want), key=repr)
    assert got or name in EMPTY
