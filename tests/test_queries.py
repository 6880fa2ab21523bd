"""Every query that has SQL gives the same rows as the SQL."""

import math

import pytest

import __spark_entry__
from loomwork.plans import catalogue


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    try:
        return round(float(v), 5)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def con(small):
    import duckdb

    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split():
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, small, con, name):
    got = catalogue.QUERIES[name](spark, small)
    rows = got.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    key = lambda rows: sorted(repr([plain(v) for v in r]) for r in rows)
    assert key([r[c] for c in columns] for r in rows) == key([r[want.columns.index(c)] for c in columns] for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["doc_id", "source", "score", "origins", "head_sha256"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
