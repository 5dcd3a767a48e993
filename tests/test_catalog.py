"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from lodestar.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1e-8


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLE:
        assert df.columns
        return
    want = con.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    a = sorted(want.fetchall(), key=key)
    b = sorted((tuple(r[c] for c in want.columns) for r in rows), key=key)
    assert len(a) == len(b) and all(close(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def test_flagship(spark, sf):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["status"] == "supported" for r in rows)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
