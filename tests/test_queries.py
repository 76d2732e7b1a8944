"""Every registered query of the reference's operators against its SQL, over the smallest tables."""

import math

import duckdb
import pytest

from corvane import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    cols = sorted(df.columns)
    if name not in catalog.oracle_sql():  # compared with brute force elsewhere
        assert df.count() > 0
        return
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    res = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in res.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 12
