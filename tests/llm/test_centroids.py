"""Centroid clustering against plain whole-number k-means."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from corvane.llm import centroids as ce


def slow(rows, k, rounds, dims, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    c = [v for _, v in first]
    if not c:
        return []
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr)


@pytest.mark.parametrize(("seed", "k", "rounds"), [(0, 5, 5), (1, 3, 1), (2, 8, 12), (3, 30, 2)])
def test_same_as_plain_k_means(spark, seed, k, rounds):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=4).round(1)]) for i in range(60)]
    rows += [(1, rows[0][1]), (1, rows[0][1]), (None, rows[1][1]), (101, None), (102, [1.0, 2.0]), (103, [1.0, None, 0.0, 0.0]), (104, [math.nan, 0.0, 0.0, 0.0]), (105, [math.inf, 0.0, 0.0, 0.0]), (106, []), (107, [0.0] * 4), (108, [-0.0] * 4)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, x int").repartition(3)
    table, c = ce.cluster(df, k, rounds, 4)
    assert len(c) == k
    assert sorted(map(tuple, table.select("vec_id", "cluster", "distance").collect()), key=repr) == slow(rows, k, rounds, 4)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<double>"
    table, c = ce.cluster(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0])], schema), 40, 5, 2)
    assert len(c) == 2 and [r.cluster for r in table.collect()] == [0, 0]
    table, c = ce.cluster(spark.createDataFrame([], schema), 40, 5, 2)
    assert table.count() == 0 and len(c) == 0


def test_too_large(spark):
    df = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        ce.cluster(df, 1, 1, 2)


def test_update_touches_changed_components_only():
    rng = np.random.default_rng(0)
    x, a = rng.integers(-9, 9, (50, 6)), rng.integers(-9, 9, (4, 6))
    b = a.copy()
    b[1, 2] += 5
    b[3, :2] -= 1
    assert (ce.updated(x @ a.T, x, b - a) == x @ b.T).all()


def test_query_and_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    got = ce.op13_centroid_clustering(spark, d)
    res = con.execute(ce.ORACLE["op13_centroid_clustering"])
    names = [c[0] for c in res.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(res.fetchall())
