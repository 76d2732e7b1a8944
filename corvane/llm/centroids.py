"""Centroid clustering in whole numbers with an incremental distance matrix.

Components are turned into whole numbers, so every sum and every comparison is exact and the result
doesn't depend on partitions. For each vector a table keeps its dot products with all centroids. A
round needs one pass over it: the products are brought up to date with the components of each
centroid that changed (``dots[k] += x[changed] . change``), and the nearest centroid is the smallest
``|c|^2 - 2 dots``; a vector's own square is the same for all of them and only enters distances.

Each round writes its table into the shared folder and removes the one before, so the lineage is one
table long, a lost executor's tasks are run again from it, and the disk holds two tables at most. The
driver sees the centroids' component sums (``k`` x ``dims`` numbers, added up by tasks and by Spark)
and sends back the changes. When no centroid changed, later rounds would change nothing and are left out.

Defined cases: vectors that are null, of another length, or with a null, NaN or infinite component are
left out. Repeated rows are vectors of their own. Ties go to the smaller centroid number. Vectors without
an id are clustered, but don't start a centroid; among equal ids the smaller vector comes first. With
fewer than ``k`` starting vectors there are as many centroids as those; without any, no rows come out.
Other columns are ignored. A whole-number component of 2^27 or more raises OverflowError, since squared
distances may then not fit a long; a sum of distances beyond a long raises Spark's overflow error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import removed, shared_dir

CENTROIDS, ROUNDS, DIMS, SCALE = 40, 5, 64, 256
SALT = "2:"
LARGEST = 1 << 27


def whole(batch: pa.Array, scale: float) -> np.ndarray:
    """Rows of whole numbers: floor(scale * component)."""
    x = np.floor(batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(x) and np.abs(x).max() >= LARGEST:
        raise OverflowError(f"a component of {np.abs(x).max():.0f} is too large for exact distances")
    return x.astype(np.int64)


def nearest(dots: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each row, and the squared distance to it."""
    cost = (centroids * centroids).sum(1) - 2 * dots
    best = cost.argmin(1)  # the first of equals
    return best, cost[np.arange(len(x)), best] + (x * x).sum(1)


def updated(dots: np.ndarray, x: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after the centroids' change, by their changed components only."""
    out = dots.copy()
    for k in np.flatnonzero(change.any(1)):
        moved = np.flatnonzero(change[k])
        out[:, k] += x[:, moved] @ change[k, moved]
    return out


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _table(ids: pa.Array, x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    best, distance = nearest(dots, x, centroids)
    return pa.RecordBatch.from_arrays([ids, _lists(x.astype(np.int32)), _lists(dots), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "x", "dots", "cluster", "distance"])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task: vectors and component sums of each cluster."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        if not b.num_rows:
            continue
        of = b.column(0).to_numpy()
        x = _matrix(b.column(1), len(b.column(1)[0]))
        x = np.c_[np.ones(len(x), np.int64), x][np.argsort(of, kind="stable")]
        k, at = np.unique(np.sort(of), return_index=True)
        for c, s in zip(k.tolist(), np.add.reduceat(x, at), strict=True):
            total[c] = total[c] + s if c in total else s
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), _lists(np.stack(list(total.values())))], names=["cluster", "sums"])


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, salt: str = SALT, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Every kept vector's ``vec_id``, ``x`` (whole numbers), ``dots``, ``cluster`` and ``distance``; and the centroids."""
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`")
    kept = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), v.alias("vector"))
    kept = kept.where((F.size("vector") == dims) & F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    first = kept.where("vec_id IS NOT NULL").orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "vector").limit(k).select("vector").toArrow()
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, x array<int>, dots array<long>, cluster int, distance long"
    if not first.num_rows:
        return spark.createDataFrame([], schema), np.empty((0, dims), np.int64)
    centroids = whole(first.column(0).combine_chunks(), scale).reshape(-1, dims)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = whole(b.column(1), scale).reshape(-1, dims)
            yield _table(b.column(0), x, x @ centroids.T, centroids)

    def step(change: np.ndarray, now: np.ndarray) -> Callable:
        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(1), dims)
                yield _table(b.column(0), x, updated(_matrix(b.column(2), len(now)), x, change), now)

        return move

    root = f"{shared_dir(spark)}/centroids-{uuid.uuid4().hex}"

    def kept_as(df: DataFrame, n: int) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{root}/round-{n}")
        return spark.read.schema(schema).parquet(f"{root}/round-{n}")

    table = kept_as(kept.mapInArrow(begin, schema), 0)
    for n in range(rounds):
        part = table.select("cluster", "x").mapInArrow(_sums, "cluster int, sums array<long>")
        rows = part.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect()  # k x (dims + 1) at most
        sums = np.zeros((len(centroids), dims + 1), np.int64)
        for r in rows:
            sums[r.cluster, r.pos] = r.s
        now = centroids.copy()
        some = sums[:, 0] > 0
        now[some] = sums[some, 1:] // sums[some, :1]
        change = now - centroids
        if not change.any():
            break
        table = kept_as(table.select("vec_id", "x", "dots").mapInArrow(step(change, now), schema), n + 1)
        removed(spark, f"{root}/round-{n}")
        centroids = now
    return table, centroids


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    inertia = {r.cluster: r.s for r in table.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid at most
    rows = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return table.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """The rounds written out one after the other: c: centroids, d: distances, a: assignments."""
    out = [
        f"""k AS MATERIALIZED (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
        v AS MATERIALIZED (SELECT vec_id, unnest(range({DIMS})) AS j, floor({SCALE} * unnest(e)::DOUBLE)::BIGINT AS x FROM k),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS c FROM k ORDER BY sha256('{SALT}' || vec_id) LIMIT {k}),
        c0 AS MATERIALIZED (SELECT c, j, x AS w FROM s JOIN v USING (vec_id))"""
    ]
    for n in range(rounds + 1):
        out.append(f"a{n} AS MATERIALIZED (SELECT vec_id, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - w) * (x - w))::BIGINT AS d FROM v JOIN c{n} USING (j) GROUP BY ALL) GROUP BY vec_id)".replace("min_by(c, (d, c))", "min({'d': d, 'c': c}).c"))
        if n < rounds:
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c, j, coalesce((s - ((s % n) + n) % n) // n, w) AS w FROM c{n} LEFT JOIN (SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{n} USING (vec_id) GROUP BY c, j) USING (c, j))")
    return f"""WITH {", ".join(out)}, h AS (SELECT c, sha256(string_agg(w::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
        SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (c)"""


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}
ORACLE = {"op13_centroid_clustering": _sql()}
