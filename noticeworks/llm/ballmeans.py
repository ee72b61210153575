"""Centroid clustering by ball k-means: exact Lloyd rounds that compare a vector only with the centroids near its ball."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeworks.llm.common import drop_stage, small_batches, stage

DIM = 64
K = 16
ROUNDS = 3
SCALE = 64
#: Components beyond it (either sign) would not leave room for squared distances in a long.
LARGEST = 1 << 26
#: Below it, products of components are exact in doubles.
IN_DOUBLES = 1 << 20
STATE = "vec_id long, x array<long>, cluster int, distance long, compared int"


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of `x` from the row or rows `c`."""
    if len(x) and max(np.abs(x).max(), np.abs(c).max()) <= IN_DOUBLES:
        a, b = x.astype(np.float64), np.atleast_2d(c).astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - r) ** 2).sum(axis=1) for r in np.atleast_2d(c)], axis=1) if len(x) else np.empty((0, len(np.atleast_2d(c))), dtype=np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance, centroids compared) by all centroids; ties: the smaller number."""
    d = _squares(x, c)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best], np.full(len(x), len(c))


def moved(x: np.ndarray, c: np.ndarray, was: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, distance, centroids compared) after the centroids moved to `c`, from the clusters `was` before.

    The members of a cluster are a ball round its centroid. A centroid can win a member only within twice the
    member's distance, so those beyond twice the radius are no neighbours of the ball. Members within half the
    way to the nearest neighbour are its stable core and stay; the others lie in annuli, the t-th of which meets the t
    nearest neighbours, and are compared with those. A distance that could tie is compared, so the smaller number wins.
    """
    cluster, distance, compared = was.copy(), np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=np.int64)
    apart = _squares(c, c)
    for j in np.unique(was):
        at = np.flatnonzero(was == j)
        own = _squares(x[at], c[j])[:, 0]
        distance[at] = own
        near = np.flatnonzero(apart[j] <= 4 * own.max())
        near = near[near != j]
        near = near[np.argsort(apart[j][near], kind="stable")]
        annulus = np.searchsorted(apart[j][near], 4 * own, side="right")
        compared[at] += annulus
        for t, i in enumerate(near):
            part = at[annulus > t]
            d = _squares(x[part], c[i])[:, 0]
            closer = (d < distance[part]) | ((d == distance[part]) & (i < cluster[part]))
            cluster[part[closer]], distance[part[closer]] = i, d[closer]
    return cluster, distance, compared


def _assign(centroids: np.ndarray, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            if again:
                cluster, distance, compared = moved(x, centroids, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
            else:
                cluster, distance, compared = nearest(x, centroids)
            out = [b.column("vec_id"), b.column("x"), *(pa.array(v, t) for v, t in ((cluster, pa.int32()), (distance, pa.int64()), (compared, pa.int32())))]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "x", "cluster", "distance", "compared"])

    return run


def whole(embedding: Column, dim: int = DIM, scale: int = SCALE) -> Column:
    """floor(scale * component), null unless there are `dim` components, all finite."""
    ok = (F.size(embedding) == dim) & F.forall(embedding, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    big = F.exists(embedding, lambda e: F.abs(e) > LARGEST / scale)
    cut = F.transform(embedding, lambda e: F.floor(F.lit(float(scale)) * e))
    return F.when(F.coalesce(ok, F.lit(False)), F.when(big, F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}"))).otherwise(cut))


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, dim: int = DIM) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared) for each vector kept of `vectors` (vec_id, embedding).

    Vectors with exactly `dim` components, none null or non-finite, are kept as whole numbers floor(64 * component).
    Centroids start as the `k` kept vectors whose sha256 of `seed:vec_id` is smallest (null ids last; rows of one id
    by their components; fewer vectors than `k`: as many centroids). Each round assigns every vector to the nearest
    centroid, ties to the smaller number, and moves each centroid that has vectors to the floor of their mean; then
    vectors are assigned once more. `compared` is the number of centroids that the last assignment looked at.

    The first assignment compares all centroids, later ones go by balls (see `moved`), one for each cluster of a
    batch of rows: the bounds hold for any part of a cluster, and smaller balls have fewer neighbours. Only sums
    by cluster (k rows) reach the driver. Sums and means are exact; a component beyond 2^20 in size is an error,
    as its squared distances would leave no room in a long. Repeated rows and null ids are vectors of their own; an
    empty table, or none kept, gives no rows; other columns are ignored. vec_id is read as a long.
    """
    small_batches(vectors.sparkSession)
    points = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    points = points.select("vec_id", whole(F.col("embedding"), dim).alias("x")).where("x is not null")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = points.orderBy(key.asc_nulls_last(), "x").limit(k).collect()
    if not start:
        return points.select(
            "vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("compared", "int"))]
        )
    c = np.array([r.x for r in start], dtype=np.int64)
    state = points
    for n in range(rounds):
        new = stage(state.mapInArrow(_assign(c, again=n > 0), STATE))
        if n:
            drop_stage(state)
        state = new
        sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(dim)])
        for r in sums.collect():
            c[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(dim)]
    last = stage(state.mapInArrow(_assign(c, again=rounds > 0), STATE).drop("x"))
    if rounds:
        drop_stage(state)
    by = {r.cluster: r.d for r in last.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, r.tolist())).encode()).hexdigest() for r in c]
    table = [(j, by[j], sum(by.values()), names[j]) for j in sorted(by)]
    about = vectors.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")


def op13_clusters(spark, sf_dir: str) -> DataFrame:
    """Cluster, distance and centroid of every vector kept."""
    found = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.drop("compared")


def _sql() -> str:
    parts = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INTEGER) AS cluster, x AS c FROM v
  ORDER BY sha256('1:' || vec_id), x LIMIT 16)""",
    ]
    for n in range(4):
        parts.append(
            f"""a{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT), k := cluster)) AS b
  FROM v, c{n} GROUP BY r)"""
        )
        if n < 3:
            parts.append(
                f"""s{n} AS (
  SELECT b.k AS cluster, i, sum(x[i]) AS s, count(*) AS n FROM a{n} JOIN v USING (r), range(1, 65) AS t(i) GROUP BY ALL),
m{n} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + """
SELECT vec_id, b.k AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN v USING (r) JOIN c3 ON c3.cluster = b.k"""
    )


OP13_SQL = _sql()
