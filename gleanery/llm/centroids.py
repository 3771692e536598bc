"""Plain Lloyd clustering in integers.

A vector's components become floor(scale * x), x as double. The first centroids are the k
vectors whose ``<seed>:<vec_id>`` has the smallest SHA-256. A round broadcasts the
centroids (k times the dimensions, whatever the table's size); each task takes integer
squared differences to one centroid after the other in NumPy, gives each vector to the
first of the nearest, and hands on one row of integer sums for each centroid that it met.
A groupBy adds those rows, and k rows come to the driver, where each centroid with
vectors becomes the floor of its mean. All sums are integers, so neither the order of
rows nor a task that runs again changes a result. The last assignment is written to the
shared folder once; inertias are summed from there.

Cases: vectors that are null, have another number of components, or hold a null or
non-finite one take no part, nor do rows with a null vec_id; rows that repeat count each
(their hashes tie, then components decide); with fewer than k vectors there are as many
centroids as vectors; a centroid without vectors stays where it is; an empty table gives
no rows; other columns are left out, also those named like a result. Quantised components
have to lie within 2**26, so that squared distances fit in 64 bits; one beyond is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

K = 16
DIMENSIONS = 64
ROUNDS = 3
SCALE = 64.0
SEED = "1"
LARGEST = 1 << 26
ROWS = 4096  # whose differences are held at once
SUMS = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vec_id: Column, embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a row takes part; never NULL."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vec_id.isNotNull() & F.coalesce((F.size(embedding) == dimensions) & fine, F.lit(False))


def quantised(vectors: pd.Series, scale: float, dimensions: int) -> np.ndarray:
    """A row of integers for each vector."""
    flat = np.concatenate(vectors.to_list()).astype(np.float64).reshape(-1, dimensions) if len(vectors) else np.zeros((0, dimensions))
    flat = np.floor(scale * flat)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component times {scale} lies beyond {LARGEST}: squared distances would not fit in 64 bits")
    return flat.astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each vector's nearest centroid, the smaller of equals, and the squared distance."""
    most = int(np.abs(vectors).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    kind = np.int32 if most * most * vectors.shape[1] < 1 << 31 else np.int64
    distances = np.empty((len(centroids), len(vectors)), np.int64)
    narrow = vectors.astype(kind)
    for c, centroid in enumerate(centroids.astype(kind)):
        difference = narrow - centroid
        distances[c] = np.einsum("ij,ij->i", difference, difference)
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(vectors))]


def _parts(frames: Iterator[pd.DataFrame], scale: float, dimensions: int) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        for i in range(0, len(frame), ROWS):
            part = frame.iloc[i : i + ROWS]
            yield part["vec_id"], quantised(part["embedding"], scale, dimensions)


def _summer(centroids, scale: float, dimensions: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = centroids.value
        n, sums = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for _, vectors in _parts(frames, scale, dimensions):
            cluster, _ = nearest(vectors, at)
            counts = np.bincount(cluster, minlength=len(at))
            n += counts
            for c in np.flatnonzero(counts).tolist():
                sums[c] += vectors[cluster == c].sum(axis=0)
        met = np.flatnonzero(n)
        if len(met):
            yield pd.DataFrame({"cluster": met.astype(np.int32), "n": n[met], "sums": sums[met].tolist()})

    return run


def _assigner(centroids, scale: float, dimensions: int) -> Callable:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, vectors in _parts(frames, scale, dimensions):
            cluster, distance = nearest(vectors, centroids.value)
            yield pd.DataFrame({"vec_id": ids.to_numpy(), "cluster": cluster.astype(np.int32), "distance": distance})

    return run


def first_centroids(kept: DataFrame, k: int, scale: float, seed: str, dimensions: int) -> np.ndarray:
    """The k vectors of least hash, in its order: a top-k of hashes in the tasks, k rows on the driver."""
    hashed = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("hash"), "embedding")
    rows = hashed.orderBy("hash", "embedding").limit(k).collect()
    return quantised(pd.Series([np.array(r["embedding"], np.float64) for r in rows], dtype=object), scale, dimensions)


def moved(centroids: np.ndarray, totals: DataFrame) -> np.ndarray:
    """The centroids after a round, from the tasks' rows of sums."""
    wide = centroids.shape[1]
    merged = totals.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(wide))).alias("sums"))
    out = centroids.copy()
    for row in merged.collect():  # a row for each centroid
        out[row["cluster"]] = [total // row["n"] for total in row["sums"]]
    return out


def lloyd(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: float = SCALE, seed: str = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """The final assignment (vec_id, cluster, distance), written once, and the centroids. vectors: vec_id, embedding (an array of numbers)."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("vec_id"), F.col("embedding"), dimensions))
    centroids = first_centroids(kept, k, scale, seed, dimensions)
    if not len(centroids):
        return spark.createDataFrame([], ASSIGNED), centroids
    for _ in range(rounds):
        told = spark.sparkContext.broadcast(centroids)
        centroids = moved(centroids, kept.mapInPandas(_summer(told, scale, dimensions), SUMS))
        told.destroy()
    told = spark.sparkContext.broadcast(centroids)
    out = common.staged(kept.mapInPandas(_assigner(told, scale, dimensions), ASSIGNED), "centroid-clusters")
    told.destroy()
    return out, centroids


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assignment with each cluster's inertia, all clusters' and the hash of the centroid."""
    spark = assigned.sparkSession
    own = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row for each centroid
    rows = [(c, own.get(c, 0), sum(own.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(*(part.split()[0] for part in RESULT.split(", ")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(*lloyd(common.table(spark, sf_dir, "embeddings")))


def _sql(rounds: int = ROUNDS, k: int = K) -> str:
    """Rounds unrolled. Integer division of DuckDB cuts towards zero, so the remainder is made positive first."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('{SEED}:' || vec_id) AS h, e FROM v ORDER BY h, e LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, e, c, d FROM (SELECT v.r, v.vec_id, v.e, c.c, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{i}) GROUP BY 1, 2),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS e FROM s{i} GROUP BY 1),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)""")
    last = f"""SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.c"""
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
