"""Centroid clustering in exact integers, screened by block norms.

A vector of 64 integers is compressed to the Euclidean norms of its 8 segments, once, and a centroid in every round. By
Cauchy-Schwarz in each segment, |v - c|^2 >= |v|^2 + |c|^2 - 2 * sum of |v_s| * |c_s|. The centroid with the least bound is
measured first; one whose bound exceeds that distance cannot be nearer or as near, so only the others are measured, in
integers. The bound is lowered by more than its rounding error, so screening never changes an assignment.

Each round is one pass over the packed vectors; a task gives one row of sums for each cluster, so what is shuffled and the
driver's 16 x 64 totals don't grow with the table. No row is dealt by a key.

Defined cases: vectors that are null, of another length, or with null or non-finite components are left out, and so are
those with an integer component beyond MOST in magnitude, as their squared distances would not fit a long; fewer kept
vectors than centroids give as many centroids as vectors; a null vec_id stands for an empty one in the hash, and repeated
ids are chosen in order of their components; an inertia that does not fit a long is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored

COMPONENTS, SEGMENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 16, 3, 64, 1
MOST = 1 << 27
#: Rows of an Arrow batch that are measured together.
STEP = 8192


def packed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector, norms): kept vectors as little-endian 32-bit integers, and the norms of their segments as doubles; written to the shared folder."""
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(F.floor(x * SCALE).cast("double")) > MOST) | (F.abs(x) > MOST))
    kept = own.where((F.size("v") == COMPONENTS) & ~bad)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            v = np.floor(flat * SCALE).astype("<i4").reshape(-1, COMPONENTS)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in block_norms(v)], pa.binary())], ["id", "vector", "norms"])

    return stored(kept.mapInArrow(pack, "id long, vector binary, norms binary"), "vectors")


def block_norms(v: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row."""
    parts = v.astype(np.float64).reshape(len(v), SEGMENTS, -1)
    return np.sqrt((parts * parts).sum(axis=2))


def bounds(norms: np.ndarray, of_centroids: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of each vector to each centroid, below the true bound by more than rounding can add."""
    square = (norms * norms).sum(axis=1)[:, None] + (of_centroids * of_centroids).sum(axis=1)[None, :]
    return square - 2 * norms @ of_centroids.T - 1e-12 * square - 1e-6


def assigned(v: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (the smaller number on ties), its squared distance, and how many distances were measured."""
    low = bounds(norms, block_norms(centroids))
    v, rows = v.astype(np.int64), np.arange(len(v))

    def measured(at: np.ndarray, which: int | np.ndarray) -> np.ndarray:
        apart = v[at] - centroids[which]
        return np.einsum("ij,ij->i", apart, apart)

    cluster = low.argmin(axis=1)
    distance = measured(rows, cluster)
    first, n = cluster.copy(), len(v)
    for k in range(len(centroids)):
        at = np.flatnonzero((low[:, k] <= distance) & (first != k))
        d = measured(at, k)
        nearer = (d < distance[at]) | ((d == distance[at]) & (k < cluster[at]))
        cluster[at[nearer]], distance[at[nearer]] = k, d[nearer]
        n += len(at)
    return cluster, distance, n


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for start in range(0, batch.num_rows, STEP):
        part = batch.slice(start, STEP)
        v, norms = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(part.num_rows, -1) for c, kind in (("vector", "<i4"), ("norms", "<f8")))
        yield part, v, norms


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:id`, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = vectors.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()
    return np.frombuffer(b"".join(bytes(r["vector"]) for r in found), "<i4").reshape(-1, COMPONENTS).astype(np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: exact floors of the means of their vectors; one without vectors stays."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, norms in _rows(batch):
                cluster = assigned(v, norms, centroids)[0]
                for k in np.unique(cluster):
                    mine = v[cluster == k]
                    total[k] += mine.sum(axis=0, dtype=np.int64)
                    count[k] += len(mine)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(count[used], pa.int64()), "sums": pa.array(total[used].tolist(), pa.list_(pa.int64()))})

    parts = vectors.mapInArrow(sums, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
    out = centroids.copy()
    for r in parts.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
    return out


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(id_col, cluster, distance) of every kept vector after the rounds, and the final centroids."""
    kept = packed(vectors, id_col, vector_col)
    centroids = first_centroids(kept, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, v, norms in _rows(batch):
                cluster, distance, _ = assigned(v, norms, centroids)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    found = stored(kept.mapInArrow(measure, "id long, cluster int, distance long"), "clusters")
    return found.withColumnRenamed("id", id_col), centroids


def digests(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with the inertia of each row's cluster and of all, and the digest of its centroid."""
    spark = found.sparkSession
    names = spark.createDataFrame([(k, ",".join(map(str, c.tolist()))) for k, c in enumerate(centroids)], "cluster int, components string")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("mine"))
    total = sums.agg(F.sum("mine").alias("all"))
    about = names.join(sums, "cluster").crossJoin(total).select(
        "cluster", F.col("mine").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), F.sha2("components", 256).alias("centroid_sha256")
    )
    return found.join(F.broadcast(about), "cluster").select(*[c for c in found.columns if c not in ("cluster", "distance")], "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
