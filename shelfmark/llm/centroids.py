"""Centroid clustering with Ptolemaic pivots.

Method: a few fixed pivots, in pairs, are chosen once, and every vector keeps
its distances to them.  By Ptolemy's inequality, for pivots p and s,

    d(v, c) >= |d(v, p) d(c, s) - d(v, s) d(c, p)| / d(p, s),

so eight cached numbers of a vector and eight of each centroid bound every
distance from below.  The centroid with the lowest bound is measured exactly;
of the others only those whose bound, rounded down by more than the arithmetic
can err, does not exceed that distance.  Components, distances and sums are
integers, so ties and floors are exact.

A round is one pass over the stored vectors.  A task returns one sum for each
centroid; the driver holds the centroids, whose size does not depend on the rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store

#: Components of 28 bits and more take no part: squared distances of 64 of them would not fit BIGINT.
MOST = 1 << 27
#: Pivots, paired in order: the first centroids.
PIVOTS = 8
#: Times the rounding unit that one bound can err by, with room.
SLACK = 64 * np.finfo(np.float64).eps


def quantised(vectors: pa.Array, scale: int, length: int) -> list[bytes | None]:
    """floor(scale * component) of every vector as 32-bit integers; None for one that takes no part."""
    out: list[bytes | None] = []
    for v in vectors:
        x = None
        if v.is_valid and len(v.values) == length and not v.values.null_count:
            with np.errstate(over="ignore"):
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            # A non-finite component fails the comparison as well.
            x = x.astype(np.int32).tobytes() if (np.abs(x) < MOST).all() else None
        out.append(x)
    return out


def exact(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` to ``c`` (one row, or one for each)."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def bounds(near: np.ndarray, centre: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distance of every vector to every centroid, safely rounded.

    ``near`` and ``centre`` hold distances to the pivots, ``pivots`` those between them.
    """
    low = np.zeros((len(near), len(centre)))
    for p in range(0, len(pivots) - 1, 2):
        apart = pivots[p, p + 1]
        if apart > 0:
            x, y = np.outer(near[:, p], centre[:, p + 1]), np.outer(near[:, p + 1], centre[:, p])
            np.maximum(low, (np.abs(x - y) - SLACK * (x + y)) / apart, out=low)
    return low * low * (1 - SLACK)


def nearest(x: np.ndarray, near: np.ndarray, centres: np.ndarray, centre: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of every row (of equal ones the first), its squared distance, and how many distances were computed."""
    low = bounds(near, centre, pivots)
    cluster = low.argmin(axis=1)
    best = exact(x, centres[cluster])
    tried, done = cluster.copy(), len(x)
    for c in range(len(centres)):
        # An equal bound may still be a tie that goes to the smaller number.
        at = np.flatnonzero((low[:, c] <= best * (1 + SLACK)) & (tried != c))
        d = exact(x[at], centres[c])
        better = (d < best[at]) | (d == best[at]) & (c < cluster[at])
        best[at[better]], cluster[at[better]] = d[better], c
        done += len(at)
    return cluster, best, done


def _distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([exact(x, p) for p in to], 1).astype(np.float64))


class Pass:
    """What a task knows of the centroids of one round."""

    def __init__(self, centres: np.ndarray, pivots: np.ndarray):
        self.centres, self.centre, self.pivots = centres, _distances(centres, pivots), _distances(pivots, pivots)

    def rows(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(batch.num_rows, -1).astype(np.int64)
        near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float64).reshape(batch.num_rows, -1)
        cluster, distance, _ = nearest(x, near, self.centres, self.centre, self.pivots)
        return x, cluster, distance

    def sums(self, batches):
        """(cluster, n, total) of the task's vectors."""
        n, total = np.zeros(len(self.centres), np.int64), np.zeros(self.centres.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, cluster, _ = self.rows(batch)
                for c in np.unique(cluster):
                    of = x[cluster == c]
                    n[c] += len(of)
                    total[c] += of.sum(axis=0)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    def assigned(self, batches):
        for batch in batches:
            if batch.num_rows:
                _, cluster, distance = self.rows(batch)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])


def first_centres(kept: DataFrame, clusters: int, seed: str) -> np.ndarray:
    """The vectors of the smallest hashes of ``seed`` and the id; equal ids go by the vector."""
    mark = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.orderBy(mark, "x").select("x").limit(clusters).collect()
    return np.array([np.frombuffer(r.x, np.int32) for r in rows], np.int64)


def _moved(vectors: DataFrame, centres: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of their vectors; empty ones stay."""
    parts = vectors.select("x", "near").mapInArrow(Pass(centres, pivots).sums, "cluster long, n long, total array<long>")
    cells = parts.select("cluster", "n", F.posexplode("total").alias("at", "part")).groupBy("cluster", "at")
    out = centres.copy()
    for r in cells.agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cluster, r.at] = int(r.total) // r.n
    return out


def cluster(
    df: DataFrame, vector: str = "embedding", key: str = "vec_id", clusters: int = 8, rounds: int = 10, scale: int = 1024, length: int = 64, seed: str = "3:"
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    Vectors of another length, null vectors and those with a null or non-finite
    component take no part and have no row, nor have those with a component
    whose integer has more than 27 bits (distances would not fit BIGINT).  With
    fewer vectors than ``clusters`` there are as many centroids as vectors, and
    an empty table gives no rows.  Repeated rows count as rows; equal ids rank
    by their vectors, a null id as the empty text.  Other columns are not read.
    """
    spark, store = df.sparkSession, Store(df.sparkSession, "centroids")
    source = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"))
    kind = source.schema["id"].dataType

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(quantised(batch.column("vector"), scale, length), pa.binary())], names=["id", "x"])

    kept = source.mapInArrow(whole, T.StructType([T.StructField("id", kind), T.StructField("x", T.BinaryType())])).filter("x IS NOT NULL")
    centres = first_centres(kept, clusters, seed)
    names = T.StructType([T.StructField(key, kind)] + [T.StructField(n, t) for n, t in (
        ("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType()))])
    if not len(centres):
        return spark.createDataFrame([], names)
    pivots = centres[:PIVOTS]

    def cached(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).reshape(batch.num_rows, length).astype(np.int64)
            near = [d.tobytes() for d in _distances(x, pivots)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.binary())], names=["id", "x", "near"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("x", T.BinaryType()), T.StructField("near", T.BinaryType())])
    vectors = store.put(kept.mapInArrow(cached, schema))
    for _ in range(rounds):
        centres = _moved(vectors, centres, pivots)
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    rows = store.put(vectors.mapInArrow(Pass(centres, pivots).assigned, schema))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    # A sum beyond BIGINT is null.
    total = lambda n: F.lit(str(n)).try_cast("bigint")
    inertia = F.element_at(F.array(*(total(sums.get(c, 0)) for c in range(len(centres)))), F.col("cluster") + 1)
    return rows.select(
        F.col("id").alias(key), "cluster", "distance", inertia.alias("cluster_inertia"), total(sum(sums.values())).alias("inertia"), at(marks).alias("centroid_sha256"),
    )
