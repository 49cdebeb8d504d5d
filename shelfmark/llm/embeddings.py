"""Embedding near-dedup by Euclidean p-stable hashing.

Method: vectors are normalised; in every table several random projections,
shifted and cut into cells of WIDTH, name a bucket.  Near vectors share a
bucket of some table; pairs of a bucket are confirmed by their exact cosine in
double precision.

Equal vectors are one node from the start, so copies cost nothing.  The rows of
a bucket are cut into tiles, and one step compares one pair of tiles, so a
bucket of any size is many bounded steps.  A pair counts in the first table in
which it meets only.  Steps return sums of links and a spanning forest, never
all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, components

#: At a cosine of 0.98 unit vectors are 0.2 apart, and a projection keeps them in one cell of 2.0 with
#: probability 0.92: 20 projections with 0.19, and all 44 tables miss the pair in one case of 10,000.
#: Unrelated vectors (1.4 apart) meet in a table in one case of two million.
WIDTH, PROJECTIONS, TABLES = 2.0, 20, 44
COSINE = 0.98
TILE = 256
_M = np.uint64(0x9E3779B97F4A7C15)


def bucket_ids(unit: np.ndarray) -> np.ndarray:
    """The bucket of every unit vector in every table, as one number each."""
    r = np.random.default_rng(4)
    axes, shift = r.normal(size=(unit.shape[1], TABLES * PROJECTIONS)), r.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cells = np.floor((unit @ axes + shift) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    out = np.zeros((len(unit), TABLES), np.uint64) + np.arange(TABLES, dtype=np.uint64)
    for k in range(PROJECTIONS):
        out = (out ^ cells[:, :, k].astype(np.uint64)) * _M
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def unit_vectors(batch: pa.RecordBatch) -> list[bytes | None]:
    """Each vector at length 1 as bytes of doubles; None for one that links with nothing."""
    out: list[bytes | None] = []
    for v, label in zip(batch.column("vector"), batch.column("label").to_pylist()):
        x = None
        if label is not None and v.is_valid and not v.values.null_count and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            # Scaled first, so that the length neither overflows nor vanishes.
            most = np.abs(x).max()
            x = x / most if np.isfinite(x).all() and most > 0 else None
        out.append(None if x is None else (x / np.linalg.norm(x)).tobytes())
    return out


def _normalised(batches):
    for batch in batches:
        units = unit_vectors(batch)
        digests = [None if u is None else np.frombuffer(xxhash.xxh3_128_digest(u), np.int64).tolist() for u in units]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("label"), pa.array([d and d[0] for d in digests], pa.int64()),
             pa.array([d and d[1] for d in digests], pa.int64()), pa.array(units, pa.binary())],
            names=["id", "label", "d1", "d2", "unit"],
        )


def _bucketed(batches):
    """Nodes with their buckets, which are named for the label and the length too."""
    for batch in batches:
        labels = batch.column("label").to_numpy()
        units = batch.column("unit").to_pylist()
        size = np.array([len(u) for u in units])
        out = np.zeros((len(units), TABLES), np.int64)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            ids = bucket_ids(np.frombuffer(b"".join([units[i] for i in at]), np.float64).reshape(len(at), -1)).view(np.uint64)
            out[at] = (((ids ^ labels[at, None].astype(np.int64).view(np.uint64)) * _M ^ np.uint64(n)) * _M).view(np.int64)
        buckets = pa.ListArray.from_arrays(np.arange(0, out.size + 1, TABLES, dtype=np.int32), out.ravel())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("unit"), buckets], names=["node", "unit", "buckets"])


def _compared(batches):
    """Links among the rows of a partition sorted by step: (node, links, other); other joins the node to its component."""
    left: list[pa.RecordBatch] = []

    def step(rows: pa.Table) -> list[tuple]:
        node, size, side = (rows.column(c).to_numpy() for c in ("node", "size", "side"))
        one_tile = rows.column("i")[0].as_py() == rows.column("j")[0].as_py()
        x = np.frombuffer(b"".join(rows.column("unit").to_pylist()), np.float64).reshape(len(node), -1)
        a = np.flatnonzero(side == 0)
        b = a if one_tile else np.flatnonzero(side == 1)
        if not len(a) or not len(b):
            return []
        near = x[a] @ x[b].T >= COSINE
        if one_tile:
            near &= ~np.eye(len(a), dtype=bool)
        if not near.any():
            return []
        # Only in the first table in which both meet.
        ids = rows.column("buckets").combine_chunks().values.to_numpy().reshape(len(node), TABLES)
        ia, ib = np.nonzero(near)
        again = np.zeros(len(ia), bool)
        for t in range(rows.column("table")[0].as_py()):
            again |= ids[a[ia], t] == ids[b[ib], t]
        near[ia[again], ib[again]] = False
        links = np.zeros(len(node), np.int64)
        links[a] = near @ size[b]
        if not one_tile:
            links[b] = near.T @ size[a]
        # A spanning forest: smallest node numbers spread along the links.
        root = np.arange(len(node))
        ia, ib = np.nonzero(near)
        ia, ib = a[ia], b[ib]
        while True:
            low = root.copy()
            np.minimum.at(low, ia, root[ib])
            np.minimum.at(low, ib, root[ia])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return [(node[k], links[k], node[root[k]]) for k in np.flatnonzero(links > 0)]

    def done(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows)
        key = table.column("step").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        got = [r for a, b in zip(cuts, cuts[1:]) for r in step(table.slice(a, b - a))]
        cells = list(zip(*got)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in cells], names=["node", "links", "other"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("step").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if cut or left and left[0].column("step")[0].as_py() != key[-1]:
            yield done([*left, batch.slice(0, cut)])
            left = []
        left.append(batch.slice(cut))
    if left:
        yield done(left)


def link(df: DataFrame, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null and the cosine is 0.98 or
    more.  Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing, nor do vectors of different lengths.  Equal
    vectors of a label link; repeated rows count as rows.  ``component_id`` is
    the smallest key reachable; null keys are never the smallest and never
    kept.  Other columns are not read.
    """
    store = Store(df.sparkSession, "embeddings")
    source = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").cast("long").alias("label"))
    kind = source.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind)] + [T.StructField(n, T.LongType()) for n in ("label", "d1", "d2")] + [T.StructField("unit", T.BinaryType())])
    every = store.put(source.mapInArrow(_normalised, schema))
    node = F.xxhash64("label", "d1", "d2").alias("node")
    valid = every.filter("d1 IS NOT NULL").withColumn("node", node)
    sizes = valid.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("least"))
    distinct = valid.select("node", "label", "unit").dropDuplicates(["node"])
    nodes = store.put(distinct.mapInArrow(_bucketed, "node long, unit binary, buckets array<long>").join(sizes, "node"))
    posted = nodes.select("node", F.posexplode("buckets").alias("table", "bucket"))
    # Buckets of two and more; their rows are dealt out to tiles by the hash of the node.
    full = posted.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("table").alias("table"), *(F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"h{k}") for k in (1, 2))
    ).filter("n > 1")
    # Near vectors share most of their buckets: of buckets with the same members the first table's stands for all.
    full = full.groupBy("n", "h1", "h2").agg(F.min_by("bucket", "table").alias("bucket"))
    full = full.select("bucket", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    members = posted.join(full, "bucket").withColumn("tile", F.pmod(F.xxhash64("node", "bucket"), F.col("tiles")).cast("int"))
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = (F.col("tile") > F.col("other")).cast("int").alias("side")
    pairs = pairs.select("bucket", "table", "node", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), side)
    rows = pairs.join(nodes.select("node", "unit", "buckets", "size"), "node").withColumn("step", F.xxhash64("bucket", "i", "j"))
    found = store.put(rows.repartition("step").sortWithinPartitions("step").mapInArrow(_compared, "node long, links long, other long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(store, found.select(F.col("node").alias("a"), F.col("other").alias("b")), found)
    named = nodes.select("node", "size", "least").join(links, "node", "left").join(joined, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = named.join(least, "component").select("node", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = every.select("id", F.when(F.col("d1").isNotNull(), F.xxhash64("label", "d1", "d2")).alias("node")).join(by_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
