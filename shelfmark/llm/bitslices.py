"""Exact top-k search over a bit-sliced index.

Method: rows lie in blocks.  For every attribute of a block the index holds the
most significant bits of its values, each as one bitmap over the rows.  A query
adds the attribute slices, weighted by its own values, with bitmap arithmetic:
weights are recoded to signed digits, a digit shifts an attribute's slices, and
carry-save adders sum them, 64 rows in a word.  The slices of the sum are walked
from the most significant one down to the top rows.  What the index left out
bounds how far a sum can be from the score, so the rows at and near the boundary
are resolved by their exact integer scores.

Row blocks and tiles of queries meet in units of bounded size.  A unit reads
its queries, then block after block, and keeps only ``top`` rows a query, so no
pair of a query and a row is ever a row of a table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store

#: Rows of a block, blocks of a unit, queries of a unit (few where few units would leave cores idle), partitions of all units.
ROWS, BLOCKS, QUERIES, PARTITIONS = 1 << 14, 16, (32, 1024), 1 << 16
#: Slices kept of an attribute.
SLICES = 7
#: Vectors of this squared length and more take no part: their scores might not fit BIGINT.
MOST = 1 << 62


def quantised(vectors: pa.Array, scale: int) -> list[np.ndarray | None]:
    """floor(scale * component) of every vector; None for one that takes no part."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None
        if v.is_valid and not v.values.null_count:
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                x = x.astype(np.int64) if (x @ x) < MOST else None
        out.append(x)
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return x.astype(kind)


def sliced(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(slices, low, shift): (x - low) >> shift of every column as bitmaps [column, slice, word], least significant first."""
    low = x.min(axis=0)
    above = (x - low).astype(np.uint64)
    bits = max(1, int(above.max(initial=0)).bit_length())
    shift = max(0, bits - SLICES)
    above >>= np.uint64(shift)
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], bits - shift, words * 8), np.uint8)
    for b in range(bits - shift):
        plane = np.packbits((above >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little")
        out[:, b, : len(plane)] = plane.T
    return out.view(np.uint64), low, shift


def digits(weight: int) -> list[tuple[int, int]]:
    """(place, sign) of the signed binary digits of a weight, no two of them next to each other."""
    out, place, sign, left = [], 0, 1 if weight >= 0 else -1, abs(weight)
    while left:
        if left & 1:
            d = 2 - (left & 3)
            out.append((place, d * sign))
            left -= d
        left >>= 1
        place += 1
    return out


def _full(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bitmaps."""
    t = a ^ b
    s = t ^ c
    t &= c
    t |= a & b
    return s, t


def weighted_sum(slices: np.ndarray, inverse: np.ndarray, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """(slices, less): of every row the sum of attributes times weights, plus ``less``, as bitmaps."""
    top, less = (1 << slices.shape[1]) - 1, 0
    pools: dict[int, list[np.ndarray]] = {}
    for j in np.flatnonzero(query).tolist():
        for place, sign in digits(int(query[j])):
            # A negative digit adds the complement, which is too much by all ones.
            pools.setdefault(place, []).append(slices[j] if sign > 0 else inverse[j])
            less += top << place if sign < 0 else 0
    # Carry-save: three summands of a place become one there and one a place above.
    place, columns = 0, {}
    while pools:
        pool = pools.pop(place, [])
        while len(pool) > 1:
            if len(pool) > 2:
                s, carry = _full(pool.pop(), pool.pop(), pool.pop())
            else:
                a, b = pool.pop(), pool.pop()
                s, carry = a ^ b, a & b
            pool.append(s)
            pools.setdefault(place + 1, []).append(carry)
        for b, bitmap in enumerate(pool[0] if pool else []):
            columns.setdefault(place + b, []).append(bitmap)
        place += 1
    out, place = [], 0
    while columns:
        column = columns.pop(place, [])
        while len(column) > 1:
            a, b = column.pop(), column.pop()
            s, carry = _full(a, b, column.pop()) if column else (a ^ b, a & b)
            column.append(s)
            columns.setdefault(place + 1, []).append(carry)
        out.append(column[0] if column else np.zeros(slices.shape[2], np.uint64))
        place += 1
    return out, less


def least_of_top(total: list[np.ndarray], rows: np.ndarray, top: int) -> int:
    """The smallest sum among the ``top`` rows of the largest ones, from the most significant slice down."""
    need, ties, value = top, rows, 0
    for place in range(len(total) - 1, -1, -1):
        ones = ties & total[place]
        n = int(np.bitwise_count(ones).sum())
        if n >= need:
            ties, value = ones, value | 1 << place
        else:
            need, ties = need - n, ties & ~total[place]
    return value


def at_least(total: list[np.ndarray], rows: np.ndarray, least: int) -> np.ndarray:
    """Bitmap of the rows whose sum is at least ``least``."""
    if least <= 0:
        return rows
    if least >> len(total):
        return np.zeros_like(rows)
    above, ties = np.zeros_like(rows), rows
    for place in range(len(total) - 1, -1, -1):
        if least >> place & 1:
            ties = ties & total[place]
        else:
            above |= ties & total[place]
            ties = ties & ~total[place]
    return above | ties


class Block:
    """One block of the index, opened."""

    def __init__(self, row: dict):
        self.number, self.n = row["block"], row["n"]
        self.ids, self.null = row["ids"].fill_null(0).to_numpy(), row["ids"].is_null().to_numpy(zero_copy_only=False)
        width = row["width"]
        self.low, self.shift = np.frombuffer(row["low"], np.int64), row["shift"]
        words = -(-self.n // 64)
        self.slices = np.frombuffer(row["slices"], np.uint64).reshape(width, -1, words)
        self.inverse = ~self.slices
        self.x = np.frombuffer(row["x"], np.dtype(f"i{row['item']}")).reshape(self.n, width)
        bits = np.zeros(words * 64, np.uint8)
        bits[: self.n] = 1
        self.rows = np.packbits(bits, bitorder="little").view(np.uint64)

    def best(self, query: np.ndarray, own: int | None, top: int, least: int | None) -> list[tuple[int, int | None]]:
        """(score, id) of the ``top`` best rows, in order, leaving out those with a score below ``least``."""
        q = np.zeros(self.x.shape[1], np.int64)
        q[: min(len(q), len(query))] = query[: len(q)]
        rows = self.rows
        if own is not None:
            rows = rows.copy()
            rows[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
        # score = base + (sum << shift) + rest, where rest lies between the two limits.
        over = (1 << self.shift) - 1
        base = sum(a * b for a, b in zip(q.tolist(), self.low.tolist()))
        down, up = int(q[q < 0].sum()) * over, int(q[q > 0].sum()) * over
        total, less = weighted_sum(self.slices, self.inverse, q)
        wide, floor = self.n - (own is not None) >= top, 0
        if wide:
            # The row at the boundary scores at least this, so no row below it by more than the rest counts.
            floor = least_of_top(total, rows, top) - (up - down >> self.shift) - 1
        if least is not None:
            floor = max(floor, (least - base - up >> self.shift) + less)
        at = np.flatnonzero(np.unpackbits(at_least(total, rows, floor).view(np.uint8), bitorder="little"))
        score = self.x[at].astype(np.int64) @ q
        order = np.lexsort((self.ids[at], self.null[at], -score))[:top]
        return [(s, None if null else i) for s, i, null in zip(score[order].tolist(), self.ids[at[order]].tolist(), self.null[at[order]].tolist())]


def _search(batches, top: int):
    """Units in order, each with its queries first and then its blocks: the best rows of every query of a unit."""
    unit, queries, found = None, [], []

    def done():
        rows = [(*q[:3], i, s) for q, best in zip(queries, found) for s, i in best]
        cells = list(zip(*rows)) or [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["block", "at", "query_id", "vec_id", "score"])

    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            if row["unit"].as_py() != unit:
                if unit is not None:
                    yield done()
                unit, queries, found = row["unit"].as_py(), [], []
            if row["kind"].as_py() == 0:
                queries.append((row["block"].as_py(), row["at"].as_py(), row["query_id"].as_py(), np.frombuffer(row["x"].as_py(), np.int64)))
                found.append([])
                continue
            block = Block({c: v.values if c == "ids" else v.as_py() for c, v in row.items()})
            for k, (number, at, _, x) in enumerate(queries):
                more = block.best(x, at if number == block.number else None, top, found[k][-1][0] if len(found[k]) == top else None)
                found[k] = sorted(found[k] + more, key=_rank)[:top]
    if unit is not None:
        yield done()


def _rank(row: tuple[int, int | None]) -> tuple:
    score, key = row
    return -score, key is None, key or 0


_INDEX = "n int, width int, shift int, item int, ids array<long>, low binary, slices binary, x binary"


def _indexed(scale: int, most: int):
    def run(batches):
        held: list[tuple[int | None, np.ndarray]] = []

        def block():
            width = max(1, *(len(x) for _, x in held))
            x = np.zeros((len(held), width), np.int64)
            for k, (_, v) in enumerate(held):
                x[k, : len(v)] = v
            slices, low, shift = sliced(x)
            x = narrow(x)
            cells = [len(held), width, shift, x.itemsize, [i for i, _ in held], low.tobytes(), slices.tobytes(), x.tobytes()]
            kinds = [pa.int32()] * 4 + [pa.list_(pa.int64())] + [pa.binary()] * 3
            names = ["n", "width", "shift", "item", "ids", "low", "slices", "x"]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=names)

        for batch in batches:
            for key, x in zip(batch.column("id").to_pylist(), quantised(batch.column("vector"), scale)):
                if x is not None:
                    held.append((key, x))
                    if len(held) == most:
                        yield block()
        if held:
            yield block()

    return run


def _queries(every: int):
    """(block, at, query_id, x) of the rows of an index whose id is divisible by ``every``; ``at`` is their place in the block."""

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids = batch.column("ids")[r].as_py()
                at = [k for k, i in enumerate(ids) if i is not None and i % every == 0]
                kind = np.dtype(f"i{batch.column('item')[r].as_py()}")
                x = np.frombuffer(batch.column("x")[r].as_py(), kind).reshape(len(ids), -1)[at].astype(np.int64)
                cells = [batch.column("block")[r].as_py()] * len(at), at, [ids[k] for k in at], [v.tobytes() for v in x]
                kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=["block", "at", "query_id", "x"])

    return run


def search(df: DataFrame, vector: str = "embedding", key: str = "vec_id", every: int = 50, top: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, key, score) of the ``top`` best rows for every row whose key is divisible by ``every``.

    The score is the inner product of the integers floor(scale * component).
    A row is not a candidate of itself, but another row of the same key is, and
    every row of a repeated key is a query of its own.  Equal scores go to the
    smaller key, null keys last; rows with a null key are candidates, not
    queries.  Null vectors, and those with a null or non-finite component, take
    no part, nor do those whose integers have a squared length of 2^62 and more
    (scores might not fit BIGINT).  The shorter of two vectors counts as zero
    beyond its end.  Empty tables give no rows.  Other columns are not read.
    """
    spark, store = df.sparkSession, Store(df.sparkSession, "bitslices")
    source = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    # Small partitions would make small blocks.
    source = source.coalesce(max(1, min(source.count() // ROWS, (1 << 31) - 1)))
    index = store.put(source.mapInArrow(_indexed(scale, ROWS), _INDEX).withColumn("block", F.monotonically_increasing_id()))
    queries = store.put(index.select("block", "item", "ids", "x").mapInArrow(_queries(every), "block long, at long, query_id long, x binary"))
    blocks, asked = index.count(), queries.count()
    groups, least = max(1, -(-blocks // BLOCKS)), spark.sparkContext.defaultParallelism * 2
    tiles = max(1, -(-asked // min(max(-(-asked * groups // least), QUERIES[0]), QUERIES[1])))
    parts = min(groups * tiles, PARTITIONS)
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = queries.select("*", F.lit(0).alias("kind"), dealt(tiles, "block", "at").alias("tile"), each(groups).alias("group"))
    asked_of = index.select("*", F.lit(1).alias("kind"), dealt(groups, "block").alias("group"), each(tiles).alias("tile"))
    met = asking.unionByName(asked_of, allowMissingColumns=True).withColumn("unit", F.col("group") * tiles + F.col("tile")).drop("group", "tile")
    met = met.repartitionById(parts, F.pmod("unit", F.lit(parts)).cast("int")).sortWithinPartitions("unit", "kind", "block", "at")
    rows = met.mapInArrow(lambda batches: _search(batches, top), "block long, at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(key), "score")
