"""Steps that several operators share: text batches, stored tables, hot keys, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

#: Text that one call of a batch function gets, unless a single row is larger.
CHUNK_BYTES = 1 << 20
#: Bytes of a stored table for one task of a table like it.
TASK_BYTES = 4 << 20
#: Parts of the rows of one key, one for each bit of a BIGINT.
SALTS = 64
#: An unknown size leaves the number of tasks as it is; this is beyond any.
MOST_TASKS = (1 << 31) - 1


def fold_case(raw: bytes) -> bytes:
    """A-Z in lower case, all other bytes as they are."""
    return raw.lower()


def words(raw: bytes) -> list[bytes]:
    r"""The runs of ``[^\x20\x09-\x0D]`` of a UTF-8 text."""
    return raw.split()


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at least one row and, beyond that, at most ``limit`` text bytes."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def map_text(
    df: DataFrame,
    text: str,
    added: T.StructType,
    make: Callable[[], Callable[[list[str]], list]],
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` with columns computed from its text, in Arrow batches of bounded bytes.

    ``make`` runs once in a task and returns the function from texts (null is
    '') to one list or array for each added column.  ``carry`` names the
    columns to keep, all by default; columns that have the name of an added
    one are replaced.
    """
    new = {f.name.lower() for f in added.fields}
    kept = [c for c in (df.columns if carry is None else carry) if c.lower() not in new]
    whole = fresh(df, "_text")
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(whole))
    schema = T.StructType([f for f in source.schema.fields if f.name != whole] + list(added.fields))
    kinds = [_arrow(f.dataType) for f in added.fields]

    def run(batches):
        call = make()
        for batch in batches:
            for part in chunks(batch, whole):
                got = call(part.column(whole).to_pylist())
                columns = [part.column(i) for i in range(len(kept))]
                columns += [pa.array(x, type=k, from_pandas=True) if isinstance(x, np.ndarray) else pa.array(x, type=k) for x, k in zip(got, kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f.name for f in added.fields)])

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    fixed = {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(),
        T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_(),
    }
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow(f.dataType)) for f in kind.fields])
    return fixed[kind]


class Store:
    """Tables written to the shared folder, so that a lost executor costs no recomputation of them."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.root, self.count = spark, shared_folder(spark, purpose), 0

    def put(self, df: DataFrame, like: DataFrame | int | None = None, heavy: bool = False) -> DataFrame:
        """``df``, written and read again.

        ``like`` is a stored table of at least about the size of ``df``, or a
        size in bytes.  Then ``df`` is written by no more tasks than TASK_BYTES
        of that size each (``heavy`` work by twice the cores at least): a small
        table in very many files costs more than its rows.
        """
        self.count += 1
        path = f"{self.root}/{self.count}"
        if like is not None:
            size = like if isinstance(like, int) else self.size(like)
            least = 2 * self.spark.sparkContext.defaultParallelism if heavy else 1
            df = df.coalesce(min(max(least, -(-size // TASK_BYTES)), MOST_TASKS))
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def size(self, df: DataFrame) -> int:
        """Bytes of a table of ``put``."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of ``put`` that no later step reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for df in frames:
            if at := getattr(df, "_stored_at", None):
                path = jvm.org.apache.hadoop.fs.Path(at)
                path.getFileSystem(conf).delete(path, True)


def lookup(many: DataFrame, one: DataFrame, on: list[str], row: list[str]) -> DataFrame:
    """``many`` joined to ``one``, which has one row for a key, where one key may be held by a large part of the rows.

    ``row`` names columns that differ between the rows of a key; they decide
    the salt.  The one row is copied only to the salts that occur, so a unique
    key is copied once.
    """
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int"))
    wanted = salted.groupBy(*on).agg(F.expr("bit_or(shiftleft(1L, _salt))").alias("_salts")).join(one, on)
    there = F.expr(f"filter(sequence(0, {SALTS - 1}), i -> shiftright(_salts, i) & 1 = 1)")
    return salted.join(wanted.withColumn("_salt", F.explode(there)).drop("_salts"), [*on, "_salt"]).drop("_salt")


def planned_size(df: DataFrame) -> int:
    """Bytes that the optimizer expects of ``df``, beyond any number where it cannot tell."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether the checksum of the id as text falls into the fold kept for tests; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold


def components(store: Store, edges: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b); component is some node of it.

    ``like`` is a stored table of about the size of the edges.

    Rounds of contraction: each node hooks to its smallest neighbour in a
    pseudo-random order, which keeps chains short; hooks are shortened by
    pointer jumping, and edges are rewritten between what remains.  Every round
    removes all nodes but local minima; counts are aggregated before shuffles,
    so a node with very many neighbours is no single task's work.
    """
    both = edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    # xxhash64 of a BIGINT is one-to-one: an order without long descending chains, reversed at the end.
    keyed = both.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")).distinct()
    left = store.put(keyed, like)
    names = store.put(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.xxhash64("node").alias("label")), left)
    while not left.isEmpty():
        hook = left.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        hook = store.put(hook, left)
        for _ in range(3):
            step = hook.select(F.col("a").alias("to"), F.col("to").alias("next"))
            hook = hook.join(step, "to", "left").select("a", F.coalesce("next", "to").alias("to"))
        hook = store.put(hook, left)
        at_a, at_b = hook.select("a", F.col("to").alias("ta")), hook.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        renamed = left.join(at_a, "a").join(at_b, "b").filter("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")).distinct()
        moved = names.join(hook.select(F.col("a").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        old = left, names
        left, names = store.put(renamed, left), store.put(moved, names)
        store.drop(*old)
    return names.select("node", F.col("label").alias("component"))
