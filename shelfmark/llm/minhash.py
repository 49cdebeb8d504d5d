"""MinHash near-dedup over word shingles.

Method: signature-coordinate inverted join.  A document's signature has one
minimum per coordinate; the document is posted under each coordinate-value
pair.  Two documents that agree in at least MATCHES coordinates must share one
of the rarest COORDINATES - MATCHES + 1 pairs of either, so only this prefix of
every posting is merged; the long lists of frequent pairs are skipped and only
looked up when the signatures of a found pair are compared.  Pairs above the
match threshold are confirmed on their full shingle sets.

Lists are merged without all their pairs.  First every member of a list is
paired with the list's leader, the member whose values are the most common, and
what is confirmed joins one component; a second turn does so with the leader of
what is left.  Then only members of different components of a list still need
each other: they are compared in tiles of bounded size, either list by list or,
where many lists have much the same members, once for all of these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, components, fold_case, lookup, map_text, planned_size, words

WORDS = 5
#: Coordinates, and agreeing ones that a pair needs to be confirmed: at a
#: similarity of 0.75 fewer agree in about one pair of 4,000, above it more rarely.
COORDINATES, MATCHES = 40, 20
PREFIX = COORDINATES - MATCHES + 1
PERCENT = 75
#: Members of a tile; a step compares the members of two.
TILE = 128
_M = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct shingle hashes of texts, remembering the hashes of a bounded number of words."""

    def __init__(self, most: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        split = [words(fold_case(t.encode())) for t in texts]
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for s in split:
            for w in s:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w)
        return [self._set(np.array([known[w] for w in s], np.uint64)) for s in split]

    @staticmethod
    def _set(hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return hashes
        n = min(WORDS, len(hashes))
        out = np.full(len(hashes) - n + 1, n, np.uint64)  # a shorter sequence equals none of five words
        for k in range(n):
            out *= _M
            out += hashes[k : len(hashes) - n + 1 + k]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def multipliers() -> np.ndarray:
    return np.random.default_rng(11).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of every coordinate's hash, 32 bits each."""
    out = np.empty(len(factors), np.uint32)
    for k, f in enumerate(factors):
        mixed = shingles * f
        mixed ^= mixed >> np.uint64(32)
        out[k] = (mixed * _M >> np.uint64(32)).min()
    return out


def signatures(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, th, n_shingles, d1, d2, sig): text hash, set size, 128-bit set digest, signature (null for an empty set)."""
    added = T.StructType([
        T.StructField("n_shingles", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()),
        T.StructField("sig", T.ArrayType(T.IntegerType())),
    ])

    def make():
        shingler, factors = Shingler(), multipliers()

        def call(texts):
            sizes, d1, d2, sigs = [], [], [], []
            for s in shingler.sets(texts):
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                sizes.append(len(s))
                d1.append(int(digest[0]))
                d2.append(int(digest[1]))
                sigs.append(signature(s, factors).view(np.int32).tolist() if len(s) else None)
            return [sizes, d1, d2, sigs]

        return call

    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("th", F.xxhash64("text"))
    return map_text(source, "text", added, make, carry=["id", "th"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the sets' Jaccard similarity is PERCENT or more."""
    low, high = sorted((len(x), len(y)))
    if 100 * low < PERCENT * high:
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= PERCENT * (low + high - shared)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has (node, text)."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            # Few rows at a time: both texts of a pair may be long.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                keep = []
                for ta, tb in zip(part.column("ta").to_pylist(), part.column("tb").to_pylist()):
                    keep.append(similar(*shingler.sets([ta, tb])))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _matching(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs whose signatures agree in MATCHES coordinates at least."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    agreeing = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    return both.filter(agreeing >= MATCHES).select("a", "b")


def postings(sigs: DataFrame) -> DataFrame:
    """(pair, node, weight): every node under those of its rarest PREFIX coordinate-value pairs that others share.

    The weight says how common the node's values are.
    """
    spread = sigs.select("node", F.posexplode("sig").alias("at", "value"))
    pair = F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long").bitwiseAND(0xFFFFFFFF))
    spread = spread.select("node", pair.alias("pair"))
    shared = spread.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # At most COORDINATES entries a node.  Pairs of its own are the rarest and fill the prefix first.
    lists = spread.join(shared, "pair").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "pair"))).alias("own"), F.sum("n").alias("weight"))
    taken = F.expr(f"slice(own, 1, greatest(0, {PREFIX} - ({COORDINATES} - size(own))))")
    return lists.select("node", "weight", F.explode(taken).alias("p")).select("p.pair", "node", "weight")


def _led(open_: DataFrame, members: DataFrame) -> DataFrame:
    """(pair, leader, of): of every list the member of ``members`` with the greatest weight, and its component."""
    code = F.shiftleft(F.least("weight", F.lit(1 << 30)), 32).bitwiseOR(F.pmod(F.xxhash64("node"), F.lit(1 << 32)))
    top = members.groupBy("pair").agg(F.max(code).alias("top"))
    return open_.join(top, "pair").filter(code == F.col("top")).select("pair", F.col("node").alias("leader"), F.col("component").alias("of"))


def _units(store: Store, open_: DataFrame) -> DataFrame:
    """(unit, node, component, tiles) of sets that hold all pairs of open lists: lists, or clusters of lists.

    A cluster (lists connected by their members) stands for its lists where
    comparing all its members costs no more than comparing list by list.
    """
    cost = lambda n: n * F.ceil(n / TILE)
    edges = open_.join(open_.groupBy("pair").agg(F.min("node").alias("low")), "pair").select(F.col("low").alias("a"), F.col("node").alias("b"))
    cluster = components(store, edges.distinct(), open_).select("node", F.col("component").alias("cluster"))
    placed = store.put(open_.select("pair", "node", "component").join(cluster, "node"), open_)
    lists = placed.groupBy("cluster", "pair").agg(F.count(F.lit(1)).alias("n"))
    members = placed.select("cluster", "node", "component").distinct()
    choice = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m")).join(lists.groupBy("cluster").agg(F.sum(cost(F.col("n"))).alias("by_list")), "cluster")
    choice = choice.select("cluster", "m", (cost(F.col("m")) <= F.col("by_list")).alias("whole"))
    # All members of a cluster have its row, and one cluster may hold a large part of the members.
    whole = lookup(members, choice.filter("whole"), ["cluster"], ["node"]).select(F.col("cluster").alias("unit"), "node", "component", F.ceil(F.col("m") / TILE).alias("tiles"))
    apart = lookup(placed, lists.join(choice.filter("NOT whole").select("cluster"), "cluster"), ["cluster", "pair"], ["node"])
    return whole.union(apart.select(F.col("pair").alias("unit"), "node", "component", F.ceil(F.col("n") / TILE).alias("tiles")))


def _tiled(units: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """New links (a, b) between members of different components of a unit; a forest of each step."""
    units = units.withColumn("tile", F.pmod(F.xxhash64("node", "unit"), F.col("tiles")))
    pairs = units.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    step = F.xxhash64("unit", F.least("tile", "other"), F.greatest("tile", "other")).alias("step")
    rows = pairs.select(step, "node", "component", F.when(F.col("tile") == F.col("other"), 2).otherwise((F.col("tile") > F.col("other")).cast("int")).alias("side"))
    rows = rows.join(sigs.select("node", "sig"), "node").join(texts, "node")

    def compare(rows: pa.Table, shingler: Shingler):
        node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
        sig = rows.column("sig").combine_chunks().values.to_numpy().reshape(len(node), -1)
        _, root = np.unique(rows.column("component").to_numpy(), return_inverse=True)
        texts = rows.column("text")
        sets: dict[int, np.ndarray] = {}
        for i in range(len(node)):
            other = np.flatnonzero((side > side[i]) | ((side == 2) & (np.arange(len(node)) > i))) if side[i] != 1 else []
            if not len(other):
                continue
            alike = (sig[other] == sig[i]).sum(axis=1) >= MATCHES
            for j in other[alike]:
                if root[i] == root[j]:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingler.sets([texts[int(k)].as_py()])[0]
                if similar(sets[i], sets[j]):
                    root[root == root[j]] = root[i]
                    yield int(node[i]), int(node[j])

    def run(batches):
        shingler, left = Shingler(), []

        def done(part):
            table = pa.Table.from_batches(part)
            key = table.column("step").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            got = list(zip(*(e for a, b in zip(cuts, cuts[1:]) for e in compare(table.slice(a, b - a), shingler)))) or [[], []]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("step").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last step may go on
            if cut or left and left[0].column("step")[0].as_py() != key[-1]:
                yield done([*left, batch.slice(0, cut)])
                left = []
            left.append(batch.slice(cut))
        if left:
            yield done(left)

    rows = rows.select("step", "node", "component", "side", "sig", "text")
    return rows.repartition("step").sortWithinPartitions("step").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, text: str = "text", key: str = "doc_id", text_hash: str | None = None) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document; ``text_hash`` names a column for xxhash64 of its text.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` with A-Z in lower case.  A text of
    fewer than five words is one shingle; null texts and texts without words
    have none and are linked with nothing.  Documents of equal sets are one
    node from the start.  ``component_id`` is the smallest key reachable;
    a null key is linked like any other and is never the smallest.  Rows that
    repeat a key are judged each by its text.  Other columns are not read.
    """
    store = Store(docs.sparkSession, "minhash")
    # As the files are, whatever the columns that follow would be estimated at.
    size = planned_size(docs)
    every = store.put(signatures(docs, text, key), size, heavy=True)
    # One node for each distinct set, named by a hash of its digest, with any one of its rows.
    node = F.xxhash64("d1", "d2").alias("node")
    some = every.filter("n_shingles > 0")
    classes = some.groupBy("d1", "d2").agg(F.min("id").alias("least")).withColumn("node", node)
    sigs = store.put(some.select(node, "id", "th", "sig").dropDuplicates(["node"]), every)
    lists = store.put(postings(sigs.select("node", "sig")), every)
    # Only the texts of posted nodes are read again, one for each node.
    asked_for = sigs.select("node", "id", "th").join(lists.select("node").distinct(), "node", "left_semi")
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    texts = source.join(asked_for, F.col("key").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th")))
    texts = store.put(texts.select("node", "text").dropDuplicates(["node"]), size, heavy=True)
    joined, confirmed = None, None
    for turn in (1, 2, 3):
        open_ = lists.withColumn("component", F.col("node"))
        if joined is not None:
            named = lists.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
            mixed = named.groupBy("pair").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
            open_ = store.put(named.join(mixed.select("pair"), "pair"), lists)
        if turn < 3:
            led = _led(open_, open_)
            if turn == 2:
                led = _led(open_, open_.join(led, "pair").filter("component <> of").select("pair", "node", "weight"))
            pairs = open_.join(led, "pair").filter("component <> of").select(F.col("node").alias("a"), F.col("leader").alias("b"))
            good = _confirmed(store.put(_matching(pairs.distinct(), sigs), lists), texts)
        else:
            good = _tiled(store.put(_units(store, open_), lists), sigs, texts)
        good = store.put(good, lists, heavy=True)
        confirmed = good if confirmed is None else confirmed.union(good)
        joined = components(store, confirmed, lists)
    named = classes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(least, "component").select("d1", "d2", "component_id")
    # The rows of one set may be a large part of all: adaptive execution splits them, the other side has one row a set.
    out = every.select("id", "th", "n_shingles", "d1", "d2").join(by_set, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    columns = [F.col("id").alias(key), F.col("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")]
    return out.select(*columns, *([F.col("th").alias(text_hash)] if text_hash else []))
