"""Ranked lexical search with range-maximum tables over posting lists.

Method: an inverted index in blocks of documents.  Every posting list of a
block carries a sparse table that answers the maximum impact in any range of
its documents.  For an item the whole block is the first interval; the sum of
the terms' range maxima bounds every score in it.  Intervals are taken best
bound first: the document of the largest impact is scored exactly, and the
interval is split there in two, each with bounds of its own.  An interval whose
bound is below the item's tenth best score is dropped; one with few postings
left is read out.

The text is read once.  A block is built in one step and stays where it is: no
posting is shuffled, only document frequencies are.  A first wave of a fixed
share of the blocks gives every item a threshold, which prunes the other blocks
and changes no result.  Items go through the driver in blocks of bounded size,
and each reads the index, not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, chunks

#: Documents of a block at most (a packed impact names one in BITS bits), and text bytes unless one document is larger.
BITS = 12
BLOCK_DOCS, BLOCK_BYTES = 1 << BITS, 8 << 20
#: Postings of an interval that are read out instead of split further.
READ_OUT = 64
#: Intervals of an item that the first round of a block takes; every round takes twice as many.
BEAM = 2
#: The first wave searches one block of this many.
WAVE = 16
#: Items and their terms that one pass over the index searches.
ITEMS, ITEM_TERMS = 2048, 1 << 17
#: Fixed pseudo-random order of a block's documents: equal impacts split intervals evenly, not at one end.
_ORDER = np.random.default_rng(12).permutation(BLOCK_DOCS).astype(np.uint32)
_PLACE = np.argsort(_ORDER).astype(np.int64)
_TERM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def term_lists(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """(document, code) of every term of the texts in order, and the term of every code.

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII; only A-Z are lower-cased.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    folded = raw[int(ends[0]) : int(ends[-1])].to_pybytes().translate(_TERM) if raw is not None else b""
    clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(folded))
    split = pc.ascii_split_whitespace(clean)
    words = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.index(words.dictionary, "").as_py()
    return doc[code != empty], code[code != empty], words.dictionary


def _indexed(batches):
    """Batches of (id, text) as index blocks; positions of a block ascend with the id, null ids last."""
    for batch in batches:
        for some in chunks(batch, "text", BLOCK_BYTES):
            for at in range(0, some.num_rows, BLOCK_DOCS):
                part = some.slice(at, BLOCK_DOCS)
                order = pc.sort_indices(part.column("id"), null_placement="at_end").to_numpy()
                place = np.argsort(order)
                doc, code, terms = term_lists(part.column("text"))
                key, tf = np.unique(code << BITS | place[doc], return_counts=True)
                used, df = np.unique(key >> BITS, return_counts=True)
                n = np.bincount(place[doc], minlength=part.num_rows)
                lists = part.column("id").take(pa.array(order)), pa.array(n), terms.take(pa.array(used)), pa.array(df)
                packed = (key & (BLOCK_DOCS - 1)).astype(np.uint16), tf.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays([0, len(x)], x) for x in lists] + [pa.array([x.tobytes()]) for x in packed],
                    names=["ids", "n", "terms", "df", "pos", "tf"],
                )


def _item_terms(batches):
    """Batches of (item, text) as (item, term), once for each item."""
    for batch in batches:
        for part in chunks(batch, "text"):
            doc, code, terms = term_lists(part.column("text"))
            key = np.unique(doc * (len(terms) + 1) + code)
            at, term = np.divmod(key, len(terms) + 1)
            yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(at)), terms.take(pa.array(term))], names=["item", "term"])


class Ranges:
    """Posting lists of one block with sparse tables of their packed impacts (impact, then a mark of the document)."""

    def __init__(self, starts: np.ndarray, pos: np.ndarray, impact: np.ndarray):
        self.starts, self.pos, self.impact = starts, pos, impact
        size = np.diff(starts)
        self.key = np.repeat(np.arange(len(size), dtype=np.int64), size) << BITS | pos
        top = int(size.max()).bit_length() if len(size) else 1
        self.levels = np.zeros((top, len(pos)), np.uint32)
        self.levels[0] = impact.astype(np.uint32) << np.uint32(BITS) | _ORDER[pos]
        for k in range(1, top):
            h, below = 1 << (k - 1), self.levels[k - 1]
            np.maximum(below[: len(pos) - h], below[h:], out=self.levels[k, : len(pos) - h])
        self.log = np.zeros(int(size.max(initial=0)) + 1, np.int64)
        for k in range(1, top):
            self.log[1 << k :] = k

    def most(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Largest packed impact of the postings a to b (exclusive) of one list, for non-empty ranges."""
        k = self.log[b - a]
        return np.maximum(self.levels[k, a], self.levels[k, b - (1 << k)]).astype(np.int64)


class Intervals:
    """Open intervals: their item, bound and splitting document, and for every term of theirs the postings a to b."""

    def __init__(self, ranges: Ranges, item: np.ndarray, of: np.ndarray, terms: tuple[np.ndarray, ...]):
        """``of`` is the ascending interval number of each term row (list, weight, a, b); rows without postings go."""
        some = terms[2] < terms[3]
        of, terms = of[some], tuple(x[some] for x in terms)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        self.item, self.terms = item[of[first]], terms
        self.ends = np.append(first[1:], len(of))
        most = ranges.most(terms[2], terms[3])
        value = terms[1] * (most >> BITS)
        self.bound = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.int64)
        best = np.maximum.reduceat(value << BITS | most & (BLOCK_DOCS - 1), first) if len(first) else np.zeros(0, np.int64)
        self.split = _PLACE[best & (BLOCK_DOCS - 1)]

    @classmethod
    def gather(cls, parts: list[tuple[Intervals, np.ndarray]]) -> Intervals:
        """The chosen intervals of several sets, as one."""
        out = cls.__new__(cls)
        out.item, out.bound, out.split = (np.concatenate([getattr(x, c)[at] for x, at in parts]) for c in ("item", "bound", "split"))
        rows = [x.rows(at) for x, at in parts]
        out.terms = tuple(np.concatenate([x.terms[c][r] for (x, _), (r, _) in zip(parts, rows)]) for c in range(4))
        out.ends = np.cumsum(np.concatenate([size for _, (_, size) in zip(parts, rows)]))
        return out

    def rows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term rows of the chosen intervals, and how many each has."""
        size = np.diff(self.ends, prepend=0)[at]
        return np.repeat(self.ends[at] - np.cumsum(size), size) + np.arange(size.sum()), size


def _spread(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from a to b (exclusive) of every range, and the range of each."""
    size = b - a
    of = np.repeat(np.arange(len(a)), size)
    return np.repeat(b - np.cumsum(size), size) + np.arange(size.sum()), of


def best_documents(ranges: Ranges, item: np.ndarray, lists: np.ndarray, weight: np.ndarray, least: np.ndarray, top: int):
    """(item, document, score) of every item's ``top`` documents in the block with a score of at least ``least[item]``.

    ``item`` ascends and names the item of each (list, weight).  Equal scores go by the document.
    """
    least = least.copy()
    found = (np.zeros(0, np.int64),) * 3
    open_ = Intervals(ranges, np.arange(len(least)), item, (lists, weight, ranges.starts[lists], ranges.starts[lists + 1]))
    beam = BEAM
    while len(open_.item):
        order = np.lexsort((-open_.bound, open_.item))
        order = order[open_.bound[order] >= least[open_.item[order]]]
        new = np.diff(open_.item[order], prepend=-1) != 0
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        taken, later = np.sort(order[rank < beam]), np.sort(order[rank >= beam])
        beam *= 2
        rows, size = open_.rows(taken)
        of = np.repeat(np.arange(len(taken)), size)
        lst, w, a, b = (x[rows] for x in open_.terms)
        short = np.bincount(of, b - a, len(taken)) <= READ_OUT
        # Few postings left: all of them are added up.
        out = short[of]
        at, row = _spread(a[out], b[out])
        key, back = np.unique(of[out][row] << BITS | ranges.pos[at], return_inverse=True)
        score = np.zeros(len(key), np.int64)
        np.add.at(score, back, w[out][row] * ranges.impact[at])
        parts = [(open_.item[taken][key >> BITS], key & (BLOCK_DOCS - 1), score)]
        # Else the document of the largest impact is scored, and the interval is parted there.
        go = ~out
        of, lst, w, a, b = of[go], lst[go], w[go], a[go], b[go]
        doc = open_.split[taken][of]
        mid = np.searchsorted(ranges.key, lst << BITS | doc)
        hit = mid < b
        hit[hit] = ranges.key[mid[hit]] == (lst[hit] << BITS | doc[hit])
        split = np.flatnonzero(~short)
        first = np.searchsorted(of, split)
        score = np.add.reduceat(np.where(hit, w * ranges.impact[np.minimum(mid, len(ranges.pos) - 1)], 0), first) if len(split) else np.zeros(0, np.int64)
        parts.append((open_.item[taken][split], open_.split[taken][split], score))
        halves = np.stack([a, mid + hit], 1).ravel(), np.stack([mid, b], 1).ravel()
        side = np.stack([2 * of, 2 * of + 1], 1).ravel()
        turn = np.argsort(side, kind="stable")
        children = Intervals(
            ranges, np.repeat(open_.item[taken], 2), side[turn],
            (np.repeat(lst, 2)[turn], np.repeat(w, 2)[turn], halves[0][turn], halves[1][turn]),
        )
        found = _best([np.concatenate(x) for x in zip(found, *parts)], least, top)
        open_ = Intervals.gather([(open_, later), (children, np.arange(len(children.item)))])
    return found


def _best(rows: list[np.ndarray], least: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The best rows of every item; ``least`` rises to the score of the last where ``top`` are known."""
    item, doc, score = (x[rows[2] >= least[rows[0]]] for x in rows)
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    last = rank == top - 1
    least[item[last]] = np.maximum(least[item[last]], score[last])
    return item[rank < top], doc[rank < top], score[rank < top]


def _searcher(items: list[tuple[int, list[str], list[int]]], least: list[int], docs: int, length: int, top: int):
    """The function that searches index blocks for ``items`` (number, terms, weights)."""
    terms = sorted({t for _, ts, _ in items for t in ts})
    at = {t: i for i, t in enumerate(terms)}
    item = np.repeat(np.arange(len(items)), [len(ts) for _, ts, _ in items])
    term = np.array([at[t] for _, ts, _ in items for t in ts], np.int64)
    weight = np.array([w for _, _, ws in items for w in ws], np.int64)
    number = np.array([i for i, _, _ in items], np.int64)
    at = None

    def run(batches):
        floor = np.array(least, np.int64)
        vocabulary = pa.array(terms, pa.string())
        for batch in batches:
            for r in range(batch.num_rows):
                ranges, known = _opened(batch, r, vocabulary, docs, length)
                have = known[term] >= 0
                got = best_documents(ranges, item[have], known[term[have]], weight[have], floor, top)
                # Later blocks of the task need as much as the items' tenth best of this one.
                for_item, at_place, score = got
                full = np.bincount(for_item, minlength=len(floor)) == top
                low = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(low, for_item, score)
                floor[full] = np.maximum(floor[full], low[full])
                ids = batch.column("ids")[r].values
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[for_item]), ids.take(pa.array(at_place)), pa.array(score)], names=["item", "doc_id", "score"]
                )

    return run


def _opened(batch: pa.RecordBatch, r: int, vocabulary: pa.Array, docs: int, length: int) -> tuple[Ranges, np.ndarray]:
    """The lists of the vocabulary's terms in an index block, and the list of every term (-1: none)."""
    df = batch.column("df")[r].values.to_numpy()
    starts = np.concatenate([[0], np.cumsum(df)])
    where = pc.fill_null(pc.index_in(vocabulary, value_set=batch.column("terms")[r].values), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = where[where >= 0]
    known = np.full(len(where), -1)
    known[where >= 0] = np.arange(len(lists))
    rows, _ = _spread(starts[lists], starts[lists + 1])
    pos = np.frombuffer(batch.column("pos")[r].as_py(), np.uint16)[rows].astype(np.int64)
    tf = np.frombuffer(batch.column("tf")[r].as_py(), np.uint32)[rows].astype(np.int64)
    n = batch.column("n")[r].values.to_numpy()
    # Exact at any size: Python's integers where 64 bits might not hold a product.
    n = n.astype(object) if 90 * int(n.max(initial=0)) * docs >= 1 << 62 else n
    m = (10 + (90 * n * docs) // max(length, 1)).astype(np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[pos])
    return Ranges(np.concatenate([[0], np.cumsum(df[lists])]), pos, impact), known


def build_index(store: Store, df: DataFrame, text: str, key: str) -> DataFrame:
    """The stored index: blocks of (ids, n, terms, df, pos, tf), numbered."""
    source = df.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    schema = T.StructType([
        T.StructField("ids", T.ArrayType(source.schema["id"].dataType)), T.StructField("n", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("df", T.ArrayType(T.LongType())),
        T.StructField("pos", T.BinaryType()), T.StructField("tf", T.BinaryType()),
    ])
    return store.put(source.mapInArrow(_indexed, schema).withColumn("block", F.monotonically_increasing_id()))


def weighted_items(store: Store, items: DataFrame, index: DataFrame, docs: int) -> DataFrame:
    """(item, terms, weights) of every item row that shares a term with the index; numbers ascend."""
    rows = items.mapInArrow(_item_terms, "item long, term string")
    counts = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    counts = counts.join(rows.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = rows.join(counts.select("term", weight.alias("weight")), "term")
    lists = weighted.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))
    return store.put(lists.orderBy("item"))


def _item_blocks(rows: DataFrame) -> Iterator[list[tuple[int, list[str], list[int]]]]:
    """The items, a bounded block of them in the driver at a time."""
    block, terms = [], 0
    for r in rows.orderBy("item").toLocalIterator():
        if block and (len(block) == ITEMS or terms + len(r.terms) > ITEM_TERMS):
            yield block
            block, terms = [], 0
        block.append((r.item, r.terms, r.weights))
        terms += len(r.terms)
    if block:
        yield block


def search(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", top: int = 10) -> DataFrame:
    """(item_key, rank, key, score) of every item's best documents with a score above 0.

    Terms are the maximal runs of ASCII letters and digits and of characters
    beyond ASCII, A-Z lower-cased; null and empty texts have none and are found
    by nothing.  Equal scores go by ascending key, null keys last; repeated
    rows are documents of their own, and repeated items are ranked each.  An
    item without a term in any document has no row, nor has anything where one
    of the tables is empty.  Other columns are not read.
    """
    store = Store(df.sparkSession, "lexical")
    kinds = df.schema[key].dataType, items.schema[item_key].dataType
    index = build_index(store, df, text, key)
    sizes = index.select(F.explode("n").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    source = items.select(F.col(f"`{item_key}`").alias("item_id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("text"))
    source = store.put(source.withColumn("item", F.monotonically_increasing_id()))
    weighted = weighted_items(store, source.select("item", "text"), index, sizes.docs)
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", kinds[0]), T.StructField("score", T.LongType())])
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    blocks = index.select("block", "ids", "n", "terms", "df", "pos", "tf")
    first = F.pmod(F.xxhash64("block"), F.lit(WAVE)) == 0
    found = []
    for some in _item_blocks(weighted):
        run = lambda rows, least: rows.drop("block").mapInArrow(_searcher(some, least, sizes.docs, sizes.length, top), schema)  # noqa: B023, E731
        early = store.put(best(run(blocks.filter(first), [1] * len(some))))
        known = {r.item: r.score for r in early.filter(F.col("rank") == top).select("item", "score").collect()}
        late = run(blocks.filter(~first), [known.get(i, 1) for i, _, _ in some])
        found.append(store.put(best(early.drop("rank").union(late))))
    if not found:
        found = [df.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(1))]
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    named = rows.join(source.select("item", "item_id"), "item")
    return named.select(F.col("item_id").alias(item_key), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(key), "score")
