"""Suffix-array dedup: bytes of long strings that start earlier in the corpus are removed.

Method: bucket-pointer refinement.  A position's bucket is an identifier of the
q bytes from there on; the bucket of 2q bytes is made of the position's own
bucket and that of the offset q later, and the new identifiers are used for the
next step in the same way.  Sorting positions by those identifiers refines the
buckets of the corpus:

1. In every window the position with the smallest bucket of the first size
   stands for the window.  Neighbouring windows mostly share it, so one posting
   stands for a run of windows.  Postings are sorted by that bucket, then by
   the bucket of all bytes of the run.
2. A posting whose run stands earlier in its refined bucket is a repeat.  A
   posting alone in its first bucket has no repeat at all.  Only first postings
   of a refined bucket that shares its first bucket with others stay open.
3. Open runs are cut in two; each half goes, with its bytes, to the bucket of
   the position's bytes and half of the rest, which all its windows hold.
   There its single windows are sorted by their buckets of 64 bytes at the
   start and at the end, which settles them.  The windows of a half's bucket
   with very many runs are settled one level later, each as a posting.

Equal windows choose equal representatives, so no repeat is missed, and equal
identifiers (128 bits in all) stand for equal bytes.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, chunks

#: Windows that one position can stand for, less one: the first buckets have ``window - SPREAD`` bytes.
SPREAD = 60
#: Bytes that are refined at a time in a task.
BLOCK = 2 << 20
_LONGS = ["h", "c", "id", "place"]
_POSTING = T.StructType([T.StructField(n, T.LongType()) for n in _LONGS])
_SETTLED = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "crc", "lo", "hi", "anchor")] + [T.StructField("kind", T.ByteType())])
_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("k", "id", "place")] + [T.StructField("piece", T.BinaryType())])
#: Kinds of settled rows: windows that are repeats, runs that stay open, single windows for the next level.
REPEAT, OPEN, NEXT = 1, 2, 3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a longer bucket, from two shorter ones in order."""
    out = a * _M1
    out += b
    out ^= out >> np.uint64(31)
    out *= _M2
    out ^= out >> np.uint64(29)
    return out


def _letters() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def buckets(data: np.ndarray, letters: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of ``gram`` and of 64 bytes at every position that has them."""
    level, q, at_gram = letters[data], 1, None
    while q < 64:
        if q < gram <= 2 * q:
            at_gram = _join(level[: len(level) - (gram - q)], level[gram - q :])
        level, q = _join(level[:-q], level[q:]), 2 * q
    return at_gram, level


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def _place(crc: np.ndarray, lo: np.ndarray, length: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """20 bits of the text's checksum, 31 of the first window, 6 each of the last and the position from there."""
    return (crc & 0xFFFFF) << 43 | lo << 12 | length << 6 | anchor


def _parts(place: np.ndarray) -> tuple:
    lo = place >> 12 & 0x7FFFFFFF
    return place >> 43, lo, lo + (place >> 6 & 63), lo + (place & 63)


def postings(data: np.ndarray, starts: np.ndarray, letters: np.ndarray, window: int) -> tuple:
    """(first bucket, refined bucket, document, first and last window, position) of the runs of windows.

    ``data`` holds documents one after another from ``starts`` on; documents
    are numbered, windows count from the start of the block.
    """
    gram = window - SPREAD
    grams, long = buckets(data, letters, gram)
    n = len(data) - window + 1
    ends = np.append(starts[1:], len(data))
    doc = np.repeat(np.arange(len(starts)), ends - starts)[:n]
    inside = np.arange(n) + window <= ends[doc]
    # Bucket bits above, position below: the minimum names the leftmost position of the smallest bucket.
    bits = np.uint64(24)
    best = _smallest(grams >> bits << bits | np.arange(len(grams), dtype=np.uint64), SPREAD + 1)[:n]
    at = (best & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.flatnonzero(inside)
    if not len(valid):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    cut = np.flatnonzero((np.diff(at[valid]) != 0) | (np.diff(valid) != 1))
    lo, hi = valid[np.append(0, cut + 1)], valid[np.append(cut, len(valid) - 1)]
    anchor, end = at[lo], hi + window
    # Three buckets of 64 bytes cover all bytes of the run.
    refined = _join(_join(long[lo], long[(lo + end - 64) // 2]), long[end - 64])
    refined = _join(refined, ((end - lo) * 256 + anchor - lo).astype(np.uint64))
    return grams[anchor].view(np.int64), refined.view(np.int64), doc[lo], lo, hi, anchor


def _blocks(batch: pa.RecordBatch, window: int):
    """Blocks of documents; a very long document comes in overlapping blocks of its own."""
    ids, crcs = batch.column("id").to_pylist(), batch.column("crc").to_pylist()
    texts = batch.column("data")
    part: list = []
    for i in range(batch.num_rows):
        raw = np.frombuffer(texts[i].as_buffer() or b"", np.uint8)
        for at in range(0, max(1, len(raw) - window + 1), BLOCK):
            piece = raw[at : at + BLOCK + window - 1]
            if len(piece) >= window:
                part.append((ids[i], crcs[i], at, piece))
        if sum(len(p[3]) for p in part) >= BLOCK:
            yield part
            part = []
    if part:
        yield part


def _firsts(h, c, ids, place) -> tuple:
    """Rows sorted by (h, c, id, place) without repeated ones, and which of them repeat an earlier (h, c)."""
    order = np.lexsort((place, ids, c, h))
    h, c, ids, place = h[order], c[order], ids[order], place[order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    keep = ~again | (ids != ids[first]) | (place != place[first])
    return h[keep], c[keep], ids[keep], place[keep], again[keep]


def _united(ids, crc, lo, hi) -> tuple:
    """Windows of a document that touch or overlap as one run."""
    order = np.lexsort((lo, crc, ids))
    ids, crc, lo, hi = ids[order], crc[order], lo[order], hi[order]
    if not len(ids):
        return ids, crc, lo, hi
    # Runs of a document may lie within one another: the furthest end so far decides.
    same = np.append(False, (ids[1:] == ids[:-1]) & (crc[1:] == crc[:-1]))
    group = np.cumsum(~same)
    far = np.maximum.accumulate(group * (1 << 33) + hi) - group * (1 << 33)
    new = np.flatnonzero(~(same & np.append(False, lo[1:] <= far[:-1] + 1)))
    return ids[new], crc[new], lo[new], np.maximum.reduceat(hi, new)


def _table(names, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64), pa.int64()) for x in columns], names=names)


def _posted(h, c, ids, place) -> pa.RecordBatch:
    """Postings of a block: first ones to be settled, and runs that are repeats already (with a negative place)."""
    h, c, ids, place, again = _firsts(h, c, ids, place)
    crc, lo, hi, _ = _parts(place[again])
    d_ids, crc, lo, hi = _united(ids[again], crc, lo, hi)
    known = (_join(d_ids.astype(np.uint64), lo.astype(np.uint64)).view(np.int64), hi, d_ids, ~_place(crc, lo, 0 * lo, 0 * lo))
    return _table(_LONGS, [np.concatenate(x) for x in zip((h[~again], c[~again], ids[~again], place[~again]), known)])


def _post(window: int):
    letters = _letters()

    def run(batches):
        for batch in batches:
            for small in chunks(batch, "data", BLOCK):
                for part in _blocks(small, window):
                    starts = np.cumsum([0] + [len(p[3]) for p in part])[:-1]
                    h, c, doc, lo, hi, anchor = postings(np.concatenate([p[3] for p in part]), starts, letters, window)
                    shift = np.array([p[2] for p in part])[doc] - starts[doc]
                    ids, crc = np.array([p[0] for p in part], np.int64)[doc], np.array([p[1] for p in part], np.int64)[doc]
                    yield _posted(h, c, ids, _place(crc, lo + shift, hi - lo, anchor - lo))

    return run


def _settled(ids, crc, lo, hi, anchor, kind) -> pa.RecordBatch:
    out = [pa.array(x.astype(np.int64), pa.int64()) for x in (ids, crc, lo, hi, anchor)]
    return pa.RecordBatch.from_arrays([*out, pa.array(kind.astype(np.int8), pa.int8())], names=_SETTLED.names)


def _settle(batches):
    """Repeats and open runs of a partition that is sorted by (h, c, id, place).

    Streams the partition; of a bucket only its first posting is remembered.
    """
    last, first, held, many = None, None, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        h, c, ids, place = (batch.column(n).to_numpy(zero_copy_only=False) for n in _LONGS)
        post = place >= 0
        crc, lo, _, _ = _parts(~place[~post])
        repeats, opened = [(ids[~post], crc, lo, c[~post])], []
        h, c, ids, place = h[post], c[post], ids[post], place[post]
        n = len(h)
        if n:
            new_h, new_c = np.ones(n, bool), np.ones(n, bool)
            new_h[1:] = h[1:] != h[:-1]
            new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
            if last is not None:
                new_h[0] = h[0] != last[0]
                new_c[0] = new_h[0] or c[0] != last[1]
            group = np.cumsum(new_h)  # 0: continues the last batch
            classes = np.bincount(group, weights=new_c, minlength=group[-1] + 1)
            if not new_h[0]:
                classes[0] += 1 + many
            several = classes >= 2
            start = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))
            f_id, f_place = ids[start], place[start]
            if first is not None:
                f_id, f_place = np.where(start >= 0, f_id, first[0]), np.where(start >= 0, f_place, first[1])
            # A row of the first one's own place is the same run of a repeated row.
            again = ~new_c & ((ids != f_id) | (place != f_place))
            crc, lo, hi, _ = _parts(place[again])
            repeats.append((ids[again], crc, lo, hi))
            opened.append((ids[new_c & several[group]], place[new_c & several[group]]))
            if held is not None and not new_h[0] and several[0]:
                opened.append(held)
                held = None
            if new_h.any():
                k = int(np.flatnonzero(new_h)[-1])
                held = None if several[group[-1]] else (ids[k : k + 1], place[k : k + 1])
            many = bool(several[group[-1]])
            last, first = (h[-1], c[-1]), (f_id[-1], f_place[-1])
        ids, crc, lo, hi = _united(*(np.concatenate(x) for x in zip(*repeats)))
        yield _settled(ids, crc, lo, hi, lo, np.full(len(ids), REPEAT))
        if opened:
            ids, place = (np.concatenate(x) for x in zip(*opened))
            yield _settled(ids, *_parts(place), np.full(len(ids), OPEN))


def _halves(window: int):
    """Open runs of documents, cut in two, with the bucket that all windows of a half hold, and their bytes."""
    letters, gram, side = _letters(), window - SPREAD, SPREAD // 2

    def run(batches):
        for batch in batches:
            for small in chunks(batch, "z", BLOCK):
                rows = []
                for i in range(small.num_rows):
                    raw = _inflated(small.column("z")[i].as_py())
                    ident, crc = small.column("id")[i].as_py(), small.column("crc")[i].as_py()
                    spans = small.column("spans")[i].as_py()
                    for s in spans:
                        lo, hi, a = s["lo"], s["hi"], s["anchor"]
                        for f, t, at in ((lo, min(hi, a - side), a - side), (max(lo, a - side + 1), hi, a)):
                            if f <= t:
                                key = xxhash.xxh64_intdigest(raw[at : at + gram + side]) - (1 << 63)
                                rows.append((key, ident, (crc & 0xFFFFF) << 43 | f << 12, raw[f : t + window]))
                cells = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cells[:3]), pa.array(cells[3], pa.binary())], names=_RUN.names)

    return run


def _windows(ids, place, pieces, letters, window: int) -> tuple:
    """(h, c, id, place) of all single windows of some pieces."""
    size = np.array([len(p) for p in pieces])
    _, long = buckets(np.frombuffer(b"".join(pieces), np.uint8), letters, window - SPREAD)
    n = size - window + 1
    row = np.repeat(np.arange(len(size)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[row] + offset
    return long[at].view(np.int64), long[at + window - 64].view(np.int64), ids[row], place[row] + (offset << 12)


def _settle_windows(window: int):
    """Repeats among the windows of a partition of halves that is sorted by their bucket."""
    letters = _letters()

    def whole(ids, place, pieces):
        _, _, ids, place, again = _firsts(*_windows(ids, place, pieces, letters, window))
        crc, lo, hi, _ = _parts(place[again])
        ids, crc, lo, hi = _united(ids[again], crc, lo, hi)
        return _settled(ids, crc, lo, hi, lo, np.full(len(ids), REPEAT))

    def later(ids, place, pieces):
        h, c, ids, place, again = _firsts(*_windows(ids, place, pieces, letters, window))
        # Of a bucket with very many runs, single windows go to the next level: buckets in the columns of a run.
        crc, lo, hi, _ = _parts(place[again])
        d_ids, crc, lo, hi = _united(ids[again], crc, lo, hi)
        yield _settled(d_ids, crc, lo, hi, lo, np.full(len(d_ids), REPEAT))
        yield _settled(ids[~again], place[~again], h[~again], c[~again], h[~again], np.full((~again).sum(), NEXT))

    def run(batches):
        keys, ids, place, pieces, size, hot = [], [], [], [], 0, None

        def taken(to):
            nonlocal keys, ids, place, pieces, size
            got = np.array(keys[:to]), np.array(ids[:to], np.int64), np.array(place[:to], np.int64), pieces[:to]
            keys, ids, place, pieces = keys[to:], ids[to:], place[to:], pieces[to:]
            size = sum(map(len, pieces))
            return got

        for batch in batches:
            keys += batch.column("k").to_pylist()
            ids += batch.column("id").to_pylist()
            place += batch.column("place").to_pylist()
            pieces += batch.column("piece").to_pylist()
            size = sum(map(len, pieces))
            while size >= BLOCK or keys and keys[0] == hot:
                # The last bucket may go on.
                to = bisect_left(keys, keys[-1])
                if keys[0] == hot or not to:
                    hot = keys[0]
                    yield from later(*taken(bisect_right(keys, hot))[1:])
                else:
                    yield whole(*taken(to)[1:])
        if keys:
            yield whole(*taken(len(keys))[1:])

    return run


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Rows with the order key of documents: a null id comes before all, equal ids by the text's checksum."""
    data = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    return docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("id"),
        F.crc32(data).bitwiseAND(0xFFFFF).alias("crc"), data.alias("data"),
    )


def _deflated(keyed: DataFrame, *names: str) -> DataFrame:
    """The named columns with the texts compressed, as they are shuffled."""
    schema = T.StructType([keyed.schema[n] for n in names] + [T.StructField("z", T.BinaryType())])

    def run(batches):
        shut = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in chunks(batch, "data"):
                z = [shut.compress(x) for x in part.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(z, pa.binary())], names=schema.names)

    return keyed.select(*names, "data").mapInArrow(run, schema)


def _inflated(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "crc").agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("spans"))


def repeated(docs: DataFrame, window: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, crc, spans) of documents with repeats: runs (lo, hi) of starts of windows that also start earlier.

    One shuffle carries the postings, about one for thirty bytes; within a
    block only first occurrences are posted, so a passage that many documents
    share is a few rows.  The list of a document is bounded by its length.
    """
    if not 84 <= window <= 132:
        raise ValueError("the window must have 84 to 132 bytes")
    store = Store(docs.sparkSession, "repeats")
    keyed = _keyed(docs, text, key)
    sorted_ = lambda df: df.repartition("h").sortWithinPartitions(*_LONGS).mapInArrow(_settle, _SETTLED)
    first = store.put(sorted_(keyed.select("id", "crc", "data").mapInArrow(_post(window), _POSTING)))
    open_ = _deflated(keyed, "id", "crc").join(_spans(first.filter(F.col("kind") == OPEN)), ["id", "crc"])
    halves = open_.select("id", "crc", "z", "spans").mapInArrow(_halves(window), _RUN)
    second = store.put(halves.repartition("k").sortWithinPartitions("k", "id", "place").mapInArrow(_settle_windows(window), _SETTLED))
    third = sorted_(second.filter(F.col("kind") == NEXT).select(F.col("lo").alias("h"), F.col("hi").alias("c"), "id", F.col("crc").alias("place")))
    return _spans(first.union(second).union(third).filter(F.col("kind") == REPEAT))


def _covered(spans, size: int, window: int) -> list[tuple[int, int]]:
    """The maximal byte ranges that the windows cover."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [(a, min(b, size)) for a, b in out]


def remove(docs: DataFrame, window: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of every document the key, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes that are ``kept``.

    Strings of ``window`` bytes (84 to 132) are judged on the input.  A null
    text is empty.  Texts shorter than the window keep all bytes.  Rows of
    equal id and text are one document and get equal results; rows of equal id
    and other text are ordered by 20 bits of their checksum; a null id comes
    first.  Other columns are not read.
    """
    texts = _deflated(_keyed(docs, text, key), "key", "id", "crc")
    found = texts.join(repeated(docs, window, text, key), ["id", "crc"], "left").select("key", "z", "spans")
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "z", BLOCK // 2):
                got = []
                for i in range(part.num_rows):
                    raw = _inflated(part.column("z")[i].as_py())
                    cover = _covered(part.column("spans")[i].as_py(), len(raw), window)
                    kept, at = [], 0
                    for a, b in cover:
                        kept.append(raw[at:a])
                        at = b
                    got.append((len(raw), sum(b - a for a, b in cover), len(cover), b"".join([*kept, raw[at:]])))
                cells = list(zip(*got))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), *(pa.array(c, pa.int64()) for c in cells[:3]), pa.array(cells[3], pa.binary())], names=schema.names,
                )

    return found.mapInArrow(run, schema)


def report(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
