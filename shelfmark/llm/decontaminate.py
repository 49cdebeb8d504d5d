"""Benchmark decontamination by the CGK embedding of edit distance into Hamming distance.

Method: texts and items are sequences of words.  A random walk (CGK) repeats
or advances over a window of the item's size, a step for a random bit of the
step and the word; windows a few edits apart soon walk in step again, so their
outputs differ in few places.  Every table samples some steps of a walk, and
windows that equal an item there are its candidates; walks and samples are
repeated until the wanted recall.  Candidates are verified by their exact edit
distance in words.

The items are a stated query set: they are read in blocks of bounded size and
each block is held against all documents, which are never shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

#: Edits in words that a passage may have, as a part of the item's words.
EDITS = 0.2
#: Walks, tables of each, and sampled steps of a table.  Measured on items with random edits of 0.05, 0.1,
#: 0.15 and 0.2 of their words, 1.0, 0.998, 0.99 and 0.96 were found.
WALKS, SAMPLES, STEPS = 6, 8, 5
#: A word in more than this part of the items says little about where one stands.
COMMON = 0.02
#: Sizes of windows in words; an item is sought by the largest one not above its own.
SIZES = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 19, 24, 30, 38, 48, 60, 75, 95, 120, 150, 190, 240, 300, 380, 480, 600, 760, 960)
#: Bytes of items in a block.
ITEM_BLOCK = 16 << 20

_WORD = re.compile(r"\w+")
#: Bytes of ASCII that are no word character as spaces, A-Z in lower case.
_FOLDED = bytes(c if c >= 0x80 or chr(c).isalnum() or c == 0x5F else 0x20 for c in range(256)).lower()
_ODD = "[^\\x00-\\x7F\\p{L}\\p{N}]|[\u0130\u03a3]"
_M = np.uint64(0x9E3779B97F4A7C15)


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text in lower case, and where they stand."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


def walk(words: np.ndarray, start: np.ndarray, size: int, seed: int, sampled: np.ndarray) -> np.ndarray:
    """The outputs of the walks over windows of ``size`` words at the sampled steps; 0 beyond the window's end."""
    at = np.zeros(len(start), np.int64)
    out = np.empty((len(sampled), len(start)), np.uint64)
    wanted = {int(s): k for k, s in enumerate(sampled)}
    for step in range(int(sampled.max()) + 1):
        inside = at < size
        seen = np.where(inside, words[np.minimum(start + at, len(words) - 1)], np.uint64(0))
        if step in wanted:
            out[wanted[step]] = seen
        salt = np.uint64((seed * 1_000_003 + step) * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        at += ((seen ^ salt) * _M >> np.uint64(63)).astype(np.int64)
    return out


def plan(size: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(seed, sampled steps, tables as rows of positions among them) of every walk over windows of a size."""
    r = np.random.default_rng(size)
    out = []
    for seed in range(WALKS):
        # A walk advances every other step, so two steps for a word reach the end of the window.
        tables = r.integers(0, 2 * size, (SAMPLES, STEPS))
        sampled, at = np.unique(tables, return_inverse=True)
        out.append((seed, sampled, at.reshape(tables.shape)))
    return out


def keys(words: np.ndarray, start: np.ndarray, size: int, walks: list) -> np.ndarray:
    """The sampled outputs of each window as one number for every table."""
    out = []
    for seed, sampled, tables in walks:
        outputs = walk(words, start, size, seed, sampled)
        for t, table in enumerate(tables):
            key = np.full(len(start), seed * SAMPLES + t + 1, np.uint64)
            for k in table:
                key = (key ^ outputs[k]) * _M
                key ^= key >> np.uint64(32)
            out.append(key)
    return np.stack(out, axis=1)


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least edits in words between the item and any part of the text, and where that part begins and ends.

    Of parts with equally few edits the first that ends counts, and of these the longest.
    """
    n = len(text)
    cost, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    # Cost first, then the beginning, in one number, so that minima carry their beginning along.
    base = n + 1
    row = cost * base + begin
    for i, w in enumerate(item, 1):
        step = np.empty(n + 1, np.int64)
        step[0] = i * base
        step[1:] = np.minimum(row[:-1] + (text != w) * base, row[1:] + base)
        step[0] = min(step[0], row[0] + base)
        row = np.minimum.accumulate(step - ramp * base) + ramp * base
    best = int((row // base).min())
    end = int(np.flatnonzero(row // base == best)[0])
    return best, int(row[end] % base), end


class Numbers:
    """The words of texts as numbers in a vocabulary of words, -1 for any other.

    ASCII is parted and lower-cased by its bytes, and Arrow splits a chunk of
    texts and looks up its distinct pieces.  A piece is one word, unless it
    holds a character beyond ASCII that is no letter or digit, or one whose
    lower case depends on more than itself: only such pieces are taken apart
    singly.
    """

    def __init__(self, vocabulary: list[str]):
        self.words = pa.array(vocabulary, pa.string())
        self.place = {w: k for k, w in enumerate(vocabulary)}

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, one text after the other, and how many words each has."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        folded = raw[int(ends[0]) : int(ends[-1])].to_pybytes().translate(_FOLDED) if raw is not None else b""
        clean = pa.StringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).tobytes()), pa.py_buffer(folded))
        split = pc.ascii_split_whitespace(clean)
        pieces = split.flatten().dictionary_encode()
        number = pc.fill_null(pc.index_in(pc.utf8_lower(pieces.dictionary), value_set=self.words), -1).to_numpy(zero_copy_only=False)
        size = np.ones(len(number), np.int64)
        size[pc.equal(pieces.dictionary, "").to_numpy(zero_copy_only=False)] = 0
        wide = pc.invert(pc.string_is_ascii(pieces.dictionary)).to_numpy(zero_copy_only=False).nonzero()[0]
        odd = wide[pc.match_substring_regex(pieces.dictionary.take(pa.array(wide)), _ODD).to_numpy(zero_copy_only=False)]
        parts = {k: [self.place.get(w.lower(), -1) for w in _WORD.findall(pieces.dictionary[int(k)].as_py())] for k in odd}
        for k, found in parts.items():
            size[k] = len(found)
        code = pieces.indices.to_numpy(zero_copy_only=False)
        each = size[code]
        if (each == 1).all():
            out = number[code]
        else:
            out = np.repeat(number[code], each)
            first = np.cumsum(each) - each
            for at in np.flatnonzero(np.isin(code, odd)):
                out[first[at] : first[at] + each[at]] = parts[code[at]]
        upto = np.concatenate([[0], np.cumsum(each)])
        return out, np.diff(upto[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False))])])


class Items:
    """A block of benchmark items, ready to be sought.

    A cheap test comes before the walks.  An edit spoils one word at most, so a
    window with fewer words of items than its size less the edits holds no
    passage, nor does one with fewer rare words than the item has, less the
    edits; no passage within the edits fails it.
    """

    def __init__(self, rows: list[tuple]):
        self.ids = [i for i, _ in rows]
        self.words = [np.array([_hash(w) for w in word_spans(t)[0]], np.uint64) for _, t in rows]
        self.edits = [int(EDITS * len(w)) for w in self.words]
        texts = {_hash(w): w for _, t in rows for w in word_spans(t)[0]}
        self.vocabulary, held_by = np.unique(np.concatenate([np.empty(0, np.uint64), *(np.unique(w) for w in self.words)]), return_counts=True)
        self.rare = held_by <= max(2, COMMON * len(rows))
        self.texts = [texts[h] for h in self.vocabulary.tolist()]
        at = [np.searchsorted(self.vocabulary, w) for w in self.words]
        self.own = [set(k[self.rare[k]].tolist()) for k in at]
        by_size = defaultdict(list)
        for k, w in enumerate(self.words):
            if len(w):
                by_size[max(s for s in SIZES if s <= len(w))].append(k)
        # By size of the window: least known and least rare words, table keys, and the items they stand for.
        self.sizes: dict[int, tuple] = {}
        self.plans = {size: plan(size) for size in by_size}
        for size, members in by_size.items():
            tables: list[dict[int, list]] = [defaultdict(list) for _ in range(WALKS * SAMPLES)]
            least_known, least_rare = size, size
            for k in members:
                is_rare = np.concatenate(([0], np.cumsum(self.rare[np.searchsorted(self.vocabulary, self.words[k])])))
                # Long items are sought at several places, so that edits at the start do not hide them.
                starts = np.arange(0, len(self.words[k]) - size + 1, max(1, size // 2))
                least_known = min(least_known, size - self.edits[k])
                least_rare = min(least_rare, int((is_rare[starts + size] - is_rare[starts]).min()) - self.edits[k])
                for at, found in zip(starts.tolist(), keys(self.words[k], starts, size, self.plans[size]).tolist()):
                    for t, key in enumerate(found):
                        tables[t][key].append((k, at))
            arrays = [np.array(sorted(t), np.uint64) for t in tables]
            self.sizes[size] = (least_known, least_rare, [dict(t) for t in tables], arrays, members)

    def numbers(self) -> "Numbers":
        return Numbers(self.texts)

    def find(self, number: np.ndarray, size_of: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, first and end word) of the items that stand in texts of numbered words (``Numbers.of``)."""
        if not len(self.vocabulary) or not len(number):
            return []
        first = np.cumsum(size_of) - size_of
        end = np.repeat(first + size_of, size_of)
        # A word of no item has no number and the hash 0: no item has it either.
        words = np.append(self.vocabulary, np.uint64(0))[number]
        known = np.concatenate(([0], np.cumsum(number >= 0, dtype=np.int32)))
        rare = np.concatenate(([0], np.cumsum(np.append(self.rare, False)[number], dtype=np.int32)))
        asked: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size, (least_known, least_rare, tables, arrays, members) in self.sizes.items():
            # A text shorter than the window may still hold an item with words left out.
            for d in np.flatnonzero((size_of < size) & (size_of > 0)).tolist():
                for k in members:
                    if len(self.words[k]) - size_of[d] <= self.edits[k]:
                        asked[d, k].add(int(first[d]))
            if len(words) < size:
                continue
            start = np.flatnonzero(rare[size:] - rare[:-size] >= least_rare)
            start = start[(known[start + size] - known[start] >= least_known) & (start + size <= end[start])]
            if not len(start):
                continue
            found = keys(words, start, size, self.plans[size])
            doc = np.searchsorted(first, start, "right") - 1
            for t, table in enumerate(tables):
                spot = np.minimum(np.searchsorted(arrays[t], found[:, t]), len(arrays[t]) - 1)
                for i in np.flatnonzero(arrays[t][spot] == found[:, t]):
                    for k, offset in table[int(found[i, t])]:
                        asked[int(doc[i]), k].add(int(start[i]) - offset)
        out = []
        for (d, k), places in asked.items():
            item, allowed, done, tried = self.words[k], self.edits[k], -1, None
            for place in sorted(places):
                # The part tried last reaches twice as far as the edits can move a passage.
                if place < done or tried is not None and place - tried <= allowed:
                    continue
                tried = place
                low = max(int(first[d]), place - 2 * allowed)
                high = min(int(first[d] + size_of[d]), place + len(item) + 2 * allowed)
                if high <= low or len(self.own[k].intersection(number[low:high].tolist())) < len(self.own[k]) - allowed:
                    continue
                edits, a, b = edit_distance(item, words[low:high])
                if edits <= allowed and b > a:
                    out.append((d, k, edits, low + a - int(first[d]), low + b - int(first[d])))
                    done = low + b
        return sorted(out)


def item_blocks(benchmark: DataFrame, text: str, key: str):
    """The items in blocks of bounded bytes; only one block is in the driver at a time."""
    rows, size = [], 0
    for r in benchmark.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL").orderBy("key", "text").toLocalIterator():
        rows.append((r.key, r.text))
        size += len(r.text)
        if size >= ITEM_BLOCK:
            yield Items(rows)
            rows, size = [], 0
    if rows:
        yield Items(rows)


def passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id",
) -> DataFrame:
    """(key, item key, edits, start, end) of passages of benchmark items in documents; places in code points.

    Words are runs of letters, digits and underscores in lower case.  A passage has
    at most EDITS edits for every word of the item (none for an item of fewer
    than five words).  Null and empty texts hold nothing, null and empty items
    are found nowhere; repeated rows are each searched.  Without a benchmark
    row the result is empty.  Other columns are not read.
    """
    item_type = benchmark.schema[item_key].dataType
    schema = T.StructType([
        T.StructField("key", docs.schema[key].dataType), T.StructField("item", item_type),
        *(T.StructField(n, T.LongType()) for n in ("edits", "start", "end")),
    ])
    from .common import _arrow

    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL")

    def search(items: Items):
        def run(batches):
            numbers = items.numbers()
            for batch in batches:
                for part in chunks(batch, "text"):
                    texts = part.column("text")
                    hits = items.find(*numbers.of(texts))
                    spans = {d: word_spans(texts[d].as_py())[1] for d in {h[0] for h in hits}}
                    rows = [h[0] for h in hits]
                    out = [(items.ids[k], edits, spans[d][a][0], spans[d][b - 1][1]) for d, k, edits, a, b in hits]
                    cells = list(zip(*out)) or [[]] * 4
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(rows, pa.int64())), pa.array(cells[0], _arrow(item_type)), *(pa.array(c, pa.int64()) for c in cells[1:])],
                        names=schema.names,
                    )

        return run

    result = None
    for items in item_blocks(benchmark, item_text, item_key):
        found = source.mapInArrow(search(items), schema)
        result = found if result is None else result.union(found)
    if result is None:
        result = docs.sparkSession.createDataFrame([], schema)
    return result.withColumnRenamed("key", key).withColumnRenamed("item", item_key)
