"""Language-model scores by prediction by partial matching (PPM), beside a smoothed word model.

Method: a trie of byte contexts, built from the training part of the corpus,
predicts the next byte.  A byte that a context has not seen escapes to the next
shorter context (method D: counts less one half, and one half for every
distinct symbol to the escape); symbols of the longer context are excluded from
the shorter one.  The pretrained code lengths are summed over each text.

Contexts reach back ORDER bytes: ``across`` words and white space to the start
of the text, or at most to the start of the present unit, a word or the white
space between two words.  Across, an event is ORDER bytes and the symbol that
follows, whatever the words: a block of texts lists its distinct events, dealt
to cells by the last bytes of the context, a cell works out those of all
blocks, and each block gets its own back.  Within units the code length of a
unit is the same wherever it stands: texts become vectors over the dictionary
of their block of a few MB, blocks ask for the units they hold, and blocks of
units ask for the trie events they hold.  No table of the corpus is sent to
all tasks; every answer is one shuffle.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, chunks, fold_case, words

ORDER = 5
#: Contexts up to this order are few enough for one table (at most 2**16 contexts of 258 symbols).
LOW = 2
#: Text bytes of a block, units of a block of units, events that are worked out at a time.
BLOCK, UNITS, EVENTS = 16 << 20, 100_000, 1 << 20
#: Units whose events are in memory at a time.
STEP = 20_000
#: Across units: text bytes of a block, and the cells that its events are dealt to.
SPAN, CELLS = 32 << 20, 4096
# Symbols are bytes, the end of a unit, and the end of the text.  0x20 starts a word, 0x01 white space.
UNIT_END, TEXT_END, SYMBOLS = 256, 257, 258
_RUNS = re.compile(rb"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+")
_SPACE = b" \t\n\x0b\x0c\r"
#: In a unit: the text ends here.  The byte is in no UTF-8 text.
END = b"\xff"


def units(raw: bytes) -> tuple[list[bytes], Counter]:
    """The words of a text, and all further units: white space, the last one ending the text.

    A text is a word (empty if white space comes first), then white space and a
    word in turn, and white space (which may be empty) with the end.
    """
    found = words(raw)
    if found and b" ".join(found) == raw:
        return found, Counter({b" ": len(found) - 1, END: 1} if len(found) > 1 else {END: 1})
    runs = _RUNS.findall(raw)
    rest: Counter = Counter(r for r in runs if r[0] in _SPACE)
    if runs and runs[-1][0] in _SPACE:
        rest[runs[-1]] -= 1
        rest[runs[-1] + END] += 1
    else:
        rest[END] += 1
    if not runs or runs[0][0] in _SPACE:
        rest[b""] += 1  # the empty word
    return found, +rest


def is_word(unit: bytes) -> bool:
    return bool(unit) and unit[0] not in _SPACE and unit[-1:] != END


def events(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed events of units one after another, and where each unit begins.

    An event is an order, a context (ORDER bytes, the last one lowest) and the
    symbol that follows.
    """
    ends = [u[-1:] == END for u in units]
    bodies = [u[:-1] if e else u for u, e in zip(units, ends)]
    marked = [(b"\x01" if e or b and b[0] in _SPACE else b" ") + b for b, e in zip(bodies, ends)]
    size = np.array([len(m) for m in marked], np.int64)
    start = np.cumsum(size) - size
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
    place = np.arange(len(data)) - np.repeat(start, size)
    context = np.zeros(len(data), np.int64)
    for k in range(min(ORDER, int(size.max(initial=0)))):
        held = np.flatnonzero(place >= k)
        context[held] |= data[held - k] << (8 * k)
    symbol = np.append(data[1:], 0)
    symbol[start + size - 1] = np.where(ends, TEXT_END, UNIT_END)
    return pack(context, np.minimum(place + 1, ORDER), symbol), start


def pack(context: np.ndarray, order: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """One BIGINT: order, context, symbol."""
    return order << 49 | context << 9 | symbol


def suffix(event: Column, order: int) -> Column:
    """The event's context cut to its last ``order`` bytes, with the symbol."""
    return event.bitwiseAND((1 << (8 * order + 9)) - 1)


class _Vector:
    """Distinct numbers with counts as bytes: tag, differences, counts."""

    @staticmethod
    def pack(numbers: np.ndarray) -> bytes:
        at, n = np.unique(numbers, return_counts=True)
        step = np.diff(at, prepend=0)
        wide, many = step.max(initial=0) > 65535, n.max(initial=0) > 255
        return bytes([wide + 2 * many]) + step.astype("<u4" if wide else "<u2").tobytes() + n.astype("<u4" if many else "u1").tobytes()

    @staticmethod
    def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        a, b = 4 if raw[0] & 1 else 2, 4 if raw[0] & 2 else 1
        n = (len(raw) - 1) // (a + b)
        step = np.frombuffer(raw, f"<u{a}", n, 1)
        return np.cumsum(step, dtype=np.int64), np.frombuffer(raw, f"<u{b}" if b > 1 else "u1", n, 1 + a * n).astype(np.int64)


def _vectors(key: T.DataType):
    """Per block: its dictionary (unit, number, training count), and its documents as vectors over it."""
    from .common import _arrow

    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), _arrow(key), pa.bool_(), pa.int64(), pa.binary()]
    names = ["block", "unit", "number", "n", "key", "held_out", "n_tokens", "vector"]

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        numbers: dict[bytes, int] = {}
        taught: Counter = Counter()
        size = 0

        def dictionary():
            got = list(numbers)
            for at in range(0, len(got), 50_000):
                part = got[at : at + 50_000]
                n, none = len(part), pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, kinds[0]), pa.array(part, kinds[1]), pa.array(range(at, at + n), kinds[2]), pa.array([taught[u] for u in part], kinds[3]),
                     none(n, kinds[4]), none(n, kinds[5]), none(n, kinds[6]), none(n, kinds[7])], names=names,
                )

        for batch in batches:
            for part in chunks(batch, "text"):
                tokens, vectors = [], []
                for text, held in zip(part.column("text").to_pylist(), part.column("held_out").to_pylist()):
                    found, rest = units(fold_case(text.encode()))
                    size += len(text)
                    number = [numbers.setdefault(w, len(numbers)) for w in found]
                    for unit, times in rest.items():
                        number += [numbers.setdefault(unit, len(numbers))] * times
                    if not held:
                        taught.update(found)
                        taught.update(rest)
                    tokens.append(len(found) + 1)
                    vectors.append(_Vector.pack(np.array(number, np.int64)))
                n, none = part.num_rows, pa.nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, kinds[0]), none(n, kinds[1]), none(n, kinds[2]), none(n, kinds[3]),
                     part.column("key").cast(kinds[4]), part.column("held_out"), pa.array(tokens, kinds[6]), pa.array(vectors, kinds[7])], names=names,
                )
                if size >= BLOCK:
                    yield from dictionary()
                    numbers, taught, size, block = {}, Counter(), 0, block + 1
        yield from dictionary()

    schema = T.StructType([
        T.StructField(n, k) for n, k in zip(names, [T.LongType(), T.BinaryType(), T.IntegerType(), T.LongType(), key, T.BooleanType(), T.LongType(), T.BinaryType()])
    ])
    return run, schema


def _asked(table: pa.Table) -> pa.Table:
    """The distinct events of a block of units, with their training counts."""
    part, seen, n = table.column("part")[0].as_py(), table.column("unit").to_pylist(), table.column("n").to_numpy()
    got = []
    for at in range(0, len(seen), STEP):
        event, start = events(seen[at : at + STEP])
        got.append(summed(event, np.repeat(n[at : at + STEP], np.diff(np.append(start, len(event))))))
    event, n = summed(*(np.concatenate(x) for x in zip(*got)))
    return pa.table({"part": pa.array(np.full(len(event), part), pa.int64()), "event": event, "n": n})


def _answered(key, tables: pa.Table, codes: pa.Table) -> pa.Table:
    """Log probability of every unit of a block, from those of its events."""
    event, logp = codes.column("event").to_numpy(), codes.column("logp").to_numpy()
    order = np.argsort(event)
    event, logp = event[order], logp[order]
    seen = tables.column("unit").to_pylist()
    out = np.empty(len(seen))
    for at in range(0, len(seen), STEP):
        asked, start = events(seen[at : at + STEP])
        out[at : at + STEP] = np.add.reduceat(logp[np.searchsorted(event, asked)], start)
    return pa.table({"unit": tables.column("unit").cast(pa.binary()), "n": tables.column("n"), "logp": out})


class Levels:
    """Counts of (context, symbol) of one order as sorted keys, and of its contexts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, below: "Levels | None"):
        seen = n > 0
        self.key, self.n = key[seen], n[seen]
        context = self.key >> 9
        start = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(context) else np.empty(0, np.int64)
        self.context = context[start]
        self.total = np.add.reduceat(self.n, start) if len(start) else start
        self.kinds = np.diff(np.append(start, len(context)))
        # What the shorter context has for the symbols of this one: excluded there.
        self.excluded = np.zeros(len(start), np.int64)
        if below is not None and len(start):
            short = self.key & ((1 << (8 * below.order + 9)) - 1)
            self.excluded = np.add.reduceat(below.count(short), start)
        self.order = 0 if below is None else below.order + 1

    def count(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.n[at], 0)

    def node(self, context: np.ndarray) -> np.ndarray:
        """The number of each context, -1 for none."""
        if not len(self.context):
            return np.full(len(context), -1)
        at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        return np.where(self.context[at] == context, at, -1)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, code = np.unique(key, return_inverse=True)
    return key, np.bincount(code, weights=n, minlength=len(key)).astype(np.int64)


def low_levels(event: np.ndarray, n: np.ndarray) -> list[Levels]:
    """Orders 0 to LOW from packed events and their counts."""
    have, cell = event >> 49, event & ((1 << 49) - 1)
    out: list[Levels] = []
    for k in range(LOW + 1):
        enough = have >= k
        out.append(Levels(*summed(cell[enough] & ((1 << (8 * k + 9)) - 1), n[enough]), out[-1] if out else None))
    return out


def code_lengths(event: np.ndarray, n: np.ndarray, low: list[Levels]) -> np.ndarray:
    """log10 of the probability of each event; the events hold all of any context beyond LOW that occurs in them."""
    have, cell = event >> 49, event & ((1 << 49) - 1)
    levels = list(low)
    for k in range(LOW + 1, ORDER + 1):
        enough = have >= k
        levels.append(Levels(*summed(cell[enough] & ((1 << (8 * k + 9)) - 1), n[enough]), levels[-1]))
    out = np.zeros(len(event))
    open_ = np.ones(len(event), bool)
    gone_n, gone_kinds = np.zeros(len(event), np.int64), np.zeros(len(event), np.int64)
    for k in range(ORDER, -1, -1):
        level = levels[k]
        at = np.flatnonzero(open_ & (have >= k))
        key = cell[at] & ((1 << (8 * k + 9)) - 1)
        node = level.node(key >> 9)
        at, key, node = at[node >= 0], key[node >= 0], node[node >= 0]
        total = level.total[node] - gone_n[at]
        kinds = level.kinds[node] - gone_kinds[at]
        count = level.count(key)
        hit = count > 0
        out[at[hit]] += np.log10((2 * count[hit] - 1) / (2 * total[hit]))
        open_[at[hit]] = False
        escape = ~hit & (kinds > 0)
        out[at[escape]] += np.log10(kinds[escape] / (2 * total[escape]))
        gone_n[at], gone_kinds[at] = level.excluded[node], level.kinds[node]
    kinds = levels[0].kinds[0] if len(levels[0].kinds) else 0
    out[open_] -= np.log10(max(1, SYMBOLS - kinds))
    return out


def _worked_out(low_event: np.ndarray, low_n: np.ndarray):
    """Code lengths of a partition sorted by group (the last three context bytes), whole groups at a time."""

    def run(batches):
        low = low_levels(low_event, low_n)
        event, n, group = (np.empty(0, np.int64) for _ in range(3))

        def rows(e, c):
            return pa.RecordBatch.from_arrays([pa.array(e), pa.array(code_lengths(e, c, low))], names=["event", "logp"])

        for batch in batches:
            event = np.append(event, batch.column("event").to_numpy(zero_copy_only=False))
            n = np.append(n, batch.column("n").to_numpy(zero_copy_only=False))
            group = np.append(group, batch.column("g").to_numpy(zero_copy_only=False))
            if len(event) >= EVENTS:
                to = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if to:
                    yield rows(event[:to], n[:to])
                    event, n, group = event[to:], n[to:], group[to:]
        if len(event):
            yield rows(event, n)

    return run


def _scored(total: int, kinds: int, ends: int, key: T.DataType):
    """Scores of a partition sorted by block, the dictionary of each block before its documents."""
    from .common import _arrow

    floor = total + kinds + 1

    def run(batches):
        block, parts, table = None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, parts, table = blocks[a], [], None
                docs = part.column("is_doc").to_numpy(zero_copy_only=False)
                split = int(np.searchsorted(docs, True))
                if split:
                    words_ = part.slice(0, split)
                    parts.append([words_.column(c).to_numpy(zero_copy_only=False) for c in ("number", "n", "logp", "is_word")])
                part = part.slice(split)
                if not part.num_rows:
                    continue
                if table is None:
                    number, count, logp, word = (np.concatenate(x) for x in zip(*parts))
                    order = np.argsort(number)
                    count, logp, word = count[order], logp[order], word[order].astype(bool)
                    table = np.where(word, np.log10((count + 1) / floor), 0.0), logp, (count > 0) & word
                base, logp, known = table
                got = []
                for raw in part.column("vector").to_pylist():
                    at, times = _Vector.unpack(raw)
                    got.append((int(times[known[at]].sum()) + (ends > 0), float(base[at] @ times) + float(np.log10((ends + 1) / floor)), float(logp[at] @ times)))
                cells = list(zip(*got))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("held_out"), part.column("n_tokens"), pa.array(cells[0], pa.int64()), pa.array([total] * part.num_rows, pa.int64()),
                     pa.array(cells[1], pa.float64()), pa.array(cells[2], pa.float64())], names=schema.names,
                )

    schema = T.StructType([
        T.StructField("key", key), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    return run, schema


def text_events(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The packed events of whole texts, and where each text begins; 0x01 stands before a text."""
    return events([r + END for r in raws])


def _squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _loosened(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _listed(event: np.ndarray, value: np.ndarray) -> bytes:
    """Sorted events with a value of eight bytes each, as compressed planes of bytes."""
    planes = [x.view(np.uint8).reshape(-1, 8).T for x in (np.diff(event, prepend=0), value)]
    return _squeezed(np.concatenate(planes).tobytes())


def _unlisted(raw: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(_loosened(raw), np.uint8).reshape(2, 8, -1)
    step, value = (np.ascontiguousarray(p.T).view(k)[:, 0] for p, k in zip(planes, ("<i8", kind)))
    return np.cumsum(step), value


def _cell(event: np.ndarray) -> np.ndarray:
    """The cell of each event: events whose contexts agree in the last LOW + 1 bytes, or are shorter and equal, share one."""
    have, group = np.minimum(event >> 49, LOW + 1), event >> 9 & ((1 << 8 * (LOW + 1)) - 1)
    mixed = (have << 8 * (LOW + 1) | group).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(CELLS)).astype(np.int64)


def _blocks(key: T.DataType):
    """Per block: its words and end with training counts, its events as one list a cell, its counts of low orders (cell -1), its texts."""
    from .common import _arrow

    kinds = {
        "block": pa.int64(), "unit": pa.binary(), "n": pa.int64(), "cell": pa.int64(), "list": pa.binary(),
        "key": _arrow(key), "held_out": pa.bool_(), "n_tokens": pa.int64(), "text": pa.binary(),
    }

    def rows(block, size, **given):
        given["block"] = [block] * size
        got = [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], k) if c in given else pa.nulls(size, k) for c, k in kinds.items()]
        return pa.RecordBatch.from_arrays(got, names=list(kinds))

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        taught: Counter = Counter()
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def ended():
            got = list(taught)
            for at in range(0, len(got), 50_000):
                part = got[at : at + 50_000]
                yield rows(block, len(part), unit=part, n=[taught[u] for u in part])
            if not asked:
                return
            event, n = summed(*(np.concatenate(x) for x in zip(*asked)))
            have = np.minimum(event >> 49, LOW)
            low = have << 49 | event & (1 << (8 * have + 9)) - 1
            lists = {-1: _listed(*summed(low, n))}
            cell = _cell(event)
            order = np.argsort(cell, kind="stable")
            cell, event, n = cell[order], event[order], n[order]
            cuts = np.flatnonzero(np.diff(cell, prepend=-1)).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(cell)]):
                lists[int(cell[a])] = _listed(event[a:b], n[a:b])
            yield rows(block, len(lists), cell=list(lists), list=list(lists.values()))

        for batch in batches:
            for part in chunks(batch, "text"):
                raws, held = [fold_case(t.encode()) for t in part.column("text").to_pylist()], part.column("held_out").to_pylist()
                found = [words(r) for r in raws]
                for some, kept in zip(found, held):
                    # Words of texts that are not learnt from stand with the count 0.
                    taught.update(dict.fromkeys(some, 0) if kept else some)
                taught[END] += len(held) - sum(held)
                asked.append(np.unique(text_events([r for r, kept in zip(raws, held) if not kept])[0], return_counts=True))
                event = np.unique(text_events([r for r, kept in zip(raws, held) if kept])[0])
                asked.append((event, np.zeros(len(event), np.int64)))
                size += sum(map(len, raws))
                yield rows(
                    block, len(raws), key=part.column("key").cast(kinds["key"]), held_out=part.column("held_out"),
                    n_tokens=[len(x) + 1 for x in found], text=[_squeezed(r) for r in raws],
                )
                if size >= SPAN:
                    yield from ended()
                    taught, asked, size, block = Counter(), [], 0, block + 1
        yield from ended()

    schema = T.StructType([
        T.StructField(n, k) for n, k in zip(kinds, [
            T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.BinaryType(), key, T.BooleanType(), T.LongType(), T.BinaryType(),
        ])
    ])
    return run, schema


def _low_rows(batches):
    for batch in batches:
        for raw in batch.column("list").to_pylist():
            event, n = _unlisted(raw, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(event), pa.array(n)], names=["event", "n"])


def _cells_worked_out(low_event: np.ndarray, low_n: np.ndarray):
    """For every block of a partition sorted by cell the code lengths of its events, whole cells at a time."""

    def run(batches):
        low = low_levels(low_event, low_n)
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        size = 0

        def rows(some):
            event, code = np.unique(np.concatenate([x[2] for x in some]), return_inverse=True)
            n = np.bincount(code, weights=np.concatenate([x[3] for x in some]), minlength=len(event)).astype(np.int64)
            logp = np.split(code_lengths(event, n, low)[code], np.cumsum([len(x[2]) for x in some])[:-1])
            for at in range(0, len(some), 1000):
                part = list(zip(some[at : at + 1000], logp[at : at + 1000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[1] for x, _ in part], pa.int64()), pa.array([_listed(x[2], p) for x, p in part], pa.binary())], names=["block", "list"],
                )

        for batch in batches:
            for cell, block, raw in zip(*(batch.column(c).to_pylist() for c in ("cell", "block", "list"))):
                if size >= EVENTS and held[-1][0] != cell:
                    yield from rows(held)
                    held, size = [], 0
                held.append((cell, block, *_unlisted(raw, "<i8")))
                size += len(held[-1][2])
        if held:
            yield from rows(held)

    return run


def _texts_scored(total: int, kinds: int, ends: int, key: T.DataType):
    """Scores of a partition sorted by block, the words and events of each block before its texts."""
    from .common import CHUNK_BYTES

    floor = total + kinds + 1
    schema = T.StructType([
        T.StructField("key", key), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def priced(rows, raws, counts, event, logp):
        asked, start = text_events(raws)
        asked, code = np.unique(asked, return_inverse=True)
        full = np.add.reduceat(logp[np.searchsorted(event, asked)][code], start)
        found = [np.array([counts[w] for w in words(r)] + [ends], np.int64) for r in raws]
        n = len(raws)
        return pa.RecordBatch.from_arrays([
            rows.column("key"), rows.column("held_out"), rows.column("n_tokens"), pa.array([int((x > 0).sum()) for x in found], pa.int64()),
            pa.array([total] * n, pa.int64()), pa.array([float(np.log10((x + 1) / floor).sum()) for x in found], pa.float64()), pa.array(full, pa.float64()),
        ], names=schema.names)

    def run(batches):
        block, counts, lists, table = None, {}, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, counts, lists, table = blocks[a], {}, [], None
                split = int(np.searchsorted(part.column("is_doc").to_numpy(zero_copy_only=False), True))
                for unit, n, raw in zip(*(part.slice(0, split).column(c).to_pylist() for c in ("unit", "n", "list"))):
                    if unit is None:
                        lists.append(_unlisted(raw, "<f8"))
                    else:
                        counts[unit] = n
                part = part.slice(split)
                if not part.num_rows:
                    continue
                if table is None:
                    event, logp = (np.concatenate(x) for x in zip(*lists))
                    order = np.argsort(event)
                    table, lists = (event[order], logp[order]), []
                at, raws, size = 0, [], 0
                for raw in part.column("text"):
                    raws.append(_loosened(raw.as_py()))
                    size += len(raws[-1])
                    if size >= CHUNK_BYTES:
                        yield priced(part.slice(at, len(raws)), raws, counts, *table)
                        at, raws, size = at + len(raws), [], 0
                if raws:
                    yield priced(part.slice(at), raws, counts, *table)

    return run, schema


def _score_across(source: DataFrame, kind: T.DataType) -> DataFrame:
    store = Store(source.sparkSession, "lm")
    run, schema = _blocks(kind)
    both = store.put(source.mapInArrow(run, schema))
    held = both.filter("unit IS NOT NULL").select("block", "unit", "n")
    counted = store.put(held.groupBy("unit").agg(F.sum("n").alias("n")))
    end = F.col("unit") == F.lit(bytearray(END))
    facts = counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("kinds"),
        F.coalesce(F.sum(F.when(end, F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    # At most 2**16 contexts of two bytes, and as many of one, with at most SYMBOLS symbols each.
    low = both.filter("cell = -1").select("list").mapInArrow(_low_rows, "event long, n long").groupBy("event").agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    lists = both.filter("cell >= 0").select("cell", "block", "list").repartition("cell").sortWithinPartitions("cell")
    codes = lists.mapInArrow(_cells_worked_out(low.column("event").to_numpy(), low.column("n").to_numpy()), "block long, list binary")
    none = lambda name, t: F.lit(None).cast(t).alias(name)
    of_doc = [none("key", kind), none("held_out", "boolean"), none("n_tokens", "long"), none("text", "binary")]
    rows = held.select("block", "unit").join(counted, "unit").select("block", F.lit(False).alias("is_doc"), "unit", "n", none("list", "binary"), *of_doc)
    rows = rows.union(codes.select("block", F.lit(False), none("unit", "binary"), none("n", "long"), "list", *of_doc))
    rows = rows.union(both.filter("text IS NOT NULL").select(
        "block", F.lit(True), none("unit", "binary"), none("n", "long"), none("list", "binary"), "key", "held_out", "n_tokens", "text",
    ))
    run, schema = _texts_scored(int(facts.tokens), int(facts.kinds), int(facts.ends), kind)
    return rows.repartition("block").sortWithinPartitions("block", "is_doc").mapInArrow(run, schema)


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", across: bool = False) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the rows that ``held_out`` does not mark.  A-Z count as lower
    case.  ``base_score`` is the word model with one added to every count;
    ``score`` is log10 of the probability that PPM gives the whole text, white
    space and end included.  Its contexts run ``across`` white space or start anew
at every unit; only across does the order of the words count.  A null text is empty: one token, its end.  Without
    any training row all counts are zero and bytes are equally likely.  Rows
    that repeat are learnt and scored each; other columns are not read.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = docs.schema[key].dataType
    if across:
        return _score_across(source, kind).withColumnRenamed("key", key)
    store = Store(docs.sparkSession, "lm")
    run, schema = _vectors(kind)
    both = store.put(source.mapInArrow(run, schema))
    held = both.filter("unit IS NOT NULL").select("block", "unit", "number", "n")
    vectors = both.filter("unit IS NULL")
    # Every unit of the corpus once, in blocks of units.
    counted = store.put(held.groupBy("unit").agg(F.sum("n").alias("n")))
    word = F.expr("length(unit) > 0 AND substring(unit, -1, 1) <> X'FF' AND substring(unit, 1, 1) NOT IN (X'20', X'09', X'0A', X'0B', X'0C', X'0D')")
    facts = counted.agg(
        F.count(F.lit(1)).alias("units"), F.coalesce(F.sum(F.when(word, F.col("n"))), F.lit(0)).alias("tokens"),
        F.count(F.when(word & (F.col("n") > 0), 1)).alias("kinds"),
    ).first()
    # Every training text ends once.
    ends = counted.filter("substring(unit, -1, 1) = X'FF'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = facts.tokens + ends, facts.kinds + (ends > 0)
    parts = max(1, -(-facts.units // UNITS))
    placed = counted.withColumn("part", F.pmod(F.xxhash64("unit"), F.lit(parts)))
    asked = store.put(placed.groupBy("part").applyInArrow(_asked, "part long, event long, n long"))
    trie = store.put(asked.groupBy("event").agg(F.sum("n").alias("n")))
    # At most 2**16 contexts of two bytes, and as many of one, with at most SYMBOLS symbols each.
    order = F.least(F.shiftright("event", 49), F.lit(LOW))
    cut = F.when(order == 0, suffix(F.col("event"), 0)).when(order == 1, suffix(F.col("event"), 1)).otherwise(suffix(F.col("event"), 2))
    low = trie.groupBy(F.shiftleft(order, 49).bitwiseOR(cut).alias("event")).agg(F.sum("n").alias("n")).filter("n > 0").toArrow()
    group = F.shiftright(suffix(F.col("event"), LOW + 1), 9).bitwiseOR(F.shiftleft(F.least(F.shiftright("event", 49), F.lit(LOW + 1)), 49)).alias("g")
    sorted_ = trie.select("event", "n", group).repartition("g").sortWithinPartitions("g")
    codes = sorted_.mapInArrow(_worked_out(low.column("event").to_numpy(), low.column("n").to_numpy()), "event long, logp double")
    answers = asked.select("part", "event").join(codes, "event").select("part", "event", "logp")
    priced = placed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_answered, "unit binary, n long, logp double")
    slices = held.select("block", "unit", "number").join(priced, "unit").select("block", "number", "n", "logp", word.alias("is_word"))
    none = lambda name, t: F.lit(None).cast(t).alias(name)
    rows = slices.select(
        "block", F.lit(False).alias("is_doc"), "number", "n", "logp", "is_word", none("key", kind), none("held_out", "boolean"), none("n_tokens", "long"), none("vector", "binary"),
    ).union(vectors.select(
        "block", F.lit(True), none("number", "int"), none("n", "long"), none("logp", "double"), none("is_word", "boolean"), "key", "held_out", "n_tokens", "vector",
    ))
    run, schema = _scored(int(total), int(kinds), int(ends), kind)
    out = rows.repartition("block").sortWithinPartitions("block", "is_doc").mapInArrow(run, schema)
    return out.withColumnRenamed("key", key)
