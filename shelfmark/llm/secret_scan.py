"""Secret scans: fixed patterns, and a character network over further candidates.

Method: every run of token characters from the shortest length of a base
finding on, with or without a digit, is a candidate; of a run that a base span
covers in part, what is left of it.  A convolutional network in numpy reads it with its surrounding
context.  It is trained on labelled findings of a bounded sample of the corpus
(values of the fixed patterns, of any length, against other runs), its scores are calibrated
on findings kept apart, and its threshold keeps the wanted recall of all
findings of the corpus that it was not fitted on, counted by score, with as few
other runs as the highest one that does.  Spans of the fixed patterns stay whatever it says.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, chunks, fresh, map_text

# The patterns of the base kinds, in listed order.
KINDS = ["assign", "access", "hex", "model"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
KEYWORDS = ("passw", "secret", "token", "api")
# A run that is too short for its kind holds no other match of the kind, so the length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

_CLASS = np.zeros(256, bool)
_CLASS[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True

BEFORE, SEEN, AFTER = 16, 48, 8
WIDTH = BEFORE + SEEN + AFTER
#: The shortest value that a fixed pattern takes.
SHORTEST = 6
#: Other runs without a digit and below this length are drawn apart from the rest.
PLAIN = 16
#: Text bytes whose convolution is in memory at a time.
TILE = 64 << 10
#: Documents whose findings train the network, and findings of each label at most.
SAMPLE_DOCS, SAMPLE_FINDINGS = 6000, 2000
RECALL = 0.98
#: Cells in which scores of findings are counted.
BINS = 4096
TAPS, FILTERS, DEPTH = 5, 16, 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return out


def value_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans without the keywords of assignments."""
    return [(ASSIGN.match(text, s, e).start(2) if k == 0 else s, e, k) for s, e, k in spans]


def runs(held: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``held``."""
    edge = np.diff(np.concatenate(([False], held, [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= shortest
    return start[long], end[long]


def windows(raw: bytes, start: int, end: int) -> np.ndarray:
    """The run with its context as rows of codes; a run beyond one row is read in half-overlapping rows to its end."""
    rows = []
    for at in range(start, max(start + 1, end - SEEN // 2), SEEN // 2):
        to = min(end, at + SEEN)
        row = np.zeros(WIDTH, np.uint8)
        before = raw[max(0, at - BEFORE) : at]
        row[BEFORE - len(before) : BEFORE] = np.minimum(np.frombuffer(before, np.uint8), 127)
        body = raw[at : min(to + AFTER, len(raw))]
        row[BEFORE : BEFORE + len(body)] = np.minimum(np.frombuffer(body, np.uint8), 127)
        rows.append(row)
    return np.stack(rows)


class Network:
    """Embedding, one convolution, maximum over positions, and a logistic output."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.3, (128, DEPTH)), "conv": r.normal(0, (2 / (TAPS * DEPTH)) ** 0.5, (TAPS * DEPTH, FILTERS)),
            "shift": np.zeros(FILTERS), "out": r.normal(0, 0.3, FILTERS), "bias": np.zeros(1),
        }
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["embed"][x]
        n = x.shape[1] - TAPS + 1
        cols = np.concatenate([e[:, k : k + n] for k in range(TAPS)], axis=2)
        a = cols @ self.p["conv"] + self.p["shift"]
        best = a.argmax(axis=1)
        top = np.take_along_axis(a, best[:, None, :], 1)[:, 0]
        h = np.maximum(top, 0)
        return h @ self.p["out"] + self.p["bias"], (cols, best, top, h)

    def logits(self, x: np.ndarray, block: int = 512) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + block])[0] for i in range(0, len(x), block)]) if len(x) else np.empty(0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return self.calibrated(self.logits(x))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 3e-3, seed: int = 3) -> None:
        """Adam on the logistic loss, classes weighted to equal parts."""
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), 64):
                i = order[at : at + 64]
                z, (cols, best, top, h) = self._forward(x[i])
                d = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[i]) * weight[i] / len(i)
                g = {"out": h.T @ d, "bias": np.array([d.sum()])}
                dt = np.outer(d, self.p["out"]) * (top > 0)
                g["shift"] = dt.sum(0)
                picked = np.take_along_axis(cols, best[:, :, None], 1)  # (row, filter, tap x depth)
                g["conv"] = np.einsum("nfk,nf->kf", picked, dt)
                back = np.einsum("nf,kf->nfk", dt, self.p["conv"]).reshape(len(i), FILTERS, TAPS, DEPTH)
                g["embed"] = np.zeros_like(self.p["embed"])
                codes = x[i][np.arange(len(i))[:, None, None], best[:, :, None] + np.arange(TAPS)]
                np.add.at(g["embed"], codes, back)
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling by Newton steps."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        # Platt's smoothed targets keep a separable set finite.
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
        for _ in range(30):
            s = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            w = np.maximum(s * (1 - s), 1e-9)
            g = np.array([((s - t) * z).sum(), (s - t).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            da, db = np.linalg.solve(hess, g)
            a, b = a - da, b - db
        self.scale, self.offset = (a, b) if a > 0 and np.isfinite([a, b]).all() else (1.0, 0.0)

    def constrain(self, counts: dict[int, int], negative: np.ndarray, recall: float) -> None:
        """The threshold that keeps ``recall`` of all positives, whose scores are counted in BINS equal bins.

        No lower threshold up to the next of the ``negative`` rows lets more of
        these pass: halfway there, but at a half at least.
        """
        upto, total, highest = 0, sum(counts.values()), 0.0
        for b in sorted(counts, reverse=True):
            upto, highest = upto + counts[b], b / BINS
            if upto >= recall * total:
                break
        scores = self.scores(negative)
        lower = scores[scores < highest].max(initial=0.0)
        self.threshold = float(min(highest, max(0.5, (highest + lower) / 2))) if total else 1.1


def train(
    docs: DataFrame, text: str = "text", key: str = "doc_id",
    sample_docs: int = SAMPLE_DOCS, findings: int = SAMPLE_FINDINGS, recall: float = RECALL,
) -> Network:
    """A network fitted on the labelled findings of a bounded sample, its threshold set by all findings it was not fitted on.

    The sample is the ``sample_docs`` documents of smallest id hash plus as
    many that hold a finding; at most ``findings`` of the values, of the other
    runs with a digit or of PLAIN characters, and of all further ones are kept, in an order that depends on their content only, so the model is reproducible.
    Without any finding the network adds no span.
    """
    import zlib

    some = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(some.alias("text"), F.xxhash64(F.col(key), some).alias("order"))
    found = F.col("text").rlike(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}")
    added = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("seen", T.BinaryType())])
    # The sample is drawn by its order alone; at most twice ``sample_docs`` numbers are sent to all tasks.
    orders = base.select("order").orderBy("order").limit(sample_docs).union(base.filter(found).select("order").orderBy("order").limit(sample_docs))
    sample = base.join(F.broadcast(orders.distinct()), "order", "left_semi")

    def label(batches):
        import pyarrow as pa

        for part in (p for b in batches for p in chunks(b, "text")):
            found = {(y, row.tobytes()) for t in part.column("text").to_pylist() for y, row in labelled(t)}
            # Of the many further runs only those that can be among the first of all.
            plain = sorted((x for x in found if x[0] == 2), key=lambda x: (zlib.crc32(x[1]), x[1]))[:findings]
            kept = [x for x in found if x[0] != 2] + plain
            labels, rows = [x[0] for x in kept], [x[1] for x in kept]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(rows, pa.binary())], names=["label", "seen"])

    rows = Store(docs.sparkSession, "secrets").put(sample.select("text").mapInArrow(label, added).distinct())
    # Bounded: at most three times ``findings`` rows of WIDTH bytes.
    order = {0: F.xxhash64("seen"), 1: F.xxhash64("seen"), 2: F.crc32("seen")}
    got = [r for y in order for r in rows.filter(F.col("label") == y).orderBy(order[y], "seen").limit(findings).collect()]
    net = Network()
    if not any(r.label == 1 for r in got):
        net.threshold = 1.1
        return net
    x = np.stack([np.frombuffer(bytes(r.seen), np.uint8) for r in got])
    y = np.array([r.label == 1 for r in got], float)
    apart = np.arange(len(y)) % 4 == 0
    # Half of the training positives lose their context, so that a secret is known by its own characters too.
    bare = x[~apart].copy()
    bare[:, :BEFORE] = 32
    net.fit(np.concatenate([x[~apart], bare]), np.concatenate([y[~apart], y[~apart]]))
    net.calibrate(x[apart], y[apart])
    # What the network was fitted on says nothing about its recall.
    fitted = {r.tobytes() for r in x[~apart & (y == 1)]}

    def scored(batches):
        import pyarrow as pa

        counts = np.zeros(BINS + 1, np.int64)
        for part in (p for b in batches for p in chunks(b, "text")):
            # A run is a positive only where a base span is, which most texts do not have.
            for t in part.column("text").to_pylist():
                for y, rows in labelled_runs(t) if base_spans(t) else ():
                    if y == 1 and any(r.tobytes() not in fitted for r in rows):
                        # A run is found by its best window.
                        best = max(net.scores(np.stack(rows[at : at + 256])).max() for at in range(0, len(rows), 256))
                        counts[int(best * BINS)] += 1
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bin", "n"])

    bins = base.select("text").mapInArrow(scored, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    net.constrain({r.bin: r.n for r in bins}, x[apart & (y == 0)], recall)
    return net


def labelled(text: str):
    """(label, row) of every window of the runs of one text."""
    for label, rows in labelled_runs(text):
        for row in rows:
            yield label, row


def labelled_runs(text: str):
    """(label, rows) of the runs of one text.

    1 within a value of the fixed patterns, 0 outside of all findings with a
    digit or PLAIN characters, 2 for further ones.  A run that holds no more
    than the keyword of a finding is neither.
    """
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    found = base_spans(text)
    spans, values = byte_spans(text, found), byte_spans(text, value_spans(text, found))
    start, end = runs(_CLASS[data], SHORTEST)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    for s, e in zip(start.tolist(), end.tolist()):
        if any(a < e and s < b for a, b in values):
            label = 1
        elif any(a < e and s < b for a, b in spans):
            continue
        else:
            label = 0 if digits[e] > digits[s] or e - s >= PLAIN else 2
        yield label, list(windows(raw, s, e))


def byte_spans(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Spans in code points as spans in UTF-8 bytes."""
    if text.isascii() or not spans:
        return [(s, e) for s, e, _ in spans]
    at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
    return [(int(at[s]), int(at[e])) for s, e, _ in spans]


class Scanner:
    """All spans of texts: of the fixed patterns, and of further runs that the network holds for secrets."""

    def __init__(self, net: Network):
        self.net = net
        # What a code adds to the convolution at each tap, and what two neighbours add.
        tap = np.stack([net.p["embed"] @ net.p["conv"][k * DEPTH : (k + 1) * DEPTH] for k in range(TAPS)]).astype(np.float32)
        self.tap, self.none = tap, tap[:, 0]
        self.pair = {k: (tap[k][:, None] + tap[k + 1][None]).reshape(-1, FILTERS) for k in (0, 2)}

    def logits(self, codes: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The network's logits of the rows of ``windows`` that begin at ``at`` (ascending) and end at ``to``.

        ``codes`` has WIDTH zeros before and after every text.  The convolution
        is worked out once for every position, not once for every row.
        """
        out = np.empty(len(at))
        low = 0
        while low < len(at):
            high = int(np.searchsorted(at, at[low] + TILE))
            out[low:high] = self._tile(codes, at[low:high], to[low:high])
            low = high
        return out

    def _tile(self, codes: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        base = int(at[0]) - BEFORE
        x = codes[base : int(at[-1]) + SEEN + AFTER].astype(np.int64)
        at, to = at - base, to - base
        two = x[:-1] << 7 | x[1:]
        n = len(x) - TAPS + 1
        here = self.pair[0][two[:n]]
        here += self.pair[2][two[2 : 2 + n]]
        here += self.tap[4][x[4 : 4 + n]]
        # The maximum over 16 positions from each on; a row has 26 to 68 positions without padding.
        for k in (1, 2, 4, 8):
            here = np.maximum(here[:-k], here[k:])
        first, last = at - BEFORE, np.minimum(to + AFTER - TAPS, at + SEEN + AFTER - TAPS) - 15
        top = np.maximum(here[first], here[last])
        for k in (16, 32, 48):
            more = np.flatnonzero(first + k < last)
            top[more] = np.maximum(top[more], here[first[more] + k])
        # Positions that reach into the padding behind a short run, and those wholly in it.
        end = to + AFTER
        for k in range(1, TAPS + 1):  # k taps in the padding
            some = np.flatnonzero(end - TAPS + k <= at + SEEN + AFTER - TAPS)
            p = end[some] - TAPS + k
            real = TAPS - k
            value = np.tile(self.none[real:].sum(0), (len(some), 1))
            if real >= 2:
                value += self.pair[0][two[p]]
            if real == 4:
                value += self.pair[2][two[p + 2]]
            elif real % 2:
                value += self.tap[real - 1][x[p + real - 1]]
            top[some] = np.maximum(top[some], value)
        return np.maximum(top + self.net.p["shift"], 0) @ self.net.p["out"] + self.net.p["bias"]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, end, kind) by start, then kind, then end."""
        out = [base_spans(t) for t in texts]
        raws = [t.encode() for t in texts]
        gap = bytes(WIDTH)
        joined = np.frombuffer(gap + b"".join(r + gap for r in raws), np.uint8)
        first = WIDTH + np.concatenate(([0], np.cumsum([len(r) + WIDTH for r in raws])))[:-1].astype(np.int64)
        held = _CLASS[joined]
        for d, spans in enumerate(out):
            for s, e in byte_spans(texts[d], spans):
                held[first[d] + s : first[d] + e] = False
        start, end = runs(held, SHORTEST)
        if len(start) and self.net.threshold <= 1:
            # The rows of ``windows``.
            rows = np.maximum(1, -(-(end - start - SEEN // 2) // (SEEN // 2)))
            owner = np.repeat(np.arange(len(start)), rows)
            at = start[owner] + SEEN // 2 * (np.arange(len(owner)) - np.repeat(np.cumsum(rows) - rows, rows))
            score = self.net.calibrated(self.logits(np.minimum(joined, 127), at, np.minimum(end[owner], at + SEEN)))
            secret = np.flatnonzero(np.maximum.reduceat(score, np.cumsum(rows) - rows) >= self.net.threshold)
            doc = np.searchsorted(first, start[secret], "right") - 1
            points = np.concatenate(([0], np.cumsum(joined & 0xC0 != 0x80)))  # code points before each byte
            for s, e, d in zip(points[start[secret]], points[end[secret]], doc):
                begin = points[first[d]]
                out[d].append((int(s - begin), int(e - begin), 3))
        return [sorted(x, key=lambda v: (v[0], v[2], v[1])) for x in out]


def scan(df: DataFrame, net: Network, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``df`` with ``secret_spans``: all spans as kind, start and end in code points.

    Sorted by start, then kind in listed order (then end); the end is
    exclusive.  Spans of kind ``model`` are runs that the network scores at its
    threshold or above, without what base spans cover of them.  Null and empty texts
    have an empty list; each row is judged alone, so repeated rows agree.  A
    column ``secret_spans`` of ``df`` is replaced, others stay.
    """

    def make():
        scanner = Scanner(net)
        return lambda texts: [[[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in x] for x in scanner.spans(texts)]]

    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return map_text(df, text, T.StructType([T.StructField("secret_spans", T.ArrayType(span))]), make, carry)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with its spans replaced; overlapping spans count as one."""
    parts, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            parts += [text[at:s], mark]
        at = max(at, e)
    return "".join(parts) + text[at:]


def redact(df: DataFrame, net: Network, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every secret of its texts replaced by ``mark``, and ``n_secrets``, the number of spans.

    Texts without one (null and empty ones too) stay as they are; a column
    ``n_secrets`` of ``df`` is replaced.
    """
    clean = fresh(df, "_clean")

    def make():
        scanner = Scanner(net)

        def call(texts):
            found = scanner.spans(texts)
            return [[len(x) for x in found], [masked(t, x, mark) if x else None for t, x in zip(texts, found)]]

        return call

    added = T.StructType([T.StructField("n_secrets", T.LongType()), T.StructField(clean, T.StringType())])
    return map_text(df, text, added, make).withColumn(text, F.coalesce(clean, text)).drop(clean)


def report(df: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans of every document as text."""
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("secret_spans", lambda x: x["kind"] != "model")
    return df.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("secret_spans")).alias("spans"),
    )
