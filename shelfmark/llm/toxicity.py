"""Toxicity scores from a counterfactually regularised classifier.

Method: a logistic model over words and word beginnings, fitted on labelled
texts.  Each training text with identity terms gets counterparts in which the
terms are swapped for others of their set; the squared change of the score is
part of the loss, so that mentioning a group does not move the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, chunks, map_text

# Sets of identity terms that may stand for one another.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["immigrants", "natives", "refugees", "citizens"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["christen", "muslime", "juden", "hindus"],
    ["femmes", "hommes", "filles", "garçons"],
    ["chrétiens", "musulmans", "juifs", "hindous"],
    ["mujeres", "hombres", "chicas", "chicos"],
    ["cristianos", "musulmanes", "judíos", "hindúes"],
]
#: Labelled texts of each label that the model is fitted on, and features that it keeps, at most.
SAMPLE, FEATURES = 4000, 8192
#: Lengths of the word beginnings that are features beside whole words.
BEGINNINGS = (4, 5, 6)
#: Least documents and least z value (of two proportions) of a feature.
LEAST_DOCS, LEAST_Z = 4, 4.0
THRESHOLD = 0.7

_WORD = regex.compile(r"\p{L}+")


class Features:
    """64-bit hashes of the words and word beginnings of a text, remembered by word."""

    def __init__(self, most: int = 50_000):
        self.known: dict[str, list[int]] = {}
        self.most = most

    def of_word(self, w: str) -> list[int]:
        got = self.known.get(w)
        if got is None:
            if len(self.known) >= self.most:
                self.known.clear()
            parts = ["=" + w, *("^" + w[:n] for n in BEGINNINGS if len(w) > n)]
            got = self.known[w] = [xxhash.xxh64_intdigest(p) >> 1 for p in parts]
        return got

    def words(self, text: str) -> set[str]:
        return set(_WORD.findall(text.lower()))

    def of(self, words: set[str]) -> np.ndarray:
        return np.unique(np.array([h for w in words for h in self.of_word(w)], np.int64))


def counterparts(words: set[str], sets: list[list[str]] = IDENTITY) -> list[set[str]]:
    """The word set with its identity terms swapped, once for every other term of a set."""
    out = []
    for terms in sets:
        here = words.intersection(terms)
        for term in here:
            out += [(words - {term}) | {other} for other in terms if other not in here]
    return out


class Model:
    """Sorted feature hashes with their weights; ``bias`` is the log odds without any of them."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    def score(self, features: np.ndarray) -> float:
        z = self.bias
        if len(self.keys) and len(features):
            at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
            z += float(self.weights[at[self.keys[at] == features]].sum())
        return 1 / (1 + np.exp(-min(max(z, -40.0), 40.0)))


def fit(
    rows: list[tuple[int, np.ndarray, list[np.ndarray]]], keys: np.ndarray, ridge: float = 0.002, swap: float = 1.0, rounds: int = 1000,
) -> Model:
    """The model over the features ``keys`` of labelled feature sets, each with the feature sets of its counterparts.

    Loss: mean logistic loss with labels in equal parts, plus ``ridge`` times
    the squared weights, plus ``swap`` times the mean squared score change
    between a text and its counterparts.  Without both labels the score is the
    share of label 1 (0 without any row).
    """
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.empty(0, np.int64), np.empty(0), float(np.clip(np.log(share + 1e-3) - np.log(1 - share + 1e-3), -7, 7)))
    keys = np.sort(keys)
    n1, n0 = y.sum(), len(y) - y.sum()

    def cells(lists):
        own = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        f = np.concatenate(lists) if lists else np.empty(0, np.int64)
        if not len(keys) or not len(f):
            return own[:0], own[:0]
        at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
        same = keys[at] == f
        return own[same], at[same]

    doc, feat = cells([r[1] for r in rows])
    swaps = [(i, c) for i, r in enumerate(rows) for c in r[2]]
    origin = np.array([i for i, _ in swaps], np.int64)
    s_doc, s_feat = cells([c for _, c in swaps])
    each = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b = np.zeros(len(keys)), 0.0
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for step in range(1, rounds + 1):
        p = sig(np.bincount(doc, weights=w[feat], minlength=len(y)) + b)
        d = (p - y) * each
        ds = np.empty(0)
        if len(swaps):
            q = sig(np.bincount(s_doc, weights=w[s_feat], minlength=len(swaps)) + b)
            gap = 2 * swap * (p[origin] - q) / len(swaps)
            d = d + np.bincount(origin, weights=gap, minlength=len(y)) * p * (1 - p)
            ds = -gap * q * (1 - q)
        g = np.bincount(feat, weights=d[doc], minlength=len(keys)) + 2 * ridge * w / max(1, len(keys))
        if len(ds):
            g = g + np.bincount(s_feat, weights=ds[s_doc], minlength=len(keys))
        g = np.append(g, d.sum() + ds.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(keys, w, b)


def train(
    docs: DataFrame, labels: DataFrame, where: Column, text: str = "text", key: str = "doc_id", label: str = "toxic",
    sample: int = SAMPLE, swap: float = 1.0,
) -> Model:
    """A model fitted on the labelled documents that ``where`` (over the id) admits.

    A bounded sample is used: of each label the ``sample`` rows of smallest
    hash of text and id, so the model is reproducible.  Null labels, null ids
    and null texts are left out.
    """
    marks = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    marks = marks.filter(where)
    # The sample is drawn from ids, so only its texts are shuffled.
    drawn = [marks.filter(F.col("_label") == y).orderBy(F.xxhash64(key), key).limit(sample) for y in (0, 1)]
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_text")).join(drawn[0].union(drawn[1]), key)
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("seen", T.ArrayType(T.LongType())), T.StructField("swaps", T.ArrayType(T.ArrayType(T.LongType())))])

    def featurise(batches):
        features = Features()
        for batch in batches:
            for part in chunks(batch, "_text"):
                got = []
                for t in part.column("_text").to_pylist():
                    found = features.words(t)
                    got.append((features.of(found), [features.of(c) for c in counterparts(found)]))
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_label").cast(pa.int32()), pa.array([a for a, _ in got], lists), pa.array([b for _, b in got], pa.list_(lists))],
                    names=schema.names,
                )

    seen = Store(docs.sparkSession, "toxicity").put(rows.select("_label", "_text").mapInArrow(featurise, schema))
    totals = seen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    n1, n0 = max(totals.n1, 1), max(totals.n - totals.n1, 1)
    # Features that are spread unevenly over the labels, by the z value of two proportions.
    counts = seen.select("label", F.explode("seen").alias("feature")).groupBy("feature").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("df"))
    share = F.col("df") / (n1 + n0)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    z = F.abs((F.col("pos") / n1 - (F.col("df") - F.col("pos")) / n0) / spread)
    chosen = counts.withColumn("z", z).filter((F.col("df") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "feature").limit(FEATURES)
    keys = np.sort(np.array([r.feature for r in chosen.select("feature").collect()], np.int64))

    def kept(batches):
        for batch in batches:
            only = lambda x: np.intersect1d(np.array(x, np.int64), keys)
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([only(x).tobytes() for x in batch.column("seen").to_pylist()], pa.binary()),
                 pa.array([[only(x).tobytes() for x in s] for s in batch.column("swaps").to_pylist()], pa.list_(pa.binary()))], names=["label", "seen", "swaps"],
            )

    # What reaches the driver: at most twice ``sample`` rows of chosen features.
    loads = lambda raw: np.frombuffer(bytes(raw), np.int64)
    got = [(r.label, loads(r.seen), [loads(s) for s in r.swaps]) for r in seen.mapInArrow(kept, "label int, seen binary, swaps array<binary>").collect()]
    return fit(sorted(got, key=lambda r: (r[0], r[1].tobytes())), keys, swap=swap)


def score(df: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on) of its whole texts.

    Null and empty texts get the score of no feature.  Rows are scored alone,
    by their text only, so repeated texts have equal scores.  Columns of these
    names are replaced, others stay.
    """

    def make():
        features = Features()

        def call(texts):
            scores = [float(model.score(features.of(features.words(t)))) for t in texts]
            return [scores, [int(s >= threshold) for s in scores]]

        return call

    return map_text(df, text, T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]), make, carry)
