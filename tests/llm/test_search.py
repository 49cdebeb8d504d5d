"""Exact top-k search, ranked lexical search and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import bitslices, centroids, lexical


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def odd_vectors(width):
    return [
        (None, [0.25] * width), (9000, None), (9050, [float("nan")] * width), (9100, [None] * width), (9150, []), (9200, [0.0] * width),
        (9250, [float("inf")] * width), (9300, [1e300] * width), (9350, [-0.5] * 3), (9400, [0.5] * (width + 2)), (9450, [-1e-9] * width),
    ]


def exact_top(rows, every, top):
    x = {}
    for r, (_, v) in enumerate(rows):
        if v is not None and None not in v and np.isfinite(v).all():
            q = [math.floor(256 * c) for c in v]
            if sum(c * c for c in q) < 1 << 62:
                x[r] = q
    out = []
    for r, q in x.items():
        if rows[r][0] is None or rows[r][0] % every:
            continue
        scores = [(-sum(a * b for a, b in zip(q, v)), rows[s][0] is None, rows[s][0] or 0, rows[s][0]) for s, v in x.items() if s != r]
        out += [(rows[r][0], k + 1, key, -s) for k, (s, _, _, key) in enumerate(sorted(scores)[:top])]
    return Counter(out)


@pytest.mark.parametrize("size", [100, 1 << 14])
def test_bitslices_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(bitslices, "ROWS", size)
    monkeypatch.setattr(bitslices, "BLOCKS", 2)
    monkeypatch.setattr(bitslices, "QUERIES", (4, 8))
    r = np.random.default_rng(3)
    rows = [(k, (r.normal(size=24) * r.choice([0.1, 1, 30])).tolist()) for k in range(700)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(300)] + [(50, rows[50][1]), (50, rows[7][1]), (5000, rows[1][1])]
    rows += odd_vectors(24)
    df = frame(spark, rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("unit", F.lit(1))
    got = bitslices.search(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(map(tuple, got.collect())) == exact_top(rows, 50, 5)


def test_bitslices_of_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.5]), (100, [3.0, 0.0])]
    got = bitslices.search(frame(spark, rows, "vec_id long, embedding array<float>"))
    assert Counter(map(tuple, got.collect())) == exact_top(rows, 50, 5)
    assert bitslices.search(spark.createDataFrame(rows[1:2], "vec_id long, embedding array<float>")).count() == 0
    assert bitslices.search(spark.createDataFrame(rows[:1], "vec_id long, embedding array<float>")).count() == 0
    assert bitslices.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bitmap_sums_and_top_slices():
    r = np.random.default_rng(4)
    for bound in (2, 100, 5000):
        x, q = r.integers(-bound, bound, (203, 9)), r.integers(-bound, bound, 9)
        slices, low, shift = bitslices.sliced(x)
        total, less = bitslices.weighted_sum(slices, ~slices, q)
        bits = np.stack([np.unpackbits(t.view(np.uint8), bitorder="little")[:203] for t in total])
        sums = sum(b.astype(object) << p for p, b in enumerate(bits)) - less
        assert sums.tolist() == ((x - low >> shift) @ q).tolist()
        rows = np.packbits(np.r_[np.ones(203, np.uint8), np.zeros(53, np.uint8)], bitorder="little").view(np.uint64)
        for top in (1, 5, 203):
            least = bitslices.least_of_top(total, rows, top)
            assert least - less == sorted(sums, reverse=True)[top - 1]
            chosen = np.unpackbits(bitslices.at_least(total, rows, least).view(np.uint8), bitorder="little")[:203]
            assert chosen.tolist() == [int(s >= least - less) for s in sums]
    assert all(sum(d << p for p, d in bitslices.digits(w)) == w for w in range(-300, 300))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def exact_ranking(docs, items, top=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    docs_n, length = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * docs_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        found = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * docs_n // max(length, 1)
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found)[:top])]
    return Counter(out)


def ranking_rows():
    r = random.Random(8)
    words = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 200])))) for k in range(900)]
    docs += [(2000 + k, docs[3][1]) for k in range(400)] + [(3000, "the " * 3000 + "rare"), (3001, None), (3002, ""), (3003, "?! \n"), (None, docs[2][1])]
    docs += [(7, docs[2][1]), (7, docs[2][1]), (3004, "É é ÉA xéX İı  a"), (3005, "common"), (3006, "Common COMMON")]
    items = [(k, docs[r.randrange(900)][1][:200]) for k in range(40)]
    items += [(2, docs[3][1]), (100, None), (101, ""), (102, "nowhere else"), (103, "éa É"), (None, "rare common"), (104, "the"), (105, "w1 w1 W1 " + docs[3][1])]
    return docs, items


@pytest.mark.parametrize("docs_a_block, read_out", [(12, 64), (6, 1), (12, 0)])
def test_lexical_against_every_document(spark, monkeypatch, docs_a_block, read_out):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", min(lexical.BLOCK_DOCS, 1 << docs_a_block))
    monkeypatch.setattr(lexical, "BITS", docs_a_block)
    order = np.random.default_rng(1).permutation(1 << docs_a_block).astype(np.uint32)
    monkeypatch.setattr(lexical, "_ORDER", order)
    monkeypatch.setattr(lexical, "_PLACE", np.argsort(order).astype(np.int64))
    monkeypatch.setattr(lexical, "READ_OUT", read_out)
    docs, items = ranking_rows()
    # Called as a task calls it: settings of this process do not reach the workers of a session.
    index = list(lexical._indexed([pa.RecordBatch.from_pydict({"id": [d for d, _ in docs], "text": [t or "" for _, t in docs]}, pa.schema([("id", pa.int64()), ("text", pa.string())]))]))
    size, length = sum(int((np.array(b["n"][0].as_py()) > 0).sum()) for b in index), sum(sum(b["n"][0].as_py()) for b in index)
    df = Counter()
    for b in index:
        df.update(dict(zip(b["terms"][0].as_py(), b["df"][0].as_py())))
    weight = {t: math.floor(1000 * math.log((2 * size + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = [(k, sorted({t for t in terms(text) if t in df})) for k, (_, text) in enumerate(items)]
    run = lexical._searcher([(k, ts, [weight[t] for t in ts]) for k, ts in asked if ts], [1] * sum(bool(ts) for _, ts in asked), size, length, 10)
    found = {}
    for b in run(iter(index)):
        for k, d, s in zip(*(c.to_pylist() for c in b.columns)):
            found.setdefault(k, []).append((-s, d is None, d or 0, d))
    got = [(items[k][0], n + 1, d, -s) for k, rows in found.items() for n, (s, _, _, d) in enumerate(sorted(rows)[:10])]
    assert Counter(got) == exact_ranking(docs, items)


def test_lexical_search(spark, monkeypatch):
    monkeypatch.setattr(lexical, "ITEMS", 7)
    docs, items = ranking_rows()
    df = frame(spark, docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("score", F.lit(1))
    asked = frame(spark, items, "item_id long, text string").withColumn("item", F.lit("x"))
    got = lexical.search(df, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == exact_ranking(docs, items)
    assert lexical.search(df.limit(0), asked).count() == 0
    assert lexical.search(df, asked.limit(0)).count() == 0


def exact_clusters(rows, rounds=10):
    kept = []
    for key, v in rows:
        if v is not None and len(v) == 64 and None not in v and np.isfinite(v).all():
            x = [math.floor(1024 * c) for c in v]
            if max(map(abs, x)) < 1 << 27:
                kept.append((key, x))
    mark = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], np.int32).tobytes())
    centres = [x for _, x in sorted(kept, key=mark)[:8]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        groups = [[x for (_, x), a in zip(kept, at) if a == k] for k in range(len(centres))]
        centres = [[sum(c) // len(g) for c in zip(*g)] if g else centres[k] for k, g in enumerate(groups)]
    last = [nearest(x) for _, x in kept]
    sums = Counter()
    for d, k in last:
        sums[k] += d
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((key, k, d, sums[k], sum(sums.values()), marks[k]) for (key, _), (d, k) in zip(kept, last))


def vector_rows(count):
    r = np.random.default_rng(6)
    middle = r.normal(size=(5, 64))
    rows = [(k, (middle[k % 5] + r.normal(size=64) * 0.4).tolist()) for k in range(count)]
    return rows + [(1000 + k, rows[0][1]) for k in range(count // 3)]


@pytest.mark.parametrize("rows", [vector_rows(240) + odd_vectors(64) + [(3, [0.0] * 64), (3, [1.0] * 64)], vector_rows(4), [(k, [0.5] * 64) for k in range(20)]])
def test_centroids_against_plain_loops(spark, rows):
    df = frame(spark, rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("x")).withColumn("cluster", F.lit(1))
    got = centroids.cluster(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == exact_clusters(rows)


def test_centroids_of_nothing(spark):
    assert centroids.cluster(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")).count() == 0


def test_ptolemaic_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    middle = r.integers(-900, 900, (8, 64))
    x = np.concatenate([m + r.integers(-60, 60, (300, 64)) for m in middle])
    pivots, centres = x[::300], middle
    near, centre, between = (centroids._distances(v, pivots) for v in (x, centres, pivots))
    low = centroids.bounds(near, centre, between)
    plain = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (low <= plain).all()
    cluster, distance, computed = centroids.nearest(x, near, centres, centre, between)
    assert (distance == plain.min(axis=1)).all() and (cluster == plain.argmin(axis=1)).all()
    assert computed < 0.8 * plain.size
