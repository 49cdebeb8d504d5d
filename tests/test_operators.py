"""Operators against plain Python on small fixtures, including skewed groups."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.operators import audit, coverage, dedupe, documents, identity, manifests, matching, ordered, overlap, runs, sequences, spread
from shelfmark.plans import registry
from shelfmark.session import stored
from shelfmark.sources import plans as sources


def running_rows():
    rng = random.Random(3)
    rows = []
    for key, size in (("hot", 200), ("a", 3), ("b", 1), ("c", 5)):
        for pos in sorted(rng.sample(range(1000), size)):
            rows.append((key, pos, rng.randint(-5, 5) if key != "c" else None, rng.choice([None, f"m{pos}"])))
    rng.shuffle(rows)
    return rows


def plain_running(rows, inclusive):
    out, state = {}, {}
    for k, pos, n, m in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        before = state.get(k, (0, None, None))
        total, mark, top = before
        state[k] = total + (n or 0), m or mark, top if n is None else n if top is None else max(top, n)
        out[(k, pos)] = state[k] if inclusive else before
    return out


VALUES = {"total": ("sum", "n"), "mark_seen": ("last", "mark"), "top": ("max", "n")}


@pytest.mark.parametrize("width", [4, 65536])
def test_prefix_matches_a_plain_loop(spark, width):
    rows = running_rows()
    df = spark.createDataFrame(rows, "k string, pos bigint, n bigint, mark string")
    got = {(r.k, r.pos): (r.total, r.mark_seen, r.top) for r in spread.prefix(df, ["k"], "pos", VALUES, False, width).collect()}
    assert got == plain_running(rows, False)
    numbered = spread.number_rows(df.select("k", "pos"), ["k"], "pos", "rn", width=4).filter("k = 'hot'").orderBy("pos")
    assert [r.rn for r in numbered.collect()] == list(range(1, 201))


@pytest.mark.parametrize("parts, batch", [(1, 10000), (7, 10000), (64, 7), (3, 1)])
@pytest.mark.parametrize("inclusive", [False, True])
def test_ordered_scan_matches_a_plain_loop(spark, parts, batch, inclusive):
    rows = running_rows() + [(None, 3, 1, "x"), (None, 5, 2, None), (None, 9, None, "y")]
    df = spark.createDataFrame(rows, "k string, pos bigint, n bigint, mark string").withColumn("mark", F.when(F.col("mark").isNotNull(), F.struct("mark")))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    for c, v in zip(old, (str(parts), str(batch), "false")):
        spark.conf.set(c, v)
    try:
        found = ordered.scan(df, ["k"], "pos", VALUES, inclusive).collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    got = {(r.k, r.pos): (r.total, r.mark_seen and r.mark_seen.mark, r.top) for r in found}
    assert len(found) == len(rows) and got == plain_running(rows, inclusive)
    assert ordered.scan(df.limit(0), ["k"], "pos", VALUES).count() == 0


@pytest.mark.parametrize("share", [False, True])
def test_attach_gives_each_row_its_group(spark, share):
    rows = [("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i bigint")
    got = spread.attach(df, ["k"], [F.count("*").alias("n"), F.min("i").alias("lo")], ["i"], share=share)
    assert sorted(map(tuple, got.collect())) == sorted(
        (k, i, 500 if k == "hot" else 1, 0 if k == "hot" else i) for k, i in rows
    )


def items(spark, rows):
    schema = ("path string, series string, localized_series string, series_sort string, number string, volume string, "
              "format string, title string")
    full = [(r["path"], r.get("series", "S"), r.get("localized_series"), None, r.get("number"), r.get("volume"),
             r.get("format"), r.get("title")) for r in rows]
    return identity.classify(spark.createDataFrame(full, schema))


def test_intentional_gap_case(spark):
    df = items(spark, [{"path": f"S/S Ch.{n:03}.cbz", "number": str(n)} for n in (1, 2, 5)])
    documented = spark.createDataFrame([("s", 3, 4), ("s", 4, 9)], "series_key string, start bigint, end bigint")
    audit = identity.series_audit(df, documented).first()
    assert (audit.normal_chapter_count, audit.unintended_gaps, audit.unintended_gap_chapters) == (3, 0, 0)
    # Every documented number is confirmed, even outside the chapters.
    assert audit.confirmed_source_gaps == 7
    bare = identity.series_audit(df).first()
    assert (bare.unintended_gaps, bare.unintended_gap_chapters) == (1, 2)


def test_identity_semantics(spark):
    df = items(spark, [
        {"path": "S/a SP01.cbz", "number": "SP1", "format": "Special", "title": "特别"},
        {"path": "S/b SP01.cbz", "number": "SP01", "format": "Special", "title": "特别"},
        {"path": "S/S Ch.1.cbz", "number": "1.50"}, {"path": "S/S Ch.1.5.cbz", "number": "01.5"},
        {"path": "S/S v02.cbz", "volume": "2"}, {"path": "S/x.cbz", "number": "n/a"},
    ])
    kinds = {r.path: (r.kind, r.identity) for r in df.collect()}
    assert kinds["S/a SP01.cbz"] == ("special", "1") and kinds["S/b SP01.cbz"] == ("special", "01")
    assert kinds["S/x.cbz"] == ("none", None)
    duplicates = identity.duplicate_identities(df).collect()
    assert {r.path for r in duplicates} == {"S/S Ch.1.cbz", "S/S Ch.1.5.cbz"}
    # The Special file-name check compares numbers, so SP1 matches SP01.
    codes = {(r.subject, r.code) for r in identity.identity_issues(df).collect()}
    assert ("S/a SP01.cbz", "special_filename_identity_mismatch") not in codes
    assert ("S/S v02.cbz", "UNDOCUMENTED_VOLUME_FALLBACK") in codes
    assert ("S/S Ch.1.cbz", "chapter_filename_identity_mismatch") in codes


def test_fractions_do_not_open_or_close_gaps(spark):
    df = items(spark, [{"path": f"S/S Ch.{n}.cbz", "number": n} for n in ("1", "1.5", "2.5", "3")])
    gaps = sequences.sequence_gaps(identity.chapter_numbers(df)).collect()
    assert [(g.start, g.end) for g in gaps] == [(2, 2)]


def test_gap_of_any_length_is_one_row(spark):
    chapters = spark.createDataFrame([("s", 1), ("s", 10**12)], "series_key string, chapter bigint")
    documented = spark.createDataFrame([("s", 5, 10**11), ("s", 7, 9)], "series_key string, start bigint, end bigint")
    got = sorted((g.start, g.end) for g in sequences.sequence_gaps(chapters, documented).collect())
    assert got == [(2, 4), (10**11 + 1, 10**12 - 1)]


def test_coverage_case_without_ranges(spark):
    spans = spark.createDataFrame([], "source string, start bigint, end bigint")
    counts = spark.createDataFrame([("a", 5, 1), ("b", 5, 1)], "source string, pages bigint, seq bigint")
    flags = spark.createDataFrame([("a", True), ("c", False)], "source string, complete boolean")
    got = {(r.source, r.code) for r in coverage.page_coverage(spans, counts, flags).collect()}
    assert got == {("b", "source_coverage_undocumented"), ("c", "source_coverage_incomplete"), ("c", "source_coverage_undocumented")}


def test_span_beyond_the_source(spark):
    spans = spark.createDataFrame([("s", 0, 1, 2), ("s", 1, 3, 4)], "source string, item_index int, start bigint, end bigint")
    counts = spark.createDataFrame([("s", 3)], "source string, pages bigint")
    codes = {r.code for r in coverage.span_issues(spans, counts).collect()}
    assert codes == {"BOUNDARY_OUT_OF_RANGE", "BOUNDARY_INCOMPLETE_COVERAGE"}


def hashes_of(rng, count):
    base = [rng.getrandbits(88) for _ in range(6)]
    out = []
    for _ in range(count):
        value = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            value ^= 1 << rng.randrange(88)
        out.append(value)
    # Blank pages: equal difference bits, many colours.
    return out + [(0 << 24) | rng.getrandbits(5) for _ in range(count // 3)]


def page_rows(rng, count):
    rows = []
    for i, value in enumerate(hashes_of(rng, count)):
        hi = value >> 24
        rows.append(("s", f"a{i % 5}", i, f"h{i}", hi - (1 << 64) if hi >= 1 << 63 else hi, value & 0xFFFFFF,
                     rng.choice([100, 101, 103]), 150))
    return rows


PAGE = "series string, archive string, page bigint, sha256 string, hi bigint, color int, width int, height int"


def aspect(a, b):
    left, right = a[6] * b[7], b[6] * a[7]
    return abs(left - right) / max(left, right) <= 0.01


def distance(a, b):
    return ((a[4] ^ b[4]) & (2**64 - 1)).bit_count() + (a[5] ^ b[5]).bit_count()


@pytest.mark.parametrize("threshold, agree", [(0, 2), (1, 1), (4, 2), (6, 2), (4, 3)])
def test_banded_join_equals_brute_force(spark, threshold, agree):
    rows = page_rows(random.Random(threshold), 60)
    found = overlap.near_nodes(overlap.nodes(spark.createDataFrame(rows, PAGE), ["series"]), ["series"], threshold, agree).collect()
    got = sorted((tuple(r.a), tuple(r.b), r.distance) for r in found)
    distinct = sorted({r[4:] for r in rows})
    pad = lambda n: (None,) * 4 + n
    brute = sorted(
        (a, b, distance(pad(a), pad(b))) for i, a in enumerate(distinct) for b in distinct[i + 1:]
        if distance(pad(a), pad(b)) <= threshold and aspect(pad(a), pad(b))
    )
    assert got == brute
    if threshold >= 4:
        assert len(brute) > 10


def test_equal_hashes_are_candidates(spark):
    rows = [("s", a, p, f"h{p}", hi, 7, 100, 150) for a, p, hi in (("a", 1, 5), ("b", 2, 5), ("c", 3, 5), ("a", 4, 4), ("d", 5, -1))]
    pages = spark.createDataFrame(rows, PAGE)
    found = overlap.near_candidates(pages, pages.select("series", "archive"), 4).collect()
    want = {(a[2], b[2], distance(a, b)) for a in rows for b in rows if a[1] != b[1] and distance(a, b) <= 4}
    assert {(r.page, r.other_page, r.distance) for r in found} == want and len(found) == len(want) == 10
    pairs = {(r.a_pages, r.b_pages, r.distance) for r in overlap.near_pairs(pages, ["series"], 4).collect()}
    assert pairs == {(3, 3, 0), (1, 3, 1)} or pairs == {(3, 3, 0), (3, 1, 1)}


def test_a_span_without_its_first_page(spark):
    pages = spark.createDataFrame([("s", 2, "2.png", "h2"), ("s", 3, "3.png", "h3"), ("s", 9, "9.png", "h9")], "source string, page int, member string, sha256 string")
    spans = spark.createDataFrame([("s", 0, 1, 3, "a"), ("s", 1, 4, 5, "b")], "source string, item_index int, start int, end int, output string")
    got = {(r.source_page, r.output, r.output_page) for r in coverage.map_pages(pages, spans).collect()}
    assert got == {(2, "a", 2), (3, "a", 3)}


def test_erased_candidates_are_noticed(spark):
    rows = page_rows(random.Random(5), 40)
    pages = spark.createDataFrame(rows, PAGE)
    packages = pages.select("series", "archive").distinct()
    pairs = [
        ("s", a[1], a[2], a[3], b[1], b[2], b[3], distance(a, b))
        for a in rows for b in rows if a[1] != b[1] and distance(a, b) <= 4 and aspect(a, b)
    ]
    schema = "series string, archive string, page bigint, sha256 string, other string, other_page bigint, other_sha256 string, distance int"
    good = overlap.audit_near(spark.createDataFrame(pairs, schema), pages, packages, 4).collect()
    assert all(r.ok for r in good) and sum(r.expected for r in good) == len(pairs)
    less = overlap.audit_near(spark.createDataFrame(pairs[1:], schema), pages, packages, 4).collect()
    assert [r.archive for r in less if not r.ok] == [pairs[0][1]]


def plain_merge(rows, decisions, threshold):
    """The ordered merge as one loop: rows are (source, page, archive_sha, sha, hi, color, w, h)."""
    kept, by_sha, out = [], {}, {}
    for row in sorted(rows):
        source, page, archive, sha = row[:4]
        if sha in by_sha:
            out[(source, page)] = ("exact", None, by_sha[sha][:2])
            continue
        best = None
        for other in kept:
            shaped = (None,) * 4 + row[4:], (None,) * 4 + other[4:]
            d = distance(*shaped)
            if d <= threshold and aspect(*shaped) and (best is None or d < best[0]):
                best = (d, other)
        state, review = "kept", None
        if best:
            decision = decisions.get((source, page))
            if decision is None:
                review = "unresolved"
            elif decision[1:] != (archive, sha, best[1][3]):
                review = "stale"
            elif decision[0]:
                state, review = "near", "duplicate"
            else:
                review = "unique"
        out[(source, page)] = (state, review, best[1][:2] if best else None)
        if state == "kept":
            kept.append(row)
            by_sha[sha] = row
    numbers = {row[:2]: i + 1 for i, row in enumerate(kept)}
    return {key: (*value, numbers.get(key)) for key, value in out.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_equals_the_plain_loop(spark, seed):
    rng = random.Random(seed)
    pictures = [r[4:] for r in page_rows(rng, 25)]
    rows = []
    for source in range(3):
        for page in range(1, 16):
            k = rng.randrange(len(pictures))
            rows.append((source, page, f"a{source}", f"h{k}", *pictures[k]))
    decisions: dict = {}
    for _ in range(6):  # decide against the targets of the merge so far, so chains appear
        for key, (state, review, target, _) in plain_merge(rows, decisions, 4).items():
            if review in ("unresolved", "stale") and rng.random() < 0.7:
                mine = next(r for r in rows if r[:2] == key)
                goal = next(r for r in rows if r[:2] == target)
                decisions[key] = (rng.random() < 0.7, mine[2], mine[3], goal[3] if rng.random() < 0.9 else "old")
    expected = plain_merge(rows, decisions, 4)
    assert {v[0] for v in expected.values()} == {"kept", "exact", "near"}
    schema = "source_index int, page bigint, archive_sha256 string, sha256 string, hi bigint, color int, width int, height int"
    pages = spark.createDataFrame(rows, schema).withColumn("output", F.lit("o"))
    decided = spark.createDataFrame(
        [("o", *key, *value) for key, value in decisions.items()],
        "output string, source_index int, page bigint, duplicate boolean, source_archive_sha256 string, "
        "source_page_sha256 string, duplicate_target_sha256 string",
    )
    merged = dedupe.merge_pages(pages, decided, ["output"], 4)
    got = {
        (r.source_index, r.page): (
            r.state, r.review, (r.target_source, r.target_page) if r.target_page is not None else None, r.output_page
        )
        for r in merged.collect()
    }
    assert got == expected
    report = dedupe.merge_report(merged, ["output"]).first()
    assert report.input_pages == len(rows) and report.output_pages == sum(v[0] == "kept" for v in expected.values())


def test_reconcile_outcomes(spark):
    def table(rows):
        return spark.createDataFrame(rows or [("none", "x", "x")], "run string, path string, sha256 string")

    old = [(r, "a.cbz", "1") for r in ("before", "between", "after", "odd")]
    new = [(r, "a.cbz", "2") for r in ("before", "between", "after", "odd", "fresh")]
    runs_ = spark.createDataFrame(
        [("before", True, True, False, "promotion-intent", True, True, False), ("between", True, False, True, "promotion-intent", True, True, False),
         ("after", False, True, True, "promotion-intent", True, True, True), ("odd", False, True, True, "promotion-intent", True, True, False),
         ("fresh", True, False, False, "promotion-intent", True, True, False), ("unknown", True, False, False, "promotion-intent", False, False, False)],
        "run string, candidate_exists boolean, formal_exists boolean, backup_exists boolean, status string, "
        "candidate_recorded boolean, formal_recorded boolean, backup_recorded boolean",
    )
    flags = manifests.snapshot_flags(
        runs_, table([r for r in new if r[0] in ("before", "between", "fresh")]),
        table([("before", "a.cbz", "1"), ("after", "a.cbz", "2"), ("odd", "a.cbz", "9")]),
        table([("between", "a.cbz", "1"), ("after", "a.cbz", "1"), ("odd", "a.cbz", "1")]), table(new), table(old),
        table([("after", "a.cbz", "1")]),
    )
    assert {r.run: r.action for r in manifests.reconcile(flags).collect()} == {
        "before": "close-noop-intent-and-restart-promotion", "between": "continue-candidate-promotion-then-postcheck",
        "after": "run-formal-postcheck-and-finalize", "odd": "stop-for-manual-recovery",
        "fresh": "continue-candidate-promotion-then-postcheck", "unknown": "stop-for-manual-recovery",
    }


def test_first_document_wins_ties(spark):
    archives = spark.createDataFrame([("S/x v1.cbz", "S", "1")], "path string, series string, volume string")
    docs = spark.createDataFrame(
        [(3, "other/x v1.cbz", None, None), (2, None, "s", "1.0"), (1, "other/x v1.cbz", "T", "2"), (4, None, "S", "2")],
        "doc_seq bigint, path string, series string, volume string",
    )
    best = matching.match_documents(archives, docs, "volume").first()
    assert (best.doc_seq, best.score) == (1, 50)


def test_checksum_of_a_tampered_state(spark):
    df = spark.createDataFrame(
        [('{"b":1,"a":{"y":2,"x":1},"state_checksum":"q"}',), ('{"a":{"x":1,"y":2},"b":1}',), ('{"a":{"x":1,"y":3},"b":1}',)],
        "j string",
    )
    sums = [r.x for r in df.select(runs.state_checksum(F.col("j")).alias("x")).collect()]
    assert sums[0] == sums[1] != sums[2]


def test_scan_of_sparse_positions(spark):
    # One group, positions a million apart and up to the end of BIGINT.
    at = [i * 1_000_003 for i in range(3000)] + [(1 << 62) + i * (1 << 40) for i in range(300)]
    df = spark.createDataFrame([("s", p, i) for i, p in enumerate(at)], "k string, pos bigint, v bigint")
    found = ordered.scan(df, ["k"], "pos", {"last": ("last", "v"), "total": ("sum", "v")}).orderBy("pos").collect()
    assert [(r.last, r.total) for r in found] == [(i - 1 if i else None, i * (i - 1) // 2) for i in range(len(at))]


def test_salted_lookup_keeps_null_and_repeated_rows(spark):
    many = spark.createDataFrame([("a", 1), ("a", 1), (None, 2), ("c", 3)], "k string, v int")
    one = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, w string")
    got = sorted((tuple(r) for r in spread.lookup(many, one, ["k"], copies=4).collect()), key=str)
    assert got == sorted([("a", 1, "x"), ("a", 1, "x"), (None, 2, None), ("c", 3, None)], key=str)


def test_copied_sides_stay_off_the_driver(spark):
    # The size that the optimizer takes copies for leaves out the copies, so no copied side may be broadcast.
    many, one = spark.range(200).selectExpr("id % 50 AS k", "id"), spark.range(60).selectExpr("id AS k", "id * 2 AS v")
    joined = spread.lookup(many, one, ["k"], "inner", spread.COPIES)
    counted = spread.attach(many, ["k"], [F.count("*").alias("n")], ["id"])
    for df in (joined, counted):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.k, r.v) for r in joined.collect()} == {(i, i % 50, i % 50 * 2) for i in range(200)}
    assert {(r.id, r.n) for r in counted.collect()} == {(i, 4) for i in range(200)}


def test_tables_of_archives_stay_off_the_driver(spark):
    # What is read from files has the size of the files, packed as they are, so only stored tables show it.
    table = lambda rows, schema: stored(spark.createDataFrame(rows, schema), "test")
    items = table([("a", "s"), ("b", "s"), ("c", "t"), ("d", None)], "path string, series_key string")
    members = table([(a, "1.jpg", "x") for a in "abcd"], "archive string, name string, sha256 string")
    facts = table([(a, 3) for a in "abcd"], "path string, pages bigint")
    matched = table([("a", "volume", 1), ("c", "volume", 1), ("d", "special", 1)], "path string, kind string, doc_seq int")
    sharing = audit.sharing_archives(items, members)
    faults = audit.fallback_evidence(matched, table([(1, "{}")], "doc_seq int, json string"), facts, sharing)
    for df in (sharing, faults):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.path for r in sharing.collect()) == ["a", "b"]
    assert {r.subject for r in faults.collect()} == {"a", "c"}


def plain_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    longest = max(len(a), len(b))
    return (longest - row[-1]) * 10000 // longest if longest else 0


def near_title_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 25]))) for _ in range(40)] + ["a" * 12, "ab" * 9, "x"]

    def changed(text):
        letters = list(text)
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(letters) + 1)
            letters[at:at + rng.randrange(2)] = rng.choice(["", "z", "ab"])
        return "".join(letters)

    return base, [changed(rng.choice(base)) for _ in range(120)] + base[:5] * 3 + ["", "a" * 11, "b" + "a" * 12]


def test_near_texts_are_all_found(spark):
    left, right = near_title_rows()
    a, b = (spark.createDataFrame([(t,) for t in side], "text string") for side in (left, right))
    for least in (8200, 7600, 10000):
        got = sorted(map(tuple, matching.near_texts(a, b, least).collect()))
        pairs = [(x, y, plain_similarity(x, y)) for x in set(left) for y in set(right)]
        assert got == sorted(p for p in pairs if p[2] >= least)
    with pytest.raises(ValueError):
        matching.near_texts(a, b, 7500)


def exchanges(df, *names):
    """How often rows that have all of the named columns are shuffled."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    return sum(all(f"{n}#" in line for n in names) for line in lines)


def reviewed_pages(spark):
    pages = spark.createDataFrame(
        [("s", f"a{i % 3}", i, f"h{i}", i // 4, 0, 100, 100) for i in range(24)],
        "series string, archive string, page int, sha256 string, hi bigint, color int, width int, height int",
    )
    found = overlap.near_candidates(pages, pages.select("series", "archive"), 1)
    return pages, found.toDF("series", "archive", *overlap.CANDIDATE_KEY)


def test_decisions_are_shuffled_once_for_each_page(spark):
    pages, found = reviewed_pages(spark)
    given = spark.createDataFrame(found.union(found.limit(1)).collect(), found.schema)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        classes, strays = overlap.decision_coverage(pages, pages.select("series", "archive"), given, 1)
        # Once by each page, which meets the page's own row there; no copy of the decisions is stored.
        assert exchanges(strays, "fallback_page") == 2 and exchanges(strays, "compared_page") == 2
        assert [r.message for r in strays.collect()] == ["candidate.decided-once"]
        assert all(r.candidates == r.decided for r in classes.collect())
        other = given.withColumn("hamming_distance", F.col("hamming_distance") + 1)
        classes, strays = overlap.decision_coverage(pages, pages.select("series", "archive"), other, 1)
        assert {r.message for r in strays.collect()} == {"visual.candidate"} and all(r.decided == 0 for r in classes.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_decision_issues_take_one_shuffle(spark):
    _, found = reviewed_pages(spark)
    given = spark.createDataFrame(found.collect(), found.schema)
    rows = given.selectExpr("*", "true AS duplicate", "' ' AS reviewer", "CAST(null AS STRING) AS reason")
    got = overlap.decision_issues(given, rows.union(rows).union(rows.withColumn("fallback_page_sha256", F.lit(None).cast("string"))))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(") == 1
    messages = got.groupBy("message").count().collect()
    n = given.count()
    # Without its hash the subject of a decision may be that of another, and each is listed once.
    lone = given.withColumn("fallback_page_sha256", F.lit(None).cast("string")).distinct().count()
    assert {r["message"]: r["count"] for r in messages} == {
        "candidate.decided-once": n, "visual.candidate": lone, "visual.reviewer": n + lone, "visual.reason": n + lone,
    }


def test_pages_of_near_queries_are_hashed_once(spark):
    for name in ("near_candidates", "near_pairs", "decided_classes"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert all("/grid-" in f for f in df.inputFiles())


def test_near_texts_are_paired_in_all_tasks(spark):
    a = spark.createDataFrame([(t,) for t in near_title_rows()[0]], "text string")
    near = matching.near_texts(a, a, 8200)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "HashAggregate" not in plan  # nothing is sent to all tasks, and pairs need no distinct
    assert near.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_search_titles_against_all_pairs(spark):
    left, right = near_title_rows()
    items = [(i, t.upper() + " !", f"i{i}" if i % 9 == 0 else None) for i, t in enumerate(left + left[:10])]
    catalog = [(k, t, right[-k] if k % 3 == 0 and k else None, f"i{k % 60}" if k % 7 == 0 else None) for k, t in enumerate(right)]
    got = matching.search_titles(
        spark.createDataFrame(items, "item int, title string, isbn string"),
        spark.createDataFrame(catalog, "candidate int, title string, alias string, isbn string"),
    ).collect()
    want = []
    for (i, _, isbn), title in zip(items, left + left[:10]):
        scores = []
        for k, t, alias, other in catalog:
            score = 10000 if isbn is not None and isbn == other else max(plain_similarity(title, t), plain_similarity(title, alias or ""))
            if score >= 8200:
                scores.append((-score, k))
        scores.sort()
        if not scores:
            want.append((i, None, None, None, "META001"))
            continue
        best, lead = -scores[0][0], -scores[0][0] + (scores[1][0] if len(scores) > 1 else 0)
        want.append((i, scores[0][1], best, lead, "META003" if best < 9200 else "META002" if lead < 1000 else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_state_is_rebuilt_from_its_leaves(spark):
    rows = [("r", "a.b.c", "1"), ("r", "a.b.d", "x\"y"), ("r", "a.e", None), ("r", "z", "2"), ("s", "k", "v")]
    got = {r.run: r.document for r in runs.rebuild_state(spark.createDataFrame(rows, "run string, path string, value string")).collect()}
    assert got == {"r": '{"a":{"b":{"c":"1","d":"x\\"y"},"e":null},"z":"2"}', "s": '{"k":"v"}'}
    assert runs.rebuild_state(spark.createDataFrame([], "run string, path string, value string")).count() == 0


@pytest.mark.parametrize("length", [2, 40])
def test_merge_of_a_long_chain(spark, length):
    # Every page is near only its neighbours and claims to be the copy of the one before, so each second one goes.
    pages = [("o", 1, k, "arc", f"s{k:03d}", (1 << (2 * k % 62)) * 0 + ((1 << (k % 60 + 1)) - 1), 0, 10, 10) for k in range(length)]
    decisions = [("o", 1, k, True, "arc", f"s{k:03d}", f"s{k - 1:03d}") for k in range(1, length)]
    pages_df = spark.createDataFrame(pages, "output string, source_index int, page bigint, archive_sha256 string, sha256 string, hi bigint, color bigint, width int, height int")
    decided = spark.createDataFrame(decisions, "output string, source_index int, page bigint, duplicate boolean, source_archive_sha256 string, source_page_sha256 string, duplicate_target_sha256 string")
    merged = dedupe.merge_pages(pages_df, decided, ["output"], 1).orderBy("page").collect()
    assert [r.state for r in merged] == ["kept" if k % 2 == 0 else "near" for k in range(length)]


def test_included_pages_must_be_those_of_the_map(spark):
    from shelfmark.operators import provenance

    sha = lambda x: x * 64
    columns = "output string, row int, output_page bigint, source string, source_page bigint, source_archive_sha256 string, source_page_sha256 string, output_sha256 string"
    rows = [(o, k, k + 1, "s", k + 1, sha("a"), None, sha("12"[k])) for o in ("good", "less", "more", "none") for k in (0, 1)]
    components = spark.createDataFrame([(o, "s", sha("A")) for o in ("good", "less", "more", "none")], "output string, source string, sha256 string")
    pages = [(a, k + 1, sha("12"[k])) for a in ("s", "good", "less", "more", "none") for k in (0, 1)]
    included = [("good", "s", 1), ("good", "s", 2), ("less", "s", 1), ("more", "s", 1), ("more", "s", 2), ("more", "s", 3)]
    found = provenance.bind_page_map(
        spark.createDataFrame(rows, columns), components, spark.createDataFrame(pages, "archive string, page int, sha256 string"),
        spark.createDataFrame(included, "output string, source string, page bigint"),
    )
    assert sorted(map(tuple, found.collect())) == [(o, None, "map.included-equal") for o in ("less", "more", "none")]


@pytest.mark.parametrize("ways", [lambda n: sources.coverage_claims(n), lambda n: sequences.documented_gaps(n)])
def test_plans_are_walked_once_and_by_many_tasks(spark, ways):
    # Documents of one small file are many: all tasks walk them, and what several results need is walked once.
    text = '{"series":"S","source":"s","page_count":3,"start":1,"end":2,"deliberate_missing_ranges":[{"from":1,"end":2,"reason":"r"}]}'
    docs = spark.range(0, 400, 1, 1).selectExpr("CAST(id AS STRING) AS doc", f"'{text}' AS text")
    nodes = sources.walk_nodes(docs, below=fixed.GAP_KEYS)
    assert nodes.select(F.spark_partition_id()).distinct().count() > 1
    found = ways(nodes)
    assert all("MapInPandas" not in df._jdf.queryExecution().optimizedPlan().toString() for df in found)
    assert [df.count() for df in found] == ([400, 0] if len(found) == 2 else [400, 400, 0])


def test_record_rules_are_worked_on_by_many_tasks(spark):
    rows = spark.range(0, 200, 1, 1).selectExpr("id AS doc_seq", "id AS run", "'{}' AS json")
    for found in (documents.special_issues(rows), runs.run_state_issues(rows)):
        assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_folders_and_series_are_classified_once(spark):
    found = registry.QUERIES["folder_series"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() and all("/pairs-" in f for f in found.inputFiles())


def test_states_are_walked_once_for_their_caches(spark):
    docs = spark.createDataFrame([("1", '{"cache_paths":["/a","/b"]}'), ("2", '{"cache_paths":["/b"]}')], "doc string, text string")
    states = spark.createDataFrame([("1", "paused", "/t", True), ("2", "paused", None, False)], "run string, status string, staging string, staging_exists boolean")
    existing = spark.createDataFrame([("/b",)], "path string")
    found = runs.next_actions(states, states.select("run").limit(0), sources.cache_paths(docs, "run"), existing)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect() if r.step == 2) == [("1", 2, "rebuild-disposable-cache", "/a")]


def test_archives_are_unpacked_and_their_metadata_parsed_once(spark):
    for name in ("archive_audit", "archive_table", "archive_issues", "archive_pages"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.inputFiles() and all("/members-" in f for f in df.inputFiles())
    plan = registry.QUERIES["archive_audit"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Parsed above the rows that are dealt out, not in the few tasks below.
    assert plan.count("from_xml(") == 1 and "RepartitionByExpression" in plan[plan.index("from_xml("):]


def test_merge_decisions_are_read_once_and_near_hashes_may_be_given(spark):
    rng = random.Random(5)
    rows = [(0, page, "a0", f"h{k}", *r[4:]) for page, (k, r) in enumerate(((k, r) for k, r in enumerate(page_rows(rng, 6)) for _ in (0, 1)), 1)]
    schema = "source_index int, page bigint, archive_sha256 string, sha256 string, hi bigint, color int, width int, height int"
    pages = spark.createDataFrame(rows, schema).withColumn("output", F.lit("o"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    decisions = "output string, source_index int, page bigint, duplicate boolean, source_archive_sha256 string, source_page_sha256 string, duplicate_target_sha256 string"
    decided = spark.createDataFrame([("o", 0, 3, False, "a0", "h1", "h0")], decisions).mapInPandas(counted, decisions)
    near = overlap.neighbours(pages, ["output"], 4)
    merged = dedupe.merge_pages(pages, decided, ["output"], 4, near=near)
    assert sorted((r.page, r.state) for r in merged.collect())[:2] == [(1, "kept"), (2, "exact")]
    assert seen.value == 1


def test_only_gap_values_and_their_records_are_kept(spark, monkeypatch):
    plan = {"series": "S", "items": [{"path": "a"}, {"path": "b"}], "intentional_gaps": [{"start": 3, "end": 4, "reason": "r"}, "7, 9-8"],
            "more": {"series": "T", "intentional_gaps": [5, []]}}
    docs = spark.createDataFrame([("d", json.dumps(plan))], "doc string, text string")
    kept, write = [], sequences.stored
    monkeypatch.setattr(sequences, "stored", lambda df, purpose: kept.append(write(df, purpose)) or kept[-1])
    found, problems = sequences.documented_gaps(sources.walk_nodes(docs, below=fixed.GAP_KEYS))
    assert sorted(map(tuple, found.collect())) == [("s", 3, 4), ("s", 7, 7), ("t", 5, 5)]
    assert sorted((r.entry_seq, r.message) for r in problems.collect()) == [("00000000.00000003.00000001.00000001", "gap.range")]
    # The nodes are walked once for both results.
    assert all("MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString() for df in (found, problems))
    # Items are no records of gaps.
    assert not [r for r in kept[0].collect() if "items" in r.path]


def test_fallback_fields_are_taken_from_members(spark):
    docs = spark.createDataFrame([(1, '{"overlap_audit":null}'), (2, "[]"), (3, '{"overlap_audit":{"result":"open"}}')], "doc_seq bigint, json string")
    found = documents.fallback_issues(docs)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        # A look at a path that is absent costs an exception, and most of the forty fields may be.
        assert found._jdf.queryExecution().analyzed().toString().count(" $.") == 0
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    messages = {(r.doc_seq, r.message) for r in found.collect()}
    assert {d for d, m in messages if m == "overlap.present"} == {1, 2} and (3, "overlap.result") in messages
