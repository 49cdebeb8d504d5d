"""Queries of plan records (JSON built from orders) and of record matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, identity, paths, variants
from ..operators import documents, matching, sequences
from ..sources import plans
from .registry import query, with_

HEX = "0123456789abcdef" * 4
KEY = "o_orderkey"


def _json(fields: list[tuple]) -> str:
    """SQL text of a JSON object; a field is (name, good[, bad, condition])."""
    parts = []
    for name, good, *rest in fields:
        value = f"'{good}'" if not rest else f"CASE WHEN {rest[1]} THEN '{rest[0]}' ELSE '{good}' END"
        parts.append(f"'\"{name}\":' || {value}")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _problems(rows: list[tuple[str, str]], select: str, tail: str) -> str:
    return " UNION ALL ".join(f"SELECT {select.format(message=m)} FROM {tail} WHERE {c}" for c, m in rows)


C = "o_custkey"
OVERLAP = [
    ("compared_identities", "[]", "null", f"{C} % 59 = 0"), ("page_sha256_checked", "true", "1", f"{C} % 61 = 0"),
    ("perceptual_candidates_checked", "true", "false", f"{C} % 67 = 0"), ("visual_review_complete", "true", "null", f"{C} % 71 = 0"),
    ("result", '"no-overlap"', '"open"', f"{C} % 73 = 0"), ("audit_record_id", '"r"', '""', f"{C} % 79 = 0"),
    ("perceptual_distance", "4", "17", f"{C} % 83 = 0"), ("perceptual_hash_algorithm", '"dhash-88-color"', '"phash"', f"{C} % 89 = 0"),
    ("perceptual_candidates", "[]", "{}", f"{C} % 97 = 0"), ("visual_decisions", "[]", '"none"', f"{C} % 101 = 0"),
]
HAS = f"{C} % 43 <> 0"
FALLBACK = [
    ("chapter", "null", '"3"', f"{C} % 13 = 0"), ("volume", "12", '"x"', f"{C} % 11 = 0"),
    ("fallback_reason", '"why"', '" "', f"{C} % 17 = 0"), ("source_sha256", f'"{HEX}"', '"zz"', f"{C} % 19 = 0"),
    ("source", '"a/b.zip"', '"../b.zip"', f"{C} % 23 = 0"), ("boundary_method", '"m"', "7", f"{C} % 103 = 0"),
    ("series_confirmed", "true", '"true"', f"{C} % 5 = 0"), ("confirmed_volume", "true", "1", f"{C} % 107 = 0"),
    ("single_complete_volume", "true", "false", f"{C} % 109 = 0"), ("all_pages_readable", "true", "null", f"{C} % 113 = 0"),
    ("natural_page_order", "true", "false", f"{C} % 127 = 0"), ("attempted_evidence", '["a","b"]', '["a"," "]', f"{C} % 29 = 0"),
    ("ocr_used", "false", "true", f"{C} % 31 = 0"), ("cross_package_overlap_checked", "true", "false", f"{C} % 131 = 0"),
    ("content_overlap_detected", "false", "true", f"{C} % 37 = 0"), ("fallback_id", '"f"', '" "', f"{C} % 41 = 0"),
    ("source_page_count", "10", '"10"', f"{C} % 2 = 0"),
    ("coverage", '[{"start":1,"end":4},[5,10]]', '[{"start":1,"end":4},{"span":"4..10"}]', f"{C} % 3 = 1"),
    ("covered_exactly_once", "true", '"in_complete"', f"{C} % 47 = 0"),
]
FALLBACK_DOCS = (
    f"SELECT {KEY} AS doc_seq, CASE WHEN {C} % 53 = 0 THEN 11 ELSE 10 END AS actual_pages, {C} % 137 <> 0 AS exact_ok, {C}, "
    f"regexp_replace({_json(FALLBACK)}, '[}}]$', '') || ',\"overlap_audit\":' || CASE WHEN {HAS} THEN {_json(OVERLAP)} ELSE 'null' END || '}}' AS json FROM orders"
)
FALLBACK_RULES = [
    (f"{C} % 13 = 0", "fallback.chapter-null"), (f"{C} % 11 = 0", "fallback.volume-number"),
    (f"{C} % 17 = 0", "fallback.reason"), (f"{C} % 19 = 0", "fallback.hash"),
    (f"{C} % 23 = 0 AND {C} % 19 <> 0", "fallback.path-safe"), (f"{C} % 103 = 0", "fallback.boundary-method"),
    (f"{C} % 5 = 0", "fallback.series-confirmed"),
    (f"{C} % 107 = 0", "fallback.volume-confirmed"),
    (f"{C} % 109 = 0", "fallback.one-volume"),
    (f"{C} % 113 = 0", "fallback.pages-readable"),
    (f"{C} % 127 = 0", "fallback.order-confirmed"), (f"{C} % 29 = 0", "fallback.attempts"),
    (f"{C} % 31 = 0", "ocr.authorized"),
    (f"{C} % 131 = 0", "fallback.overlap-audited"),
    (f"{C} % 37 = 0", "fallback.overlap-resolved"), (f"{C} % 41 = 0", "fallback.id"),
    (f"NOT ({HAS})", "overlap.present"),
    (f"{HAS} AND {C} % 59 = 0", "overlap.identities"),
    (f"{HAS} AND {C} % 61 = 0", "overlap.exact-compared"),
    (f"{HAS} AND {C} % 67 = 0", "overlap.near-compared"),
    (f"{HAS} AND {C} % 71 = 0", "overlap.decisions-complete"),
    (f"{HAS} AND {C} % 73 = 0", "overlap.result"), (f"{HAS} AND {C} % 79 = 0", "overlap.record-id"),
    (f"{HAS} AND {C} % 83 = 0", "overlap.distance"),
    (f"{HAS} AND {C} % 89 = 0", "overlap.algorithm"),
    (f"{HAS} AND {C} % 97 = 0", "overlap.candidates-array"),
    (f"{HAS} AND {C} % 101 = 0", "overlap.decisions-array"),
    (f"{C} % 47 = 0", "plan.coverage-stated"), (f"{C} % 3 = 1", "plan.coverage"),
    (f"{C} % 53 = 0", "fallback.page-count"),
    (f"{C} % 137 = 0", "overlap.exact-equal"),
]


@query("fallback_issues", _problems(FALLBACK_RULES, KEY + " AS doc_seq, '{message}' AS message", "orders"))
def fallback_issues(t):
    return documents.fallback_issues(t.sql(FALLBACK_DOCS), actual_pages="actual_pages", overlap_ok={"exact": "exact_ok"})


COMPONENT = f'[{{"source":"a.cbz","source_sha256":"{HEX}","included_source_pages":[1,2]}}]'
SPECIAL = [
    ("complete_independent_range", "true", "1", f"{C} % 7 = 0"), ("confidence", '"High "', "0.89", f"{C} % 11 = 0"),
    ("evidence", '{"a":1}', "{}", f"{C} % 13 = 0"), ("page_count", "2", "3", f"{C} % 17 = 0"),
    ("deduplication_status", '"complete"', '"open"', f"{C} % 19 = 0"), ("audit_record_id", '"r"', "5", f"{C} % 23 = 0"),
    ("source_components", COMPONENT, '[{"source":"a.cbz","source_sha256":"x","included_source_pages":[0]},3]', f"{C} % 29 = 0"),
    ("output_page_mapping", "[1,2]", "[1]", f"{C} % 31 = 0"),
]
SPECIAL_DOCS = f"SELECT {KEY} AS doc_seq, 2 AS actual_pages, {_json(SPECIAL)} AS json FROM orders"
SPECIAL_RULES = [
    (f"{C} % 7 = 0", "special.range-complete"), (f"{C} % 11 = 0", "special.confidence"),
    (f"{C} % 13 = 0", "special.identity-evidence"), (f"{C} % 17 = 0", "special.page-count"),
    (f"{C} % 19 = 0", "special.dedupe-done"), (f"{C} % 23 = 0", "special.record-id"),
    (f"{C} % 29 = 0", "component.valid"), (f"{C} % 29 = 0", "component.path-and-hash"),
    (f"{C} % 29 = 0", "component.included-valid"),
    (f"{C} % 31 = 0", "special.map-length"),
]


@query("special_issues", _problems(SPECIAL_RULES, KEY + " AS doc_seq, '{message}' AS message", "orders"))
def special_issues(t):
    return documents.special_issues(t.sql(SPECIAL_DOCS), actual_pages="actual_pages")


SP = f"{C} % 2 = 0"
PLAN = [
    ("identity_policy", '"continuous_chapter"', '"Volume-Aware-Chapter"', f"{C} % 3 = 0"), ("source", '"src"', '"other"', f"{C} % 31 = 0"),
    ("source_page_count", "9", "8", f"{C} % 37 = 0"), ("visual_checks", '{"first":true,"last_page":true}', '{"first":true,"last_page":true,"boundary":false}', f"{C} % 5 = 0"),
]
ITEM = [
    ("kind", '"Special"', '"chapter"', f"NOT ({SP})"), ("start", "1", "0", f"{C} % 41 = 0"), ("end_page", "4", "true", f"{C} % 43 = 0"),
    ("output", '"out/Vol.2 x.cbz"', '"out/x.zip"', f"{C} % 47 = 0"), ("number", '"SP1"', '"5"', f"{C} % 7 = 0"),
    ("identity", '{"Title":"特别篇","Volume":"1"}', '{"Title":"Extra","Format":"Digital","Number":"5"}', f"{C} % 11 = 0"),
    ("complete_independent_range", "true", "false", f"{C} % 53 = 0"), ("confidence", "0.9", '"low"', f"{C} % 59 = 0"),
    ("evidence", '["e"]', "[]", f"{C} % 61 = 0"), ("visual_boundary_verified", "false", "true", f"{C} % 15 = 0"),
]
BOUNDARY_DOCS = f"SELECT 'src' AS source, CAST({KEY} AS INT) AS item_index, 9 AS pages, {_json(PLAN)} AS plan, {_json(ITEM)} AS item FROM orders"
BOUNDARY_RULES = [
    (f"{SP} AND {C} % 53 = 0", "SPECIAL_RANGE_INCOMPLETE:special.range-confirmed"),
    (f"{SP} AND {C} % 59 = 0", "MANIFEST_UNCERTAIN_SOURCE:special.evidence-high"),
    (f"{SP} AND {C} % 61 = 0", "BOUNDARY_INVALID:special.evidence"),
    (f"{C} % 41 = 0 OR {C} % 43 = 0", "BOUNDARY_INVALID:span.indices"),
    (f"{C} % 47 = 0", "OUTPUT_EXTENSION:item.output-suffix"),
    (f"{C} % 11 = 0 AND {C} % 7 <> 0", "BOUNDARY_INVALID:item.number-equal"),
    (f"{SP} AND {C} % 7 = 0", "BOUNDARY_INVALID:special.number-form"),
    (f"{SP} AND {C} % 11 = 0", "BOUNDARY_INVALID:special.format-kept"),
    (f"{SP} AND {C} % 11 = 0", "META008:special.title-han"),
    (f"NOT ({SP}) AND {C} % 7 <> 0", "BOUNDARY_INVALID:chapter.number-not-sp"),
    (f"NOT ({SP}) AND {C} % 3 <> 0 AND {C} % 47 <> 0", "KAVITA_VOLUME_JUMP_RISK:item.name-without-volume"),
    (f"NOT ({SP}) AND {C} % 3 = 0 AND {C} % 11 = 0", "BOUNDARY_INVALID:item.volume"),
    (f"{C} % 5 = 0 AND {C} % 15 <> 0", "BOUNDARY_VISUAL_REVIEW_REQUIRED:span.seen"),
    (f"{C} % 31 = 0", "BOUNDARY_SOURCE_MISMATCH:plan.source"),
    (f"{C} % 37 = 0", "BOUNDARY_PAGE_COUNT_MISMATCH:plan.page-count"),
]


@query("boundary_issues", " UNION ALL ".join(
    f"SELECT 'src' AS source, CAST({KEY} AS INTEGER) AS item_index, '{m.split(':')[0]}' AS code, '{m.split(':')[1]}' AS message FROM orders WHERE {c}"
    for c, m in BOUNDARY_RULES
))
def boundary_issues(t):
    return documents.boundary_issues(t.sql(BOUNDARY_DOCS), pages="pages")


@query("review_evidence", f"""
SELECT {KEY} AS item, CASE WHEN {C} % 5 <> 0 THEN 'plan:visual_checks' WHEN {C} % 15 = 0 THEN 'item:visual_boundary_verified' END AS evidence FROM orders""")
def review_evidence(t):
    rows = t.sql(BOUNDARY_DOCS)
    where = documents.review_evidence(variants.parse(F.col("plan")), variants.parse(F.col("item")))
    return rows.select(F.col("item_index").cast("bigint").alias("item"), where.alias("evidence"))


SOURCE = [
    ("path", '"p"', '""', f"{C} % 13 = 0"), ("official", "true", '"yes"', f"{C} % 7 = 0"), ("confidence", '"verified"', "true", f"{C} % 11 = 0"),
]
SOURCE_DOCS = (
    f"SELECT 'out ' || CAST({C} AS STRING) AS output, CAST({KEY} AS INT) AS source_index, CASE WHEN {C} % 17 = 0 THEN 0 ELSE 5 END AS pages, "
    f"replace({_json(SOURCE)}, '\"p\"', '\"p' || CAST({KEY} % 3 AS STRING) || '\"') AS json FROM orders"
)


@query("merge_source_issues", f"""
SELECT DISTINCT 'out ' || CAST({C} AS VARCHAR) AS output, CAST({KEY} AS INTEGER) AS source_index, code FROM (
  SELECT {C}, {KEY}, 'MANIFEST_INVALID' AS code FROM orders WHERE {C} % 13 = 0
  UNION ALL SELECT {C}, {KEY}, 'MANIFEST_UNOFFICIAL_SOURCE' FROM orders WHERE {C} % 7 = 0
  UNION ALL SELECT {C}, {KEY}, 'MANIFEST_UNCERTAIN_SOURCE' FROM orders WHERE {C} % 11 = 0
  UNION ALL SELECT {C}, {KEY}, 'PAGE004' FROM orders WHERE {C} % 17 = 0
  UNION ALL SELECT {C}, {KEY}, 'MANIFEST_INVALID' FROM (SELECT *, min({KEY}) OVER (PARTITION BY {C}, {KEY} % 3) AS f FROM orders WHERE {C} % 13 <> 0) WHERE {KEY} > f)""")
def merge_source_issues(t):
    return documents.merge_source_issues(t.sql(SOURCE_DOCS))


MERGED = [
    ("number", '"sp07"', '"7"', f"{C} % 13 = 0"), ("identity", '{"Title":"官方特别篇"}', '{"Title":"x","Format":"Web","Number":"SP9"}', f"{C} % 11 = 0"),
]


@query("merged_identity_issues", f"""
SELECT DISTINCT CAST({KEY} AS VARCHAR) AS output, unnest(CASE WHEN {C} % 11 = 0 THEN ['MANIFEST_INVALID', 'META008'] ELSE ['MANIFEST_INVALID'] END) AS code
FROM orders WHERE {C} % 13 = 0 OR {C} % 11 = 0""")
def merged_identity_issues(t):
    docs = t.sql(f"SELECT CAST({KEY} AS STRING) AS output, {_json(MERGED)} AS json FROM orders")
    return documents.merged_identity_issues(docs)


DECISION = [
    ("duplicate", "true", '"true"', f"{C} % 7 = 0"), ("reason", '"r"', '" "', f"{C} % 11 = 0"), ("reviewer", '"me"', "null", f"{C} % 13 = 0"),
    ("source_archive_sha256", f'"{HEX}"', '""', f"{C} % 17 = 0"), ("source_page_sha256", f'"{HEX}"', "null", f"{C} % 19 = 0"),
    ("duplicate_target_sha256", f'"{HEX}"', "1", f"{C} % 23 = 0"),
]
DECISION_KEY = f"CASE WHEN {C} % 29 = 0 THEN '0:0' ELSE CAST({KEY} AS STRING) || ':1' END"


@query("decision_row_issues", _problems([
    (f"{C} % 29 = 0", "decision.key-form"), (f"{C} % 7 = 0", "decision.duplicate-boolean"),
    (f"{C} % 11 = 0 OR {C} % 13 = 0", "decision.reason-and-reviewer"), (f"{C} % 17 = 0", "source_archive_sha256 is required"),
    (f"{C} % 19 = 0", "source_page_sha256 is required"), (f"{C} % 23 = 0", "duplicate_target_sha256 is required"),
], DECISION_KEY + " AS key, '{message}' AS message", "orders"))
def decision_row_issues(t):
    return documents.decision_row_issues(t.sql(f"SELECT {DECISION_KEY} AS key, {_json(DECISION)} AS json FROM orders"))


MISSING = [
    ("record_kind", '"missing-source"', '"source"', f"{C} % 3 = 0"), ("source", '"vol 3"', '""', f"{C} % 7 = 0"),
    ("source_sha256", "null", f'"{HEX}"', f"{C} % 5 = 0"), ("source_page_count", "null", "12", f"{C} % 5 = 0"),
    ("missing_scope_kind", '"source-volume"', '"chapter-range"', f"{C} % 2 = 0"), ("chapter_range", "null", "[1,2]", f"{C} % 11 = 0"),
]
M = f"{C} % 3 <> 0"


@query("missing_source_issues", " UNION ALL ".join(
    f"SELECT {KEY} AS doc_seq, '{code}' AS code, '{message}' AS message FROM orders WHERE {c}" for c, code, message in [
        (f"{C} % 3 = 0 AND {C} % 5 <> 0", "invalid_missing_source", "missing.only-then-blank"),
        (f"{M} AND {C} % 5 = 0", "invalid_missing_source", "missing.no-hash-no-count"),
        (f"{M} AND {C} % 7 = 0", "invalid_missing_source", "missing.locator"),
        (f"{M} AND {C} % 2 <> 0 AND {C} % 11 = 0", "invalid_missing_source", "missing.volume-range-null"),
        (f"{M} AND {C} % 2 <> 0 AND {C} % 11 <> 0", "UNMAPPED_SOURCE_ABSENCE", "missing.volume-chapters"),
        (f"{M} AND {C} % 2 = 0 AND {C} % 11 <> 0", "invalid_missing_source", "missing.chapters-stated"),
    ]
))
def missing_source_issues(t):
    return documents.missing_source_issues(t.sql(f"SELECT {KEY} AS doc_seq, {_json(MISSING)} AS json FROM orders"))


# Nested plan documents, one per order.
PLAN_DOCS = f"""
SELECT CAST({KEY} AS STRING) AS doc, '{{"series":"Series ' || CAST({KEY} AS STRING) || '","identity_policy":"' || o_orderstatus || '_x","deliberate_missing_ranges":['
  || '{{"from":2,"end":' || CAST({C} % 5 AS STRING) || ',"reason":"' || CASE WHEN {C} % 7 = 0 THEN '' ELSE 'r' END || '","confirmed":' || CASE WHEN {C} % 11 = 0 THEN 'false' ELSE 'true' END || '}},'
  || '"8-9, ' || CAST(10 + {C} % 3 AS STRING) || ',x",{{"series":"Other ' || CAST({C} AS STRING) || '","reason":1,"chapters":[20,["21-22"]]}},"none"],'
  || '"items":[{{"output":".\\\\a\\\\b.cbz","source":"s' || CAST({KEY} AS STRING) || '","start":1,"end":3,"page_count":9}},{{"path":"","archive":"./c.zip","source":"s' || CAST({KEY} AS STRING)
  || '","spans":["x",[4,9],{{"span":"2-3"}}],"exact_coverage":"Exactly_Once"}}]}}' AS text FROM orders"""


def plan_docs(t):
    return t.sql(PLAN_DOCS.replace("\\\\", "\\\\\\\\"))


@query("walk_records", f"""
SELECT CAST({KEY} AS VARCHAR) AS doc, seq, depth, path FROM orders, (VALUES ('00000000', 0, ''), ('00000000.00000002.00000000', 2, 'deliberate_missing_ranges/#'),
  ('00000000.00000002.00000002', 2, 'deliberate_missing_ranges/#'), ('00000000.00000003.00000000', 2, 'items/#'), ('00000000.00000003.00000001', 2, 'items/#'),
  ('00000000.00000003.00000001.00000003.00000002', 4, 'items/#/spans/#')) r(seq, depth, path)""")
def walk_records(t):
    return plans.walk_records(plan_docs(t)).select("doc", "seq", "depth", F.array_join("path", "/").alias("path"))


GAP_SQL = f"""
SELECT 'series ' || CAST({KEY} AS VARCHAR) AS series_key, 2 AS a, {C} % 5 AS b FROM orders WHERE {C} % 5 >= 2
UNION ALL SELECT 'series ' || CAST({KEY} AS VARCHAR), 8, 9 FROM orders
UNION ALL SELECT 'series ' || CAST({KEY} AS VARCHAR), 10 + {C} % 3, 10 + {C} % 3 FROM orders
UNION ALL SELECT 'other ' || CAST({C} AS VARCHAR), 20, 20 FROM orders
UNION ALL SELECT 'other ' || CAST({C} AS VARCHAR), 21, 22 FROM orders"""


@query("gap_parser", f"""
SELECT series_key, CAST(a AS BIGINT) AS "start", CAST(b AS BIGINT) AS "end" FROM ({GAP_SQL})""")
def gap_parser(t):
    return sequences.documented_gaps(plans.walk_nodes(plan_docs(t), below=fixed.GAP_KEYS))[0]


@query("gap_plan_issues", f"""
SELECT CAST({KEY} AS VARCHAR) AS subject, seq AS entry_seq, 'invalid_intentional_gap' AS code, message FROM (
  SELECT {KEY}, '00000000.00000002.00000000' AS seq, 'gap.reason-confirmed' AS message FROM orders WHERE {C} % 7 = 0 OR {C} % 11 = 0
  UNION ALL SELECT {KEY}, '00000000.00000002.00000000', 'gap.range' FROM orders WHERE {C} % 5 < 2
  UNION ALL SELECT {KEY}, '00000000.00000002.00000003', 'gap.range' FROM orders)""")
def gap_plan_issues(t):
    return sequences.documented_gaps(plans.walk_nodes(plan_docs(t), below=fixed.GAP_KEYS))[1]


@query("documented_gap_pieces", with_(g=GAP_SQL) + """
SELECT series_key, CAST(count(*) AS BIGINT) AS chapters FROM (SELECT DISTINCT series_key, unnest(range(a, b + 1)) AS n FROM g) GROUP BY series_key""")
def documented_gap_pieces(t):
    intervals = sequences.documented_gaps(plans.walk_nodes(plan_docs(t), below=fixed.GAP_KEYS))[0]
    return sequences.disjoint(intervals, ["series_key"]).groupBy("series_key").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("chapters")
    )


@query("policy_records", f"""
SELECT CAST({KEY} AS VARCHAR) AS doc, 'Series ' || CAST({KEY} AS VARCHAR) AS series, o_orderstatus || '_x' AS policy, '00000000' AS seq FROM orders""")
def policy_records(t):
    return plans.policy_records(plans.walk_nodes(plan_docs(t), below=()))


@query("first_non_empty", f"""
SELECT CAST({KEY} AS VARCHAR) AS doc, seq, path FROM orders, (VALUES ('00000000', NULL), ('00000000.00000002.00000000', NULL), ('00000000.00000002.00000002', NULL),
  ('00000000.00000003.00000000', 'a/b.cbz'), ('00000000.00000003.00000001', 'c.zip'), ('00000000.00000003.00000001.00000003.00000002', NULL)) r(seq, path)""")
def first_non_empty(t):
    return plans.record_paths(plans.walk_nodes(plan_docs(t), below=())).select("doc", "seq", "path")


@query("coverage_claims", f"""
SELECT 's' || CAST({KEY} AS VARCHAR) AS source, kind, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM orders,
  (VALUES ('span', 1, 3), ('span', 4, 9), ('span', 2, 3), ('count', 9, NULL), ('complete', 1, NULL)) r(kind, a, b)""")
def coverage_claims(t):
    spans, counts, flags = plans.coverage_claims(plans.walk_nodes(plan_docs(t), below=()))
    none = F.lit(None).cast("bigint").alias("b")
    return (
        spans.select("source", F.lit("span").alias("kind"), F.col("start").alias("a"), F.col("end").alias("b"))
        .unionByName(counts.select("source", F.lit("count").alias("kind"), F.col("pages").alias("a"), none))
        .unionByName(flags.select("source", F.lit("complete").alias("kind"), F.col("complete").cast("bigint").alias("a"), none))
    )


MANIFEST_DOCS = """
SELECT source AS doc, '{"formal_library_baseline":{"root":"/lib/' || source || '","archives":{"a ' || CAST(doc_id AS STRING) || '.cbz":"' || {h}text{e} || '"},"tree_sha256":"' || {h}lang{e}
  || '","files":[{"path":"b' || CAST(doc_id AS STRING) || '","checksum":"' || upper({h}source{e}) || '","extra":"' || {h}lang{e} || '"},{"path":"b' || CAST(doc_id AS STRING) || '","hash":"' || {h}lang{e}
  || '"},{"path":"bad","sha256":"zz"}]},"other":{"c":"' || {h}text{e} || '"}}' AS text, doc_id FROM documents"""


@query("flatten_manifest", """
SELECT CAST(doc_id AS VARCHAR) AS doc, '/lib/' || source AS root, 'a ' || CAST(doc_id AS VARCHAR) || '.cbz' AS path, sha256(text) AS sha256 FROM documents
UNION ALL SELECT CAST(doc_id AS VARCHAR), '/lib/' || source, 'b' || CAST(doc_id AS VARCHAR), sha256(lang) FROM documents""")
def flatten_manifest(t):
    docs = t.sql(MANIFEST_DOCS.replace("{h}", "sha2(").replace("{e}", ", 256)"))
    return plans.flatten_manifest(
        plans.walk_nodes(docs.withColumn("doc", F.col("doc_id").cast("string")), below=()),
        ["formal_library_baseline", "formal_library_hashes", "baseline_hashes"],
    )


# Records to match: part archives against the plan records of all parts.
ARCHIVES = """
SELECT DISTINCT p_brand || '/' || p_name || ' v' || CAST(p_size AS STRING) || ' ' || CAST(p_partkey % 40 AS STRING) || '.cbz' AS path,
  p_brand AS series, CAST(p_size AS STRING) AS volume, 'SP ' || CAST(p_size AS STRING) AS number FROM part"""
DOCS = """
SELECT p_partkey AS doc_seq, CASE p_partkey % 5 WHEN 0 THEN './' || p_brand || '/' || p_name || ' v' || CAST(p_size AS STRING) || ' ' || CAST(p_partkey % 40 AS STRING) || '.cbz'
    WHEN 1 THEN 'elsewhere/' || p_name || ' v' || CAST(p_size AS STRING) || ' ' || CAST(p_partkey % 40 AS STRING) || '.cbz' END AS path,
  CASE WHEN p_partkey % 4 <> 0 THEN upper(p_brand) END AS series, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS STRING) || '.0' END AS volume,
  'sp' || CAST(p_size AS STRING) AS number FROM part"""


def _match_sql(same: str) -> str:
    return with_(a=ARCHIVES, d=DOCS, s=f"""
SELECT a.path, d.doc_seq, CASE WHEN ltrim(d.path, './') = a.path THEN 100 WHEN regexp_extract(d.path, '[^/]*$') = regexp_extract(a.path, '[^/]*$') THEN 50 ELSE 0 END
  + CASE WHEN lower(d.series) = lower(a.series) THEN 10 ELSE 0 END + CASE WHEN {same} THEN 10 ELSE 0 END AS score FROM a, d""") + """
SELECT path, min(doc_seq) AS doc_seq, CAST(score AS INTEGER) AS score FROM (SELECT *, max(score) OVER (PARTITION BY path) AS best FROM s WHERE score >= 20)
WHERE score = best GROUP BY path, score"""


@query("match_documents_volume", _match_sql("d.volume = a.volume || '.0'"))
def match_documents_volume(t):
    return matching.match_documents(t.sql(ARCHIVES), t.sql(DOCS), "volume")


@query("match_documents_special", _match_sql("replace(lower(d.number), ' ', '') = replace(lower(a.number), ' ', '')"))
def match_documents_special(t):
    return matching.match_documents(t.sql(ARCHIVES), t.sql(DOCS), "special")


# A title search returned three results per part.
RESULTS = """
SELECT p_partkey AS item, p_partkey * 10 + 1 AS candidate, substr(p_name, 1, length(p_name) - CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END) AS title, CAST(NULL AS STRING) AS alias, 'i' || CAST(p_partkey % 50 AS STRING) AS isbn FROM part WHERE p_partkey % 9 <> 0
UNION ALL SELECT p_partkey, p_partkey * 10 + 2, p_type || ' ' || p_name, CASE WHEN p_partkey % 6 = 0 THEN upper(p_name) || '!' END, CAST(NULL AS STRING) FROM part WHERE p_partkey % 9 <> 0
UNION ALL SELECT p_partkey, p_partkey * 10 + 3, reverse(p_name), CAST(NULL AS STRING), 'i0' FROM part WHERE p_partkey % 9 <> 0"""
RATIO = "CAST(floor((greatest(length(x), length(y)) - levenshtein(x, y)) * 10000 / greatest(length(x), length(y))) AS BIGINT)"


@query("match_titles", with_(
    r=RESULTS, s=f"""SELECT item, candidate, CASE WHEN r.isbn = 'i' || CAST(p_partkey % 100 AS VARCHAR) THEN 10000 ELSE greatest(
      {RATIO.replace('x', "regexp_replace(lower(p_name), '[\\s\\W]+', '', 'g')").replace('y', "regexp_replace(lower(title), '[\\s\\W]+', '', 'g')")},
      {RATIO.replace('x', "regexp_replace(lower(p_name), '[\\s\\W]+', '', 'g')").replace('y', "regexp_replace(lower(coalesce(alias, '')), '[\\s\\W]+', '', 'g')")}) END AS score
      FROM r JOIN part ON p_partkey = item""",
    k="SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, candidate) AS rn FROM s",
) + """
SELECT p_partkey AS item, a.candidate, CAST(a.score AS BIGINT) AS score, CAST(a.score - coalesce(b.score, 0) AS BIGINT) AS lead,
  CASE WHEN a.score IS NULL THEN 'META001' WHEN a.score < 9200 THEN 'META003' WHEN a.score - coalesce(b.score, 0) < 1000 THEN 'META002' END AS code
FROM part LEFT JOIN (SELECT * FROM k WHERE rn = 1) a ON a.item = p_partkey LEFT JOIN (SELECT * FROM k WHERE rn = 2) b ON b.item = p_partkey""")
def match_titles(t):
    items = t.part.selectExpr("p_partkey AS item", "p_name AS title", "'i' || (p_partkey % 100) AS isbn")
    return matching.match_titles(items, t.sql(RESULTS))


# A catalog of its own: every part's title in another form, searched by all parts.
TITLES = "SELECT p_partkey AS item, p_name || ' ' || p_type || ' ' || p_brand || ' ' || CAST(p_size AS STRING) AS title, 'i' || CAST(p_partkey % 700 AS STRING) AS isbn FROM part"
CATALOG = """
SELECT p_partkey AS candidate, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ', ' || p_type || ': ' || p_brand || '-' || CAST(p_size AS STRING)
    WHEN 1 THEN substr(p_name, 2) || ' ' || p_type || ' ' || p_brand || ' ' || CAST(p_size AS STRING) WHEN 2 THEN p_name || ' the ' || p_type || ' ' || p_brand ELSE p_brand END AS title,
  CASE WHEN p_partkey % 5 = 0 THEN replace(p_name, 'e', 'a') || ' ' || p_type || ' ' || p_brand || CAST(p_size AS STRING) END AS alias,
  CASE WHEN p_partkey % 9 = 0 THEN 'i' || CAST(p_partkey % 650 AS STRING) END AS isbn FROM part"""
KEYED = "regexp_replace(lower({}), '[\\s\\W]+', '', 'g')"


@query("search_titles", with_(
    i=TITLES, c=CATALOG, x=f"SELECT item, {KEYED.format('title')} AS x, isbn FROM i",
    y=f"SELECT candidate, {KEYED.format('title')} AS y, {KEYED.format("coalesce(alias, '')")} AS z, isbn FROM c",
    s=f"""SELECT item, candidate, CASE WHEN x.isbn = y.isbn THEN 10000 ELSE greatest(CASE WHEN abs(length(x) - length(y)) * 5 <= greatest(length(x), length(y)) THEN {RATIO} ELSE 0 END,
      CASE WHEN abs(length(x) - length(z)) * 5 <= greatest(length(x), length(z)) THEN {RATIO.replace('y', 'z')} ELSE 0 END) END AS score FROM x, y""",
    k="SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, candidate) AS rn FROM s WHERE score >= 8200",
) + """
SELECT i.item, a.candidate, CAST(a.score AS BIGINT) AS score, CAST(a.score - coalesce(b.score, 0) AS BIGINT) AS lead,
  CASE WHEN a.score IS NULL THEN 'META001' WHEN a.score < 9200 THEN 'META003' WHEN a.score - coalesce(b.score, 0) < 1000 THEN 'META002' END AS code
FROM i LEFT JOIN (SELECT * FROM k WHERE rn = 1) a USING (item) LEFT JOIN (SELECT * FROM k WHERE rn = 2) b USING (item)""")
def search_titles(t):
    return matching.search_titles(t.sql(TITLES), t.sql(CATALOG))


EDITIONS = """
SELECT CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS identity, CAST(l_partkey * 1000 + l_suppkey AS BIGINT) AS item,
  CAST(l_quantity AS BIGINT) % 7 AS score, 'h' || CAST(l_partkey % 10 AS STRING) AS sha256 FROM lineitem"""


@query("elect_primary", with_(
    e=EDITIONS, s="SELECT identity, max(item) AS item FROM e WHERE length(identity) % 2 = 0 GROUP BY 1",
    m="SELECT e.*, s.item IS NOT NULL AS stored FROM e LEFT JOIN s USING (identity, item)",
) + """
SELECT identity, item, score, sha256, count(*) OVER (PARTITION BY identity) AS editions, first_value(item) OVER w AS primary_item,
  CASE WHEN item = first_value(item) OVER w THEN 'primary' ELSE 'alternate' END AS role
FROM m WINDOW w AS (PARTITION BY identity ORDER BY stored DESC, score DESC, sha256, item)""")
def elect_primary(t):
    editions = t.sql(EDITIONS)
    stored = editions.filter("length(identity) % 2 = 0").groupBy("identity").agg(F.max("item").alias("item"))
    return matching.elect_primary(editions, stored)


ORDER = "['embedded-contents-bookmarks-metadata', 'epub-opf-spine-ncx-navigation', 'visible-contents-headings-structure', 'filename-folder-comicinfo', 'adjacent-sequence-volume-chapter-map', 'reliable-external-sources', 'user-authorized-ocr']"


@query("rank_evidence", with_(e=f"""SELECT l_orderkey AS boundary, {ORDER}[1 + (l_partkey + l_suppkey) % 7] AS kind, CAST((l_partkey + l_suppkey) % 7 AS INT) + 1 AS rank,
    'page ' || CAST(l_suppkey % 3 AS VARCHAR) AS value, l_partkey * 1000 + l_suppkey AS item, l_returnflag = 'R' AS authorized FROM lineitem""") + """
SELECT boundary, arg_min(value, (rank, item)) AS value, arg_min(kind, (rank, item)) AS kind, count(*) AS evidence, min(value) <> max(value) AS conflict
FROM e WHERE rank < 7 OR authorized GROUP BY boundary""")
def rank_evidence(t):
    kinds = ORDER.replace("[", "array(").replace("]", ")")
    rows = t.lineitem.selectExpr(
        "l_orderkey AS boundary", f"{kinds}[CAST((l_partkey + l_suppkey) % 7 AS INT)] AS kind", "'page ' || (l_suppkey % 3) AS value",
        "l_partkey * 1000 + l_suppkey AS item", "l_returnflag = 'R' AS authorized",
    )
    return matching.rank_evidence(rows)


ANCHORS = "SELECT l_orderkey AS source, CAST(l_quantity AS BIGINT) AS printed_page, CAST(l_quantity AS BIGINT) + l_linenumber % 3 AS scan_page FROM lineitem"


@query("page_offset", with_(a=ANCHORS, o="SELECT source, scan_page - printed_page AS offset_, count(*) AS n FROM a GROUP BY ALL") + """
SELECT source, CASE WHEN max(n) >= 2 THEN arg_max(offset_, (n, -offset_)) END AS "offset", max(n) AS agreeing, CAST(sum(n) AS BIGINT) AS anchors, count(*) > 1 AS disagreement
FROM o GROUP BY source""")
def page_offset(t):
    return matching.page_offset(t.sql(ANCHORS))


@query("series_keys", r"""
SELECT page_id, lower(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS series_key, rtrim(rtrim(CAST(CAST(page_id % 90 AS DECIMAL(20,4)) / 8 AS DECIMAL(20,6))::VARCHAR, '0'), '.') AS number FROM pages""")
def series_keys(t):
    number = F.expr("'0' || CAST(CAST(page_id % 90 AS DECIMAL(20,4)) / 8 AS DECIMAL(20,6)) || '0'")
    return t.pages.select(
        "page_id", identity.series_key(F.col("html")).alias("series_key"), identity.decimal_identity(number).alias("number")
    )


@query("page_names", """
SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(n_chars AS VARCHAR))) AS INTEGER), '0') || '.' || lower(lang) AS name FROM documents""")
def page_names(t):
    member = F.concat(F.lit("Dir/"), "source", F.lit("."), F.upper("lang"))
    return t.documents.select("doc_id", paths.page_name(F.col("doc_id"), F.col("n_chars"), member).alias("name"))
