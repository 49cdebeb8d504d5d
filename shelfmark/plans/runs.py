"""Queries of run states, over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import runs, spread
from ..sources import plans
from .records import HEX, _json
from .registry import query, with_

CHECKPOINTS = """
SELECT CAST(floor(event_id / 50) AS BIGINT) AS run, event_id % 50 + 1 - CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS sequence,
  event_type || ' ' || CAST(event_id AS STRING) AS state FROM events WHERE event_id % 89 <> 5 AND event_id % 50 <> 49"""


@query("latest_checkpoint", with_(e=CHECKPOINTS) + """
SELECT run, max(sequence) AS sequence, arg_max(state, (sequence, state)) AS state, count(*) AS checkpoints,
  max(sequence) - min(sequence) + 1 - count(DISTINCT sequence) AS missing, count(*) - count(DISTINCT sequence) AS repeated,
  max(sequence) - min(sequence) + 1 = count(DISTINCT sequence) AND count(*) = count(DISTINCT sequence) AS consecutive
FROM e GROUP BY run""")
def latest_checkpoint(t):
    return runs.latest_checkpoint(t.sql(CHECKPOINTS))


# A user's events update nested state; some replace a whole branch by a scalar.
UPDATES = """
SELECT user_id AS run, event_id AS sequence, CASE WHEN event_id % 40 = 0 THEN event_type WHEN event_id % 7 = 0 THEN event_type || '.k' || CAST(event_id % 3 AS STRING) || '.deep'
  ELSE event_type || '.k' || CAST(event_id % 3 AS STRING) END AS path, CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) AS value FROM events"""
FOLDED = dict(
    u=UPDATES, l="SELECT run, path, max(sequence) AS sequence, arg_max(value, sequence) AS value FROM u GROUP BY ALL",
    f="""SELECT run, path, value, sequence FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.run = a.run AND b.sequence > a.sequence
  AND (starts_with(b.path, a.path || '.') OR starts_with(a.path, b.path || '.')))""",
)


@query("fold_updates", with_(**FOLDED) + "SELECT * FROM f")
def fold_updates(t):
    return runs.fold_updates(t.sql(UPDATES))


@query("rebuild_state", with_(
    **FOLDED, p="SELECT run, split_part(path, '.', 1) AS a, split_part(path, '.', 2) AS b, split_part(path, '.', 3) AS c, coalesce(CAST(to_json(value) AS VARCHAR), 'null') AS v FROM f",
    two="SELECT run, a, b, CASE WHEN max(c) = '' THEN max(v) ELSE '{' || string_agg(to_json(c) || ':' || v, ',' ORDER BY c) || '}' END AS v FROM p GROUP BY run, a, b",
    one="SELECT run, a, CASE WHEN max(b) = '' THEN max(v) ELSE '{' || string_agg(to_json(b) || ':' || v, ',' ORDER BY b) || '}' END AS v FROM two GROUP BY run, a",
) + "SELECT run, '{' || string_agg(to_json(a) || ':' || v, ',' ORDER BY a) || '}' AS document FROM one GROUP BY run")
def rebuild_state(t):
    return runs.rebuild_state(runs.fold_updates(t.sql(UPDATES)))


K = "c_custkey"
STATE = [
    ("schema_version", "1", "2", f"{K} % 5 = 0"), ("run_id", '"r"', '""', f"{K} % 7 = 0"),
    ("status", '"paused"', '"validated-final"', f"{K} % 3 = 0"), ("current_phase", '"p"'), ("source_root", '"/s"'), ("formal_library", '"/f"'),
    ("backup_root", '"/b"'), ("staging_path", '"/t"'), ("last_complete_unit", '"u"'), ("completed_archives", "[]", "{}", f"{K} % 11 = 0"),
    ("pending_archives", "[]"), ("source_hashes", '{"a":"b"}'), ("formal_library_baseline", "{}"), ("chapter_boundaries", "{}"),
    ("ocr_permissions", "{}", "null", f"{K} % 13 = 0"), ("ocr_review_conclusions", "{}"), ("primary_editions", "{}"), ("ignored_damaged_items", "[]"),
    ("special_deduplication", "{}"), ("locked_metadata", "{}"), ("candidate_library_status", '"x"'), ("profile", '"p"'), ("identity_policy", '"i"'),
    ("tool_fingerprint", "{}"), ("config_sha256", f'"{HEX}"', '"z"', f"{K} % 17 = 0"), ("config_path", '"c"'), ("plan_sha256", f'"{HEX}"'), ("plan_path", '"p"'),
    ("decision_log_sha256", f'"{HEX}"'), ("decision_log_path", '"d"'), ("lock_owner", '"o"'), ("filesystem_capabilities", "{}"), ("candidate_manifest", "{}"),
    ("review_copy_hashes", "{}"), ("unaffected_archive_hashes", "{}", "[]", f"{K} % 19 = 0"), ("affected_formal_archives", '["a"]', '["../a"]', f"{K} % 23 = 0"),
    ("checkpoint_sequence", "3", "0", f"{K} % 29 = 0"), ("caches", '{"cache_paths":["/c1","/c2"]}', '{"disposable_caches":"/c3"}', f"{K} % 2 = 0"),
]
STATES = f"SELECT {K} AS run, {_json(STATE)} AS json FROM customer"


def states(t):
    """States that carry their checksum; one in 31 was edited afterwards."""
    rows = spread.dealt(t.sql(STATES)).withColumn("sum", runs.state_checksum(F.col("json")))
    body = F.regexp_replace("json", "[}]$", "")
    stored = F.concat(body, F.lit(',"state_checksum":"'), F.expr("CASE WHEN run % 37 = 0 THEN 'none' ELSE upper(sum) END"), F.lit('"}'))
    edited = F.when(F.expr("run % 31 = 0"), F.replace(stored, F.lit('"lock_owner":"o"'), F.lit('"lock_owner":"p"'))).otherwise(stored)
    return rows.select("run", edited.alias("json")).withColumn("checksum", runs.state_checksum(F.col("json")))


@query("run_state_issues", " UNION ALL ".join(
    f"SELECT {K} AS run, '{code}' AS code, '{field}' AS field FROM customer WHERE {c}" for c, code, field in [
        (f"{K} % 5 = 0", "resume_state_schema_unsupported", ""), (f"{K} % 7 = 0", "resume_state_field_missing", "run_id"),
        (f"{K} % 13 = 0", "resume_state_field_missing", "ocr_permissions"), (f"{K} % 3 = 0", "resume_state_terminal_incomplete", "promotion"),
        (f"{K} % 3 = 0", "resume_state_terminal_incomplete", "promotion_journal"), (f"{K} % 3 = 0", "resume_state_terminal_incomplete", "candidate_library_status"),
        (f"{K} % 11 = 0", "resume_state_field_invalid", "completed_archives"), (f"{K} % 17 = 0", "resume_state_field_invalid", "config_sha256"),
        (f"{K} % 19 = 0", "resume_state_field_invalid", "unaffected_archive_hashes"), (f"{K} % 23 = 0", "resume_state_field_invalid", "affected_formal_archives"),
        (f"{K} % 29 = 0", "resume_state_field_invalid", "checkpoint_sequence"), (f"{K} % 37 = 0", "resume_state_checksum_missing", ""),
        (f"{K} % 31 = 0 AND {K} % 37 <> 0", "resume_state_checksum_mismatch", ""),
    ]
))
def run_state_issues(t):
    return runs.run_state_issues(states(t), checksum="checksum")


@query("next_actions", f"""
SELECT {K} AS run, 1 AS step, CASE WHEN {K} % 5 = 0 THEN 'stop-and-replan' WHEN {K} % 3 = 0 THEN 'already-validated-final' WHEN {K} % 7 = 0 THEN 'stop'
  WHEN {K} % 2 = 0 THEN 'continue-from-last-complete-unit' ELSE 'rebuild-staging-from-checkpoint' END AS action, CASE WHEN {K} % 7 <> 0 THEN '/t' END AS path FROM customer
UNION ALL SELECT {K}, 2, 'rebuild-disposable-cache', '/c' || CAST(n AS VARCHAR) FROM customer, (VALUES (1), (2), (3)) v(n)
WHERE CASE WHEN {K} % 2 = 0 THEN n = 3 ELSE n < 3 END AND n <> 2""")
def next_actions(t):
    rows = t.customer.selectExpr(
        "c_custkey AS run", "CASE WHEN c_custkey % 3 = 0 THEN 'Validated-Final' ELSE 'paused' END AS status",
        "CASE WHEN c_custkey % 7 <> 0 THEN '/t' END AS staging", "c_custkey % 2 = 0 AS staging_exists",
    )
    problems = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("run"))
    docs = t.sql(STATES).select(F.col("run").cast("string").alias("doc"), F.col("json").alias("text"))
    caches = plans.cache_paths(docs, "run").withColumn("run", F.col("run").cast("bigint"))
    existing = t.customer.filter("c_custkey % 10 = 0").select(F.lit("/c2").alias("path"))
    return runs.next_actions(rows, problems, caches, existing)


@query("reused_sections", f"""
SELECT {K} AS run, section FROM customer, (VALUES ('chapter_boundaries'), ('ignored_damaged_items'), ('locked_metadata'), ('ocr_permissions'),
  ('ocr_review_conclusions'), ('primary_editions'), ('special_deduplication')) s(section)""")
def reused_sections(t):
    return runs.reused_sections(t.sql(STATES))


@query("row_fingerprint", """
SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '","o_orderkey":' || o_orderkey
  || ',"o_orderpriority":' || to_json(o_orderpriority) || ',"o_orderstatus":' || to_json(o_orderstatus) || ',"o_totalprice":' || printf('%.14e', o_totalprice) || '}') AS fingerprint
FROM orders""")
def row_fingerprint(t):
    orders = t.orders
    return orders.select("o_orderkey", hashes.row_fingerprint(orders).alias("fingerprint"))
