"""Queries of manifests, checksums, snapshots and collisions, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests
from ..sources import checksums
from .registry import query, with_

PATH = "lang || '/' || source || '-' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 8 = 0 THEN '.txt' ELSE '.cbz' END"
ALL = f"SELECT doc_id, source, lang, {PATH} AS path, sha256(text) AS sha256 FROM documents"
# The second snapshot lacks a language, has edited files and new ones.
NEW = f"""
SELECT path, CASE WHEN doc_id % 10 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS sha256 FROM (
  SELECT doc_id, lang, text, CASE WHEN doc_id % 9 = 0 THEN 'new/' ELSE '' END || {PATH} AS path FROM documents) WHERE lang <> 'es'"""


def _hashed(text: str) -> str:
    return text.replace("sha256(text || '!')", "sha2(text || '!', 256)").replace("sha256(text)", "sha2(text, 256)")


def old(t):
    return t.sql(_hashed(ALL))


def new(t):
    return t.sql(_hashed(NEW))


RECORDED = """
SELECT 'lib' AS root, CASE WHEN doc_id % 40 = 0 THEN '../' || path WHEN doc_id % 41 = 0 THEN 'gone/' || path ELSE path END AS path,
  CASE WHEN doc_id % 6 = 0 THEN upper(sha256) ELSE sha256 END AS sha256 FROM {}"""


@query("verify_manifest", with_(old=ALL, new=NEW, rec=RECORDED.format("old")) + """
SELECT r.root, r.path, lower(r.sha256) AS expected, n.sha256 AS actual,
  CASE WHEN r.path LIKE '../%' THEN 'unsafe_source_path' WHEN n.sha256 IS NULL THEN 'source_file_missing'
       WHEN n.sha256 <> lower(r.sha256) THEN 'source_hash_changed' ELSE 'ok' END AS status,
  status IN ('ok', 'source_hash_changed') AS checked
FROM rec r LEFT JOIN new n USING (path)""")
def verify_manifest(t):
    recorded = old(t).selectExpr(
        "'lib' AS root",
        "CASE WHEN doc_id % 40 = 0 THEN '../' || path WHEN doc_id % 41 = 0 THEN 'gone/' || path ELSE path END AS path",
        "CASE WHEN doc_id % 6 = 0 THEN upper(sha256) ELSE sha256 END AS sha256",
    )
    return manifests.verify_manifest(recorded, new(t).withColumn("root", F.lit("lib")), "source")


@query("diff_manifests", with_(old=ALL, new=NEW) + """
SELECT path, o.sha256 AS old_sha256, n.sha256 AS new_sha256,
  CASE WHEN o.sha256 IS NULL THEN 'added' WHEN n.sha256 IS NULL THEN 'removed' WHEN o.sha256 = n.sha256 THEN 'same' ELSE 'changed' END AS change
FROM old o FULL JOIN new n USING (path)""")
def diff_manifests(t):
    return manifests.diff_manifests(old(t), new(t))


@query("manifests_equal", with_(old=ALL, new=NEW) + """
SELECT lang, count(*) FILTER (n.sha256 IS DISTINCT FROM o.sha256) = 0 AS equal
FROM old o LEFT JOIN new n USING (path) GROUP BY lang""")
def manifests_equal(t):
    """Per language: whether its old files are unchanged in the new snapshot."""
    kept = old(t).select("path", "lang", "sha256")
    both = manifests.diff_manifests(kept.select("path", "sha256"), new(t)).filter("change != 'added'")
    return both.groupBy(F.substring_index("path", "/", 1).alias("lang")).agg(
        (F.count_if(F.col("change") != "same") == 0).alias("equal")
    )


LINES = """
SELECT doc_id AS line, CASE
  WHEN doc_id % 31 = 0 THEN 'not a line ' || path
  WHEN doc_id % 37 = 0 THEN sha256 || '  ../' || path
  WHEN doc_id % 29 = 0 THEN sha256 || '  en/same.cbz'
  WHEN doc_id % 23 = 0 THEN '   '
  WHEN doc_id % 2 = 0 THEN upper(sha256) || ' *' || path
  ELSE sha256 || '  ' || path END AS value FROM {}"""
LISTED = r"""
SELECT arg_min(sha256, line) AS sha256, path FROM (
  SELECT line, lower(left(value, 64)) AS sha256, regexp_extract(value, '^[0-9a-fA-F]{64}[ \t]+\*?(.+)$', 1) AS path FROM lines
  WHERE regexp_matches(value, '^[0-9a-fA-F]{64}[ \t]+\*?.+$') AND value NOT LIKE '%../%') GROUP BY path"""
CHECKSUM_BASE = dict(old=ALL, new=NEW, lines=LINES.format("old"), listed=LISTED)


def lines(t):
    return old(t).selectExpr("doc_id AS line", LINES.split("AS line, ", 1)[1].split(" AS value")[0] + " AS value")


@query("parse_checksums", with_(**CHECKSUM_BASE) + "SELECT path, sha256 FROM listed")
def parse_checksums(t):
    return checksums.parse_checksums(lines(t))[0]


@query("checksum_line_issues", with_(**CHECKSUM_BASE) + r"""
SELECT DISTINCT code, subject, CASE code WHEN 'checksums_manifest_invalid' THEN 'checksums.line-valid'
    WHEN 'checksums_manifest_unsafe_path' THEN 'checksums.path-safe' ELSE 'checksums.path-once' END AS message
FROM (SELECT 'checksums_manifest_invalid' AS code, value AS subject FROM lines WHERE value LIKE 'not a line%'
  UNION ALL SELECT 'checksums_manifest_unsafe_path', regexp_extract(value, '[ ]+\*?(.+)$', 1) FROM lines WHERE value LIKE '%../%' AND value NOT LIKE 'not a line%'
  UNION ALL SELECT 'checksums_manifest_duplicate', 'en/same.cbz' FROM lines WHERE value LIKE '%  en/same.cbz' HAVING count(*) > 1)""")
def checksum_line_issues(t):
    return checksums.parse_checksums(lines(t))[1]


@query("checksum_issues", with_(**CHECKSUM_BASE, b="""
    SELECT path, l.sha256 AS listed, n.sha256 AS actual, l.path IS NOT NULL AS on_list, n.path IS NOT NULL AS present,
      path LIKE '%.cbz' AS archive FROM listed l FULL JOIN new n USING (path)""") + """
SELECT 'checksums_target_missing' AS code, path AS subject, 'checksums.target-present' AS message FROM b WHERE on_list AND NOT present
UNION ALL SELECT 'checksums_mismatch', path, 'checksums.hash-equal' FROM b WHERE listed <> actual
UNION ALL SELECT 'checksums_archive_coverage_missing', path, 'checksums.covers-archives' FROM b WHERE present AND NOT on_list AND archive
UNION ALL SELECT 'checksums_archive_coverage_extra', path, 'checksums.within-library' FROM b WHERE on_list AND NOT present AND archive""")
def checksum_issues(t):
    return manifests.checksum_issues(checksums.parse_checksums(lines(t))[0], new(t))


UNAFFECTED = """
SELECT CASE WHEN doc_id % 50 = 1 THEN '/abs/' || path ELSE path END AS path, CASE WHEN doc_id % 33 = 0 THEN 'bad' WHEN doc_id % 34 = 0 THEN sha256 || '' ELSE sha256 END AS sha256
FROM {} WHERE doc_id % 3 <> 0"""


@query("partition_issues", with_(
    old=ALL, new=NEW, aff="SELECT path FROM old WHERE doc_id % 3 = 0 AND doc_id % 15 <> 0 OR doc_id % 70 = 1 UNION ALL SELECT 'extra/' || path FROM old WHERE doc_id % 90 = 0",
    unaff0=UNAFFECTED.format("old"), un="SELECT * FROM unaff0 WHERE path NOT LIKE '/%' AND sha256 <> 'bad'",
    b="""SELECT path, a.path IS NOT NULL AS a, u.path IS NOT NULL AS u, o.path IS NOT NULL AS f, u.sha256 AS us, o.sha256 AS os, n.sha256 AS ns
         FROM aff a FULL JOIN un u USING (path) FULL JOIN old o USING (path) FULL JOIN new n USING (path)""",
) + """
SELECT 'formal_partition_overlap' AS code, path AS subject, 'partition.disjoint' AS message FROM b WHERE a AND u
UNION ALL SELECT 'formal_partition_incomplete', path, 'missing' FROM b WHERE f AND NOT a AND NOT u
UNION ALL SELECT 'formal_partition_incomplete', path, 'unexpected' FROM b WHERE NOT f AND (a OR u)
UNION ALL SELECT 'unaffected_baseline_mismatch', path, 'unaffected.in-baseline' FROM b WHERE u AND us IS DISTINCT FROM os
UNION ALL SELECT 'unaffected_archive_changed', path, 'unaffected.in-candidate' FROM b WHERE u AND us IS DISTINCT FROM ns
UNION ALL SELECT 'unaffected_partition_invalid', path, 'unaffected.row-valid' FROM unaff0 WHERE path LIKE '/%' OR sha256 = 'bad'""")
def partition_issues(t):
    formal = old(t)
    affected = formal.filter("doc_id % 3 = 0 AND doc_id % 15 <> 0 OR doc_id % 70 = 1").select("path").unionByName(
        formal.filter("doc_id % 90 = 0").selectExpr("'extra/' || path AS path")
    )
    unaffected = formal.filter("doc_id % 3 <> 0").selectExpr(
        "CASE WHEN doc_id % 50 = 1 THEN '/abs/' || path ELSE path END AS path",
        "CASE WHEN doc_id % 33 = 0 THEN 'bad' ELSE sha256 END AS sha256",
    )
    return manifests.partition_issues(affected, unaffected, formal.select("path", "sha256"), new(t))


@query("unaffected", with_(
    old=ALL, new=NEW, wanted="""SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN path WHEN doc_id % 4 = 1 THEN 'moved/' || regexp_extract(path, '[^/]*$')
      ELSE 'nowhere/x' || CAST(doc_id AS VARCHAR) END AS path FROM old WHERE doc_id % 5 < 3""",
    by_name="SELECT regexp_extract(path, '[^/]*$') AS name, arg_max(sha256, doc_id) AS by_name FROM old GROUP BY 1",
    expected="""SELECT w.path, coalesce(o.sha256, by_name) AS sha256 FROM wanted w LEFT JOIN old o USING (path)
                LEFT JOIN by_name n ON n.name = regexp_extract(w.path, '[^/]*$') WHERE coalesce(o.sha256, by_name) IS NOT NULL""",
) + """
SELECT path, CASE WHEN n.sha256 IS NULL THEN 'unaffected_archive_missing' ELSE 'unaffected_archive_changed' END AS code,
  e.sha256 AS expected, n.sha256 AS actual FROM expected e LEFT JOIN new n USING (path) WHERE n.sha256 IS DISTINCT FROM e.sha256""")
def unaffected(t):
    baseline = old(t).selectExpr("'./' || path AS path", "sha256", "doc_id AS seq")
    requested = old(t).filter("doc_id % 5 < 3").selectExpr(
        """CASE WHEN doc_id % 4 = 0 THEN path WHEN doc_id % 4 = 1 THEN 'moved\\\\' || regexp_extract(path, '([^/]*)$', 1)
           ELSE 'nowhere/x' || doc_id END AS path"""
    )
    return manifests.unaffected_issues(manifests.unaffected_expectations(baseline, requested), new(t))


RUNS = """
SELECT source AS run, CASE min(doc_id) % 7 WHEN 6 THEN 'validated-final' ELSE 'promotion-intent' END AS status,
  min(doc_id) % 2 = 0 AS candidate_exists, min(doc_id) % 3 <> 0 AS formal_exists, min(doc_id) % 5 < 2 AS backup_exists,
  min(doc_id) % 8 <> 6 AS candidate_recorded, min(doc_id) % 9 <> 5 AS formal_recorded, min(doc_id) % 4 = 0 AS backup_recorded
FROM documents GROUP BY source"""


def _snapshot(which: str, changed: str) -> str:
    return f"SELECT source AS run, path, CASE WHEN {changed} THEN 'x' ELSE sha256 END AS sha256 FROM {which}"


@query("reconcile_snapshots", with_(
    old=ALL, runs=RUNS,
    m="SELECT source AS run, min(doc_id) AS m FROM documents GROUP BY 1",
    d="SELECT o.source AS run, o.path, o.sha256, m.m FROM old o JOIN m ON m.run = o.source",
    new="SELECT run, path, sha256 || 'n' AS sha256 FROM d WHERE path LIKE '%.cbz'",
    oldm="SELECT run, path, sha256 FROM d WHERE m % 11 <> 0",
    cand="SELECT run, path, sha256 || 'n' AS sha256 FROM d WHERE m % 2 = 0",
    formal="SELECT run, path, CASE WHEN m % 4 = 1 THEN sha256 || 'n' ELSE sha256 END AS sha256 FROM d WHERE m % 3 <> 0",
    backup="SELECT run, path, sha256 FROM d WHERE m % 5 < 2 AND NOT (m % 13 = 0 AND path LIKE '%0.cbz')",
    own="SELECT run, path, sha256 FROM d WHERE m % 4 = 0 AND NOT (m % 16 = 0 AND path LIKE '%0.cbz')",
    f="""SELECT run, status, candidate_exists, formal_exists, backup_exists,
      formal_recorded AND NOT EXISTS (FROM oldm o WHERE o.run = r.run) AS new_library,
      candidate_exists AND candidate_recorded AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM cand WHERE run = r.run AND path LIKE '%.cbz') c FULL JOIN (SELECT * FROM new WHERE run = r.run) n USING (path) WHERE c.sha256 IS DISTINCT FROM n.sha256) AS candidate_matches,
      formal_exists AND candidate_recorded AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM formal WHERE run = r.run AND path LIKE '%.cbz') c FULL JOIN (SELECT * FROM new WHERE run = r.run) n USING (path) WHERE c.sha256 IS DISTINCT FROM n.sha256) AS formal_matches_candidate,
      formal_exists AND formal_recorded AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM formal WHERE run = r.run) c FULL JOIN (SELECT * FROM oldm WHERE run = r.run) n USING (path) WHERE c.sha256 IS DISTINCT FROM n.sha256) AS formal_matches_old,
      backup_exists AND CASE WHEN backup_recorded THEN NOT EXISTS (SELECT 1 FROM (SELECT * FROM backup WHERE run = r.run) c FULL JOIN (SELECT * FROM own WHERE run = r.run) n USING (path) WHERE c.sha256 IS DISTINCT FROM n.sha256)
        ELSE formal_recorded AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM backup WHERE run = r.run) c FULL JOIN (SELECT * FROM oldm WHERE run = r.run) n USING (path) WHERE c.sha256 IS DISTINCT FROM n.sha256) END AS backup_matches_old
      FROM runs r""",
) + """
SELECT *, CASE WHEN status IN ('validated-final', 'rollback-complete') THEN NULL
  WHEN new_library AND NOT formal_exists AND candidate_matches AND NOT backup_exists THEN 'continue-candidate-promotion-then-postcheck'
  WHEN new_library AND formal_matches_candidate AND NOT backup_exists THEN 'run-formal-postcheck-and-finalize'
  WHEN formal_matches_old AND candidate_matches AND NOT backup_exists THEN 'close-noop-intent-and-restart-promotion'
  WHEN NOT formal_exists AND candidate_matches AND backup_matches_old THEN 'continue-candidate-promotion-then-postcheck'
  WHEN formal_matches_candidate AND backup_matches_old THEN 'run-formal-postcheck-and-finalize'
  WHEN formal_matches_old AND NOT backup_exists THEN 'mark-rollback-complete'
  ELSE 'stop-for-manual-recovery' END AS action FROM f""")
def reconcile_snapshots(t):
    first = t.documents.groupBy(F.col("source").alias("run")).agg(F.min("doc_id").alias("m"))
    d = old(t).withColumnRenamed("source", "run").join(first, "run").select("run", "path", "sha256", "m")
    pick = lambda condition, sha="sha256": d.filter(condition).selectExpr("run", "path", f"{sha} AS sha256")
    flags = manifests.snapshot_flags(
        t.sql(RUNS),
        candidate=pick("m % 2 = 0", "sha256 || 'n'"),
        formal=pick("m % 3 <> 0", "CASE WHEN m % 4 = 1 THEN sha256 || 'n' ELSE sha256 END"),
        backup=pick("m % 5 < 2 AND NOT (m % 13 = 0 AND path LIKE '%0.cbz')"),
        expected_candidate=pick("path LIKE '%.cbz'", "sha256 || 'n'"),
        expected_formal=pick("m % 11 <> 0"),
        expected_backup=pick("m % 4 = 0 AND NOT (m % 16 = 0 AND path LIKE '%0.cbz')"),
    )
    return manifests.reconcile(flags)


OUTPUTS = """
SELECT p_partkey AS item, CASE WHEN p_partkey % 7 = 0 THEN upper(p_name) ELSE p_name END || ' ' || CAST(p_partkey % 900 AS STRING) || '.cbz' AS output FROM part"""
SOURCES = "SELECT p_name || ' ' || CAST(p_partkey % 901 AS STRING) || '.cbz' AS path FROM part"
EXISTING = "SELECT p_name || ' ' || CAST(p_partkey % 902 AS STRING) || '.cbz' AS path FROM part"


@query("output_collisions", with_(o=OUTPUTS, s=SOURCES, e=EXISTING) + """
SELECT item, output, 'NAME005' AS code, 'output.planned-once' AS reason FROM (SELECT *, min(item) OVER (PARTITION BY lower(output)) AS f FROM o) WHERE item > f
UNION ALL SELECT item, output, 'SOURCE_REPLACEMENT_REFUSED', 'output.no-source' FROM o WHERE output IN (SELECT path FROM s)
UNION ALL SELECT item, output, 'NAME005', 'output.new' FROM o WHERE output IN (SELECT path FROM e)""")
def output_collisions(t):
    return manifests.output_collisions(t.sql(OUTPUTS), t.sql(SOURCES), t.sql(EXISTING))
