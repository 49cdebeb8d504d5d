"""Queries of exact and near-duplicate matching, over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import dedupe, ordered, overlap, provenance, spread
from ..session import stored
from .members import DOC_PAGES, doc_pages
from .registry import query, with_

SHA_PAGES = DOC_PAGES.format("sha256(text)")


@query("dedupe_exact", with_(p="SELECT CAST(substr(source, 4) AS INT) AS source_index, doc_id AS page, sha256(text) AS sha256 FROM documents") + """
SELECT source_index, page, sha256, count(*) OVER g AS copies,
  first_value(source_index) OVER (g ORDER BY source_index, page) AS target_source,
  first_value(page) OVER (g ORDER BY source_index, page) AS target_page,
  row_number() OVER (g ORDER BY source_index, page) = 1 AS kept
FROM p WINDOW g AS (PARTITION BY sha256)""")
def dedupe_exact(t):
    pages = t.documents.selectExpr(
        "CAST(substr(source, 4) AS INT) AS source_index", "doc_id AS page", "sha2(text, 256) AS sha256"
    )
    return dedupe.dedupe_exact(pages, [])


@query("exact_overlap", with_(h="SELECT series, sha256, archive, count(*) AS pages FROM (" + SHA_PAGES + ") GROUP BY ALL") + """
SELECT series, sha256, archive, pages, count(*) OVER w AS archives, min(archive) OVER w AS first_archive
FROM h WINDOW w AS (PARTITION BY series, sha256) QUALIFY archives > 1""")
def exact_overlap(t):
    return overlap.exact_overlap(doc_pages(t))


REVIEWED = "SELECT DISTINCT lang AS series, source AS archive FROM documents WHERE source IN ('src3', 'src7', 'src12')"


@query("shared_with", with_(p=SHA_PAGES, r=REVIEWED, h="SELECT DISTINCT series, sha256, archive FROM p",
    g="SELECT h.*, r.archive IS NOT NULL AS reviewed FROM h LEFT JOIN r USING (series, archive)") + """
SELECT series, sha256, archive, reviewed, count(*) OVER w AS archives FROM g WINDOW w AS (PARTITION BY series, sha256)
QUALIFY archives > 1 AND bool_or(reviewed) OVER w""")
def shared_with(t):
    return overlap.shared_with(doc_pages(t), t.sql(REVIEWED))


@query("audit_exact", with_(
    p=SHA_PAGES, h="SELECT DISTINCT series, archive, sha256 FROM p",
    pairs="SELECT a.series, a.archive, b.archive AS other, a.sha256 FROM h a JOIN h b ON a.series = b.series AND a.sha256 = b.sha256 AND a.archive <> b.archive",
    star="SELECT series, archive, sha256, min(archive) OVER (PARTITION BY series, sha256) AS head FROM h",
    recorded="""SELECT series, archive, other, CASE WHEN length(other) = 5 AND archive = 'src1' THEN 'forged' ELSE sha256 END AS sha256
                FROM (SELECT series, archive, head AS other, sha256 FROM star WHERE archive <> head
                      UNION ALL SELECT series, head, archive, sha256 FROM star WHERE archive <> head) WHERE NOT (archive = 'src2' AND other LIKE '%1')""",
    e="SELECT series, archive, count(*) AS expected FROM pairs GROUP BY ALL",
    c="""SELECT r.series, r.archive, count(*) FILTER (p.sha256 IS NOT NULL) AS confirmed, count(*) FILTER (p.sha256 IS NULL) AS wrong
         FROM (SELECT DISTINCT * FROM recorded) r LEFT JOIN pairs p USING (series, archive, other, sha256) GROUP BY ALL""",
) + """
SELECT series, archive, coalesce(expected, 0) AS expected, coalesce(confirmed, 0) AS confirmed, coalesce(wrong, 0) AS wrong,
  coalesce(expected, 0) = coalesce(confirmed, 0) AND coalesce(wrong, 0) = 0 AS ok
FROM (SELECT DISTINCT series, archive FROM h) LEFT JOIN e USING (series, archive) LEFT JOIN c USING (series, archive)""")
def audit_exact(t):
    """Records that compare every package with the first holder of each shared hash, and back."""
    pages = doc_pages(t)
    star = overlap.exact_overlap(pages).filter("archive != first_archive")
    recorded = (
        star.selectExpr("series", "archive", "first_archive AS other", "sha256")
        .unionByName(star.selectExpr("series", "first_archive AS archive", "archive AS other", "sha256"))
        .filter("NOT (archive = 'src2' AND other LIKE '%1')")
        .withColumn("sha256", F.expr("CASE WHEN length(other) = 5 AND archive = 'src1' THEN 'forged' ELSE sha256 END"))
    )
    return overlap.audit_exact(recorded, pages, pages.select("series", "archive"))


# A document is a page: its grey grid counts eight letters in nine parts of the
# text, so copies have equal hashes and near copies near ones; the colour grid
# has one colour, made of the language and the source.  The package is the
# source, the series the language; three page widths differ in aspect.
PARTS = ", ".join(f"substr(text, CAST(1 + {i} * floor(length(text) / 9) AS INT), CAST(floor(length(text) / 9) AS INT)) AS part{i}" for i in range(9))
CELLS = [f"length(part{c}) - length(replace(part{c}, '{letter}', ''))" for letter in "etanoisr" for c in range(9)]
PAGE_WIDTH = "CAST(1000 + (floor(n_chars / 40) % 3) * 8 AS INT)"
DISTANCE = 4
_CODE = "CAST(substr(source, 4) AS INT)"
GRID_SQL = f"SELECT doc_id, lang, source, n_chars, text, {PARTS} FROM documents"
HASH_SQL = f"""SELECT doc_id, lang, source, sha256(text) AS sha256, {PAGE_WIDTH} AS width,
  array_to_string(list_transform(range(64), lambda i: CASE WHEN cells[i // 8 * 9 + i % 8 + 1] > cells[i // 8 * 9 + i % 8 + 2] THEN '1' ELSE '0' END), '') ||
  lpad(bin((ascii(lang) << 16) | (ascii(substr(lang, 2)) << 8) | {_CODE}), 24, '0') AS bits
FROM (SELECT *, [{', '.join(CELLS)}] AS cells FROM g)"""
NEAR_SQL = f"""
SELECT x.*, y.lang AS lang2, y.bits AS bits2, y.width AS width2, y.source AS source2, y.doc_id AS doc2, y.sha256 AS sha2, CAST(hamming(x.bits, y.bits) AS INTEGER) AS distance
FROM v x JOIN v y ON x.lang = y.lang WHERE hamming(x.bits, y.bits) <= {DISTANCE} AND abs(x.width - y.width) * 100 <= greatest(x.width, y.width)"""
NEAR_CTES = {"g": GRID_SQL, "v": HASH_SQL, "n": NEAR_SQL}
PAIRS_SQL = """
SELECT lang AS series, source AS archive, doc_id AS page, sha256, source2 AS other, doc2 AS other_page, sha2 AS other_sha256, distance FROM n WHERE source <> source2"""


def grid_pages(t):
    """Pages of the documents with their 88-bit hashes, stored, as several steps of a query read them."""
    return stored(_hashed_pages(t), "grid")


def _hashed_pages(t):
    # The cells are computed once, not for every bit that reads them.
    grid = spread.computed(t.sql(GRID_SQL).withColumn("gray", F.array(*map(F.expr, CELLS))), "gray")
    color = F.struct(F.ascii("lang").alias("r"), F.ascii(F.substring("lang", 2, 1)).alias("g"), F.expr(_CODE).alias("b"))
    hi, tint = hashes.dhash88(F.col("gray"), F.array_repeat(color, 64))
    return grid.select(
        F.col("lang").alias("series"), F.col("source").alias("archive"), F.col("doc_id").alias("page"), F.sha2("text", 256).alias("sha256"),
        hi.alias("hi"), tint.alias("color"), F.expr(PAGE_WIDTH).alias("width"), F.lit(1500).alias("height"),
    )


def _bits(hi, color):
    return F.concat(F.lpad(F.bin(hi), 64, "0"), F.lpad(F.bin(color.cast("bigint")), 24, "0"))


@query("difference_hash", with_(g=GRID_SQL, v=HASH_SQL) + """
SELECT doc_id, bits, array_to_string(list_transform(range(22), lambda i: substr('0123456789abcdef', 1 + 8 * CAST(substr(bits, i * 4 + 1, 1) AS INT)
  + 4 * CAST(substr(bits, i * 4 + 2, 1) AS INT) + 2 * CAST(substr(bits, i * 4 + 3, 1) AS INT) + CAST(substr(bits, i * 4 + 4, 1) AS INT), 1)), '') AS hex FROM v""")
def difference_hash(t):
    pages = _hashed_pages(t)
    return pages.select(F.col("page").alias("doc_id"), _bits(F.col("hi"), F.col("color")).alias("bits"), hashes.dhash_hex(F.col("hi"), F.col("color")).alias("hex"))


@query("near_pairs", with_(
    **NEAR_CTES, k="SELECT lang, bits, width, count(*) AS pages FROM v GROUP BY ALL",
    d="SELECT DISTINCT lang, bits, width, bits2, width2, distance FROM n WHERE (bits, width) < (bits2, width2)",
) + """
SELECT d.lang AS series, d.bits AS a_bits, bits2 AS b_bits, d.width AS a_width, width2 AS b_width, CAST(distance AS BIGINT) AS distance, x.pages AS a_pages, y.pages AS b_pages FROM d
JOIN k x ON x.lang = d.lang AND x.bits = d.bits AND x.width = d.width JOIN k y ON y.lang = d.lang AND y.bits = bits2 AND y.width = width2
UNION ALL SELECT lang, bits, bits, width, width, 0, pages, pages FROM k WHERE pages > 1""")
def near_pairs(t):
    pairs = overlap.near_pairs(grid_pages(t), ["series"], DISTANCE)
    # The order of two nodes follows the signed hash; name them by their bits as the SQL does.
    a = F.struct(_bits(F.col("a.hi"), F.col("a.color")).alias("bits"), F.col("a.width").alias("width"), F.col("a_pages").alias("pages"))
    b = F.struct(_bits(F.col("b.hi"), F.col("b.color")).alias("bits"), F.col("b.width").alias("width"), F.col("b_pages").alias("pages"))
    low, high = F.least(a, b), F.greatest(a, b)
    return pairs.select("series", low.alias("x"), high.alias("y"), F.col("distance").cast("bigint").alias("distance")).select(
        "series", F.col("x.bits").alias("a_bits"), F.col("y.bits").alias("b_bits"), F.col("x.width").alias("a_width"), F.col("y.width").alias("b_width"),
        "distance", F.col("x.pages").alias("a_pages"), F.col("y.pages").alias("b_pages"),
    )


def candidates(pages):
    return overlap.near_candidates(pages, pages.select("series", "archive"), DISTANCE)


@query("near_candidates", with_(**NEAR_CTES) + PAIRS_SQL)
def near_candidates(t):
    return candidates(grid_pages(t))


@query("audit_near", with_(
    **NEAR_CTES, p=PAIRS_SQL,
    e="SELECT series, archive, count(*) AS expected, count(*) FILTER (page % 3 <> 0 OR page % 2 = 0) AS kept, count(*) FILTER (page % 3 <> 0 AND page % 7 = 0) AS forged FROM p GROUP BY ALL",
) + """
SELECT series, archive, coalesce(expected, 0) AS expected, coalesce(kept - forged, 0) AS confirmed, coalesce(forged, 0) AS wrong,
  coalesce(expected, 0) = coalesce(kept - forged, 0) AND coalesce(forged, 0) = 0 AS ok
FROM (SELECT DISTINCT lang AS series, source AS archive FROM v) l LEFT JOIN e USING (series, archive)""")
def audit_near(t):
    """The recorded candidates lack some pairs (planted) and state a wrong distance for others."""
    pages = grid_pages(t)
    recorded = candidates(pages).filter("page % 3 <> 0 OR page % 2 = 0").withColumn(
        "distance", F.expr("distance + CASE WHEN page % 3 <> 0 AND page % 7 = 0 THEN 1 ELSE 0 END")
    )
    return overlap.audit_near(recorded, pages, pages.select("series", "archive"), DISTANCE)


DECISIONS_SQL = """
SELECT archive, page, sha256, other, other_page, other_sha256, distance, page % 5 AS k FROM p WHERE page % 4 <> 0
UNION ALL SELECT archive, page, sha256, other, other_page, other_sha256, distance, 9 FROM p WHERE page % 9 = 0
UNION ALL SELECT archive, page, sha256, other, other_page, 'other', distance, 9 FROM p WHERE page % 11 = 0"""


def _decided(found):
    """The planted decisions of candidates, up to three for each, from one pass over them; ``k`` plants the faults."""
    decision = lambda condition, k, sha: f"CASE WHEN {condition} THEN struct(CAST({k} AS INT) AS k, {sha} AS sha) END"
    decisions = ", ".join([
        decision("fallback_page % 4 <> 0", "fallback_page % 5", "compared_page_sha256"), decision("fallback_page % 9 = 0", 9, "compared_page_sha256"),
        decision("fallback_page % 11 = 0", 9, "'other'"),
    ])
    rows = found.withColumn("_d", F.expr(f"explode(array({decisions}))")).filter("_d IS NOT NULL")
    return rows.withColumns({"k": F.col("_d.k"), "compared_page_sha256": F.col("_d.sha")}).drop("_d")


@query("decision_issues", with_(
    **NEAR_CTES, p=PAIRS_SQL, d=DECISIONS_SQL,
    c="""SELECT archive, page, sha256, other, other_page, other_sha256, distance, count(*) FILTER (src = 'c') AS c, count(*) FILTER (src = 'd') AS d
         FROM (SELECT archive, page, sha256, other, other_page, other_sha256, distance, 'c' AS src FROM p
               UNION ALL SELECT archive, page, sha256, other, other_page, other_sha256, distance, 'd' FROM d) GROUP BY ALL""",
    i="""SELECT *, 'candidate.decided' AS message FROM (SELECT * EXCLUDE (c, d) FROM c WHERE c > 0 AND d = 0)
      UNION ALL SELECT *, 'candidate.decided-once' FROM (SELECT * EXCLUDE (c, d) FROM c WHERE c > 0 AND d > 1)
      UNION ALL SELECT *, 'visual.candidate' FROM (SELECT * EXCLUDE (c, d) FROM c WHERE c = 0)
      UNION ALL SELECT *, 'visual.duplicate-boolean' FROM (SELECT * EXCLUDE (k) FROM d WHERE k = 1)
      UNION ALL SELECT *, 'visual.reviewer' FROM (SELECT * EXCLUDE (k) FROM d WHERE k = 2)
      UNION ALL SELECT *, 'visual.reason' FROM (SELECT * EXCLUDE (k) FROM d WHERE k = 3)""",
) + """
SELECT DISTINCT 'invalid_volume_fallback' AS code, concat_ws('|', CAST(archive AS VARCHAR), CAST(page AS VARCHAR), sha256, CAST(other AS VARCHAR), CAST(other_page AS VARCHAR), other_sha256, CAST(distance AS VARCHAR)) AS subject, message FROM i""")
def decision_issues(t):
    found = candidates(grid_pages(t)).toDF("series", "archive", *_reordered())
    rows = _decided(found).selectExpr(
        "archive", *overlap.CANDIDATE_KEY, "CASE WHEN k <> 1 THEN k % 2 = 0 END AS duplicate",
        "CASE WHEN k = 2 THEN ' ' ELSE 'reviewer' END AS reviewer", "CASE WHEN k <> 3 THEN 'seen' END AS reason",
    )
    return overlap.decision_issues(found, rows)


CLASS_CTES = dict(
    **NEAR_CTES, p=PAIRS_SQL, d=DECISIONS_SQL,
    q="""SELECT lang AS series, source AS archive, bits AS a_bits, width AS a_width, bits2 AS b_bits, width2 AS b_width, distance, doc_id AS page, sha256, source2 AS other, doc2 AS other_page, sha2 AS other_sha256
         FROM n WHERE source <> source2""",
    u="SELECT DISTINCT archive, page, sha256, other, other_page, other_sha256, distance, TRUE AS there FROM d",
)


def _coverage(t):
    pages = grid_pages(t)
    decisions = _decided(candidates(pages).toDF("series", "archive", *_reordered()))
    return overlap.decision_coverage(pages, pages.select("series", "archive"), decisions, DISTANCE)


@query("decided_classes", with_(**CLASS_CTES) + """
SELECT series, archive, a_bits, a_width, b_bits, b_width, distance, count(*) AS candidates, count(there) AS decided
FROM q LEFT JOIN u USING (archive, page, sha256, other, other_page, other_sha256, distance) GROUP BY ALL""")
def decided_classes(t):
    bits = lambda side: _bits(F.col(f"{side}.hi"), F.col(f"{side}.color"))
    return _coverage(t)[0].select(
        "series", "archive", bits("node").alias("a_bits"), F.col("node.width").alias("a_width"), bits("other").alias("b_bits"),
        F.col("other.width").alias("b_width"), "distance", "candidates", "decided",
    )


@query("decision_strays", with_(**CLASS_CTES) + """
SELECT 'invalid_volume_fallback' AS code, concat_ws('|', CAST(archive AS VARCHAR), CAST(page AS VARCHAR), sha256, CAST(other AS VARCHAR), CAST(other_page AS VARCHAR), other_sha256, CAST(distance AS VARCHAR)) AS subject,
  CASE WHEN other_sha256 = 'other' THEN 'visual.candidate' ELSE 'candidate.decided-once' END AS message
FROM d GROUP BY archive, page, sha256, other, other_page, other_sha256, distance HAVING other_sha256 = 'other' OR count(*) > 1""")
def decision_strays(t):
    return _coverage(t)[1]


IDENTITIES = """
SELECT lang AS series, source AS archive, 'volume ' || source AS identity, {h}source || lang{e} AS sha256 FROM documents GROUP BY lang, source"""
COMPARED = """
SELECT a.series, a.archive, b.identity, CASE WHEN length(a.archive) = 5 AND length(b.archive) = 4 THEN upper(b.sha256) WHEN a.archive = b.archive THEN 'self' ELSE b.sha256 END AS sha256
FROM {t} a JOIN {t} b ON a.series = b.series WHERE a.archive <> b.archive AND NOT (a.archive = 'src2' AND b.archive LIKE '%1') OR a.archive = b.archive AND a.archive LIKE '%7'"""


@query("audit_identities", with_(a=IDENTITIES.replace("{h}", "sha256(").replace("{e}", ")"), r=COMPARED.replace("{t}", "a")) + """
SELECT a.series, a.archive, count(*) - 1 AS expected, any_value(r.confirmed) AS confirmed, any_value(r.wrong) AS wrong, count(*) - 1 = any_value(r.confirmed) AND any_value(r.wrong) = 0 AS ok
FROM a JOIN a b ON a.series = b.series JOIN (SELECT x.series, x.archive, count(r.series) FILTER (r.sha256 <> 'self') AS confirmed, count(r.series) FILTER (r.sha256 = 'self') AS wrong
  FROM a x LEFT JOIN r ON r.series = x.series AND r.archive = x.archive GROUP BY ALL) r ON r.series = a.series AND r.archive = a.archive GROUP BY a.series, a.archive""")
def audit_identities(t):
    packages = t.sql(IDENTITIES.replace("{h}", "sha2(").replace("{e}", ", 256)"))
    packages.createOrReplaceTempView("given_identities")
    recorded = t.spark.sql(COMPARED.replace("{t}", "given_identities"))
    return overlap.audit_identities(recorded, packages, packages.select("series", "archive"))


def _reordered():
    return ["fallback_page", "fallback_page_sha256", "compared_path", "compared_page", "compared_page_sha256", "hamming_distance"]


STATE_SQL = """
SELECT doc_id AS page, CASE WHEN d.doc_id IS NULL THEN 'unresolved' WHEN d.doc_id % 7 = 0 OR (d.doc_id % 11 = 0) THEN 'stale'
  WHEN quality = 0 THEN 'duplicate' ELSE 'unique' END AS state FROM documents LEFT JOIN labels d USING (doc_id)"""


@query("stale_decisions", STATE_SQL)
def stale_decisions(t):
    candidates_ = t.documents.selectExpr(
        "doc_id AS page", "'0:' || doc_id AS review_key", "sha2(source, 256) AS source_archive_sha256",
        "sha2(text, 256) AS source_page_sha256", "sha2(lang, 256) AS duplicate_target_sha256",
    )
    decisions = t.labels.join(t.documents, "doc_id").selectExpr(
        "'0:' || doc_id AS review_key", "quality = 0 AS duplicate",
        "upper(sha2(source, 256)) AS source_archive_sha256",
        "CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha2(text, 256) END AS source_page_sha256",
        "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE sha2(lang, 256) END AS duplicate_target_sha256",
    )
    return overlap.stale_decisions(candidates_, decisions).select("page", "state")


def merge_input(t):
    """Documents as pages of a merge for each language; near pairs have a decision that names one page as the copy."""
    pages = grid_pages(t).selectExpr(
        "series AS output", f"{_CODE.replace('source', 'archive')} AS source_index", "page", "'a' || archive AS archive_sha256", "sha256", *overlap.NODE,
    )
    pos = dedupe.position()
    near = stored(overlap.neighbours(pages, ["output"], DISTANCE), "near")
    a = pages.withColumn("node", F.struct(*overlap.NODE)).withColumn("pos", pos)
    b = a.groupBy("output", F.col("node").alias("other")).agg(F.min(F.struct("pos", "sha256")).alias("first"))
    b = b.select("output", "other", F.col("first.pos").alias("other_pos"), F.col("first.sha256").alias("target"))
    pairs = a.join(near, ["output", "node"]).join(b, ["output", "other"]).filter("other_pos < pos AND target != sha256")
    decisions = pairs.groupBy("output", "source_index", "page", "archive_sha256", "sha256").agg(
        F.min_by("target", F.struct("distance", "other_pos")).alias("target")
    ).filter("page % 5 <> 0").selectExpr(
        "output", "source_index", "page", "page % 2 = 0 AS duplicate", "archive_sha256 AS source_archive_sha256",
        "CASE WHEN page % 7 = 0 THEN 'old' ELSE sha256 END AS source_page_sha256", "target AS duplicate_target_sha256",
    )
    return pages, decisions, near


def _merged(t):
    pages, decisions, near = merge_input(t)
    return dedupe.merge_pages(pages, decisions, ["output"], DISTANCE, near=near)


@query("merge_pages")
def merge_pages(t):
    return _merged(t)


@query("merge_report")
def merge_report(t):
    return dedupe.merge_report(_merged(t), ["output"])


# Provenance: each source's pages are merged into one output; some rows are forged.
MAP_SQL = """
SELECT 'out ' || source AS output, CAST(rn - 1 AS INT) AS "row", CASE WHEN doc_id % 41 = 0 THEN rn + 1 ELSE rn END AS output_page,
  CASE WHEN doc_id % 43 = 0 THEN 'srcX' ELSE source END AS source,
  CASE WHEN doc_id % 47 = 0 THEN 1 WHEN doc_id % 53 = 0 THEN 100000 ELSE rn END AS source_page,
  sha256(CASE WHEN doc_id % 37 = 0 THEN 'x' ELSE source END) AS source_archive_sha256,
  CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN sha256('z') ELSE upper(sha256(text)) END AS source_page_sha256,
  CASE WHEN doc_id % 59 = 0 THEN 'short' WHEN doc_id % 29 = 0 THEN sha256('y') ELSE sha256(text) END AS output_sha256
FROM numbered WHERE doc_id % 101 <> 0"""
NUMBERED_SQL = "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents"


@query("bind_page_map", with_(
    numbered=NUMBERED_SQL, map=MAP_SQL,
    pages="SELECT source AS archive, rn AS page, sha256(text) AS sha256 FROM numbered UNION ALL SELECT 'out ' || source, rn, sha256(text) FROM numbered",
    j="""SELECT m.*, s.sha256 AS ssha, o.sha256 AS osha, coalesce(m.source = substr(m.output, 5) AND m.source_archive_sha256 = sha256(m.source), false) AS bound,
           min("row") OVER (PARTITION BY m.output, m.source, m.source_page) AS first_row
         FROM map m LEFT JOIN pages s ON s.archive = m.source AND s.page = m.source_page
         LEFT JOIN pages o ON o.archive = m.output AND o.page = m."row" + 1""",
    i="""SELECT output, output_page, 'map.bound' AS message FROM j WHERE NOT bound
      UNION ALL SELECT output, output_page, 'map.source-page' FROM j WHERE bound AND ssha IS NULL
      UNION ALL SELECT output, output_page, 'map.source-page-once' FROM j WHERE bound AND ssha IS NOT NULL AND "row" > first_row
      UNION ALL SELECT output, output_page, 'map.source-hash' FROM j WHERE bound AND lower(source_page_sha256) <> ssha
      UNION ALL SELECT output, output_page, 'map.bytes-equal' FROM j WHERE bound AND output_sha256 <> 'short' AND output_sha256 <> ssha
      UNION ALL SELECT output, output_page, 'map.output-hash-valid' FROM j WHERE output_sha256 = 'short'
      UNION ALL SELECT output, output_page, 'map.continuous' FROM j WHERE output_page <> "row" + 1
      UNION ALL SELECT output, output_page, 'map.output-hash' FROM j WHERE output_sha256 IS DISTINCT FROM osha
      UNION ALL SELECT output, NULL, 'map.length' FROM (
        SELECT 'out ' || source AS output FROM documents GROUP BY source HAVING count(*) FILTER (doc_id % 101 <> 0) <> count(*))""",
) + "SELECT DISTINCT output, CAST(output_page AS BIGINT) AS output_page, message FROM i")
def bind_page_map(t):
    numbered = ordered.number_rows(t.documents.select("doc_id", "source", "text"), ["source"], "doc_id", "rn")
    text = MAP_SQL.split("SELECT ", 1)[1].split("FROM numbered")[0].replace('"row"', "`row`")
    text = text.replace("sha256(text)", "sha2(text, 256)").replace("sha256('z')", "sha2('z', 256)").replace("sha256('y')", "sha2('y', 256)")
    text = text.replace("sha256(CASE WHEN doc_id % 37 = 0 THEN 'x' ELSE source END)", "sha2(CASE WHEN doc_id % 37 = 0 THEN 'x' ELSE source END, 256)")
    numbered.createOrReplaceTempView("given_numbered")
    page_map = t.spark.sql(f"SELECT {text} FROM given_numbered WHERE doc_id % 101 <> 0")
    held = numbered.selectExpr("source AS archive", "rn AS page", "sha2(text, 256) AS sha256")
    pages = held.unionByName(held.withColumn("archive", F.concat(F.lit("out "), "archive")))
    components = t.documents.select("source").distinct().selectExpr(
        "'out ' || source AS output", "source", "upper(sha2(source, 256)) AS sha256"
    )
    return provenance.bind_page_map(page_map, components, pages)


OMIT_SQL = """
SELECT 'out' AS output, CAST(doc_id AS INT) AS "index", CASE WHEN doc_id % 61 = 0 THEN NULL WHEN doc_id % 67 = 0 THEN 'srcX' ELSE source END AS source,
  CASE WHEN doc_id % 71 = 0 THEN doc_id + 1000000 ELSE doc_id END AS source_page,
  CASE WHEN doc_id % 31 = 0 THEN {h}'z'{e} ELSE {h}text{e} END AS source_page_sha256,
  CASE WHEN doc_id % 73 = 0 THEN doc_id + 1000000 ELSE doc_id END AS target_page,
  CASE WHEN doc_id % 37 = 0 THEN {h}'z'{e} ELSE {h}text{e} END AS target_sha256,
  CASE WHEN doc_id % 19 = 0 THEN '00' ELSE lower(lpad(to_hex_(doc_id), 16, '0')) || '000007' END AS target_hash,
  CASE WHEN doc_id % 41 = 0 THEN 'guess' WHEN doc_id % 2 = 0 THEN 'byte-sha256' ELSE 'dhash-88-color' END AS method,
  CASE WHEN doc_id % 14 = 0 THEN 'q' ELSE {h}text{e} END AS evidence_sha256, CASE WHEN doc_id % 17 = 0 THEN 3 ELSE 2 END AS evidence_distance,
  CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id % 29 <> 0 END AS review_duplicate, {h}text{e} AS review_source_sha256,
  CASE WHEN doc_id % 13 = 0 THEN {h}'t'{e} ELSE {h}text{e} END AS review_target_sha256,
  CASE WHEN doc_id % 43 = 0 THEN ' ' ELSE 'me' END AS reviewer, 'seen' AS reason, doc_id % 11 <> 0 AS review_copy_preserved,
  CASE WHEN doc_id % 47 = 0 THEN NULL ELSE 'copy/' || source END AS review_copy,
  CASE WHEN doc_id % 9 = 0 THEN 'stale' ELSE {h}source{e} END AS review_copy_sha256
FROM documents"""


@query("audit_omitted", with_(
    r=OMIT_SQL.format(h="sha256(", e=")").replace("to_hex_(doc_id)", "to_hex(doc_id)"),
    j="""SELECT r.*, r.source IS NOT NULL AS located, r.source IS NOT NULL AND r.source <> 'srcX' AS trusted, s.sha256 AS s, t.sha256 AS t
         FROM r LEFT JOIN (SELECT source, doc_id, sha256(text) AS sha256 FROM documents) s ON s.source = r.source AND s.doc_id = r.source_page
         LEFT JOIN (SELECT doc_id, sha256(text) AS sha256 FROM documents) t ON t.doc_id = r.target_page""",
    k="""SELECT *, trusted AND s IS NOT NULL AS found, trusted AND s IS NOT NULL AND t IS NOT NULL AS aimed,
           evidence_distance = 2 AND target_hash <> '00' AS measured, review_duplicate IS NOT NULL AS reviewed,
           coalesce(review_duplicate, false) AND review_source_sha256 = s AND review_target_sha256 = t AND trim(reviewer) <> '' AS positive,
           review_copy_preserved AND review_copy IS NOT NULL AS preserved FROM j""",
) + """
SELECT output, "index", 'omitted.located' AS message FROM k WHERE NOT located
UNION ALL SELECT output, "index", 'omitted.source-trusted' FROM k WHERE located AND NOT trusted
UNION ALL SELECT output, "index", 'omitted.source-page' FROM k WHERE trusted AND NOT found
UNION ALL SELECT output, "index", 'omitted.source-hash' FROM k WHERE found AND source_page_sha256 <> s
UNION ALL SELECT output, "index", 'omitted.target-page' FROM k WHERE found AND NOT aimed
UNION ALL SELECT output, "index", 'omitted.target-hash' FROM k WHERE aimed AND target_sha256 <> t
UNION ALL SELECT output, "index", 'omitted.exact-evidence' FROM k WHERE aimed AND method = 'byte-sha256' AND NOT (s = t AND evidence_sha256 = s)
UNION ALL SELECT output, "index", 'omitted.near-evidence' FROM k WHERE aimed AND method = 'dhash-88-color' AND NOT (measured AND reviewed)
UNION ALL SELECT output, "index", 'omitted.near-decision' FROM k WHERE aimed AND method = 'dhash-88-color' AND measured AND reviewed AND NOT positive
UNION ALL SELECT output, "index", 'omitted.method' FROM k WHERE aimed AND method = 'guess'
UNION ALL SELECT output, "index", 'omitted.copy' FROM k WHERE aimed AND NOT preserved
UNION ALL SELECT output, "index", 'omitted.copy-bound' FROM k WHERE aimed AND preserved AND review_copy_sha256 = 'stale'""")
def audit_omitted(t):
    rows = t.sql(
        OMIT_SQL.format(h="sha2(", e=", 256)").replace('"index"', "`index`").replace("to_hex_(doc_id)", "hex(doc_id)")
    )
    docs = t.documents
    sources = docs.select(F.lit("out").alias("output"), "source").distinct()
    source_pages = docs.selectExpr("source", "doc_id AS page", "sha2(text, 256) AS sha256", "doc_id AS hi", "4 AS color")
    output_pages = docs.selectExpr("'out' AS output", "doc_id AS page", "sha2(text, 256) AS sha256", "doc_id AS hi", "7 AS color")
    copies = docs.select("source").distinct().selectExpr(
        "'copy/' || source AS path", "sha2(source, 256) AS expected", "sha2(source, 256) AS actual"
    )
    return provenance.audit_omitted(rows, sources, source_pages, output_pages, copies)


@query("audit_records", with_(
    o="SELECT DISTINCT source AS output FROM documents",
    n="SELECT source AS output, count(*) AS n FROM documents WHERE lang = 'fr' AND doc_id % 9 = 0 GROUP BY 1",
    r="""SELECT source AS output, CASE min(doc_id) % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'resolved' ELSE 'open' END AS result, min(doc_id) % 4 <> 0 AS vis,
           CASE WHEN min(doc_id) % 5 = 0 THEN '' ELSE 'id' END AS rid, min(doc_id) % 6 <> 0 AS ok, CASE WHEN min(doc_id) % 2 = 0 THEN 'preserved' ELSE 'not-applicable' END AS st
         FROM documents GROUP BY 1 HAVING min(doc_id) % 8 <> 7""",
    j="SELECT r.*, n FROM r LEFT JOIN n USING (output)",
) + """
SELECT output, 'special_deduplication_incomplete' AS code, 'omitted.state-complete' AS message FROM j WHERE result = 'open'
UNION ALL SELECT output, 'special_deduplication_incomplete', 'omitted.review-complete' FROM j WHERE NOT vis
UNION ALL SELECT output, 'special_deduplication_incomplete', 'omitted.record-id' FROM j WHERE rid = ''
UNION ALL SELECT output, 'special_deduplication_incomplete', 'omitted.sources-equal' FROM j WHERE NOT ok
UNION ALL SELECT output, 'special_deduplication_incomplete', 'omitted.copy-stated' FROM j WHERE st <> CASE WHEN n > 0 THEN 'preserved' ELSE 'not-applicable' END
UNION ALL SELECT output, 'special_deduplication_missing', 'omitted.state-present' FROM o WHERE output NOT IN (SELECT output FROM r)""")
def audit_records(t):
    docs = t.documents
    first = docs.groupBy(F.col("source").alias("output")).agg(F.min("doc_id").alias("m")).filter("m % 8 <> 7")
    records = first.selectExpr(
        "output", "CASE m % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'resolved' ELSE 'open' END AS result",
        "m % 4 <> 0 AS visual_review_complete", "CASE WHEN m % 5 = 0 THEN '' ELSE 'id' END AS audit_record_id",
        "m % 6 <> 0 AS sources_ok", "CASE WHEN m % 2 = 0 THEN 'preserved' ELSE 'not-applicable' END AS review_copy_status",
    )
    omitted = docs.filter("lang = 'fr' AND doc_id % 9 = 0").select(F.col("source").alias("output"))
    return provenance.audit_records(docs.select(F.col("source").alias("output")), records, omitted)


@query("member_integrity", with_(
    b="""SELECT source AS archive, CAST(doc_id AS INT) AS i, CASE WHEN doc_id % 10 = 0 THEN 'ComicInfo.xml' ELSE 'p' || CAST(doc_id AS VARCHAR) END AS name, sha256(text) AS s FROM documents""",
    a="""SELECT source AS archive, CAST(doc_id AS INT) AS i, CASE WHEN doc_id % 10 = 0 THEN 'ComicInfo.xml' WHEN doc_id % 77 = 0 THEN 'q' ELSE 'p' || CAST(doc_id AS VARCHAR) END AS name,
           CASE WHEN doc_id % 15 = 0 THEN sha256('e') ELSE sha256(text) END AS s FROM documents WHERE doc_id % 83 <> 0""",
) + """
SELECT b.archive, b.i AS member_index, b.name AS member_name, b.name = 'ComicInfo.xml' AS is_metadata, b.s AS before_sha256, a.s AS after_sha256,
  a.s IS NOT DISTINCT FROM b.s AS content_unchanged, a.name IS NOT DISTINCT FROM b.name AS member_order_unchanged,
  CASE WHEN a.name IS DISTINCT FROM b.name OR (b.name <> 'ComicInfo.xml' AND a.s IS DISTINCT FROM b.s) THEN 'ARC010' END AS code
FROM b LEFT JOIN a USING (archive, i)""")
def member_integrity(t):
    docs = t.documents
    before = docs.selectExpr(
        "source AS archive", "CAST(doc_id AS INT) AS member_index",
        "CASE WHEN doc_id % 10 = 0 THEN 'ComicInfo.xml' ELSE 'p' || doc_id END AS name", "sha2(text, 256) AS sha256",
    )
    after = docs.filter("doc_id % 83 <> 0").selectExpr(
        "source AS archive", "CAST(doc_id AS INT) AS member_index",
        "CASE WHEN doc_id % 10 = 0 THEN 'ComicInfo.xml' WHEN doc_id % 77 = 0 THEN 'q' ELSE 'p' || doc_id END AS name",
        "CASE WHEN doc_id % 15 = 0 THEN sha2('e', 256) ELSE sha2(text, 256) END AS sha256",
    )
    return provenance.member_integrity(before, after)
