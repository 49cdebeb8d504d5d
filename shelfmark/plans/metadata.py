"""Queries of metadata policy: patches, precedence, tags, languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import metadata
from .registry import query, with_

# A customer is one archive's metadata.
BOOKS = """
SELECT c_custkey AS item, c_name AS Title, c_mktsegment AS Series, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS LocalizedSeries,
  CAST(c_nationkey AS STRING) AS Number, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 9 AS STRING) END AS Volume, 'Digital' AS Format,
  CASE WHEN c_custkey % 5 = 0 THEN 'Source volume: ' || CAST(c_custkey % 9 AS STRING) WHEN c_custkey % 7 = 0 THEN ' old ' END AS Notes,
  c_mktsegment || '/' || c_name AS path FROM customer"""
FIELDS = ["Title", "Series", "LocalizedSeries", "Number", "Volume", "Format"]
AFTER = """
SELECT *, CASE WHEN item % 4 = 0 THEN 'New ' || Title ELSE Title END AS new_Title, Series AS new_Series,
  CASE WHEN item % 6 = 0 THEN NULL ELSE LocalizedSeries END AS new_LocalizedSeries, CASE WHEN item % 8 = 0 THEN '1' ELSE Number END AS new_Number,
  CASE WHEN item % 3 = 1 THEN NULL ELSE Volume END AS new_Volume, Format AS new_Format FROM b"""
CHANGED = "concat_ws(',', " + ", ".join(f"CASE WHEN {f} IS DISTINCT FROM new_{f} THEN '{f}' END" for f in FIELDS) + ")"


def books(t):
    return t.sql(BOOKS)


def patched(t):
    """Books with a three-valued patch, applied."""
    pairs = [
        F.when(F.expr("item % 4 = 0"), F.struct(F.lit("title").alias("key"), F.concat(F.lit("New "), "Title").alias("value"))),
        F.when(F.expr("item % 6 = 0"), F.struct(F.lit("LocalizedSeries").alias("key"), F.lit(None).cast("string").alias("value"))),
        F.when(F.expr("item % 8 = 0"), F.struct(F.lit("NUMBER").alias("key"), F.lit("1").alias("value"))),
        F.when(F.expr("item % 3 = 1"), F.struct(F.lit("Volume").alias("key"), F.lit(None).cast("string").alias("value"))),
    ]
    rows = books(t).withColumn("patch", F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull())))
    return metadata.apply_patch(rows, "patch")


@query("apply_patch", with_(b=BOOKS, a=AFTER) + f"""
SELECT item, new_Title, new_LocalizedSeries, new_Number, new_Volume, {CHANGED} AS changed, {CHANGED} = '' AS no_change FROM a""")
def apply_patch(t):
    return patched(t).select(
        "item", "new_Title", "new_LocalizedSeries", "new_Number", "new_Volume",
        F.concat_ws(",", "changed_fields").alias("changed"), "no_change",
    )


@query("provenance_note", with_(b=BOOKS, a=AFTER) + """
SELECT item, CASE WHEN Volume IS NOT NULL AND new_Volume IS NULL AND NOT contains(coalesce(Notes, ''), 'Source volume: ' || Volume)
  THEN CASE WHEN trim(coalesce(Notes, '')) = '' THEN '' ELSE trim(Notes) || chr(10) END || 'Source volume: ' || Volume ELSE Notes END AS notes FROM a""")
def provenance_note(t):
    return patched(t).select("item", F.col("new_Notes").alias("notes"))


@query("changed_fields", with_(b=BOOKS, a=AFTER) + f"""
SELECT field, count(*) AS items FROM (SELECT unnest(string_split({CHANGED}, ',')) AS field FROM a) WHERE field <> '' GROUP BY field""")
def changed_fields(t):
    return patched(t).select(F.explode("changed_fields").alias("field")).groupBy("field").agg(F.count("*").alias("items"))


@query("patch_issues", """
SELECT c_custkey AS item, code FROM customer, (VALUES ('PATCH_FIELD_NOT_ALLOWED', 5), ('PATCH_INVALID', 7), ('PATCH_VALUE_INVALID', 11), ('PATCH_EMPTY', 13)) r(code, m)
WHERE c_custkey % m = 0 AND (m = 13 OR c_custkey % 13 <> 0)""")
def patch_issues(t):
    def entry(condition, key, value):
        return F.when(F.expr(condition), F.struct(F.lit(key).alias("key"), F.lit(value).cast("string").alias("value")))

    pairs = [
        entry("true", "Title", "t"), entry("item % 5 = 0", "Pages", "1"), entry("item % 7 = 0", "TITLE", "u"),
        entry("item % 11 = 0", "Number", " "), entry("true", "Volume", None),
    ]
    full = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull()))
    empty = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    rows = books(t).withColumn("patch", F.when(F.expr("item % 13 = 0"), empty).otherwise(full))
    return metadata.patch_issues(rows, "patch", "item")


@query("update_mode", with_(b=BOOKS, a=AFTER) + f"""
SELECT item, 'metadata-refresh' AS mode, field FROM (SELECT item, unnest(string_split({CHANGED}, ',')) AS field FROM a) WHERE field NOT IN ('', 'Title')
UNION ALL SELECT item, 'metadata-refresh', 'path' FROM a WHERE item % 10 = 0
UNION ALL SELECT item, 'identity-normalization', 'Count' FROM a WHERE item % 14 = 0""")
def update_mode(t):
    rows = patched(t).withColumns({
        "new_path": F.expr("CASE WHEN item % 10 = 0 THEN 'x' || path ELSE path END"), "Count": F.lit("3"),
        "new_Count": F.expr("CASE WHEN item % 14 = 0 THEN '4' ELSE '3' END"),
    })
    refresh = metadata.update_mode_issues(rows, "item", "metadata-refresh")
    normal = metadata.update_mode_issues(rows, "item", "identity-normalization")
    return refresh.withColumn("mode", F.lit("metadata-refresh")).unionByName(
        normal.withColumn("mode", F.lit("identity-normalization"))
    )


VALUES = """
SELECT c_custkey AS item, 'Series' AS field, 'existing' AS source, c_mktsegment AS value FROM customer
UNION ALL SELECT c_custkey, 'Series', 'locked', 'Locked ' || c_mktsegment FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, 'Series', 'locked', c_mktsegment FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, 'Number', 'inferred', CAST(c_custkey AS STRING) FROM customer
UNION ALL SELECT c_custkey, 'Number', 'volume', CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_nationkey AS STRING) END FROM customer
UNION ALL SELECT c_custkey, 'Number', 'embedded', 'E' FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT c_custkey, 'Number', 'rumour', 'R' FROM customer"""


@query("resolve_fields", with_(v=VALUES, r="""SELECT *, list_position(['locked', 'existing', 'volume', 'series', 'embedded', 'inferred'], source) AS rank FROM v WHERE value <> ''""") + """
SELECT item, field, arg_min(value, (rank, value)) AS value, arg_min(source, (rank, value)) AS source,
  CASE WHEN bool_or(source <> 'locked' AND value <> lock_) THEN 'META004' END AS code
FROM (SELECT *, min(value) FILTER (source = 'locked') OVER (PARTITION BY item, field) AS lock_ FROM r WHERE rank IS NOT NULL) GROUP BY item, field""")
def resolve_fields(t):
    return metadata.resolve_fields(t.sql(VALUES))


TAGS = """
SELECT p_partkey AS item, CASE p_partkey % 6 WHEN 0 THEN 'cosplay' WHEN 1 THEN 'Cosplay' WHEN 2 THEN '4koma' WHEN 3 THEN '汉化' WHEN 4 THEN '冒险' ELSE '校园' END
  || CASE WHEN p_partkey % 2 = 0 THEN ', ' ELSE '，' END || lower(p_type) || ',' || p_name || ' ,, full colour、' || CASE WHEN p_partkey % 5 = 0 THEN 'one-shot' ELSE 'yuri' END AS tags
FROM part"""
TAG_ROWS = """
SELECT item, tag, CASE WHEN tag = '校园' AND item % 10 <> 99 THEN 'allowlisted' WHEN tag = '汉化' THEN 'release' WHEN tag IN ('Cosplay', '4koma', 'full colour', 'one-shot') THEN 'mapped'
    WHEN tag = '冒险' THEN 'omitted' ELSE 'kept' END AS decision, tag IN ('cosplay', '校园') AS protected,
  CASE tag WHEN '冒险' THEN NULL WHEN 'Cosplay' THEN 'cosplay' WHEN '4koma' THEN '4-koma' WHEN 'full colour' THEN 'full-color' WHEN 'one-shot' THEN 'oneshot' ELSE tag END AS canonical,
  CASE WHEN tag = '冒险' THEN 'META010' END AS code
FROM (SELECT item, trim(unnest(regexp_split_to_array(tags, '[,，、]'))) AS tag FROM t) WHERE tag <> ''"""


def tag_rows(t):
    allow = t.part.filter("p_partkey % 6 = 5").selectExpr("'校园' AS value", "'chosen' AS reason")
    return metadata.canonical_tags(t.sql(TAGS), "item", "tags", allow)


@query("canonical_tags", with_(t=TAGS) + TAG_ROWS)
def canonical_tags(t):
    return tag_rows(t).drop("pos")


@query("lost_tags", with_(t=TAGS, r=TAG_ROWS) + "SELECT DISTINCT item, tag, 'META011' AS code FROM r WHERE protected AND item % 12 < 6")
def lost_tags(t):
    final = tag_rows(t).filter("canonical IS NOT NULL AND item % 12 >= 6").selectExpr("item", "canonical AS tag")
    return metadata.lost_tags(tag_rows(t), final, "item")


LANG = """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '系列' WHEN 1 THEN 'シリーズ' ELSE lang END AS Series, CASE WHEN doc_id % 5 = 0 THEN '第1话' ELSE '第1话の' END AS Title,
  CASE doc_id % 4 WHEN 0 THEN '故事' WHEN 1 THEN 'これは故事' WHEN 2 THEN source END AS Summary, CASE WHEN doc_id % 7 = 0 THEN '12' END AS Count, doc_id % 14 = 0 AS evidence
FROM documents"""


@query("language_issues", with_(l=LANG) + """
SELECT doc_id, 'Series' AS field, 'META008' AS code FROM l WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'Title', 'META008' FROM l WHERE doc_id % 5 <> 0
UNION ALL SELECT doc_id, 'Summary', 'META012' FROM l WHERE doc_id % 4 IN (1, 2)
UNION ALL SELECT doc_id, 'Count', 'META008' FROM l WHERE doc_id % 7 = 0 AND doc_id % 14 <> 0""")
def language_issues(t):
    return metadata.language_issues(t.sql(LANG), "doc_id", count_evidence="evidence")


PUBLISHERS = """
SELECT s_suppkey AS item, CASE s_suppkey % 4 WHEN 0 THEN '某社 ' WHEN 1 THEN '' WHEN 2 THEN s_name ELSE '某社' END AS zh,
  CASE s_suppkey % 5 WHEN 0 THEN '某社' WHEN 1 THEN NULL WHEN 2 THEN upper(s_name) WHEN 3 THEN '原社' ELSE 'ゲンシャ' END AS original FROM supplier"""


@query("publisher", with_(p=PUBLISHERS, q="SELECT item, nullif(trim(zh), '') AS z, nullif(trim(original), '') AS o, original IN ('某社', '原社') AS chinese FROM p") + """
SELECT item, CASE WHEN z IS NULL OR o IS NULL THEN coalesce(z, o) WHEN lower(z) = lower(o) THEN z WHEN chinese THEN o ELSE z || '（' || o || '）' END AS publisher,
  CASE WHEN (z IS NULL AND NOT coalesce(chinese, false)) OR o IS NULL THEN 'META009' END AS code FROM q""")
def publisher(t):
    zh, original = F.col("zh"), F.col("original")
    return t.sql(PUBLISHERS).select(
        "item", text.publisher(zh, original).alias("publisher"), text.publisher_issue(zh, original).alias("code")
    )


@query("rating", """
SELECT c_custkey AS item, CASE WHEN c_custkey % 15 > 10 THEN NULL ELSE CAST((c_custkey % 15) * 5 AS DOUBLE) / 10 END AS rating FROM customer""")
def rating(t):
    value = text.rating5(F.expr("CAST(c_custkey % 15 AS STRING)"), F.lit(10))
    return t.customer.select(F.col("c_custkey").alias("item"), value.cast("double").alias("rating"))


@query("language_code", """
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'ja' WHEN 1 THEN 'en' WHEN 2 THEN 'zh-Hans' WHEN 3 THEN 'zh-Hant' END AS code,
  CASE WHEN n_nationkey % 5 = 0 THEN 'YesAndRightToLeft' END AS direction FROM nation""")
def language_code(t):
    name = F.expr("element_at(array(' Japanese', 'ENGLISH', 'Simplified Chinese', 'traditional chinese', 'Klingon'), CAST(n_nationkey % 5 AS INT) + 1)")
    return t.nation.select("n_nationkey", text.language_code(name).alias("code"), text.direction_code(name).alias("direction"))
