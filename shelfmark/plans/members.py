"""Queries of member and page checks, over web pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes, identity, paths
from ..operators import members
from .registry import query, with_

# A web page is one stored member; its host is the archive.
MEMBERS = r"""
SELECT split_part(replace(replace(url, 'https://', ''), 'http://', ''), '/', 1) AS archive, CAST(page_id AS INT) AS member_index,
  CASE WHEN page_id % 17 = 0 THEN '../' || CAST(page_id AS STRING) WHEN page_id % 19 = 0 THEN '/abs/' || CAST(page_id AS STRING)
       WHEN page_id % 23 = 0 THEN 'C:/x' || CAST(page_id AS STRING) WHEN page_id % 11 = 0 THEN 'ComicInfo.xml'
       WHEN page_id % 29 = 0 THEN 'sub/comicinfo.XML' WHEN page_id % 7 = 0 THEN 'sub/p' || CAST(page_id % 50 AS STRING) || '.PNG'
       WHEN page_id % 13 = 0 THEN 'P' || CAST(page_id % 5 AS STRING) || '.jpg'
       ELSE 'p' || CAST(page_id % 50 AS STRING) || CASE WHEN page_id % 2 = 0 THEN '.jpg' ELSE '.png' END END AS name,
  CAST(length(html) AS BIGINT) AS file_size,
  CASE WHEN page_id % 31 = 0 THEN CAST(0 AS BIGINT) WHEN page_id % 37 = 0 THEN CAST(2 AS BIGINT) ELSE CAST(length(html) AS BIGINT) END AS compress_size,
  CAST(page_id % 8 AS INT) AS flag_bits,
  CASE WHEN page_id % 41 = 0 THEN CAST(2717843456 AS BIGINT) ELSE CAST(2175008768 AS BIGINT) END AS external_attr,
  CAST(page_id % 4 AS INT) AS create_system, page_id % 43 = 0 AS is_dir, html
FROM pages"""


# What the row checks reject; such members are not counted anywhere.
REJECTED = r"""(name LIKE '../%' OR name LIKE '/%' OR regexp_matches(name, '^[A-Za-z]:') OR (external_attr >> 16) & 61440 = 40960
  OR flag_bits % 2 = 1 OR file_size > greatest(compress_size, 1) * 1000)"""


def stored(t):
    return t.sql(MEMBERS)


@query("member_issues", with_(m=MEMBERS) + r"""
SELECT archive, name, code FROM (SELECT archive, name, CASE
  WHEN name LIKE '../%' OR name LIKE '/%' OR regexp_matches(name, '^[A-Za-z]:') THEN 'unsafe_archive_path'
  WHEN (external_attr >> 16) & 61440 = 40960 THEN 'archive_symlink'
  WHEN flag_bits % 2 = 1 THEN 'encrypted_archive_member'
  WHEN file_size > greatest(compress_size, 1) * 1000 THEN 'archive_expansion_ratio' END AS code FROM m) WHERE code IS NOT NULL""")
def member_issues(t):
    return members.member_issues(stored(t))


@query("member_flags", with_(m=MEMBERS) + """
SELECT member_index, (external_attr >> 16) & 61440 = 40960 AS symlink,
  (external_attr >> 16) & 61440 = 40960 AND create_system = 3 AS strict_symlink, flag_bits & 1 = 1 AS encrypted FROM m""")
def member_flags(t):
    attr = F.col("external_attr")
    return stored(t).select(
        "member_index", members.is_symlink(attr).alias("symlink"),
        members.is_symlink(attr, F.col("create_system")).alias("strict_symlink"),
        members.is_encrypted(F.col("flag_bits")).alias("encrypted"),
    )


@query("bomb_limits", with_(m=MEMBERS) + """
SELECT archive, 'archive_member_limit' AS code, CAST(NULL AS VARCHAR) AS name, count(*) AS actual FROM m GROUP BY archive HAVING count(*) > 2
UNION ALL SELECT archive, 'archive_uncompressed_limit', NULL, CAST(sum(file_size) AS BIGINT) FROM m GROUP BY archive HAVING sum(file_size) > 8000
UNION ALL SELECT archive, 'archive_expansion_ratio', name, file_size FROM m WHERE file_size > greatest(compress_size, 1) * 1000""")
def bomb_limits(t):
    return members.bomb_issues(stored(t), max_members=2, max_bytes=8000)


@query("duplicate_members", with_(m=MEMBERS) + """
SELECT archive, member_index, name, lower(name) AS folded, min(member_index) OVER (PARTITION BY archive, lower(name)) AS first_index
FROM m WHERE NOT """ + REJECTED + """ QUALIFY member_index > first_index""")
def duplicate_members(t):
    return members.duplicate_members(stored(t))


@query("metadata_uniqueness", with_(m=MEMBERS) + r"""
SELECT archive, count(*) FILTER (NOT is_dir AND ok AND regexp_matches(lower(name), '(^|/)comicinfo\.xml$')) AS total_count,
  count(*) FILTER (NOT is_dir AND ok AND name = 'ComicInfo.xml') AS root_count, CASE WHEN total_count > 1 THEN 'ARC006' ELSE 'ARC005' END AS code
FROM (SELECT *, NOT """ + REJECTED + """ AS ok FROM m) GROUP BY archive HAVING total_count <> 1 OR root_count <> 1""")
def metadata_uniqueness(t):
    return members.metadata_uniqueness(stored(t))


@query("nested_pages", with_(m=MEMBERS) + r"""
SELECT archive, name FROM m WHERE NOT is_dir AND regexp_matches(lower(name), '\.(jpg|png)$') AND name LIKE '%/%'""")
def nested_pages(t):
    images = stored(t).filter(~F.col("is_dir") & paths.is_image(F.col("name")))
    return members.nested_pages(images).select("archive", "name")


@query("page_count_issues", with_(
    d="""SELECT source AS archive, CASE WHEN count(*) % 3 = 0 THEN 'many' WHEN min(doc_id) % 4 = 0 THEN CAST(count(*) + 1 AS VARCHAR)
           WHEN min(doc_id) % 5 = 0 THEN NULL ELSE ' ' || CAST(count(*) FILTER (lang <> 'zz') AS VARCHAR) || ' ' END AS declared FROM documents GROUP BY 1
         UNION ALL SELECT 'order ' || CAST(o_orderkey AS VARCHAR), '3' FROM orders """,
    n="SELECT source AS archive, count(*) AS n FROM documents GROUP BY 1",
    j="SELECT archive, declared, coalesce(n, 0) AS actual FROM d LEFT JOIN n USING (archive)",
) + """
SELECT archive, declared, actual, 'pagecount_mismatch' AS code FROM j WHERE TRY_CAST(trim(declared) AS BIGINT) IS DISTINCT FROM actual
UNION ALL SELECT archive, declared, actual, 'archive_has_no_pages' FROM j WHERE actual = 0""")
def page_count_issues(t):
    pages = t.documents.select(F.col("source").alias("archive"), "doc_id", "lang")
    declared = pages.groupBy("archive").agg(
        F.expr("""CASE WHEN count(*) % 3 = 0 THEN 'many' WHEN min(doc_id) % 4 = 0 THEN CAST(count(*) + 1 AS STRING)
                  WHEN min(doc_id) % 5 = 0 THEN NULL ELSE ' ' || count_if(lang <> 'zz') || ' ' END""").alias("declared")
    )
    empty = t.orders.selectExpr("'order ' || o_orderkey AS archive", "'3' AS declared")
    return members.page_count_issues(declared.unionByName(empty), pages)


# Parts as pages: the brand number decides the natural order, so stored order often breaks it.
PART_PAGES = """
SELECT 'a' || CAST(p_partkey % 97 AS STRING) AS archive, CAST(floor(p_partkey / 97) AS BIGINT) + 1 AS page,
  p_brand || '.' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 4 = 0 THEN '.50.png' ELSE '.png' END AS name
FROM part"""
NATURAL = r"""list_transform(regexp_extract_all(lower(name), '[0-9]+(?:\.[0-9]+)?|[^0-9]+'),
  lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN 'a' || lpad(split_part(x, '.', 1), 12, '0') || '.' || rtrim(split_part(x, '.', 2), '0') ELSE 'b' || x END)"""


@query("page_order_issues", with_(p=PART_PAGES, k=f"SELECT *, {NATURAL} AS key FROM p") + """
SELECT a.archive, a.page, a.name, b.name AS next_name FROM k a JOIN k b ON a.archive = b.archive AND b.page = a.page + 1 WHERE a.key > b.key""")
def page_order_issues(t):
    return members.page_order_issues(t.sql(PART_PAGES))


@query("natural_order", with_(p="SELECT DISTINCT name FROM (" + PART_PAGES + ")") + r"""
SELECT name, array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+(?:\.[0-9]+)?|[^0-9]+'),
  lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN '0:' || CAST(length(ltrim(split_part(x, '.', 1), '0')) AS VARCHAR) || ':' || ltrim(split_part(x, '.', 1), '0')
         || ':' || rtrim(split_part(x, '.', 2), '0') ELSE '1:0:' || x || ':' END), '|') AS sort_key FROM p""")
def natural_order(t):
    names = members.natural_order(t.sql(PART_PAGES).select("name").distinct(), "name")
    text = F.transform(identity.natural_key(F.col("name")), lambda k: F.concat_ws(":", k["kind"], k["width"], k["digits"], k["rest"]))
    return names.select("name", F.array_join(text, "|").alias("sort_key"))


DOC_PAGES = "SELECT source AS archive, doc_id AS page, lang AS series, {} AS sha256 FROM documents"


def doc_pages(t):
    return t.documents.select(
        F.col("source").alias("archive"), F.col("doc_id").alias("page"), F.col("lang").alias("series"),
        hashes.sha256(F.col("text")).alias("sha256"),
    )


@query("duplicate_pages", with_(
    p="SELECT 'l ' || series AS archive, page, sha256 FROM (" + DOC_PAGES.format("sha256(text)") + ")",
) + """
SELECT archive, page, sha256, min(page) OVER (PARTITION BY archive, sha256) AS first_page FROM p QUALIFY page > first_page""")
def duplicate_pages(t):
    return members.duplicate_pages(doc_pages(t).withColumn("archive", F.concat(F.lit("l "), "series")))


@query("missing_page_numbers", with_(
    n="SELECT DISTINCT source AS archive, CAST(floor(doc_id / 20) AS BIGINT) AS number FROM documents WHERE length(text) % 3 <> 0",
    b="SELECT archive, unnest(range(min(number), max(number))) AS number FROM n GROUP BY archive",
    a="SELECT * FROM b ANTI JOIN n USING (archive, number)",
) + """
SELECT archive, min(number) AS "start", max(number) AS "end" FROM (
  SELECT archive, number, number - row_number() OVER (PARTITION BY archive ORDER BY number) AS g FROM a) GROUP BY archive, g""")
def missing_page_numbers(t):
    pages = t.documents.filter("length(text) % 3 <> 0").selectExpr(
        "source AS archive", "'page ' || CAST(floor(doc_id / 20) AS BIGINT) || '.png' AS name"
    )
    return members.missing_page_numbers(pages)


@query("signature_mismatch", with_(m=MEMBERS) + r"""
SELECT member_index, name, 'ARC001' AS code FROM m
WHERE regexp_matches(lower(name), '\.(jpg|jpeg|png)$') AND CASE member_index % 3 WHEN 0 THEN NOT regexp_matches(lower(name), '\.png$')
  WHEN 1 THEN NOT regexp_matches(lower(name), '\.jpe?g$') ELSE false END""")
def signature_mismatch(t):
    head = F.expr("CASE member_index % 3 WHEN 0 THEN X'89504E470D0A1A0A0000' WHEN 1 THEN X'FFD8FFE000104A46' ELSE CAST(html AS BINARY) END")
    found = members.signature_mismatch(stored(t).withColumn("head", head))
    return found.select("member_index", "name", "code")


@query("illegal_names", with_(u="SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages") + r"""
SELECT page_id, name, regexp_matches(name, '[<>:"|?*]') AS illegal, regexp_extract(lower(name), '^[^/]+?(\.[^./]+)$', 1) AS suffix FROM u""")
def illegal_names(t):
    name = F.regexp_extract("url", "([^/]*)$", 1)
    return t.pages.select(
        "page_id", name.alias("name"), paths.illegal_name(name).alias("illegal"), paths.suffix(name).alias("suffix")
    )


@query("unsafe_paths", with_(m=MEMBERS, n=r"""SELECT member_index, CASE member_index % 5 WHEN 0 THEN replace(name, '/', '\') WHEN 1 THEN name || '/' WHEN 2 THEN './' || name
  WHEN 3 THEN 'a//' || name ELSE name END AS path FROM m""") + r"""
SELECT member_index, path, replace(path, '\', '/') LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') OR regexp_matches(replace(path, '\', '/'), '(^|/)\.\.(/|$)') AS lenient,
  contains(path, '\') OR path LIKE '/%' OR regexp_matches(path, '^[A-Za-z]:') OR regexp_matches(rtrim(path, '/'), '(^|/)\.{0,2}(/|$)') AS strict FROM n""")
def unsafe_paths(t):
    path = F.expr(r"""CASE member_index % 5 WHEN 0 THEN replace(name, '/', '\\') WHEN 1 THEN name || '/' WHEN 2 THEN './' || name
                      WHEN 3 THEN 'a//' || name ELSE name END""")
    return stored(t).select("member_index", path.alias("path")).select(
        "member_index", "path", paths.unsafe_path(F.col("path")).alias("lenient"),
        paths.unsafe_member(F.col("path")).alias("strict"),
    )


@query("geometry_flags", """
SELECT l_orderkey AS order_key, CAST(l_quantity * 100 AS INT) AS width, CAST(l_linenumber * 500 AS INT) AS height,
  CAST(l_quantity * 100 AS INT) > CAST(l_linenumber * 500 AS INT) * 1.2 AS probable_spread,
  greatest(CAST(l_quantity * 100 AS INT), CAST(l_linenumber * 500 AS INT)) > 4000 OR CAST(l_quantity * 100 AS BIGINT) * l_linenumber * 500 > 9000000 AS extreme
FROM lineitem""")
def geometry_flags(t):
    pages = t.lineitem.selectExpr(
        "l_orderkey AS order_key", "CAST(l_quantity * 100 AS INT) AS width", "l_linenumber * 500 AS height"
    )
    return members.geometry_flags(pages, max_side=4000, max_pixels=9_000_000)
