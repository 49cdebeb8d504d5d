"""Queries of the archive sources, over archives that Spark builds from the tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import members
from ..session import shared_folder, stored
from ..sources import archives, reports
from ..streaming import inventory
from .registry import query, with_

ARCHIVE_NAMES = """
SELECT page_id, 'Lib/' || CASE WHEN page_id % 7 = 0 THEN 'Deep/' ELSE '' END || 'Page ' || CAST(page_id AS STRING)
  || CASE page_id % 5 WHEN 0 THEN '.cbz' WHEN 1 THEN '.ZIP' WHEN 2 THEN '.Cbz' WHEN 3 THEN '.cbz.bak' ELSE '' END AS path FROM pages"""


@query("archive_listing", with_(n=ARCHIVE_NAMES) + r"""
SELECT page_id, path, lower(path) AS sort_path FROM n WHERE regexp_matches(lower(path), '\.(cbz|zip)$')""")
def archive_listing(t):
    return archives.archive_paths(t.sql(ARCHIVE_NAMES))


#: Bytes of archives in one batch, which the reader of the archives gets as it is.
_BATCH_BYTES = 8 << 20


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """An archive per document: its text as three images and a metadata document."""
    names, contents, held = [], [], 0
    for batch in batches:
        for path, doc, text, xml in zip(batch["path"], batch["doc_id"], batch["text"], batch["xml"]):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as out:
                out.writestr("p10.png", text)
                out.writestr("p2.JPG", str(doc))
                if doc % 9:
                    out.writestr("ComicInfo.xml", xml)
                out.writestr("sub/p3.webp", text[::-1])
            names.append(path)
            contents.append(buffer.getvalue()[: 40 if doc % 50 == 3 else None])
            held += len(contents[-1])
            if held >= _BATCH_BYTES:
                yield pd.DataFrame({"path": names, "content": contents})
                names, contents, held = [], [], 0
    if names:
        yield pd.DataFrame({"path": names, "content": contents})


XML = """'<?xml version="1.0"?><ComicInfo xmlns:x="urn:x"><x:Series> ' || source || ' </x:Series><Number>' || CAST(doc_id AS STRING)
  || '</Number>' || CASE WHEN doc_id % 4 = 0 THEN '<Volume/>' ELSE '<Volume>' || CAST(doc_id % 9 AS STRING) || '</Volume>' END
  || CASE WHEN doc_id % 11 = 0 THEN '<Title>a</Title><Title>b</Title>' ELSE '<Title>T &amp; ' || lang || '</Title>' END
  || '<PageCount>' || CASE WHEN doc_id % 6 = 0 THEN '4' ELSE '3' END || '</PageCount>' || CASE WHEN doc_id % 13 = 0 THEN '' ELSE '</ComicInfo>' END"""


def built(t):
    """(path, content) archives made from the documents, inside the tasks that hold them."""
    rows = t.documents.selectExpr("doc_id", "text", "source || '/' || doc_id || '.cbz' AS path", f"{XML} AS xml")
    return rows.mapInPandas(_zipped, "path string, content binary")


def _members(t):
    """Members of the built archives, for queries that read them several times; stored, so archives are unpacked once."""
    return stored(archives.read_members(built(t)).drop("head"), "members")


GOOD = "SELECT *, source || '/' || CAST(doc_id AS VARCHAR) || '.cbz' AS archive FROM documents WHERE doc_id % 50 <> 3"
MEMBER_SQL = """
SELECT archive, doc_id, 0 AS i, 'p10.png' AS name, sha256(text) AS sha256, strlen(text) AS size FROM d
UNION ALL SELECT archive, doc_id, 1, 'p2.JPG', sha256(CAST(doc_id AS VARCHAR)), strlen(CAST(doc_id AS VARCHAR)) FROM d
UNION ALL SELECT archive, doc_id, CASE WHEN doc_id % 9 = 0 THEN 2 ELSE 3 END, 'sub/p3.webp', sha256(reverse(text)), strlen(text) FROM d"""
XML_MEMBER_SQL = f"SELECT archive, doc_id, 2 AS i, 'ComicInfo.xml' AS name, sha256({XML}) AS sha256, strlen({XML}) AS size FROM d WHERE doc_id % 9 <> 0".replace("AS STRING", "AS VARCHAR")


@query("archive_members", with_(d=GOOD, m=MEMBER_SQL, x=XML_MEMBER_SQL) + """
SELECT archive, CAST(i AS INTEGER) AS member_index, name, CAST(size AS BIGINT) AS file_size, sha256, true AS crc_ok FROM (FROM m UNION ALL FROM x)
UNION ALL SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.cbz', NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id % 50 = 3""")
def archive_members(t):
    return archives.read_members(built(t)).select("archive", "member_index", "name", "file_size", "sha256", "crc_ok")


@query("archive_pages", with_(d=GOOD, m=MEMBER_SQL) + """
SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY i) AS page, name, sha256 FROM m""")
def archive_pages(t):
    return archives.pages_of(_members(t)).select("archive", "page", "name", "sha256")


@query("archive_issues", """
SELECT 'invalid_zip' AS code, source || '/' || CAST(doc_id AS VARCHAR) || '.cbz' AS subject, 'archive.readable' AS message FROM documents WHERE doc_id % 50 = 3""")
def archive_issues(t):
    return archives.archive_issues(_members(t))


META_SQL = """
SELECT doc_id, trim(source) AS series, CAST(doc_id AS VARCHAR) AS number, CASE WHEN doc_id % 4 <> 0 THEN CAST(doc_id % 9 AS VARCHAR) END AS volume,
  CASE WHEN doc_id % 11 = 0 THEN 'a' ELSE 'T & ' || lang END AS title, CASE WHEN doc_id % 6 = 0 THEN '4' ELSE '3' END AS declared_page_count,
  CASE WHEN doc_id % 11 = 0 THEN 'metadata.one-Title' END AS issue FROM documents"""


@query("metadata_parse", with_(m=META_SQL) + """
SELECT doc_id, series, number, volume, title, declared_page_count, issue AS metadata_issue FROM m WHERE doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 17 = 0 THEN 'metadata.no-declaration'
  ELSE 'metadata.well-formed' END FROM m WHERE doc_id % 17 = 0 OR doc_id % 13 = 0
UNION ALL SELECT doc_id, series, number, volume, title, declared_page_count, 'metadata.root' FROM m WHERE doc_id % 19 = 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0""")
def metadata_parse(t):
    xml = f"""CASE WHEN doc_id % 17 = 0 THEN replace({XML}, '<ComicInfo', '<!DOCTYPE x><ComicInfo')
              WHEN doc_id % 19 = 0 THEN replace({XML}, 'ComicInfo', 'Other') ELSE {XML} END"""
    rows = t.documents.selectExpr("doc_id", f"CAST({xml} AS BINARY) AS xml")
    fields = ["series", "number", "volume", "title", "declared_page_count"]
    return archives.parse_metadata(rows, "xml").select("doc_id", *fields, "metadata_issue")


@query("archive_table", with_(d=GOOD, m=META_SQL) + """
SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.cbz' AS path, CASE WHEN doc_id % 50 = 3 THEN 0 ELSE 3 END AS page_count, doc_id % 50 = 3 AS unreadable,
  CASE WHEN doc_id % 50 <> 3 AND doc_id % 9 <> 0 AND doc_id % 13 <> 0 THEN series END AS series, CASE WHEN doc_id % 50 <> 3 AND doc_id % 9 <> 0 AND doc_id % 13 <> 0 THEN declared_page_count END AS declared
FROM documents JOIN m USING (doc_id)""")
def archive_table(t):
    table = archives.archive_table(_members(t))
    return table.select(
        "path", F.col("page_count").cast("int").alias("page_count"), F.col("error").isNotNull().alias("unreadable"),
        "series", F.col("declared_page_count").alias("declared"),
    )


@query("archive_audit", with_(d=GOOD) + """
SELECT archive, 'comicinfo_root_uniqueness' AS code FROM d WHERE doc_id % 9 = 0
UNION ALL SELECT archive, 'pages_not_at_archive_root' FROM d
UNION ALL SELECT archive, 'page_order_not_natural' FROM d
UNION ALL SELECT archive, 'pagecount_mismatch' FROM d WHERE doc_id % 9 <> 0 AND doc_id % 13 <> 0 AND doc_id % 6 = 0""")
def archive_audit(t):
    """From archive bytes to issues: members, pages, metadata and their checks."""
    found = _members(t)
    pages = archives.pages_of(found)
    table = archives.archive_table(found).filter("metadata_issue IS NULL OR metadata_issue LIKE 'metadata.one-%'")
    declared = table.filter("series IS NOT NULL").select(
        F.col("path").alias("archive"), F.col("declared_page_count").alias("declared")
    )
    code = lambda df, name: df.select("archive", F.lit(name).alias("code")).distinct()
    real = found.filter("member_index IS NOT NULL")
    return (
        code(members.metadata_uniqueness(real), "comicinfo_root_uniqueness")
        .unionByName(code(members.nested_pages(pages), "pages_not_at_archive_root"))
        .unionByName(code(members.page_order_issues(pages), "page_order_not_natural"))
        .unionByName(members.page_count_issues(declared, pages).select("archive", "code"))
    )


@query("reports", with_(p="SELECT o_orderstatus AS series, count(*) AS items FROM orders GROUP BY 1") + """
SELECT series, items, 'csv' AS format FROM p UNION ALL SELECT series, items, 'json' FROM p""")
def written_reports(t):
    """The same table through both report sinks and back."""
    root = shared_folder(t.spark, "reports")
    rows = t.orders.groupBy(F.col("o_orderstatus").alias("series")).agg(F.count("*").alias("items"))
    as_csv = reports.write_report(rows, "series-identity-audit", root)
    as_json = reports.write_report(rows, "plan", root)
    schema = "series string, items bigint"
    return (
        t.spark.read.schema(schema).option("header", True).csv(as_csv).withColumn("format", F.lit("csv"))
        .unionByName(t.spark.read.schema(schema).json(as_json).withColumn("format", F.lit("json")))
    )


@query("inventory_stream", """
SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.png' AS member, sha256(text) AS sha256 FROM documents""")
def inventory_stream(t):
    """Page inventory of the document files as a resumable stream; the second run adds nothing."""
    root = shared_folder(t.spark, "inventory")
    schema = t.documents.schema

    def work(df):
        return df.selectExpr("source || '/' || doc_id || '.png' AS member", "sha2(text, 256) AS sha256").filter(
            paths.is_image(F.col("member"))
        )

    for _ in range(2):
        out = inventory.table_inventory(t.spark, t.folder, "documents.parquet", schema, f"{root}/out", f"{root}/state", work)
    return out


