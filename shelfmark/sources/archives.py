"""Archives, members, pages and metadata documents as rows."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..operators import issues, spread
from ..operators import members as checks

MEMBER_SCHEMA = (
    "archive string, archive_sha256 string, member_index int, name string, file_size bigint, "
    "compress_size bigint, flag_bits int, external_attr bigint, create_system int, is_dir boolean, "
    "sha256 string, crc_ok boolean, head binary, metadata binary, error string"
)
_BATCH = 5000
#: Bytes of metadata documents in one batch of members.
_BATCH_BYTES = 16 << 20
_COLUMNS = [field.split()[0] for field in MEMBER_SCHEMA.split(", ")]
_METADATA = _COLUMNS.index("metadata")


def archive_paths(files: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path names an archive, with the key that lists sort by."""
    return files.filter(paths.is_archive(F.col(path))).withColumn("sort_path", F.lower(path))


def list_archives(spark: SparkSession, root: str) -> DataFrame:
    """Archives below ``root``: path, sort_path, length, content.

    Drop ``content`` for a listing: the column is then not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return archive_paths(files.select("path", "length", "content"))


def _member(archive: zipfile.ZipFile, info: zipfile.ZipInfo, readable: bool) -> tuple:
    """(sha256, crc_ok, head, metadata) of one member; zipfile checks the CRC while reading."""
    if not readable or info.is_dir():
        return None, None, None, None
    keep = info.filename == fixed.METADATA_NAME and info.file_size <= max(fixed.MAX_METADATA_BYTES.values())
    digest, head, kept = hashlib.sha256(), b"", bytearray()
    try:
        with archive.open(info) as stream:
            while block := stream.read(1 << 20):
                digest.update(block)
                head = head or block[:12]
                if keep:
                    kept += block
    except (OSError, RuntimeError, zipfile.BadZipFile, NotImplementedError, EOFError):
        return None, False, None, None
    return digest.hexdigest(), True, head, bytes(kept) if keep else None


def _archive_rows(path: str, content: bytes) -> list[tuple]:
    digest = hashlib.sha256(content).hexdigest()
    blank = (None,) * 11
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (OSError, ValueError, zipfile.BadZipFile, zipfile.LargeZipFile) as exc:
        return [(path, digest, *blank, None, f"invalid_zip: {exc}")]
    with archive:
        infos = archive.infolist()
        if not infos:
            return [(path, digest, *blank, None, None)]
        # Limits come from the directory, before any member is unpacked.
        open_all = len(infos) <= fixed.MAX_ARCHIVE_MEMBERS and sum(
            max(0, i.file_size) for i in infos
        ) <= fixed.MAX_ARCHIVE_BYTES
        rows = []
        for index, info in enumerate(infos):
            encrypted = bool(info.flag_bits & 1)
            bomb = info.file_size / max(info.compress_size, 1) > fixed.MAX_MEMBER_RATIO
            sha, crc_ok, head, metadata = _member(archive, info, open_all and not encrypted and not bomb)
            rows.append((
                path, digest, index, info.filename, info.file_size, info.compress_size, info.flag_bits,
                info.external_attr, info.create_system, info.is_dir(), sha, crc_ok, head, metadata, None,
            ))
        return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    for column in ("member_index", "file_size", "compress_size", "flag_bits", "external_attr", "create_system"):
        frame[column] = frame[column].astype("Int64")
    return frame


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            found = _archive_rows(path, content)
            rows += found
            held += sum(len(row[_METADATA] or b"") for row in found)
            if len(rows) >= _BATCH or held >= _BATCH_BYTES:
                yield _frame(rows)
                rows, held = [], 0
    if rows:
        yield _frame(rows)


def read_members(archives: DataFrame) -> DataFrame:
    """One row per stored member of each archive (path, content).

    An unreadable archive gives one row with ``error``; an empty one a row
    without a member.  Members that break a limit, or are encrypted, are listed
    without being unpacked.  One archive is one row of at most 2 GiB and at
    most 100,000 unpacked members.
    """
    return archives.select("path", "content").mapInPandas(_explode, MEMBER_SCHEMA)


def pages_of(members: DataFrame) -> DataFrame:
    """Accepted image members with their 1-based page number in stored order."""
    images = checks.accepted(members).filter(F.col("member_index").isNotNull() & ~F.col("is_dir") & paths.is_image(F.col("name")))
    return spread.number_rows(images, ["archive"], "member_index", "page")


def metadata_documents(members: DataFrame) -> DataFrame:
    """(archive, xml bytes) of the one root metadata member of each archive."""
    return (
        checks.accepted(members).filter(F.col("name") == fixed.METADATA_NAME)
        .groupBy("archive")
        .agg(F.count("*").alias("n"), F.max("metadata").alias("xml"), F.max("file_size").alias("bytes"))
        .filter("n = 1")
        .drop("n")
    )


def xml_guard(xml: Column, mode: str = "transform", size: Column | None = None) -> Column:
    """Why a metadata document must not be parsed, or null: size, encoding, declarations.

    ``size`` is the listed size of a document that may not have been unpacked.
    """
    limit = fixed.MAX_METADATA_BYTES[mode]
    size = F.octet_length(xml) if size is None else size
    decoded = F.when(F.is_valid_utf8(xml.cast("string")), xml.cast("string"))
    return (
        F.when(size > limit, "metadata.size")
        .when(~F.is_valid_utf8(xml.cast("string")), "metadata.utf-8")
        .when(decoded.rlike(fixed.FORBIDDEN_XML_PATTERN), "metadata.no-declaration")
    )


METADATA_FIELDS = [*fixed.IDENTITY_FIELDS, "PageCount", "Notes", "Summary", "Genre", "Tags", "Publisher", "LanguageISO"]


def parse_metadata(df: DataFrame, xml: str, mode: str = "transform", size: str | None = None) -> DataFrame:
    """Metadata fields as columns, plus ``metadata_issue``.

    Namespaces and the case of element names are ignored, text is trimmed,
    empty is null, and of the elements of a name the first in document order
    counts, at any depth (a repeated identity child is an issue).  Unsafe
    documents are never handed to the parser.  One parse reads the children of
    the root; a path is evaluated only for a name that stands elsewhere too.
    """
    schema = ", ".join(f"`{name}` array<string>" for name in METADATA_FIELDS) + ", _corrupt_record string"
    options = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
    words = F.col(xml).cast("string")
    clean = F.regexp_replace(words, "^﻿", "")
    body = F.regexp_replace(clean, r"(?s)<\?.*?\?>|<!--.*?-->", "")
    df = (
        df.withColumn("_guard", xml_guard(F.col(xml), mode, F.col(size) if size else None))
        .withColumn("_root", F.regexp_extract(body, r"^\s*<(?:[^\s<>/:]+:)?([^\s<>/:]+)", 1))
        .withColumn("_doc", F.from_xml(F.when(F.col("_guard").isNull(), clean), schema, options))
        .withColumn("_body", body)
    )
    # Once and where the caller asks for it, whatever the results are filtered by.
    df = spread.computed(df, "_guard", "_root", "_doc", "_body")
    repeated = [
        F.when(F.size(F.col(f"_doc.{name}")) > 1, F.lit(f"metadata.one-{name}")) for name in fixed.IDENTITY_FIELDS
    ]
    issue = F.coalesce(
        F.col("_guard"),
        F.when(F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull(), "metadata.well-formed"),
        F.when(F.col("_root") != fixed.METADATA_ROOT, F.lit("metadata.root")),
        *repeated,
    )
    # Nothing is read from a document that is not well-formed.
    whole = F.col("_doc._corrupt_record").isNull()

    def first(name: str) -> Column:
        child = F.get(F.col(f"_doc.{name}"), F.lit(0))
        tags = F.regexp_count("_body", F.lit(f"(?i)<(?:[^\\s<>/:!?]+:)?{name}[\\s/>]"))
        once = (tags == 0) | ((tags == 1) & child.isNotNull())
        small = "translate(local-name(),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
        anywhere = F.xpath_string("_body", F.lit(f"string((//*[{small}='{name.lower()}'])[1]/text()[1])"))
        return F.when(whole & F.col("_guard").isNull(), F.nullif(F.trim(F.when(once, child).otherwise(anywhere)), F.lit(""))).alias(_snake(name))

    values = [first(name) for name in METADATA_FIELDS]
    return df.select(*(c for c in df.columns if c not in ("_guard", "_root", "_doc", "_body")), *values,
                     issue.alias("metadata_issue"))


def _snake(name: str) -> str:
    return {
        "LocalizedSeries": "localized_series", "SeriesSort": "series_sort", "PageCount": "declared_page_count",
        "LanguageISO": "language_iso",
    }.get(name, name.lower())


def archive_table(members: DataFrame, mode: str = "transform") -> DataFrame:
    """One row per archive: hash, page count, folder and parsed metadata."""
    image = F.col("member_index").isNotNull() & ~F.col("is_dir") & paths.is_image(F.col("name")) & ~checks.rejected()
    facts = members.groupBy("archive").agg(
        F.max("archive_sha256").alias("sha256"),
        F.count_if(image).alias("page_count"),
        F.max("error").alias("error"),
    )
    # Documents are few bytes and dear to parse, so all tasks take their share of them.
    documents = spread.dealt(metadata_documents(members))
    documents = parse_metadata(documents, "xml", mode, "bytes").drop("xml", "bytes")
    return facts.join(documents, "archive", "left").withColumnRenamed("archive", "path")


def archive_issues(members: DataFrame) -> DataFrame:
    """Unreadable archives and members whose content fails its CRC."""
    return issues.all_issues(
        issues.issue_rows(members.filter("error IS NOT NULL"), "invalid_zip", "archive.readable", "archive"),
        issues.issue_rows(members.filter("crc_ok = false"), "zip_crc_failed", "member.crc", "archive"),
    )
