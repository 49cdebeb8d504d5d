"""Checksum text files: '<64 hex>  <path>' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, paths
from ..operators import issues, spread


def read_checksum_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a checksum file with their number: line, value.

    The file is read as ordinary splittable text; Spark keeps no line numbers,
    so ``line`` is only increasing, which is all the first-wins rule needs.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")


def parse_checksums(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(listed, issues) of (line, value): listed has path, sha256, first line per path."""
    value = F.col("value")
    parsed = lines.filter(F.trim(value) != "").select(
        "line", "value",
        value.rlike(fixed.CHECKSUM_PATTERN).alias("valid"),
        F.lower(F.regexp_extract(value, fixed.CHECKSUM_PATTERN, 1)).alias("sha256"),
        F.regexp_extract(value, fixed.CHECKSUM_PATTERN, 2).alias("raw"),
    )
    # Empty and '.' components collapse, as in a normalised relative path.
    tidy = F.regexp_replace(paths.slashed(F.col("raw")), r"(^|/)(?:\.?/)+", "$1")
    tidy = F.regexp_replace(tidy, r"(?<=[^/])/\.?$", "")
    safe = parsed.filter("valid").filter(~paths.unsafe_path(F.col("raw"))).withColumn("path", tidy)
    marked = spread.attach(safe, ["path"], [F.min("line").alias("first_line")], ["line"])
    problems = issues.all_issues(
        issues.issue_rows(parsed.filter("NOT valid"), "checksums_manifest_invalid", "checksums.line-valid", "value"),
        issues.issue_rows(
            parsed.filter("valid").filter(paths.unsafe_path(F.col("raw"))),
            "checksums_manifest_unsafe_path", "checksums.path-safe", "raw",
        ),
        issues.issue_rows(
            marked.filter("line > first_line"),
            "checksums_manifest_duplicate", "checksums.path-once", "path",
        ),
    )
    return marked.filter("line = first_line").select("path", "sha256"), problems


def read_checksums(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_checksums(read_checksum_lines(spark, path))


def write_checksums(manifest: DataFrame, path: str) -> None:
    """Manifest (path, sha256) as checksum lines, globally sorted by path."""
    lines = manifest.orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))
    lines.write.mode("errorifexists").text(path)
