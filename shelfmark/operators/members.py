"""Checks of archive members and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, identity, paths
from . import issues, sequences, spread


def is_symlink(external_attr: Column, create_system: Column | None = None) -> Column:
    """Symbolic link by Unix mode; the strict form also needs a Unix creator."""
    link = F.shiftright(external_attr, 16).bitwiseAND(0xF000) == 0xA000
    return link if create_system is None else link & (create_system == 3)


def is_encrypted(flag_bits: Column) -> Column:
    return flag_bits.bitwiseAND(1) == 1


def member_issues(members: DataFrame) -> DataFrame:
    """Row checks of members -> (archive, name, code), first fault of a member only."""
    name = F.regexp_replace(paths.slashed(F.col("name")), r"/+$", "")
    ratio = F.col("file_size") > F.greatest(F.col("compress_size"), F.lit(1)) * fixed.MAX_MEMBER_RATIO
    code = (
        F.when(paths.unsafe_path(name), "unsafe_archive_path")
        .when(is_symlink(F.col("external_attr")), "archive_symlink")
        .when(is_encrypted(F.col("flag_bits")), "encrypted_archive_member")
        .when(ratio, "archive_expansion_ratio")
    )
    return members.withColumn("code", code).filter("code IS NOT NULL").select("archive", "name", "code")


def rejected() -> Column:
    """Whether a row check rejects the member of a row."""
    name = F.regexp_replace(paths.slashed(F.col("name")), r"/+$", "")
    ratio = F.col("file_size") > F.greatest(F.col("compress_size"), F.lit(1)) * fixed.MAX_MEMBER_RATIO
    return F.coalesce(paths.unsafe_path(name) | is_symlink(F.col("external_attr")) | is_encrypted(F.col("flag_bits")) | ratio, F.lit(False))


def accepted(members: DataFrame) -> DataFrame:
    """Members that no row check rejects; pages and duplicates are counted on these."""
    return members.filter(~rejected())


def bomb_issues(
    members: DataFrame,
    max_members: int = fixed.MAX_ARCHIVE_MEMBERS,
    max_bytes: int = fixed.MAX_ARCHIVE_BYTES,
    max_ratio: int = fixed.MAX_MEMBER_RATIO,
    mode: str = "validate",
) -> DataFrame:
    """Decompression-bomb limits -> (archive, code, actual); the ratio names its member.

    ``transform`` mode ignores members without compressed bytes, ``validate``
    counts them as one byte.
    """
    totals = members.groupBy("archive").agg(
        F.count("*").alias("count"), F.sum(F.greatest(F.col("file_size"), F.lit(0))).alias("bytes")
    )
    packed = F.greatest(F.col("compress_size"), F.lit(1)) if mode == "validate" else F.col("compress_size")
    over = (F.col("file_size") > packed * max_ratio) & (packed > 0)
    name = F.lit(None).cast("string").alias("name")

    def limit(column: str, maximum: int, code: str) -> DataFrame:
        return totals.filter(F.col(column) > maximum).select(
            "archive", F.lit(code).alias("code"), name, F.col(column).cast("bigint").alias("actual")
        )

    return (
        limit("count", max_members, "archive_member_limit")
        .unionByName(limit("bytes", max_bytes, "archive_uncompressed_limit"))
        .unionByName(
            members.filter(over).select(
                "archive", F.lit("archive_expansion_ratio").alias("code"), "name",
                F.col("file_size").cast("bigint").alias("actual"),
            )
        )
    )


def duplicate_members(members: DataFrame) -> DataFrame:
    """Accepted members whose case-folded name was already used in the archive."""
    folded = accepted(members).select("archive", "member_index", "name", F.lower(paths.slashed(F.col("name"))).alias("folded"))
    return spread.attach(
        folded, ["archive", "folded"], [F.min("member_index").alias("first_index")], ["member_index"]
    ).filter("member_index > first_index")


def metadata_uniqueness(members: DataFrame) -> DataFrame:
    """Archives without exactly one accepted metadata document at the root, in exact case."""
    name = paths.slashed(F.col("name"))
    here = F.lower(paths.base_name(name)) == fixed.METADATA_NAME.lower()
    file = ~F.coalesce(F.col("is_dir"), F.lit(False)) & ~rejected()
    counts = members.groupBy("archive").agg(
        F.count_if(file & here).alias("total_count"),
        F.count_if(file & (name == fixed.METADATA_NAME)).alias("root_count"),
    )
    code = F.when(F.col("total_count") > 1, "ARC006").otherwise("ARC005")
    return counts.filter("total_count != 1 OR root_count != 1").withColumn("code", code)


def nested_pages(pages: DataFrame, name: str = "name") -> DataFrame:
    """Pages that are not stored at the archive root."""
    return pages.filter(paths.slashed(F.col(name)).contains("/"))


def page_count_issues(declared: DataFrame, pages: DataFrame) -> DataFrame:
    """Declared against counted pages -> (archive, code, declared, actual).

    A missing or non-integer declaration is a mismatch; an archive without
    pages is an issue of its own.
    """
    counted = pages.groupBy("archive").agg(F.count("*").alias("actual"))
    joined = declared.join(counted, "archive", "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("bigint"))
    stated = F.when(F.col("declared").rlike(r"^\s*[+-]?\d+\s*$"), F.trim("declared").try_cast("bigint"))
    return issues.apply_rules(
        joined,
        [
            issues.rule(~stated.eqNullSafe(F.col("actual")), "pagecount_mismatch", ""),
            issues.rule(F.col("actual") == 0, "archive_has_no_pages", ""),
        ],
        "archive", "declared", "actual",
    ).drop("message")


def page_order_issues(pages: DataFrame) -> DataFrame:
    """Pages stored before a page that sorts earlier in natural order.

    Stored order equals natural order exactly when no neighbours are inverted,
    so each page only meets the next one: an equi-join on (archive, page).
    """
    keyed = pages.select("archive", "page", "name", identity.natural_key(paths.slashed(F.col("name"))).alias("key"))
    after = keyed.select("archive", (F.col("page") - 1).alias("page"), F.col("name").alias("next_name"), F.col("key").alias("next_key"))
    return keyed.join(after, ["archive", "page"]).filter("key > next_key").select("archive", "page", "name", "next_name")


def natural_order(df: DataFrame, column: str) -> DataFrame:
    """Rows sorted by the natural order of ``column`` (a global, distributed sort)."""
    return df.orderBy(identity.natural_key(F.col(column)), column)


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """Byte-equal pages inside one archive, all but the first, with the first page."""
    return spread.attach(
        pages.select("archive", "page", "sha256"), ["archive", "sha256"], [F.min("page").alias("first_page")], ["page"]
    ).filter("page > first_page")


def missing_page_numbers(pages: DataFrame, name: str = "name") -> DataFrame:
    """Intervals of page numbers (digits that end the file stem) absent in an archive."""
    numbers = pages.select(
        "archive", F.regexp_extract(paths.stem(F.col(name)), r"(\d+)$", 1).try_cast("bigint").alias("number")
    )
    return sequences.gap_intervals(numbers.filter("number IS NOT NULL").distinct(), ["archive"], "number")


def signature(head: Column) -> Column:
    """Suffixes that go with the first content bytes, or null when unknown."""
    digits = F.hex(head)
    return reduce(
        lambda chain, item: chain.when(digits.startswith(item[0]), F.array(*map(F.lit, item[1]))),
        fixed.SIGNATURES,
        F,
    )


def signature_mismatch(members: DataFrame, name: str = "name", head: str = "head") -> DataFrame:
    """ARC001: suffix and content signature are both known and disagree."""
    known = paths.suffix(F.col(name)).isin(sorted({s for _, group in fixed.SIGNATURES for s in group}))
    expected = signature(F.col(head))
    return members.filter(
        known & expected.isNotNull() & ~F.array_contains(F.coalesce(expected, F.array(F.lit(""))), paths.suffix(F.col(name)))
    ).withColumn("code", F.lit("ARC001"))


def geometry_flags(pages: DataFrame, spread_ratio: float = 1.2, max_side: int = 20_000, max_pixels: int = 200_000_000) -> DataFrame:
    """Probable spreads (wider than tall by a factor) and extreme dimensions."""
    width, height = F.col("width"), F.col("height")
    return pages.withColumns({
        "probable_spread": F.coalesce(width > height * F.lit(spread_ratio), F.lit(False)),
        "extreme": F.coalesce(
            (F.greatest(width, height) > max_side) | (width.cast("bigint") * height > max_pixels), F.lit(False)
        ),
    })
