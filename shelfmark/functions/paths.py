"""Path and file-name expressions (Column in, Column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def slashed(c: Column) -> Column:
    """Backslashes turned into forward slashes."""
    return F.translate(c, "\\", "/")


def base_name(c: Column) -> Column:
    """Last path component."""
    return F.substring_index(F.rtrim(c, F.lit("/")), "/", -1)


def suffix(c: Column) -> Column:
    """Lower-case suffix with its dot, or ''.  A leading or final dot starts no suffix."""
    name = F.lower(base_name(c))
    last = F.substring_index(name, ".", -1)
    return F.when(F.length(last).between(1, F.length(name) - 2), F.concat(F.lit("."), last)).otherwise("")


def stem(c: Column) -> Column:
    """Last path component without its suffix."""
    name = base_name(c)
    size, last = F.length(name), F.length(F.substring_index(name, ".", -1))
    return F.when(last.between(1, size - 2), F.substring(name, F.lit(1), size - last - 1)).otherwise(name)


def top_folder(c: Column) -> Column:
    """First path component."""
    return F.substring_index(c, "/", 1)


def is_archive(c: Column) -> Column:
    return suffix(c).isin(fixed.ARCHIVE_SUFFIXES)


def is_image(c: Column) -> Column:
    return suffix(slashed(c)).isin(fixed.IMAGE_SUFFIXES)


def unsafe_path(c: Column) -> Column:
    """Lenient check of a relative path: backslashes count as slashes.

    True for null, empty, NUL, absolute, drive-letter and '..' paths.  Empty
    and '.' components collapse away and are therefore not faults.
    """
    p = slashed(c)
    return F.coalesce(
        p.contains("\0")
        | (p == "")
        | p.startswith("/")
        | p.rlike(fixed.DRIVE_PATTERN)
        | p.rlike(r"(^|/)\.\.(/|$)"),
        F.lit(True),
    )


def unsafe_member(c: Column) -> Column:
    """Strict check of a stored member name.

    Also rejects backslashes, control characters and any empty, '.' or '..'
    component; one trailing slash (a directory entry) is allowed.
    """
    trimmed = F.regexp_replace(c, r"/$", "")
    return F.coalesce(
        c.rlike(r"[\x00-\x1f\\]")
        | (c == "")
        | c.startswith("/")
        | c.rlike(fixed.DRIVE_PATTERN)
        | (trimmed == "")
        | trimmed.rlike(r"(^|/)\.{0,2}(/|$)"),
        F.lit(True),
    )


def illegal_name(c: Column) -> Column:
    """File name holding a character that some platforms refuse."""
    return c.rlike(r'[<>:"|?*\x00-\x1f]')


def record_path(c: Column) -> Column:
    """Recorded path as it is compared: forward slashes, leading './' characters dropped."""
    return F.ltrim(slashed(c), F.lit("./"))


def page_name(index: Column, count: Column, name: Column) -> Column:
    """Zero-padded output page name with the lower-case suffix of its source."""
    width = F.greatest(F.lit(4), F.length(count.cast("string")))
    return F.concat(F.lpad(index.cast("string"), width, F.lit("0")), suffix(name))
