"""Fingerprints and perceptual-hash expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.SHA256_PATTERN), F.lit(False))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def dhash_bits(values: Column, width: int, rows: int) -> Column:
    """``rows`` x (``width`` - 1) difference bits of a row-major grid, first bit highest.

    Up to 64 bits, returned as BIGINT (the first of 64 lands in the sign bit).
    """
    steps = width - 1
    grid = F.sequence(F.lit(0), F.lit(rows * steps - 1))

    def bit(acc: Column, i: Column) -> Column:
        at = F.floor(i / steps).cast("int") * width + i % steps
        here = F.get(values, at)
        after = F.get(values, at + 1)
        return F.shiftleft(acc, 1).bitwiseOR((here > after).cast("bigint"))

    return F.aggregate(grid, F.lit(0).cast("bigint"), bit)


def dhash88(gray: Column, rgb: Column) -> tuple[Column, Column]:
    """(64 difference bits, 24 mean-colour bits) of a 9x8 grey grid and an 8x8 colour grid.

    ``rgb`` is an array of (r, g, b) structs.  Means use integer division.
    """

    def mean(channel: str) -> Column:
        total = F.aggregate(rgb, F.lit(0), lambda acc, p: acc + p[channel].cast("int"))
        return F.floor(total / F.size(rgb)).cast("int")

    color = F.shiftleft(mean("r"), 16).bitwiseOR(F.shiftleft(mean("g"), 8)).bitwiseOR(mean("b"))
    return dhash_bits(gray, 9, 8), color


def dhash_hex(hi: Column, color: Column) -> Column:
    """22 hex digits of the 88-bit hash."""
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(color.cast("bigint")), 6, "0")))


def parse_dhash(c: Column) -> tuple[Column, Column]:
    """(hi, color) of a 22-digit hex text."""
    hi = F.conv(F.substring(c, 1, 16), 16, -10).cast("bigint")
    color = F.conv(F.substring(c, 17, 6), 16, 10).cast("int")
    return hi, color


def hamming(a_hi: Column, a_color: Column, b_hi: Column, b_color: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_color.bitwiseXOR(b_color))


def similar_aspect(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    """Aspect ratios within one percent of the larger cross product."""
    left = w1.cast("bigint") * h2
    right = w2.cast("bigint") * h1
    scale = F.greatest(left, right)
    return (scale > 0) & (F.abs(left - right) * 100 <= scale)


def row_fingerprint(df: DataFrame, exclude: tuple[str, ...] = ("state_checksum",)) -> Column:
    """SHA-256 over the row's canonical JSON: columns in name order, no white space, null for nothing.

    Whole numbers, decimals and Booleans are written plainly, floating-point
    numbers in scientific form with 15 digits, dates and times in ISO form as
    text; texts and nested values as ``to_json`` writes them.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.concat(F.lit(f'"{name}":'), F.coalesce(_canonical(F.col(name), kinds[name]), F.lit("null"))) for name in sorted(kinds) if name not in exclude]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")), 256)


def _canonical(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        return c.cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(c.isNotNull(), F.format_string("%.14e", c.cast("double")))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    shown = F.to_json(F.array(c), {"ignoreNullFields": "false"})
    return F.when(c.isNotNull(), F.substring(shown, F.lit(2), F.length(shown) - 2))
