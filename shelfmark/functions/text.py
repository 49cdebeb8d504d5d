"""Text-policy expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def has_han(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.HAN_PATTERN), F.lit(False))


def has_kana(c: Column) -> Column:
    return F.coalesce(c.rlike(fixed.KANA_PATTERN), F.lit(False))


def non_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def first_non_empty(*cols: Column) -> Column:
    """First value that is neither null nor ''."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def coverage_flag(c: Column) -> Column:
    """Coverage status text as Boolean."""
    return F.trim(F.lower(F.translate(c, "_", "-"))).isin(fixed.COVERAGE_WORDS)


def publisher(zh: Column, original: Column) -> Column:
    """'zh（original）' when both exist and differ, else the one reliable value."""
    z, o = F.nullif(F.trim(zh), F.lit("")), F.nullif(F.trim(original), F.lit(""))
    return (
        F.when(z.isNull() | o.isNull(), F.coalesce(z, o))
        .when(F.lower(z) == F.lower(o), z)
        .when(has_han(o) & ~has_kana(o), o)
        .otherwise(F.concat(z, F.lit("（"), o, F.lit("）")))
    )


def publisher_issue(zh: Column, original: Column) -> Column:
    """META009 when a component is missing; a Chinese original needs no second one."""
    z, o = F.nullif(F.trim(zh), F.lit("")), F.nullif(F.trim(original), F.lit(""))
    chinese = has_han(o) & ~has_kana(o)
    return F.when((z.isNull() & ~chinese) | o.isNull(), F.lit("META009"))


def rating5(c: Column, scale: Column) -> Column:
    """Rating brought from 0..scale to 0..5 with one decimal; out of range -> null."""
    value = (c.cast("decimal(18,6)") * 5 / scale.cast("decimal(18,6)")).cast("decimal(18,6)")
    return F.when((value >= 0) & (value <= 5), F.round(value, 1).cast("decimal(3,1)"))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """Value of a fixed map for a lower-cased, trimmed key, else null."""
    key = F.lower(F.trim(c))
    return reduce(lambda acc, kv: acc.when(key == kv[0], F.lit(kv[1])), list(table.items())[1:],
                  F.when(key == next(iter(table)), F.lit(next(iter(table.values())))))


def language_code(c: Column) -> Column:
    return mapped(c, fixed.LANGUAGE_CODES)


def direction_code(c: Column) -> Column:
    return mapped(c, fixed.DIRECTION_CODES)
