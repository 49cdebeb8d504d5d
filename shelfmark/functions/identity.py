"""Identity expressions: numbers, series keys, name tokens, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def number(c: Column) -> Column:
    """Text as DECIMAL(38,18), for arithmetic; null when not a finite decimal >= 0 or too long for one."""
    text = F.trim(c)
    # A failing cast costs an exception per row, so the shape is tested first.
    d = F.when(text.rlike(r"^\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), text.try_cast("decimal(38,18)"))
    return F.when(text.rlike(r"^-0*\.?0*$") & text.rlike("0"), F.lit(0).cast("decimal(38,18)")).otherwise(d)


def decimal_identity(c: Column) -> Column:
    """Canonical number text: '001.50' -> '1.5', '1e2' -> '100', else null.

    Digits are moved as text, so numbers of any length stay exact.  An
    exponent has at most four digits; beyond that a text is no number.
    """
    text = F.trim(c)
    plain = F.concat(F.lit("0"), F.when(text.rlike("[eE]"), _without_exponent(text)).otherwise(F.ltrim(text, F.lit("+"))))
    whole = F.ltrim(text, F.lit("0"))
    return (
        # Most numbers are whole and need one test.
        F.when(text.rlike("^[0-9]+$"), F.when(whole == "", "0").otherwise(whole))
        .when(text.rlike(r"^-(?:0+\.?0*|\.0+)$"), F.lit("0"))
        .when(
            text.rlike(r"^\+?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,4})?$"),
            F.regexp_replace(plain, r"^0*([0-9]+)(?:\.0*|(\.[0-9]*[1-9])0*)?$", "$1$2"),
        )
    )


def _without_exponent(text: Column) -> Column:
    """Number text with the point moved to where its exponent puts it.

    Each part is bound once, as an element of an array: pasted where it is
    used, it would be evaluated many times over.
    """
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    halves = F.split(F.ltrim(text, F.lit("+")), "[eE]")

    def shifted(h: Column) -> Column:
        whole, fraction = F.substring_index(h[0], ".", 1), F.when(F.contains(h[0], F.lit(".")), F.substring_index(h[0], ".", -1)).otherwise("")
        parts = F.struct(F.concat(whole, fraction).alias("digits"), (F.length(whole) + h[1].try_cast("int")).alias("point"))
        return bound(parts, pointed)

    def pointed(p: Column) -> Column:
        # Digits enough on both sides of the point.
        filled = F.concat(zeros(1 - p["point"]), p["digits"], zeros(p["point"] - F.length(p["digits"])))
        place = F.greatest(p["point"], F.lit(1))
        return bound(filled, lambda f: F.concat(F.substring(f, F.lit(1), place), F.lit("."), F.substring(f, place + 1, F.length(f))))

    return bound(halves, shifted)


def series_key(c: Column) -> Column:
    """Series name as it is compared: whitespace collapsed, trimmed, lower case."""
    # Names with single spaces are the rule, and a test costs less than a replacement.
    odd = c.rlike(f"  |[{fixed.WHITE_SPACE.replace(' ', '')}]")
    return F.lower(F.trim(F.when(odd, F.regexp_replace(c, f"[{fixed.WHITE_SPACE}]+", " ")).otherwise(c)))


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs (with one fraction) compare as numbers.

    Each token is (kind, width, digits, rest): numbers sort before text, by
    length and digits of the whole part and then by the fraction, so runs of
    any length compare exactly.
    """
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+(?:\.[0-9]+)?|[^0-9]+)"), F.lit(1))

    def key(t: Column) -> Column:
        whole = F.ltrim(F.substring_index(t, ".", 1), F.lit("0"))
        fraction = F.rtrim(F.regexp_extract(t, r"\.([0-9]+)$", 1), F.lit("0"))
        return F.when(
            t.rlike("^[0-9]"),
            F.struct(
                F.lit(0).alias("kind"), F.length(whole).alias("width"),
                whole.alias("digits"), fraction.alias("rest"),
            ),
        ).otherwise(
            F.struct(
                F.lit(1).alias("kind"), F.lit(0).alias("width"),
                t.alias("digits"), F.lit("").alias("rest"),
            )
        )

    return F.transform(tokens, key)


def _token(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def chapter_token(stem: Column) -> Column:
    """Chapter number text found in a file stem."""
    return _token(stem, fixed.CHAPTER_PATTERN)


def has_volume_token(stem: Column) -> Column:
    return stem.rlike(fixed.VOLUME_PATTERN)


def volume_token(stem: Column) -> Column:
    """Volume number text found in a file stem."""
    return _token(stem, fixed.VOLUME_VALUE_PATTERN)


def special_token(number: Column) -> Column:
    """Number part of an 'SPnn' Number value."""
    return _token(number, fixed.SPECIAL_PATTERN)


def special_name_token(stem: Column) -> Column:
    """Number part of an SP token inside a file stem."""
    return _token(stem, fixed.SPECIAL_NAME_PATTERN)


def is_special(fmt: Column, number: Column) -> Column:
    return F.coalesce(F.lower(F.trim(fmt)) == "special", F.lit(False)) | F.coalesce(
        special_token(number).isNotNull(), F.lit(False)
    )


def canonical_identity(fmt: Column, number: Column, volume: Column) -> Column:
    """'special:', 'chapter:' or 'volume:' followed by the raw value."""
    n = F.coalesce(number, F.lit(""))
    return (
        F.when(is_special(fmt, number), F.concat(F.lit("special:"), n))
        .when(n != "", F.concat(F.lit("chapter:"), n))
        .otherwise(F.concat(F.lit("volume:"), F.coalesce(volume, F.lit(""))))
    )


def _padded(c: Column, width: int) -> Column:
    whole = F.substring_index(c, ".", 1)
    rest = F.substring(c, F.length(whole) + 1, F.length(c))
    return F.concat(F.lpad(whole, F.greatest(F.lit(width), F.length(whole)), F.lit("0")), rest)


def output_name(series: Column, kind: Column, policy: Column, number: Column, volume: Column, title: Column) -> Column:
    """File name by policy; ``kind`` is chapter, volume or special; numbers are canonical text."""
    return (
        F.when(
            kind == "special",
            F.concat(series, F.lit(" SP"), _padded(number, 2), F.lit(" "), title, F.lit(".cbz")),
        )
        .when(kind == "volume", F.concat(series, F.lit(" v"), _padded(volume, 2), F.lit(".cbz")))
        .when(
            policy == "volume-aware-chapter",
            F.concat(series, F.lit(" Vol."), _padded(volume, 2), F.lit(" Ch."), _padded(number, 3), F.lit(".cbz")),
        )
        .when(policy == "continuous-chapter", F.concat(series, F.lit(" Ch."), _padded(number, 3), F.lit(".cbz")))
    )


def norm_policy(c: Column) -> Column:
    return F.lower(F.translate(c, "_", "-"))
