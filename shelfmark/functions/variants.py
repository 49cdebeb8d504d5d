"""Expressions over VARIANT values (free-form JSON)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def parse(c: Column) -> Column:
    return F.try_parse_json(c)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, as an element of an array.

    Pasted where it is used it would be evaluated as often as that, and what
    uses the result multiplies this again.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


class Members:
    """The members of an object, taken apart once; stands for the object where many of its fields are asked for.

    A path that is absent costs an exception in each look at a VARIANT, a key
    that is absent from a map costs none.
    """

    def __init__(self, column: Column):
        self.column = column


def members(v: Column) -> Column:
    """MAP<STRING,VARIANT> of an object VARIANT, else null."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def field(v: Column | Members, key: str) -> Column:
    """Member ``key`` as VARIANT; SQL null only when the key is absent."""
    if isinstance(v, Members):
        return F.try_element_at(v.column, F.lit(key))
    return F.try_variant_get(v, f"$.{key}", "variant")


def kind(v: Column) -> Column:
    """Type word of a VARIANT (OBJECT, ARRAY, STRING, BOOLEAN, VOID, BIGINT, ...); null when absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def is_kind(v: Column, *words: str) -> Column:
    """Whether the value is present and of one of the types."""
    return F.coalesce(kind(v).isin(*words), F.lit(False))


def raw(v: Column) -> Column:
    """JSON text of a value, null when absent."""
    return F.to_json(v)


def text(v: Column) -> Column:
    """String value of a string VARIANT, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_text(v: Column) -> Column:
    """Any scalar as text."""
    return F.try_variant_get(v, "$", "string")


def first_field(v: Column | Members, keys: list[str]) -> Column:
    """First listed member that is present and neither null nor '', as VARIANT."""
    return F.coalesce(*(F.when(as_text(field(v, k)) != "", field(v, k)) for k in keys))


def has_key(v: Column | Members, key: str) -> Column:
    return field(v, key).isNotNull()


def is_true(v: Column) -> Column:
    """Exactly Boolean true."""
    return F.coalesce(raw(v) == "true", F.lit(False))


def is_false(v: Column) -> Column:
    return F.coalesce(raw(v) == "false", F.lit(False))


def items(v: Column) -> Column:
    """Elements of a list VARIANT, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def positive_int(v: Column) -> Column:
    """Integer >= 1 that is not a Boolean, else null."""
    return F.when(raw(v).rlike("^[1-9][0-9]*$"), raw(v).try_cast("bigint"))


def non_blank_text(v: Column) -> Column:
    return F.coalesce(F.trim(text(v)) != "", F.lit(False))


def is_high(v: Column) -> Column:
    """Number >= 0.9, or one of the high-confidence words; Booleans never."""
    words = "|".join(fixed.HIGH_CONFIDENCE_WORDS)
    number = F.when(raw(v).rlike("^-?[0-9]"), raw(v).try_cast("double"))
    return F.coalesce((number >= 0.9) & (number < float("inf")), F.lit(False)) | F.coalesce(
        raw(v).rlike(rf'(?i)^"\s*(?:{words})\s*"$'), F.lit(False)
    )


def to_int(v: Column) -> Column:
    """Integer value: whole part of a number, digits of a text, 1/0 of a Boolean."""
    return bound(raw(v), lambda j: (
        F.when(j.rlike("^-?[0-9]+$"), j.try_cast("bigint"))
        .when(j.rlike("^-?[0-9]"), j.try_cast("double").try_cast("bigint"))
        .when(j.rlike(r'^"\s*[+-]?[0-9]+\s*"$'), F.regexp_extract(j, "([+-]?[0-9]+)", 1).try_cast("bigint"))
        .when(j.isin("true", "false"), (j == "true").cast("bigint"))
    ))


def parse_span(v: Column | Members) -> Column:
    """STRUCT<start,end> of a record, from key pairs, 'a..b' text or a two-element array.

    The first key pair that is present decides, even when it does not parse.
    """
    chain = F
    for start_key, end_key in fixed.SPAN_KEY_PAIRS:
        both = has_key(v, start_key) & has_key(v, end_key)
        span = bound(_span(to_int(field(v, start_key)), to_int(field(v, end_key))), _complete)
        chain = chain.when(both, span)
    value = F.when(truthy(field(v, "span")), field(v, "span")).otherwise(field(v, "page_span"))
    return chain.otherwise(span_value(value))


def truthy(v: Column) -> Column:
    """Present and neither null, false, 0, '' nor an empty container."""
    return F.coalesce(~raw(v).rlike(r'^(?:null|false|-?0(?:\.0+)?|""|\{\}|\[\])$'), F.lit(False))


def span_value(v: Column) -> Column:
    """STRUCT<start,end> of 'a..b' text or [a, b]."""
    def of_parts(parts: Column) -> Column:
        words, pair = parts["words"], parts["pair"]
        left = F.regexp_extract(words, fixed.SPAN_PATTERN, 1)
        right = F.regexp_extract(words, fixed.SPAN_PATTERN, 2)
        return F.when(
            words.rlike(fixed.SPAN_PATTERN), _span(left.try_cast("bigint"), right.try_cast("bigint"))
        ).when(F.size(pair) == 2, bound(_span(to_int(F.get(pair, 0)), to_int(F.get(pair, 1))), _complete))

    return bound(v, lambda x: bound(F.struct(text(x).alias("words"), items(x).alias("pair")), of_parts))


def nested_spans(v: Column | Members, keys: list[str]) -> Column:
    """Spans stated by the members of the listed list fields: objects or two-element lists."""
    lists = F.filter(F.array(*(items(field(v, k)) for k in keys)), lambda a: a.isNotNull())
    return F.transform(
        F.flatten(lists),
        lambda e: F.when(is_kind(e, "OBJECT"), bound(members(e), lambda m: parse_span(Members(m)))).when(is_kind(e, "ARRAY"), span_value(e)),
    )


def _complete(span: Column) -> Column:
    """The span if both ends are known, else null."""
    return F.when(span["start"].isNotNull() & span["end"].isNotNull(), span)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def text_ranges(words: Column) -> Column:
    """ARRAY<STRUCT<start,end>> of '3-4, 7'; reversed ranges and other text are ignored."""
    parts = F.split(words, r"\s*,\s*")

    def one(p: Column) -> Column:
        left = F.regexp_extract(p, fixed.SPAN_PATTERN, 1).try_cast("bigint")
        right = F.regexp_extract(p, fixed.SPAN_PATTERN, 2).try_cast("bigint")
        pair = bound(_span(left, right), lambda s: F.when(s["end"] >= s["start"], s))
        single = F.trim(p).try_cast("bigint")
        return F.when(p.rlike(fixed.SPAN_PATTERN), pair).when(
            F.trim(p).rlike(r"^\d+$"), _span(single, single)
        )

    return F.filter(F.transform(parts, one), lambda s: s.isNotNull())
