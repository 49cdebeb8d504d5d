"""Metadata: patches, precedence, tags, language checks, update modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, identity, text
from . import issues, spread

FIELDS = fixed.IDENTITY_FIELDS


def patch_issues(df: DataFrame, patch: str, *keep: str) -> DataFrame:
    """Faults of a patch column (MAP<STRING,STRING>: absent keeps, null removes, value sets)."""
    keys = F.map_keys(patch)
    folded = F.transform(keys, F.lower)
    allowed = F.array(*(F.lit(f.lower()) for f in FIELDS))
    blank = F.exists(F.map_entries(patch), lambda e: F.coalesce(F.trim(e["value"]) == "", F.lit(False)))
    rule = issues.rule
    return issues.apply_rules(
        df,
        [
            rule(F.exists(folded, lambda k: ~F.array_contains(allowed, k)), "PATCH_FIELD_NOT_ALLOWED", ""),
            rule(F.size(F.array_distinct(folded)) < F.size(folded), "PATCH_INVALID", ""),
            rule(blank, "PATCH_VALUE_INVALID", ""),
            rule(F.size(keys) == 0, "PATCH_EMPTY", ""),
        ],
        *keep,
    ).drop("message")


def _patched(field: str, patch: str) -> Column:
    folded = F.transform_keys(patch, lambda k, _: F.lower(k))
    key = F.lit(field.lower())
    return F.when(F.map_contains_key(folded, key), F.get(F.array(F.element_at(folded, key)), 0)).otherwise(F.col(field))


def apply_patch(df: DataFrame, patch: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Fields after a valid patch, the changed-field list and whether nothing changed.

    Removing a Volume adds 'Source volume: N' to Notes, once.
    """
    present = [f for f in fields if f in df.columns]
    after = df.withColumns({f"new_{f}": _patched(f, patch) for f in present})
    if "Notes" in df.columns and "Volume" in present:
        after = after.withColumn("new_Notes", provenance_note(F.col("Notes"), F.col("Volume"), F.col("new_Volume")))
    changed = changed_fields([F.col(f) for f in present], [F.col(f"new_{f}") for f in present], present)
    return after.withColumn("changed_fields", changed).withColumn("no_change", F.size("changed_fields") == 0)


def changed_fields(before: Sequence[Column], after: Sequence[Column], names: Sequence[str]) -> Column:
    """Names whose value differs, in field order; null differs from a value."""
    marks = F.array(*(F.when(~b.eqNullSafe(a), F.lit(n)) for b, a, n in zip(before, after, names)))
    return F.filter(marks, lambda n: n.isNotNull())


def provenance_note(notes: Column, volume_before: Column, volume_after: Column) -> Column:
    """Notes with the removed Volume recorded."""
    marker = F.concat(F.lit("Source volume: "), volume_before)
    current = F.trim(F.coalesce(notes, F.lit("")))
    removed = volume_after.isNull() & (F.coalesce(volume_before, F.lit("")) != "")
    return F.when(
        removed & ~F.contains(current, marker), F.ltrim(F.concat_ws("\n", current, marker), F.lit("\n"))
    ).otherwise(notes)


def resolve_fields(values: DataFrame) -> DataFrame:
    """Final value of each (item, field) by source precedence.

    values: item, field, source (one of the fixed six), value.  META004 marks a
    locked value that another source would change.
    """
    rank = F.array_position(F.array(*map(F.lit, fixed.SOURCE_PRECEDENCE)), F.col("source"))
    usable = values.withColumn("rank", rank).filter("rank > 0 AND value IS NOT NULL AND value != ''")
    locked = F.min(F.when(F.col("source") == "locked", F.col("value")))
    offers = F.col("source") != "locked"
    # A change is an offered value other than the locked one: the smallest or
    # the largest offer then differs from it.
    low, high = F.min(F.when(offers, F.col("value"))), F.max(F.when(offers, F.col("value")))
    return usable.groupBy("item", "field").agg(
        F.min_by("value", F.struct("rank", "value")).alias("value"),
        F.min_by("source", F.struct("rank", "value")).alias("source"),
        F.when((low != locked) | (high != locked), F.lit("META004")).alias("code"),
    )


def canonical_tags(df: DataFrame, item: str, tags: str, allow: DataFrame | None = None) -> DataFrame:
    """Tags of each item one by one: canonical form, decision, code.

    A tag in the vocabulary maps to its canonical form.  A Han tag is kept only
    as a release tag or as an exact entry of ``allow`` (value, reason), else
    omitted with META010.  Other tags are kept as they are.
    """
    rows = df.select(item, F.posexplode(F.split(F.col(tags), r"\s*[,，、]\s*")).alias("pos", "raw"))
    rows = rows.withColumn("tag", F.trim("raw")).filter("tag != ''").drop("raw")
    forms = {form: canonical for canonical, accepted in fixed.TAG_VOCABULARY.items() for form in accepted}
    vocabulary = F.create_map(*(F.lit(x) for pair in forms.items() for x in pair))
    canonical = F.element_at(vocabulary, F.col("tag"))
    if allow is None:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    else:
        listed = allow.groupBy(F.col("value").alias("tag")).agg(F.min("reason").alias("reason"))
        rows = spread.lookup(rows, listed, ["tag"], copies=spread.COPIES)
    protected = F.col("tag").isin(fixed.PROTECTED_TAGS) | F.col("reason").isNotNull()
    decision = (
        F.when(F.col("reason").isNotNull(), "allowlisted")
        .when(F.col("tag").isin(fixed.RELEASE_TAGS), "release")
        .when(canonical.isNotNull(), F.when(canonical == F.col("tag"), "kept").otherwise("mapped"))
        .when(text.has_han(F.col("tag")), "omitted")
        .otherwise("kept")
    )
    return (
        rows.withColumn("decision", decision)
        .withColumn("protected", protected)
        .withColumn(
            "canonical",
            F.when(F.col("decision") == "omitted", F.lit(None))
            .when(F.col("decision").isin("allowlisted", "release"), F.col("tag"))
            .otherwise(F.coalesce(canonical, F.col("tag"))),
        )
        .withColumn("code", F.when(F.col("decision") == "omitted", "META010"))
        .drop("reason")
    )


def lost_tags(before: DataFrame, after: DataFrame, item: str) -> DataFrame:
    """META011: protected tags of ``canonical_tags`` output that the final tags (item, tag) lack."""
    needed = before.filter("protected").select(item, "tag").distinct()
    return needed.join(after.select(item, "tag").distinct(), [item, "tag"], "left_anti").withColumn(
        "code", F.lit("META011")
    )


def language_issues(df: DataFrame, item: str, summary: str = "Summary", count_evidence: str | None = None) -> DataFrame:
    """Required-language fields -> (item, field, code).

    META008 for a required field without Chinese text or with kana, META012 for
    a summary that keeps kana or is not Chinese, and a Count without evidence.
    """
    checks = [
        F.when(
            ~text.has_han(F.col(f)) | text.has_kana(F.col(f)),
            F.struct(F.lit(f).alias("field"), F.lit("META008").alias("code")),
        )
        for f in fixed.CHINESE_FIELDS
        if f in df.columns
    ]
    if summary in df.columns:
        wrong = F.col(summary).isNotNull() & (text.has_kana(F.col(summary)) | ~text.has_han(F.col(summary)))
        checks.append(F.when(wrong, F.struct(F.lit(summary).alias("field"), F.lit("META012").alias("code"))))
    if count_evidence is not None:
        unfounded = F.col("Count").isNotNull() & ~F.coalesce(F.col(count_evidence), F.lit(False))
        checks.append(F.when(unfounded, F.struct(F.lit("Count").alias("field"), F.lit("META008").alias("code"))))
    return df.select(item, F.inline(F.filter(F.array(*checks), lambda c: c.isNotNull())))


def update_mode_issues(df: DataFrame, item: str, mode: str, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Fields an update mode does not allow to change -> (item, field).

    ``df`` holds each field before (name) and after (new_name); ``path`` and
    ``new_path`` are compared in a metadata refresh.
    """
    if mode == "metadata-refresh":
        frozen = [f for f in fields if f in fixed.REFRESH_KEEPS] + ["path"]
    elif mode == "identity-normalization":
        frozen = [f for f in fields if f not in fixed.NORMALIZATION_MAY_CHANGE]
    else:
        frozen = []
    frozen = [f for f in frozen if f in df.columns and f"new_{f}" in df.columns]
    if not frozen:
        return df.select(item, F.lit(None).cast("string").alias("field")).limit(0)
    changed = changed_fields([F.col(f) for f in frozen], [F.col(f"new_{f}") for f in frozen], frozen)
    return df.select(item, F.explode(changed).alias("field"))
