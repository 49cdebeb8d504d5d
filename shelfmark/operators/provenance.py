"""Provenance: output pages bound to sources, omitted pages, member integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, hashes
from . import issues, manifests, spread


def bind_page_map(
    page_map: DataFrame, components: DataFrame, pages: DataFrame, included: DataFrame | None = None
) -> DataFrame:
    """Problems of an output page mapping -> (output, output_page, message), distinct.

    page_map: output, row (0-based position in the list), output_page, source,
    source_page, source_archive_sha256, source_page_sha256 (may be null),
    output_sha256.  components: output, source, sha256 (declared, verified).
    pages: archive, page, sha256 of sources and outputs.  included: output,
    source, page as the components list them.
    """
    known = components.select("output", "source", F.lower("sha256").alias("_component"))
    actual = pages.select("archive", F.col("page").cast("bigint").alias("page"), "sha256")
    source_pages = actual.toDF("source", "source_page", "_source_sha")
    output_pages = actual.toDF("output", "_expected_page", "_output_sha")
    counts = actual.groupBy("archive").agg(F.count("*").alias("_pages"))
    rows = page_map.withColumn("_expected_page", F.col("row").cast("bigint") + 1)
    row = ["output", "row"]
    rows = spread.lookup(rows, known, ["output", "source"], copies=spread.COPIES)
    rows = spread.lookup(rows, source_pages, ["source", "source_page"])
    rows = rows.join(output_pages, ["output", "_expected_page"], "left")
    used = rows.groupBy("output", "source", "source_page").agg(F.min("row").alias("_first_row"))
    rows = spread.lookup(rows, used, ["output", "source", "source_page"])
    sha = lambda name: F.lower(F.col(name))
    bound = F.coalesce(F.col("_component") == sha("source_archive_sha256"), F.lit(False))
    in_range = bound & F.col("_source_sha").isNotNull()
    rule = lambda condition, message: issues.rule(condition, "SPECIAL_RANGE_INCOMPLETE", message)
    per_row = issues.apply_rules(
        rows,
        [
            rule(F.col("output_page").isNull(), "map.output-page-valid"),
            rule(F.col("source_page").isNull() | (F.col("source_page") < 1), "map.source-page-valid"),
            rule(F.col("source").isNull(), "map.source"),
            rule(F.col("source").isNotNull() & ~bound, "map.bound"),
            rule(bound & ~in_range, "map.source-page"),
            rule(in_range & (F.col("row") > F.col("_first_row")), "map.source-page-once"),
            rule(
                in_range & (sha("source_page_sha256") != F.col("_source_sha")),
                "map.source-hash",
            ),
            rule(
                in_range & hashes.is_sha256(F.col("output_sha256")) & (sha("output_sha256") != F.col("_source_sha")),
                "map.bytes-equal",
            ),
            rule(~hashes.is_sha256(F.col("output_sha256")), "map.output-hash-valid"),
            rule(F.col("output_page") != F.col("_expected_page"), "map.continuous"),
            rule(
                ~sha("output_sha256").eqNullSafe(F.col("_output_sha")),
                "map.output-hash",
            ),
        ],
        "output", "output_page",
    )
    mapped = page_map.groupBy("output").agg(F.count("*").alias("_rows"))
    outputs = components.select("output").distinct().join(mapped, "output", "left").join(
        counts.withColumnRenamed("archive", "output"), "output", "left"
    )
    zero = F.lit(0).cast("bigint")
    per_output = issues.apply_rules(
        outputs,
        [
            rule(
                F.coalesce("_rows", zero) != F.coalesce("_pages", zero),
                "map.length",
            )
        ],
        "output", F.lit(None).cast("bigint").alias("output_page"),
    )
    found = [per_row, per_output]
    if included is not None:
        key = ["output", "source", "page"]
        listed = included.select(*key, F.lit(1).alias("l"), F.lit(0).alias("m"))
        used_pages = rows.filter(in_range).select(
            "output", "source", F.col("source_page").alias("page"), F.lit(0).alias("l"), F.lit(1).alias("m")
        )
        differs = (
            listed.unionByName(used_pages).groupBy(*key).agg(F.sum("l").alias("l"), F.sum("m").alias("m"))
            .filter("l != m").select("output").distinct()
        )
        found.append(
            differs.select(
                "output", F.lit(None).cast("bigint").alias("output_page"),
                F.lit("SPECIAL_RANGE_INCOMPLETE").alias("code"),
                F.lit("map.included-equal").alias("message"),
            )
        )
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out.select("output", "output_page", "message").distinct()


def audit_omitted(
    omitted: DataFrame, sources: DataFrame, source_pages: DataFrame, output_pages: DataFrame, review_files: DataFrame
) -> DataFrame:
    """Problems of the omitted-page audit -> (output, index, message).

    omitted: output, index, source, source_page, source_page_sha256,
    target_page, target_sha256, target_hash (22 hex digits), method,
    evidence_sha256, evidence_distance, review_duplicate, review_source_sha256,
    review_target_sha256, reviewer, reason, review_copy_preserved, review_copy,
    review_copy_sha256.
    sources: output, source (verified).  source_pages: source, page, sha256,
    hi, color.  output_pages: output, page, sha256, hi, color.  review_files:
    path, expected, actual.

    As in a hand-written audit, a row whose source or target cannot be found
    is not examined further.
    """
    row = ["output", "index"]
    verified = sources.select("output", "source").distinct().withColumn("_verified", F.lit(True))
    from_page = source_pages.select(
        "source", F.col("page").cast("bigint").alias("source_page"),
        F.struct("sha256", "hi", "color").alias("s"),
    )
    to_page = output_pages.select(
        "output", F.col("page").cast("bigint").alias("target_page"),
        F.struct("sha256", "hi", "color").alias("t"),
    )
    copies = review_files.select(
        F.col("path").alias("review_copy"), F.col("expected").alias("_expected"), F.col("actual").alias("_actual")
    )
    rows = spread.lookup(omitted, verified, ["output", "source"], copies=spread.COPIES)
    rows = spread.lookup(rows, from_page, ["source", "source_page"])
    rows = spread.lookup(rows, to_page, ["output", "target_page"])
    rows = spread.lookup(rows, copies, ["review_copy"])

    c = F.col
    same = lambda a, b: F.coalesce(F.lower(a) == F.lower(b), F.lit(False))
    blank = lambda name: F.coalesce(F.trim(name) == "", F.lit(True))
    located = c("source").isNotNull() & c("source_page").isNotNull()
    trusted = located & c("_verified").isNotNull()
    found = trusted & c("s").isNotNull()
    aimed = found & c("t").isNotNull()
    byte = c("method") == "byte-sha256"
    visual = c("method").isin("dhash-88-color", "perceptual-hash")
    bits = hashes.hamming(c("s.hi"), c("s.color"), c("t.hi"), c("t.color"))
    measured = F.coalesce(bits == c("evidence_distance"), F.lit(False)) & same(
        c("target_hash"), hashes.dhash_hex(c("t.hi"), c("t.color"))
    )
    positive = (
        F.coalesce(c("review_duplicate"), F.lit(False))
        & same(c("review_source_sha256"), c("s.sha256"))
        & same(c("review_target_sha256"), c("t.sha256"))
        & ~blank("reviewer") & ~blank("reason")
    )
    reviewed = c("review_duplicate").isNotNull()
    preserved = F.coalesce(c("review_copy_preserved"), F.lit(False)) & c("review_copy").isNotNull()
    proven = same(c("review_copy_sha256"), c("_expected")) & same(c("_actual"), c("_expected"))
    rule = lambda condition, message: issues.rule(condition, "special_deduplication_incomplete", message)
    return issues.apply_rules(
        rows,
        [
            rule(~located, "omitted.located"),
            rule(located & ~trusted, "omitted.source-trusted"),
            rule(trusted & ~found, "omitted.source-page"),
            rule(
                found & ~same(c("source_page_sha256"), c("s.sha256")),
                "omitted.source-hash",
            ),
            rule(found & ~aimed, "omitted.target-page"),
            rule(
                aimed & ~same(c("target_sha256"), c("t.sha256")),
                "omitted.target-hash",
            ),
            rule(
                aimed & byte & ~(same(c("s.sha256"), c("t.sha256")) & same(c("evidence_sha256"), c("s.sha256"))),
                "omitted.exact-evidence",
            ),
            rule(
                aimed & visual & ~(measured & reviewed),
                "omitted.near-evidence",
            ),
            rule(
                aimed & visual & measured & reviewed & ~positive,
                "omitted.near-decision",
            ),
            rule(aimed & ~F.coalesce(byte | visual, F.lit(False)), "omitted.method"),
            rule(aimed & ~preserved, "omitted.copy"),
            rule(aimed & preserved & ~proven, "omitted.copy-bound"),
        ],
        "output", "index",
    ).select("output", "index", "message")


def audit_records(outputs: DataFrame, records: DataFrame, omitted: DataFrame) -> DataFrame:
    """Record-level checks and outputs without a record -> (output, code, message).

    outputs: output; records: output, result, visual_review_complete,
    audit_record_id, sources_ok, review_copy_status.
    """
    counted = omitted.groupBy("output").agg(F.count("*").alias("_omitted"))
    mine = records.join(outputs.select("output").distinct(), "output", "left_semi").join(counted, "output", "left")
    status = F.when(F.col("_omitted") > 0, "preserved").otherwise("not-applicable")
    no = lambda name: ~F.coalesce(F.col(name), F.lit(False))
    rule = lambda condition, message: issues.rule(condition, "special_deduplication_incomplete", message)
    broken = issues.apply_rules(
        mine,
        [
            rule(
                ~F.coalesce(F.col("result").isin("complete", "not-applicable", "no-duplicates", "resolved"), F.lit(False)),
                "omitted.state-complete",
            ),
            rule(no("visual_review_complete"), "omitted.review-complete"),
            rule(F.coalesce(F.trim("audit_record_id") == "", F.lit(True)), "omitted.record-id"),
            rule(no("sources_ok"), "omitted.sources-equal"),
            rule(~F.col("review_copy_status").eqNullSafe(status), "omitted.copy-stated"),
        ],
        "output",
    )
    lacking = outputs.select("output").distinct().join(records, "output", "left_anti")
    return broken.unionByName(
        lacking.select(
            "output", F.lit("special_deduplication_missing").alias("code"),
            F.lit("omitted.state-present").alias("message"),
        )
    )


def member_integrity(before: DataFrame, after: DataFrame) -> DataFrame:
    """Member-level before / after audit, one row per stored position.

    Both sides: archive, member_index, name, sha256.  Any change of order or of
    a member other than the metadata document is ARC010.
    """
    key = ["archive", "member_index"]
    named = manifests.side_by_side(
        {"old": before.withColumn("v", F.to_json(F.struct("name", "sha256"))),
         "new": after.withColumn("v", F.to_json(F.struct("name", "sha256")))},
        key, value="v",
    )
    part = lambda side, name: F.get_json_object(F.col(side), f"$.{name}")
    same = part("old", "sha256").eqNullSafe(part("new", "sha256"))
    order = part("old", "name").eqNullSafe(part("new", "name"))
    metadata = F.coalesce(part("old", "name"), part("new", "name")) == fixed.METADATA_NAME
    return named.select(
        *key,
        F.coalesce(part("old", "name"), part("new", "name")).alias("member_name"),
        metadata.alias("is_metadata"),
        part("old", "sha256").alias("before_sha256"),
        part("new", "sha256").alias("after_sha256"),
        same.alias("content_unchanged"),
        order.alias("member_order_unchanged"),
        F.when(~order | (~metadata & ~same), "ARC010").alias("code"),
    )
