"""Hash manifests: verification, difference, partition, snapshot reconciliation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashes, paths
from . import issues, spread


def side_by_side(sides: dict[str, DataFrame], keys: Sequence[str], value: str = "sha256") -> DataFrame:
    """One row per key with the value of every side and an ``in_<side>`` flag.

    One shuffle over the union instead of a chain of outer joins.
    """

    def tagged(name: str, df: DataFrame) -> DataFrame:
        v = F.col(value) if value in df.columns else F.lit(None).cast("string")
        return df.select(*keys, F.lit(name).alias("_side"), v.alias("_value"))

    rows = reduce(DataFrame.unionByName, (tagged(name, df) for name, df in sides.items()))
    here = lambda name: F.col("_side") == name
    return rows.groupBy(*keys).agg(
        *(F.max(F.when(here(name), F.col("_value"))).alias(name) for name in sides),
        *(F.bool_or(here(name)).alias(f"in_{name}") for name in sides),
    )


def verify_manifest(recorded: DataFrame, actual: DataFrame, kind: str) -> DataFrame:
    """Each recorded (root, path, sha256) with its status; 'checked' rows were hashed.

    Status codes: ok, unsafe_<kind>_path, <kind>_file_missing, <kind>_hash_changed.
    """
    rec = recorded.select("root", "path", F.lower("sha256").alias("expected"))
    act = actual.select("root", "path", F.col("sha256").alias("actual"))
    joined = rec.join(act, ["root", "path"], "left")
    status = (
        F.when(paths.unsafe_path(F.col("path")) & ~F.col("path").startswith("/"), f"unsafe_{kind}_path")
        .when(F.col("actual").isNull(), f"{kind}_file_missing")
        .when(F.col("actual") != F.col("expected"), f"{kind}_hash_changed")
        .otherwise("ok")
    )
    return joined.withColumn("status", status).withColumn(
        "checked", F.col("status").isin("ok", f"{kind}_hash_changed")
    )


def checksum_issues(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Checksum list against the files of a library -> issues (code, subject, message)."""
    both = side_by_side({"listed": listed, "files": files}, ["path"])
    archive = paths.is_archive(F.col("path"))
    on_list, present = F.col("in_listed"), F.col("in_files")
    rule = issues.rule
    found = issues.apply_rules(
        both,
        [
            rule(on_list & ~present, "checksums_target_missing", "checksums.target-present"),
            rule(on_list & present & (F.lower("listed") != F.col("files")), "checksums_mismatch", "checksums.hash-equal"),
            rule(present & ~on_list & archive, "checksums_archive_coverage_missing", "checksums.covers-archives"),
            rule(on_list & ~present & archive, "checksums_archive_coverage_extra", "checksums.within-library"),
        ],
        F.col("path").alias("subject"),
    ).select(*issues.COLUMNS)
    checked = both.agg(F.count_if(on_list & present).alias("n"))
    empty = checked.filter("n = 0").select(
        F.lit("checksums_manifest_empty").alias("code"), F.lit(None).cast("string").alias("subject"),
        F.lit("checksums.not-empty").alias("message"),
    )
    return found.unionByName(empty)


def diff_manifests(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Each path as added, removed, changed or same."""
    both = side_by_side({"old": old, "new": new}, list(keys))
    change = (
        F.when(~F.col("in_old"), "added")
        .when(~F.col("in_new"), "removed")
        .when(F.col("old").eqNullSafe(F.col("new")), "same")
        .otherwise("changed")
    )
    return both.select(*keys, F.col("old").alias("old_sha256"), F.col("new").alias("new_sha256"), change.alias("change"))


def partition_issues(affected: DataFrame, unaffected: DataFrame, formal: DataFrame, candidate: DataFrame) -> DataFrame:
    """Affected and unaffected paths must partition the formal archives; unaffected ones must not change."""
    valid = ~paths.unsafe_path(F.col("path")) & hashes.is_sha256(F.col("sha256"))
    kept = unaffected.filter(valid).withColumn("sha256", F.lower("sha256"))
    joined = side_by_side(
        {
            "affected": affected.filter(~paths.unsafe_path(F.col("path"))),
            "unaffected": kept, "formal": formal, "candidate": candidate,
        },
        ["path"],
    )
    a, u, f = F.col("in_affected"), F.col("in_unaffected"), F.col("in_formal")
    rule = issues.rule
    found = issues.apply_rules(
        joined,
        [
            rule(a & u, "formal_partition_overlap", "partition.disjoint"),
            rule(f & ~a & ~u, "formal_partition_incomplete", "missing"),
            rule(~f & (a | u), "formal_partition_incomplete", "unexpected"),
            rule(
                u & ~F.col("unaffected").eqNullSafe(F.col("formal")),
                "unaffected_baseline_mismatch", "unaffected.in-baseline",
            ),
            rule(
                u & ~F.col("unaffected").eqNullSafe(F.col("candidate")),
                "unaffected_archive_changed", "unaffected.in-candidate",
            ),
        ],
        F.col("path").alias("subject"),
    ).select(*issues.COLUMNS)
    invalid = issues.issue_rows(
        unaffected.filter(~valid), "unaffected_partition_invalid", "unaffected.row-valid", "path"
    )
    return found.unionByName(invalid)


def unaffected_expectations(baseline: DataFrame, requested: DataFrame | None) -> DataFrame:
    """Expected (path, sha256): the requested archives, by path or else by file name.

    baseline: path, sha256, seq (the last entry of a path or name counts).
    """
    base = baseline.withColumn("path", paths.record_path(F.col("path")))
    by_path = base.groupBy("path").agg(F.max_by("sha256", "seq").alias("sha256"))
    if requested is None:
        return by_path
    by_name = base.groupBy(paths.base_name(F.col("path")).alias("name")).agg(F.max_by("sha256", "seq").alias("by_name"))
    wanted = requested.select(paths.record_path(F.col("path")).alias("path")).distinct()
    wanted = wanted.join(by_path, "path", "left").withColumn("name", paths.base_name(F.col("path")))
    return (
        spread.lookup(wanted, by_name, ["name"])
        .select("path", F.coalesce("sha256", "by_name").alias("sha256"))
        .filter("sha256 IS NOT NULL")
    )


def unaffected_issues(expected: DataFrame, archives: DataFrame) -> DataFrame:
    """Expected archives that are missing or changed -> (path, code, expected, actual)."""
    actual = archives.select("path", F.col("sha256").alias("actual"))
    joined = expected.select("path", F.col("sha256").alias("expected")).join(actual, "path", "left")
    code = F.when(F.col("actual").isNull(), "unaffected_archive_missing").when(
        F.col("actual") != F.col("expected"), "unaffected_archive_changed"
    )
    return joined.withColumn("code", code).filter("code IS NOT NULL").select("path", "code", "expected", "actual")


def output_collisions(outputs: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned outputs that meet each other (case-folded), a source, or an existing path.

    outputs: item, output; sources and existing: path -> (item, output, code, reason).
    """
    folded = outputs.withColumn("_key", F.lower("output"))
    clash = spread.attach(folded, ["_key"], [F.min("item").alias("_first")], ["item"]).filter(F.col("item") > F.col("_first"))

    def hit(df: DataFrame, code: str, reason: str) -> DataFrame:
        return df.select("item", "output", F.lit(code).alias("code"), F.lit(reason).alias("reason"))

    def among(paths_df: DataFrame) -> DataFrame:
        known = paths_df.select(F.col("path").alias("output"), F.lit(True).alias("_known")).distinct()
        return spread.lookup(outputs, known, ["output"], "inner")

    return (
        hit(clash, "NAME005", "output.planned-once")
        .unionByName(hit(among(sources), "SOURCE_REPLACEMENT_REFUSED", "output.no-source"))
        .unionByName(hit(among(existing), "NAME005", "output.new"))
    )


def snapshot_flags(
    runs: DataFrame, candidate: DataFrame, formal: DataFrame, backup: DataFrame,
    expected_candidate: DataFrame, expected_formal: DataFrame, expected_backup: DataFrame,
) -> DataFrame:
    """Existence and equality flags of each run's snapshots.

    runs: run, status, candidate_exists, formal_exists, backup_exists, and for
    each expected manifest whether the run recorded one: candidate_recorded,
    formal_recorded, backup_recorded.  The manifests hold (run, path, sha256);
    the candidate is compared on archives only, formal and backup trees on
    every file.  An absent manifest proves nothing; a recorded one without rows
    is an empty tree.  A run without a backup manifest of its own expects the
    formal one there.
    """
    sides = side_by_side(
        {
            "candidate": candidate, "formal": formal, "backup": backup,
            "new": expected_candidate, "old": expected_formal, "own": expected_backup,
        },
        ["run", "path"],
    )
    archive = paths.is_archive(F.col("path"))

    def same(left: str, right: str, scope=None):
        equal = (F.col(f"in_{left}") == F.col(f"in_{right}")) & F.col(left).eqNullSafe(F.col(right))
        return F.bool_and(equal if scope is None else equal | ~scope)

    flags = sides.groupBy("run").agg(
        same("candidate", "new", archive).alias("candidate_same"),
        same("formal", "new", archive).alias("formal_is_new"),
        same("formal", "old").alias("formal_is_old"),
        same("backup", "old").alias("backup_is_old"),
        same("backup", "own").alias("backup_is_own"),
        F.bool_or("in_old").alias("had_formal"),
    )
    joined = runs.join(flags, "run", "left")
    told = lambda name: F.coalesce(F.col(f"{name}_recorded"), F.lit(False))
    # A run without any file on a side has no row there: empty equals empty.
    equal = lambda name: F.coalesce(name, F.lit(True))
    backup = F.when(told("backup"), equal("backup_is_own")).otherwise(told("formal") & equal("backup_is_old"))
    return joined.select(
        "run", "status", "candidate_exists", "formal_exists", "backup_exists",
        (told("formal") & ~F.coalesce("had_formal", F.lit(False))).alias("new_library"),
        (F.col("candidate_exists") & told("candidate") & equal("candidate_same")).alias("candidate_matches"),
        (F.col("formal_exists") & told("candidate") & equal("formal_is_new")).alias("formal_matches_candidate"),
        (F.col("formal_exists") & told("formal") & equal("formal_is_old")).alias("formal_matches_old"),
        (F.col("backup_exists") & backup).alias("backup_matches_old"),
    )


def reconcile(flags: DataFrame) -> DataFrame:
    """What to do with an interrupted promotion: the first condition that the facts prove."""
    c = F.col
    go_on, finish = "continue-candidate-promotion-then-postcheck", "run-formal-postcheck-and-finalize"
    no_backup = ~c("backup_exists")
    action = (
        F.when(c("status").isin("validated-final", "rollback-complete"), F.lit(None))
        .when(c("new_library") & ~c("formal_exists") & c("candidate_matches") & no_backup, go_on)
        .when(c("new_library") & c("formal_matches_candidate") & no_backup, finish)
        .when(c("formal_matches_old") & c("candidate_matches") & no_backup, "close-noop-intent-and-restart-promotion")
        .when(~c("formal_exists") & c("candidate_matches") & c("backup_matches_old"), go_on)
        .when(c("formal_matches_candidate") & c("backup_matches_old"), finish)
        .when(c("formal_matches_old") & no_backup, "mark-rollback-complete")
        .otherwise("stop-for-manual-recovery")
    )
    return flags.withColumn("action", action)
