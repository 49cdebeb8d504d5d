"""Run states: validation, checkpoints, updates, next actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, hashes, paths, variants
from ..session import stored as store_table
from . import issues, spread

V = variants


def state_checksum(json):
    """Checksum of a state inside this engine: SHA-256 of its JSON with sorted keys, without the checksum itself."""
    fields = V.parse(json).try_cast("map<string,variant>")
    return F.sha2(F.to_json(F.map_filter(fields, lambda k, _: k != "state_checksum")), 256)


def run_state_issues(states: DataFrame, json: str = "json", checksum: str | None = None) -> DataFrame:
    """Faults of run states -> (run, code, field).

    ``checksum`` names a column with the state's recomputed checksum; without
    it only the form of the stored one is checked.
    """
    states = spread.dealt(states).withColumn("_v", V.parse(F.col(json)))
    s = F.col("_v")
    get = lambda key: V.field(s, key)
    rule = issues.rule
    invalid, terminal = "resume_state_field_invalid", "resume_state_terminal_incomplete"
    rules = [
        rule(V.first_field(s, names).isNull(), "resume_state_field_missing", label)
        for label, names in fixed.STATE_GROUPS.items()
    ]
    version = get("schema_version")
    # Numbers compare by value, and true counts as 1.
    one = F.coalesce(V.raw(version).rlike(r"^(?:1(?:\.0+)?|true)$"), F.lit(False))
    rules.append(rule(~one, "resume_state_schema_unsupported", ""))
    status = V.text(V.first_field(s, ["status", "lifecycle_status"]))
    rules.append(
        rule(~F.coalesce(status.isin(fixed.STATE_STATUSES), F.lit(False)), "resume_state_status_invalid", "")
    )
    final = status == "validated-final"
    rules += [
        rule(final & ~V.is_true(V.field(get("promotion"), "formal_path_postcheck")), terminal, "promotion"),
        rule(final & ~V.non_blank_text(get("promotion_journal")), terminal, "promotion_journal"),
        rule(
            final & ~V.text(get("candidate_library_status")).eqNullSafe(F.lit("validated-final")),
            terminal, "candidate_library_status",
        ),
    ]
    for name in ("completed_archives", "pending_archives"):
        rules.append(rule(V.has_key(s, name) & ~V.is_kind(get(name), "ARRAY"), invalid, name))
    affected = get("affected_formal_archives")
    unsafe_item = F.exists(V.items(affected), lambda e: paths.unsafe_path(V.text(e)))
    rules += [
        rule(
            affected.isNotNull() & (~V.is_kind(affected, "ARRAY") | F.coalesce(unsafe_item, F.lit(False))),
            invalid, "affected_formal_archives",
        ),
        rule(
            V.has_key(s, "unaffected_archive_hashes") & ~V.is_kind(get("unaffected_archive_hashes"), "OBJECT"),
            invalid, "unaffected_archive_hashes",
        ),
    ]
    for name in ("config_sha256", "plan_sha256", "decision_log_sha256"):
        rules.append(rule(~hashes.is_sha256(V.text(get(name))), invalid, name))
    rules.append(rule(V.positive_int(get("checkpoint_sequence")).isNull(), invalid, "checkpoint_sequence"))
    stored = V.text(get("state_checksum"))
    rules.append(rule(~hashes.is_sha256(stored), "resume_state_checksum_missing", ""))
    if checksum is not None:
        rules.append(
            rule(
                hashes.is_sha256(stored) & (F.lower(stored) != F.col(checksum)), "resume_state_checksum_mismatch", ""
            )
        )
    return issues.apply_rules(states, rules, "run").withColumnRenamed("message", "field")


def latest_checkpoint(states: DataFrame) -> DataFrame:
    """Latest checkpoint of each run, and whether its sequence was ever broken.

    states: run, sequence, state.  Sequences must follow each other by one; a
    break is a sequence without its predecessor, or one that occurs twice (of
    two states with one sequence the larger text counts).
    """
    marks = states.groupBy("run", "sequence").agg(F.count("*").alias("n"))
    # Distinct sequences without a hole: as many as the range is long.
    return states.groupBy("run").agg(
        F.max("sequence").alias("sequence"), F.max_by("state", F.struct("sequence", "state")).alias("state")
    ).join(
        marks.groupBy("run").agg(
            F.min("sequence").alias("first"), F.max("sequence").alias("last"),
            F.count("*").alias("distinct_sequences"), F.sum("n").alias("checkpoints"),
        ),
        "run",
    ).select(
        "run", "sequence", "state", "checkpoints",
        (F.col("last") - F.col("first") + 1 - F.col("distinct_sequences")).alias("missing"),
        (F.col("checkpoints") - F.col("distinct_sequences")).alias("repeated"),
        (
            (F.col("distinct_sequences") == F.col("last") - F.col("first") + 1)
            & (F.col("checkpoints") == F.col("distinct_sequences"))
        ).alias("consecutive"),
    )


def fold_updates(updates: DataFrame) -> DataFrame:
    """Final leaf values of nested updates applied in order -> (run, path, value, sequence).

    updates: run, sequence (unique per run), path (dotted), value; one row per
    leaf.  A later update wins per path.  A later scalar also replaces what was
    nested below its path, and a later nested value replaces an earlier scalar
    above it.
    """
    latest = updates.groupBy("run", "path").agg(
        F.max("sequence").alias("sequence"), F.max_by("value", "sequence").alias("value")
    )
    parts = F.split("path", r"\.")
    # Proper ancestors of a path; a path has few of them.
    ups = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, 1, n), "."),
    )
    above = latest.select("run", "path", F.col("sequence").alias("seq"), F.explode(ups).alias("up"))
    # Newest write anywhere below a path, to hide an older scalar at it ...
    below = above.groupBy("run", F.col("up").alias("path")).agg(F.max("seq").alias("below"))
    # ... and the newest scalar written at an ancestor, to hide older leaves below it.
    scalar = latest.select("run", F.col("path").alias("up"), F.col("sequence").alias("up_sequence"))
    hidden = (
        above.join(scalar, ["run", "up"]).groupBy("run", "path").agg(F.max("up_sequence").alias("above"))
    )
    return (
        latest.join(below, ["run", "path"], "left")
        .join(hidden, ["run", "path"], "left")
        .filter("(below IS NULL OR below < sequence) AND (above IS NULL OR above < sequence)")
        .select("run", "path", "value", "sequence")
    )


def rebuild_state(leaves: DataFrame) -> DataFrame:
    """The nested state of each run, as JSON text with sorted keys -> (run, document).

    ``leaves`` is what ``fold_updates`` leaves: run, path (dotted), value.  The
    objects are put together from the deepest level up: of every level the
    leaves and the finished objects below it become objects of their parents.
    """
    parts = F.split("path", r"\.")
    rows = leaves.select("run", parts.alias("parts"), F.col("value").cast("variant").alias("v"), F.size(parts).alias("depth"))
    rows = store_table(rows, "state")
    top = rows.agg(F.max("depth").alias("d")).first().d or 1
    above = F.slice("parts", F.lit(1), F.size("parts") - 1)
    entry = F.struct(F.element_at("parts", -1).alias("key"), "v")
    done = rows.filter(F.lit(False)).drop("depth")
    for depth in range(top, 0, -1):
        here = rows.filter(F.col("depth") == depth).drop("depth").unionByName(done)
        done = here.groupBy("run", above.alias("parts")).agg(F.to_variant_object(F.map_from_entries(F.collect_list(entry))).alias("v"))
    return done.select("run", F.to_json("v").alias("document"))


def next_actions(states: DataFrame, problems: DataFrame, caches: DataFrame, existing: DataFrame) -> DataFrame:
    """What each run does next -> (run, step, action, path).

    states: run, status, staging, staging_exists; problems: run (any fault);
    caches: run, path; existing: path.
    """
    broken = problems.select("run").distinct().withColumn("_broken", F.lit(True))
    action = (
        F.when(F.col("_broken"), "stop-and-replan")
        .when(F.lower("status") == "validated-final", "already-validated-final")
        .when(F.col("staging").isNull(), "stop")
        .when(F.col("staging_exists"), "continue-from-last-complete-unit")
        .otherwise("rebuild-staging-from-checkpoint")
    )
    main = states.join(broken, "run", "left").select("run", F.lit(1).alias("step"), action.alias("action"), F.col("staging").alias("path"))
    known = existing.select("path").distinct().withColumn("_there", F.lit(True))
    # Stored, as the lookup reads it twice and a walk over all states may stand below it.
    wanted = store_table(caches.select("run", "path").distinct(), "caches")
    rebuild = spread.lookup(wanted, known, ["path"], copies=spread.COPIES).filter("_there IS NULL")
    return main.unionByName(
        rebuild.select("run", F.lit(2).alias("step"), F.lit("rebuild-disposable-cache").alias("action"), "path")
    )


def reused_sections(states: DataFrame, json: str = "json") -> DataFrame:
    """Decision sections each state carries, in name order -> (run, section)."""
    states = states.withColumn("_v", V.parse(F.col(json)))
    s = F.col("_v")
    present = F.filter(
        F.array(*(F.when(V.has_key(s, name), F.lit(name)) for name in sorted(fixed.DECISION_SECTIONS))),
        lambda n: n.isNotNull(),
    )
    return states.select("run", F.explode(present).alias("section"))
