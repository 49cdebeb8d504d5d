"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfmark.plans import QUERIES  # noqa: E402
from shelfmark.session import session  # noqa: E402

HEADLINE = [
    "series_audit", "sequence_gaps", "duplicate_identities", "identity_issues", "promotion_gate",
    "page_coverage", "span_issues", "split_mapping", "dedupe_exact", "exact_overlap", "near_pairs",
    "verify_manifest", "diff_manifests", "checksum_issues", "reconcile_snapshots", "bind_page_map",
    "audit_omitted", "match_documents_volume", "elect_primary", "resolve_fields", "canonical_tags",
    "fold_updates", "latest_checkpoint", "archive_members", "flatten_manifest", "gap_classes",
    "near_candidates", "audit_near", "decision_issues", "merge_pages", "merge_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "shelfmark-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first query of a session pays for its start, which is not what is measured.
    QUERIES["promotion_gate"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
