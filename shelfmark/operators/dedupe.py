"""Exact first-wins de-duplication and the ordered near-duplicate merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import deleted, shared_folder, stored
from . import ordered, overlap, spread


def position(source_index: str = "source_index", page: str = "page"):
    """Reading order of a merge as one BIGINT: sources in order, then pages."""
    return F.shiftleft(F.col(source_index).cast("bigint"), 32) + F.col(page)


def dedupe_exact(pages: DataFrame, scope: list[str]) -> DataFrame:
    """Each page with the first page of the same bytes in its scope.

    ``kept`` is true for that first page; the target columns name it.
    """
    return (
        spread.attach(
            pages,
            [*scope, "sha256"],
            [F.min(F.struct("source_index", "page")).alias("_first"), F.count("*").alias("copies")],
            ["source_index", "page"],
        )
        .withColumn("target_source", F.col("_first.source_index"))
        .withColumn("target_page", F.col("_first.page"))
        .withColumn("kept", (F.col("source_index") == F.col("target_source")) & (F.col("page") == F.col("target_page")))
        .drop("_first")
    )


def merge_pages(
    pages: DataFrame,
    decisions: DataFrame,
    scope: list[str],
    distance: int = fixed.DEFAULT_DISTANCE,
    bits: int = overlap.BITS,
    near: DataFrame | None = None,
) -> DataFrame:
    """The ordered merge of the pages of each scope, with exact and reviewed near duplicates dropped.

    pages: scope, source_index, page, archive_sha256, sha256, hi, color, width,
    height.  decisions: scope, source_index, page, duplicate and the three
    hashes it is bound to (source_archive_sha256, source_page_sha256,
    duplicate_target_sha256).  near: ``overlap.neighbours`` of the pages, where
    the caller has them stored.

    In reading order a page is dropped when a kept page has the same bytes, or
    when the nearest kept page within the distance (the earliest among equally
    near ones) was confirmed as its duplicate.  Near pages without a decision,
    or with a stale one, are kept and reported; only kept pages count as
    targets, so a byte copy of a near-dropped page is judged on its own.

    Output adds: state (kept, exact, near), review (unresolved, stale, unique,
    duplicate or null), distance, target_source, target_page, output_page.

    How it runs: pages fall into groups of equal bytes.  A group keeps at most
    one page, its first that is not near-dropped, and only a page with a
    positive decision can be near-dropped; every other group is settled at
    once.  The rest is settled in rounds (``_settled``), in which a chain of
    any length that waits page by page is one step.
    """
    bound = ["source_archive_sha256", "source_page_sha256", "duplicate_target_sha256"]
    reviewed = decisions.select(
        *scope, "source_index", "page", F.col("duplicate").alias("_duplicate"),
        *(F.lower(name).alias(f"_{name}") for name in bound),
    )
    rows = (
        pages.join(reviewed, [*scope, "source_index", "page"], "left")
        .withColumn("pos", position())
        .withColumn("node", F.struct(*overlap.NODE))
        # A decision about another archive or page version never drops a page.
        .withColumn(
            "_may_drop",
            F.coalesce(
                F.col("_duplicate")
                & (F.col("_source_archive_sha256") == F.col("archive_sha256"))
                & (F.col("_source_page_sha256") == F.col("sha256")),
                F.lit(False),
            ),
        )
    )
    group = [*scope, "sha256"]
    # The next step reads the rows twice, and what decisions are made of may be dear.
    given = stored(rows, "merge")
    # The first page that cannot be near-dropped: nothing after it is ever kept.
    rows = stored(
        spread.attach(given, group, [F.min(F.when(~F.col("_may_drop"), F.col("pos"))).alias("_sure")], ["source_index", "page"]), "merge"
    )
    deleted(given)
    if near is None:
        near = stored(overlap.neighbours(pages, scope, distance, bits=bits), "merge")

    # Pages that decide their group: droppable ones before the sure one, and the sure one.
    contenders = rows.filter(F.col("_sure").isNull() | (F.col("pos") <= F.col("_sure"))).select(
        *scope, "sha256", "node", "pos", "_may_drop", F.col("_duplicate_target_sha256").alias("target")
    )
    heads = contenders.groupBy(*group).agg(F.min_by(F.struct("pos", "_may_drop"), "pos").alias("h"))
    sure = stored(contenders.join(heads.filter("NOT h._may_drop"), group).filter("pos = h.pos").select(*group, "node", "pos"), "merge")
    kept, dropped = _settled(contenders.join(heads.filter("h._may_drop"), group, "left_semi"), sure, near, scope)

    # Every page against the final kept set.
    holder = kept.select(*group, F.col("pos").alias("_kept"))
    out = spread.lookup(rows, holder, group)
    out = out.join(dropped.withColumn("_near", F.lit(True)), [*scope, "pos"], "left")
    is_near = F.coalesce("_near", F.lit(False))
    exact = ~is_near & F.coalesce(F.col("pos") > F.col("_kept"), F.lit(False))
    out = out.withColumn("state", F.when(is_near, "near").when(exact, "exact").otherwise("kept"))
    questioned = out.filter("state != 'exact'").select(*scope, "node", "pos")
    target = _nearest(questioned, kept, near, scope)
    out = out.join(target, [*scope, "pos"], "left")
    fresh = F.lit(True)
    for name, current in zip(bound, ("archive_sha256", "sha256", "target_sha256")):
        fresh = fresh & F.col(f"_{name}").eqNullSafe(F.col(current))
    out = out.withColumn(
        "review",
        F.when(F.col("target_pos").isNull(), F.lit(None))
        .when(F.col("_duplicate").isNull(), "unresolved")
        .when(~fresh, "stale")
        .when(F.col("_duplicate"), "duplicate")
        .otherwise("unique"),
    )
    numbered = ordered.number_rows(out.filter("state = 'kept'").select(*scope, "pos"), scope, "pos", "output_page")
    target_pos = F.when(F.col("state") == "exact", F.col("_kept")).otherwise(F.col("target_pos"))
    return out.join(numbered, [*scope, "pos"], "left").select(
        *scope, "source_index", "page", "sha256", "state", "review", "distance",
        F.shiftright(target_pos, 32).cast("int").alias("target_source"),
        target_pos.bitwiseAND((1 << 32) - 1).alias("target_page"),
        "output_page",
    )


#: Groups of a node, and pages of a group, that can hold the two nearest pages of another group.
_GROUPS, _PAGES = 3, 2


def _first_pages(rows: DataFrame, scope: list[str]) -> DataFrame:
    """Of each node the earliest groups, and of each of them the earliest pages (by ``pos``).

    Without any one group they still hold the node's two earliest pages.  The
    limits are taken before the shuffle as well, so a node of any size costs a
    few rows.
    """
    node = [*scope, "node"]
    early = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*node, "sha256").orderBy("pos"))).filter(F.col("_n") <= _PAGES)
    begins = early.filter("_n = 1").withColumn("_g", F.row_number().over(Window.partitionBy(*node).orderBy("pos"))).filter(F.col("_g") <= _GROUPS)
    return early.drop("_n").join(begins.select(*node, "sha256"), [*node, "sha256"], "left_semi")


def _settled(open_pages: DataFrame, sure: DataFrame, near: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of the merge: all kept pages (scope, sha256, node, pos) and the near-dropped ones (scope, pos).

    ``open_pages`` (scope, sha256, node, pos, _may_drop, target) belong to
    groups that begin with a droppable page; ``sure`` are kept from the start.

    A page is near-dropped if its nearest kept page of another group is its
    target.  So it waits for the nearest that is kept or open alone, and if the
    next one after that is no open page, it shares the fate of the first or
    takes the opposite.  Such waits are pointers, followed by doubling: a chain
    of n pages takes log n steps of one round.  Every round settles at least
    the earliest open page of a scope.
    """
    spark, group, page = open_pages.sparkSession, [*scope, "sha256"], [*scope, "pos"]
    folder = shared_folder(spark, "merge")
    open_pages = stored(open_pages, "merge")
    near = stored(near.join(open_pages.select(*scope, "node").distinct(), [*scope, "node"], "left_semi"), "merge")
    # Of the kept pages only the first few of a node can be anyone's nearest.
    first_kept = stored(_first_pages(sure, scope), "merge")
    sure.write.mode("append").parquet(f"{folder}/kept")
    open_pages.limit(0).select(*page).write.mode("append").parquet(f"{folder}/dropped")
    while not open_pages.isEmpty():
        state = lambda df, open_: df.select(*group, "node", "pos", F.lit(open_).alias("open"))
        heads = open_pages.groupBy(*group).agg(F.min("pos").alias("head"))
        at = state(first_kept, False).unionByName(state(_first_pages(open_pages, scope), True)).join(heads, group, "left")
        at = at.select(
            *scope, F.col("node").alias("other"), F.col("sha256").alias("_sha"), F.struct("pos", "sha256", "open", (F.col("pos") == F.col("head")).alias("head")).alias("c")
        )
        reach = open_pages.join(near.select(*scope, "node", "other", "distance"), [*scope, "node"], "left").join(at, [*scope, "other"], "left")
        earlier = F.when((F.col("c.pos") < F.col("pos")) & (F.col("_sha") != F.col("sha256")), F.struct("distance", "c.*"))
        ranked = reach.withColumn("c", earlier).withColumn("_n", F.row_number().over(Window.partitionBy(*page).orderBy(F.col("c").asc_nulls_last())))
        nth = lambda n: F.max(F.when(F.col("_n") == n, F.col("c")))
        two = ranked.filter("_n <= 2").groupBy(*page).agg(F.first("_may_drop").alias("may"), F.first("target").alias("target"), nth(1).alias("c1"), nth(2).alias("c2"))
        is_target = lambda c: F.coalesce(F.col(f"{c}.sha256") == F.col("target"), F.lit(False))
        one, two_ = is_target("c1"), is_target("c2")
        waits = F.coalesce(F.col("c1.open"), F.lit(False))
        free = waits & F.col("c1.head") & ~F.coalesce(F.col("c2.open"), F.lit(False))
        judged = two.select(
            *page,
            F.when(~F.col("may"), F.lit(False)).when(~waits, one).when(free & (one == two_), one).alias("near"),
            F.when(F.col("may") & free & (one != two_), F.col("c1.pos")).alias("to"), one.alias("flip"),
        )
        judged = stored(judged, "merge")
        known = judged.filter("near IS NOT NULL").select(*page, "near").unionByName(_followed(judged, scope))
        verdict = stored(open_pages.join(known, page, "left"), "merge")
        # The first page of a group that is not near-dropped decides it, if that is known of it.
        turn = verdict.groupBy(*group).agg(F.min(F.when(~F.coalesce("near", F.lit(False)), F.struct("pos", "near"))).alias("t"))
        turn = verdict.join(turn, group)
        now_kept = stored(turn.filter("pos = t.pos AND NOT near").select(*group, "node", "pos"), "merge")
        now_kept.write.mode("append").parquet(f"{folder}/kept")
        turn.filter("t IS NULL OR pos < t.pos").select(*page).write.mode("append").parquet(f"{folder}/dropped")
        rest = stored(turn.filter("pos >= t.pos AND t.near IS NULL").select(*open_pages.columns), "merge")
        more = stored(_first_pages(first_kept.unionByName(now_kept), scope), "merge")
        for done in (open_pages, first_kept, judged, verdict, now_kept):
            deleted(done)
        open_pages, first_kept = rest, more
    read = lambda name, like: spark.read.schema(like.schema).parquet(f"{folder}/{name}")
    return read("kept", sure), read("dropped", open_pages.select(*page))


def _followed(judged: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, pos, near) of the pages whose chain of pointers (to, flip) ends at a page that is known."""
    page = [*scope, "pos"]
    chains = judged.filter("to IS NOT NULL").select(*page, "to", "flip")
    while True:
        ahead = chains.select(*scope, F.col("pos").alias("to"), F.col("to").alias("_to"), F.col("flip").alias("_flip"))
        step = chains.join(ahead, [*scope, "to"], "left").select(
            *page, F.coalesce("_to", "to").alias("to"), (F.col("flip") != F.coalesce("_flip", F.lit(False))).alias("flip"), F.col("_to").isNotNull().alias("moved")
        )
        step = stored(step, "merge")
        chains = step.drop("moved")
        if step.filter("moved").isEmpty():
            break
    ends = judged.filter("near IS NOT NULL").select(*scope, F.col("pos").alias("to"), "near")
    return chains.join(ends, [*scope, "to"]).select(*page, (F.col("near") != F.col("flip")).alias("near"))


def _nearest(asked: DataFrame, kept: DataFrame, near: DataFrame, scope: list[str]) -> DataFrame:
    """Nearest earlier kept page of each asked page (scope, node, pos).

    Kept pages of one node are equally near, so only the first of them can be
    the answer: a page meets one row per neighbouring node.
    """
    first = kept.groupBy(*scope, F.col("node").alias("other")).agg(F.min(F.struct("pos", "sha256")).alias("t"))
    reach = near.join(first, [*scope, "other"]).select(
        *scope, "node", F.struct("distance", F.col("t.pos").alias("pos"), F.col("t.sha256").alias("sha256")).alias("t")
    )
    return (
        asked.join(reach, [*scope, "node"])
        .filter(F.col("t.pos") < F.col("pos"))
        .groupBy(*scope, "pos")
        .agg(F.min("t").alias("t"))
        .select(
            *scope, "pos", F.col("t.distance").alias("distance"), F.col("t.pos").alias("target_pos"),
            F.col("t.sha256").alias("target_sha256"),
        )
    )


def merge_report(merged: DataFrame, scope: list[str]) -> DataFrame:
    """Counts of a merge per scope."""
    n = F.count_if
    return merged.groupBy(*scope).agg(
        F.count("*").alias("input_pages"),
        n(F.col("state") == "kept").alias("output_pages"),
        n(F.col("state") == "exact").alias("exact_omitted"),
        n(F.col("state") == "near").alias("near_omitted"),
        n((F.col("state") == "kept") & (F.col("review") == "unresolved")).alias("unresolved_reviews"),
        n((F.col("state") == "kept") & (F.col("review") == "stale")).alias("stale_reviews"),
        n((F.col("state") == "kept") & (F.col("review") == "unique")).alias("confirmed_unique"),
    )
