"""Chat formatting: tool calls linked to their results.

Method: calls and results are hash-joined by conversation and identifier, after
each side is reduced to one row for an identifier.  A call may name the call
whose result it uses; depths in that forest come from pointer doubling, and
(depth, turn, identifier) is a topological order.  Arguments are validated
against schemas, and every call becomes one line of canonical JSON (keys
sorted, no white space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spread
from .common import Store

#: Spark types that a schema may ask for, by the name used in the schema.
TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}
#: Every join here has one row for a key on its right, which each task holds as a hash table.
HASH = "shuffle_hash"
CALL_COLUMNS = ["conv_id", "call_id", "turn", "name", "arguments", "parent_id"]
RESULT_COLUMNS = ["conv_id", "call_id", "turn", "content"]


def argument_errors(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Names of the faults of one call; ``schemas`` maps a tool to argument -> (type, required)."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    faults = [
        F.when(~F.coalesce(name.isin(list(schemas)), F.lit(False)), F.lit("unknown tool")),
        F.when(value.isNull() | ~kind.startswith("OBJECT"), F.lit("arguments are no object")),
    ]
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    for tool, wanted in schemas.items():
        mine = (name == tool) & is_object
        for argument, (type_name, required) in sorted(wanted.items()):
            path = f"$['{argument}']"
            part = F.try_variant_get(value, path, "variant")
            found = F.schema_of_variant(part)
            absent = part.isNull() | (found == "VOID")
            right = {
                "string": found == "STRING", "boolean": found == "BOOLEAN", "integer": found == "BIGINT",
                "number": found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL"),
            }[type_name]
            if required:
                faults.append(F.when(mine & absent, F.lit(f"{argument} is missing")))
            faults.append(F.when(mine & ~absent & ~F.coalesce(right, F.lit(False)), F.lit(f"{argument} is no {type_name}")))
    return F.array_compact(F.array(*faults))


def depths(store: Store, calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) by pointer doubling; depth is null on and below a cycle.

    A parent that is absent, or the call itself, counts as none.  A chain of n
    calls takes log2(n) rounds.
    """
    known = calls.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("there")).hint(HASH)
    pointer = calls.join(known, ["conv_id", "parent_id"], "left").select(
        "conv_id", "call_id", F.when(F.col("there") & (F.col("parent_id") != F.col("call_id")), F.col("parent_id")).alias("at"),
    )
    pointer = store.put(pointer.withColumn("depth", F.col("at").isNotNull().cast("long")))
    rounds = max(1, pointer.count()).bit_length()
    for _ in range(rounds):
        if pointer.filter("at IS NOT NULL").isEmpty():
            break
        ahead = pointer.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more")).hint(HASH)
        step = pointer.join(ahead, ["conv_id", "at"], "left").select(
            "conv_id", "call_id", F.col("next").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
        )
        old, pointer = pointer, store.put(step)
        store.drop(old)
    return pointer.select("conv_id", "call_id", F.when(F.col("at").isNull(), F.col("depth")).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each call identifier: its order, faults, results and canonical line.

    ``calls`` has CALL_COLUMNS, ``results`` RESULT_COLUMNS; other columns are
    not read.  Rows without conversation or identifier are left out.  Of calls
    that repeat an identifier the first counts (by turn, then content) and the
    row says so; likewise the first result, with the number of all.  What is
    left out here is listed by ``unlinked``.  Order: conv_id, depth, turn, call_id; calls
    on a cycle have no depth.
    """
    store = Store(calls.sparkSession, "chat")
    # The smallest struct and a count: combined before the shuffle, so an identifier used very often is no hot key.
    one = calls.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "name", "arguments", "parent_id")).alias("c"), F.count(F.lit(1)).alias("n_calls")
    ).select("conv_id", "call_id", "c.*", "n_calls")
    one = store.put(one)
    answers = results.filter("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")
    ).select("conv_id", "call_id", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content"), "n_results")
    both = one.join(answers.hint(HASH), ["conv_id", "call_id"], "left").join(depths(store, one).hint(HASH), ["conv_id", "call_id"])
    faults = F.concat(
        argument_errors(F.col("name"), F.col("arguments"), schemas),
        F.array_compact(F.array(
            F.when(F.col("n_calls") > 1, F.lit("identifier repeats")),
            F.when(F.col("depth").isNull(), F.lit("calls depend on one another")),
            F.when(F.col("result_turn") <= F.col("turn"), F.lit("result before call")),
        )),
    )
    # A VARIANT object keeps its keys sorted, at every depth, so it is printed in canonical form.
    line = F.to_json(F.to_variant_object(F.struct(
        F.try_parse_json("arguments").alias("arguments"), "depth", F.col("call_id").alias("id"), "name", F.col("content").alias("result"), "turn",
    )))
    return both.select(
        "conv_id", "call_id", "turn", "depth", "name", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.array_join(faults, "; ").alias("faults"), line.alias("line"),
    )


def unlinked(calls: DataFrame, results: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(conv_id, call_id, turn, kind, fault, content, n): every row that ``link`` joins to nothing or leaves out.

    Calls without a result, results without a call, calls and results after the
    first of their identifier, and those without conversation or identifier;
    ``others`` (conv_id, turn, role, text) are turns that are neither call nor
    result.  Equal rows are one row with their number ``n``; a row of two
    faults is listed for each.  ``content`` is the text of a call's arguments,
    of a result or of a turn.  The aggregates of an identifier reach its rows
    by the library's salted ``spread.attach``.
    """
    none = lambda name: F.lit(None).cast("string").alias(name)
    rows = calls.select("conv_id", "call_id", "turn", F.lit("call").alias("kind"), "name", F.col("arguments").alias("content"), "parent_id").union(
        results.select("conv_id", "call_id", "turn", F.lit("result"), none("name"), "content", none("parent_id"))
    )
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    # The order of ``link``; a result has neither name nor parent.
    me = F.struct("turn", "name", "content", "parent_id")
    first = lambda kind: F.min(F.when(F.col("kind") == kind, me)).alias(f"first_{kind}")
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    known = spread.attach(rows.filter(named), ["conv_id", "call_id"], [first("call"), first("result")], ["kind", "turn", "name", "content", "parent_id"])
    is_call = F.col("kind") == "call"
    is_first = me.eqNullSafe(F.when(is_call, F.col("first_call")).otherwise(F.col("first_result")))
    orphan = ~is_call & F.col("first_call").isNull()
    later = F.col("n") - is_first.cast("long")
    fault = lambda says, n: F.struct(F.lit(says).alias("fault"), n.alias("n"))
    faults = F.array_compact(F.array(
        F.when(orphan, fault("result without call", F.col("n"))),
        F.when(is_call & is_first & F.col("first_result").isNull(), fault("call without result", F.lit(1).cast("long"))),
        F.when(~orphan & (later > 0), fault("identifier repeats", later)),
    ))
    out = known.select("conv_id", "call_id", "turn", "kind", "content", F.explode(faults).alias("f"))
    out = out.groupBy("conv_id", "call_id", "turn", "kind", "f.fault", "content").agg(F.sum("f.n").alias("n"))
    lost = rows.filter(~named).groupBy("conv_id", "call_id", "turn", "kind", F.lit("no identifier").alias("fault"), "content").agg(F.sum("n").alias("n"))
    out = out.union(lost)
    if others is not None:
        turns = others.select("conv_id", none("call_id"), "turn", F.lit("turn").alias("kind"), F.concat_ws(" ", F.coalesce("role", F.lit("unknown")), F.lit("turn")).alias("fault"), F.col("text").alias("content"))
        out = out.union(turns.groupBy(*turns.columns).agg(F.count(F.lit(1)).alias("n")))
    return out


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a plain transcript (conv_id, turn, role, text).

    Every assistant turn calls ``reply`` with its text; it uses the result of
    the assistant turn two turns before, and the user turn after it is its
    result.  A row without conversation or turn has no identifier.
    """
    ident = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))
    turn = F.col("turn")
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", ident(turn).alias("call_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text"), F.length("text").alias("n_chars"))).alias("arguments"), ident(turn - 2).alias("parent_id"),
    )
    results = turns.filter("role = 'user'").select("conv_id", ident(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


REPLY = {"reply": {"text": ("string", True), "n_chars": ("integer", True)}}
