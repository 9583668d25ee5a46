"""Chat formatting: tool calls linked to results, ordered, validated, serialised.

Calls and results are joined by ``(conv_id, call_id)``. A call may name, in
``after``, the calls whose results it builds on (an array of ids, or one id as a
string); calls of a conversation are ordered so that every call follows all that it
names. Arguments are checked against the tool's schema and written as canonical JSON
(keys sorted, no spaces, numbers in one form).

A schema has one row per property: its name (``outer.inner`` for a property of an
object), type, whether it is required, and, if those columns exist, the strings it may
be (``allowed``) and its numbers' bounds (``minimum``, ``maximum``). Properties are
looked at down to ``LEVELS`` levels; below an object without named properties anything goes.

Only DataFrame functions run here. Cases:

* A call without result has status ``unanswered``; a result without call is a
  row of its own with status ``orphan``. Of several results the one of the
  smallest turn (then the smallest content) counts; ``n_results`` tells how many.
* Calls with the same id in a conversation: the one of the smallest turn (then
  the smallest tool and arguments) counts, ``n_calls`` tells how many. Calls
  with a NULL id cannot be linked; each is a row of its own, unanswered.
* An id in ``after`` that names no call gives the error ``unknown after`` and counts
  as none; NULL and repeated ids count for nothing. Calls on a cycle, or behind one, get
  the error ``cycle`` and come last. ``depth`` is the longest way from a call without any.
* Arguments that are not JSON (duplicate keys included) give ``not json``, other
  values than objects ``not an object``, a tool without schema ``unknown tool``.
* Empty tables give an empty result. Only the named columns are read, so other
  columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barflow.llm.common import cut, global_running

#: Levels of inner objects whose properties are checked.
LEVELS = 3
#: How a JSON value's type (as Spark names it) meets a schema type.
TYPE_PATTERNS = {
    "string": "STRING",
    "integer": r"BIGINT|DECIMAL\(\d+,0\)",
    "number": r"BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT",
    "boolean": "BOOLEAN",
    "object": "OBJECT<.*>",
    "array": "ARRAY<.*>",
    "null": "VOID",
}


def unique_calls(calls: DataFrame) -> DataFrame:
    """``uid, conv_id, call_id, turn, tool, arguments, after, n_calls``, written once."""
    after = F.col("after") if isinstance(calls.schema["after"].dataType, T.ArrayType) else F.array("after")
    after = F.array_sort(F.array_distinct(F.array_compact(after.cast("array<string>"))))
    d = calls.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "tool", "arguments",
                     F.coalesce(after, F.array().cast("array<string>")).alias("after"))
    fields = ["turn", "tool", "arguments", "after"]
    first = d.where("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct(*fields)).alias("c"), F.count(F.lit(1)).alias("n_calls")) \
        .select("conv_id", "call_id", *[F.col(f"c.{f}").alias(f) for f in fields], "n_calls")
    loose = d.where("call_id is null").select("conv_id", "call_id", *fields, F.lit(1).cast("long").alias("n_calls"))
    return cut(first.unionByName(loose).withColumn("uid", F.monotonically_increasing_id()), "calls")


def depths(calls: DataFrame) -> DataFrame:
    """``uid, depth, on_cycle, unknown_after``: the longest way to a call that builds on none.

    Every call that is not placed yet has edges ``(uid, up, off)``: it lies ``off`` calls or more
    behind ``up``. In a round an edge ends where its target is placed, and goes on to the target's
    own target where that has a single edge, so chains take rounds by the logarithm
    of their length, and only calls that wait for several others make rounds of their own. An
    edge longer than the number of calls, or a round in which nothing moves, means a cycle."""
    named = calls.where("call_id is not null").select("conv_id", F.col("call_id").alias("a"), F.col("uid").alias("up"))
    links = calls.select("uid", "conv_id", F.explode("after").alias("a")).join(named, ["conv_id", "a"], "left")
    links = cut(links.select("uid", "up"), "links")
    unknown = links.groupBy("uid").agg(F.count_if(F.col("up").isNull()).alias("lost"), F.count("up").alias("n"))
    nodes = calls.select("uid").join(unknown, "uid", "left")
    nodes = cut(nodes.select("uid", (F.coalesce("lost", F.lit(0)) > 0).alias("unknown_after"),
                             F.when(F.coalesce("n", F.lit(0)) == 0, 0).cast("long").alias("depth")), "depths")
    edges = cut(links.where("up is not null").select("uid", "up", F.lit(1).cast("long").alias("off"),
                                                     F.lit(None).cast("long").alias("least")), "edges")
    total, before = nodes.count(), None
    while True:
        # Edges whose target is placed: ``least`` is the depth they ask for.
        at = nodes.select(F.col("uid").alias("up"), F.col("depth").alias("d"))
        edges = edges.join(at, "up").withColumn("least", F.coalesce("least", F.col("d") + F.col("off")))
        one = edges.groupBy("uid").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("least").isNull()).alias("open"),
                                       F.max("least").alias("most"), F.max("up").alias("up2"), F.max("off").alias("off2"))
        one = cut(one, "edge-states")
        edges = cut(edges.select("uid", "up", "off", "least"), "edges")
        placed = one.where("open = 0").select("uid", F.col("most").alias("d"))
        nodes = cut(nodes.join(placed, "uid", "left").select("uid", "unknown_after", F.coalesce("depth", "d").alias("depth")), "depths")
        edges = edges.join(placed, "uid", "left_anti")
        single = one.where("open = 1 and k = 1 and off2 <= %d" % total).select(F.col("uid").alias("up"), "up2", "off2")
        on = edges.join(single, "up", "left")
        move = F.col("least").isNull() & F.col("up2").isNotNull() & (F.col("off") <= total)
        edges = cut(on.select("uid", F.when(move, F.col("up2")).otherwise(F.col("up")).alias("up"),
                              F.when(move, F.col("off") + F.col("off2")).otherwise(F.col("off")).alias("off"), "least"), "edges")
        state = edges.agg(F.count(F.lit(1)), F.count("least"), F.sum("off")).first()
        if not state[0] or state == before:
            break
        before = state
    return nodes.select("uid", F.coalesce("depth", F.lit(0)).alias("depth"), F.col("depth").isNull().alias("on_cycle"), "unknown_after")


def _properties(value: Column) -> Column:
    """``map<string, variant>`` of an object's properties, those of inner objects as ``outer.inner``."""
    inner = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    level = F.map_entries(inner(value))
    out = level
    for _ in range(LEVELS - 1):
        deeper = F.transform(level, lambda e: F.transform(F.map_entries(inner(e["value"])), lambda x: F.struct(
            F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value"))))
        level = F.flatten(F.array_compact(deeper))
        out = F.concat(out, level)
    return F.map_from_entries(out)


def with_argument_errors(calls: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with the JSON in ``arguments`` by ``spec``, an array of (name, type,
    required, allowed, minimum, maximum). The parsed value, its properties and their types are columns
    of their own, so that each text is parsed once."""
    d = calls.withColumn("_value", F.try_parse_json("arguments"))
    d = d.withColumn("_found", _properties(F.col("_value")))
    d = d.withColumn("_types", F.transform_values("_found", lambda k, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID"))))
    own = argument_errors(F.col("spec"), F.col("_value"), F.col("_found"), F.col("_types"))
    return d.withColumn("errors", own).drop("_value", "_found", "_types")


def argument_errors(spec: Column, value: Column, found: Column, types: Column) -> Column:
    """Sorted errors of a parsed ``value`` with its properties ``found`` and their ``types``."""
    shape = F.schema_of_variant(value)
    keys = F.map_keys(types)
    parent = lambda name: F.when(F.instr(name, ".") > 0, F.regexp_replace(name, r"\.[^.]*$", ""))

    def fits(p: Column) -> Column:
        got = types[p["name"]]
        out = F.lit(False)
        for name, pattern in TYPE_PATTERNS.items():
            out = out | ((p["type"] == name) & got.rlike(f"^({pattern})$"))
        return out

    has = lambda p: F.array_contains(keys, p["name"])
    text = lambda p: F.try_variant_get(found[p["name"]], "$", "string")
    number = lambda p: F.try_variant_get(found[p["name"]], "$", "double")
    named = lambda word, cond: F.transform(F.filter(spec, cond), lambda p: F.concat(F.lit(word + " "), p["name"]))
    # An inner property is asked for where its object is there.
    missing = named("missing", lambda p: p["required"] & ~has(p) & (parent(p["name"]).isNull() | F.coalesce(
        types[parent(p["name"])].startswith("OBJECT<"), F.lit(False))))
    # An object whose inner properties no row names may hold any.
    free = lambda k: parent(k).isNotNull() & ~F.exists(spec, lambda p: parent(p["name"]) == parent(k))
    unknown = F.transform(F.filter(keys, lambda k: ~F.exists(spec, lambda p: p["name"] == k) & ~free(k)),
                          lambda k: F.concat(F.lit("unknown "), k))
    wrong = named("type", lambda p: has(p) & ~fits(p))
    other = named("value", lambda p: has(p) & fits(p) & p["allowed"].isNotNull() & ~F.coalesce(F.array_contains(p["allowed"], text(p)), F.lit(False)))
    beyond = named("bounds", lambda p: has(p) & fits(p) & F.coalesce((number(p) < p["minimum"]) | (number(p) > p["maximum"]), F.lit(False)))
    return (F.when(spec.isNull(), F.array(F.lit("unknown tool")))
             .when(value.isNull(), F.array(F.lit("not json")))
             .when(~F.coalesce(shape, F.lit("VOID")).startswith("OBJECT<"), F.array(F.lit("not an object")))
             .otherwise(F.array_sort(F.concat(missing, unknown, wrong, other, beyond))))


def specifications(schemas: DataFrame) -> DataFrame:
    """``tool, spec``; columns that ``schemas`` does not have are NULL."""
    kinds = {"allowed": "array<string>", "minimum": "double", "maximum": "double"}
    more = [(F.col(c) if c in schemas.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    return schemas.select("tool", F.struct("name", "type", "required", *more).alias("p")) \
                  .groupBy("tool").agg(F.array_sort(F.collect_set("p")).alias("spec"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per orphan result.

    ``calls(conv_id, turn, call_id, tool, arguments, after)``, ``results(conv_id,
    turn, call_id, content)``, ``schemas(tool, name, type, required)``.
    Returns ``conv_id, position, call_id, depth, turn, status, n_calls,
    n_results, errors, message``: ``position`` counts from 0 in the order of
    (no cycle first, depth, turn, call_id) and ``message`` is canonical JSON."""
    c = unique_calls(calls)
    d = cut(depths(c), "call-depths")
    r = results.select("conv_id", "call_id", F.col("turn").cast("long").alias("turn"), "content")
    once = cut(r.where("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results")), "results")
    loose = r.where("call_id is null").select("conv_id", "call_id", F.struct("turn", "content").alias("r"),
                                              F.lit(1).cast("long").alias("n_results"))
    spec = specifications(schemas)

    linked = c.join(d, "uid").join(spec, "tool", "left").join(once, ["conv_id", "call_id"], "left")
    graph = F.concat(F.when(F.col("on_cycle"), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")),
                     F.when(F.col("unknown_after"), F.array(F.lit("unknown after"))).otherwise(F.array().cast("array<string>")))
    linked = with_argument_errors(linked).withColumn("errors", F.concat("errors", graph))
    value = F.try_parse_json("arguments")
    # Fields in the order of their names; a NULL field is left out.
    message = F.to_json(F.struct(
        value.alias("arguments"), F.when(value.isNull(), F.col("arguments")).alias("arguments_text"), "call_id", "conv_id",
        "errors", F.col("tool").alias("name"), F.col("r.content").alias("result"), "turn"))
    done = linked.select(
        "conv_id", "call_id", F.when(F.col("on_cycle"), None).otherwise(F.col("depth")).alias("depth"), "turn",
        F.when(F.col("r").isNull(), "unanswered").otherwise("answered").alias("status"), "n_calls",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "errors", message.alias("message"))
    orphans = once.join(c.where("call_id is not null").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti") \
        .select("conv_id", "call_id", "r", "n_results").unionByName(loose)
    stray = orphans.select(
        "conv_id", "call_id", F.lit(None).cast("long").alias("depth"), F.col("r.turn").alias("turn"),
        F.lit("orphan").alias("status"), F.lit(0).cast("long").alias("n_calls"), "n_results",
        F.array().cast("array<string>").alias("errors"),
        F.to_json(F.struct("call_id", "conv_id", F.col("r.content").alias("result"), F.col("r.turn").alias("turn"))).alias("message"))
    rows = cut(done.unionByName(stray), "messages")

    # Positions from running counts over ranges of rows, so no task holds a whole conversation.
    order = [F.col("conv_id").isNull(), F.col("conv_id"), F.col("depth").isNull(), F.col("depth"), F.col("status") == "orphan",
             F.col("turn"), F.col("call_id"), F.col("message")]
    ranked = cut(global_running(rows, order, {"i": F.lit(1).cast("long")}, "positions"), "ranked")
    starts = cut(ranked.groupBy("conv_id").agg(F.min("i").alias("first")).withColumnRenamed("conv_id", "conv"), "starts")
    return ranked.join(starts, F.col("conv_id").eqNullSafe(F.col("conv"))).select(
        "conv_id", (F.col("i") - F.col("first")).alias("position"), "call_id", "depth", "turn", "status", "n_calls",
        "n_results", "errors", "message")
