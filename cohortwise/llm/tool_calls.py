"""Chat formatting: link tool calls with their results, order and validate them, serialise canonical JSON.

Messages that are JSON objects may carry calls (``{"tool_calls": [{"id", "name", "arguments", "after"}]}``) or a result
(``{"tool_call_id", "content"}``). Any other message is plain chat: a turn that no other answers is the call of
``respond`` with its text as prompt, and the assistant turn right after it is the result. Calls and results are hash-joined by
identifier. ``after`` names the call or the list of calls that must come first (plain turns: the call two turns earlier). A call's level is
the longest way to it from a call without predecessor. Stretches of calls with one predecessor are shortened by pointer doubling, about
log2(n) joins for n calls; the calls with several, and they alone, are levelled in rounds, one for each that lies behind another. No
conversation is gathered in one task; ``ordered`` sorts all of them by ranges. Arguments are checked against the schema of their
function, nested objects and arrays included. The JSON has sorted keys and no white space.

Schemas are dictionaries: ``type`` (object, array, string, number, integer, boolean, null, or a list of these), ``enum``, ``minimum``,
``maximum``, ``minLength``, ``properties``, ``required``, ``additionalProperties`` (False: no others), ``items``, ``minItems``.

Defined cases: identifiers are unique per conversation; of calls (results) that share one, the earliest turn, then the smallest JSON,
is linked, the others come out with status ``duplicate``. A call without result is ``open``, a result without call
``orphan``. Calls in or behind a cycle have level NULL and status ``cycle``. A dangling predecessor counts as none. Arguments that no
parser takes (repeated keys too) are not an object. A NULL or very long text is judged whole. NULL
text is the empty text, NULL conv_id and turn are values of their own; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortwise.llm.common import drop_written, let, whole, written

MESSAGE = "tool_calls array<struct<id:string,name:string,arguments:string,after:string>>, tool_call_id string, content string"
#: Argument schemas by function.
SCHEMAS = {"respond": {"type": "object", "required": ["prompt", "words"], "additionalProperties": False,
                       "properties": {"prompt": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1}}}}


def events(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (conv, id, turn, name, arguments, after) and results (conv, id, turn, content) of all messages."""
    rows = messages.select(F.col("conv_id").alias("conv"), "turn", "role", whole().alias("text"))
    rows = rows.withColumn("body", F.when(F.rlike("text", F.lit("^\\s*\\{")), F.from_json("text", MESSAGE)))
    structured = F.col("body").isNotNull() & (F.col("body.tool_calls").isNotNull() | F.col("body.tool_call_id").isNotNull())
    told = written(rows.withColumn("structured", F.coalesce(structured, F.lit(False))), "messages")
    plain, name = told.where("not structured"), F.concat(F.lit("turn-"), F.coalesce(F.col("turn").cast("string"), F.lit("none")))
    earlier = F.concat(F.lit("turn-"), (F.col("turn") - 2).cast("string"))
    answered = F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string"))
    asks = F.coalesce(F.col("role"), F.lit("")) != "assistant"
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), words.alias("words")))
    calls = plain.where(asks).select("conv", name.alias("id"), "turn", F.lit("respond").alias("name"), arguments.alias("arguments"), earlier.alias("after"))
    own = told.where("structured").select("conv", "turn", F.explode("body.tool_calls").alias("call")).select("conv", "call.id", "turn", "call.name", "call.arguments", "call.after")
    results = plain.where(~asks).select("conv", answered.alias("id"), "turn", F.col("text").alias("content"))
    returned = told.where("structured AND body.tool_call_id IS NOT NULL").select("conv", F.col("body.tool_call_id").alias("id"), "turn", F.col("body.content").alias("content"))
    return calls.unionByName(own), results.unionByName(returned)


def _key() -> Column:
    """Identifier within all conversations; NULL parts are told from texts."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n"))
    return F.concat_ws("/", part("conv"), part("id"))


def _first(rows: DataFrame, detail: list[str]) -> DataFrame:
    """Rows with ``copy``: 0 for the one of its key that is linked; equal rows count as one with ``times``."""
    shape = ["key", "conv", "id", "turn", *detail]
    counted = rows.withColumn("key", _key()).groupBy(*shape).agg(F.count(F.lit(1)).alias("times"))
    rank = F.struct("turn", *detail)
    best = counted.groupBy("key").agg(F.min(rank).alias("best")).withColumnRenamed("key", "own")
    joined = counted.join(best, F.col("key") == F.col("own"), "left").withColumn("linked", rank.eqNullSafe(F.col("best")))
    return joined.drop("own", "best")


def predecessors(after: Column) -> Column:
    """Identifiers in ``after``: one as plain text, or a JSON list."""
    several = F.when(F.startswith(after, F.lit("[")), F.from_json(after, "array<string>"))
    return F.array_distinct(F.array_compact(F.coalesce(several, F.array(after))))


def _chains(calls: DataFrame) -> DataFrame:
    """(key, top, steps): the call that a stretch of single predecessors begins with, and the steps from there; ``top`` is NULL in or
    behind a cycle of such calls. ``calls`` is (key, up): NULL ``up`` begins a stretch."""
    spark = calls.sparkSession
    now = written(calls.select("key", "up", F.coalesce("up", "key").alias("top"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("steps")), "chains")
    for _ in range(math.ceil(math.log2(max(now.count(), 1))) + 1):
        if now.where("up IS NOT NULL").isEmpty():
            break
        above = now.select(F.col("key").alias("over"), F.col("up").alias("next"), F.col("top").alias("higher"), F.col("steps").alias("more"))
        after = written(now.join(above, F.col("up") == F.col("over"), "left").select(
            "key", F.col("next").alias("up"), F.coalesce("higher", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chains")
        drop_written(spark, [now.scratch])
        now = after
    return now.select("key", F.when(F.col("up").isNull(), F.col("top")).alias("top"), "steps")


def levels(calls: DataFrame) -> DataFrame:
    """(key, level) of linked calls (key, parents): the longest way from a call without predecessor, NULL in or behind a cycle."""
    spark = calls.sparkSession
    known = calls.select(F.col("key").alias("up"))
    edges = written(calls.select("key", F.explode("parents").alias("up")).join(known, "up", "left_semi").select("key", "up").distinct(), "predecessors")
    single = edges.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("up"))
    begun = calls.select("key").join(single, "key", "left").select("key", F.when(F.col("n") == 1, F.col("up")).alias("up"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("meets"))
    begun = written(begun, "begun")
    chains = written(_chains(begun.select("key", "up")), "stretches")
    meets = begun.where("meets").select("key")
    # Where several ways meet: the tops that the ways come from, and how long they are.
    ways = (edges.join(meets, "key").join(chains.withColumnRenamed("key", "up"), "up")
            .groupBy("key", "top").agg((F.max("steps") + 1).alias("length")))
    open_ = written(ways.withColumn("reached", F.lit(None).cast("bigint")), "ways")
    tops = begun.where("up IS NULL and not meets").select(F.col("key").alias("top"), F.lit(0).cast("bigint").alias("level"))
    found = [written(tops, "levelled")]
    while True:
        # A way from a call that has a level now ends in a number; a meeting where all ways do has its level.
        based = open_.join(found[-1].withColumnRenamed("level", "base"), "top", "left")
        told = written(based.select("key", "top", "length", F.coalesce("reached", F.col("base") + F.col("length")).alias("reached")), "ways")
        drop_written(spark, [open_.scratch])
        done = told.groupBy("key").agg(F.max("reached").alias("level"), F.count_if(F.col("reached").isNull()).alias("waits")).where("waits = 0")
        new = written(done.select(F.col("key").alias("top"), "level"), "levelled")
        if new.isEmpty():  # the rest lies in or behind cycles
            break
        found.append(new)
        open_ = written(told.join(new.select(F.col("top").alias("key")), "key", "left_anti"), "ways")
        drop_written(spark, [told.scratch])
    bases = found[0]
    for more in found[1:]:
        bases = bases.unionByName(more)
    return chains.join(bases, "top", "left").select("key", (F.col("level") + F.col("steps")).alias("level"))


#: Names that a parsed value gives its type.
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "integer": "^BIGINT", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "null": "^VOID"}


def _check(value: Column, schema: dict, path: str) -> list[Column]:
    """Arrays of problems of a parsed value that is there."""
    name = path or "arguments"
    kind = F.schema_of_variant(value)
    is_ = lambda t: F.rlike(kind, F.lit(_KINDS[t]))
    one = lambda wrong, text: F.when(value.isNotNull() & wrong, F.array(F.lit(f"{name}: {text}"))).otherwise(F.array().cast("array<string>"))
    found = []
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types:
        fits = is_(types[0])
        for t in types[1:]:
            fits = fits | is_(t)
        found.append(one(~fits, f"not {' or '.join(types)}"))
    if "enum" in schema:
        found.append(one(~F.coalesce(F.to_json(value).isin([json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in schema["enum"]]), F.lit(False)), "not a listed value"))
    number = F.when(is_("number"), F.try_variant_get(value, "$", "double"))
    for rule, wrong in (("minimum", lambda limit: number < limit), ("maximum", lambda limit: number > limit)):
        if rule in schema:
            found.append(one(F.coalesce(wrong(schema[rule]), F.lit(False)), f"{'below' if rule == 'minimum' else 'above'} {schema[rule]}"))
    if "minLength" in schema:
        found.append(one(F.coalesce(is_("string") & (F.length(F.try_variant_get(value, "$", "string")) < schema["minLength"]), F.lit(False)), f"below {schema['minLength']}"))
    if {"properties", "required", "additionalProperties"} & set(schema):
        fields = F.when(is_("object"), F.try_variant_get(value, "$", "map<string,variant>"))
        below = f"{path}." if path else ""
        for field in schema.get("required", []):
            missing = fields.isNotNull() & ~F.coalesce(F.map_contains_key(fields, field), F.lit(False))
            found.append(F.when(missing, F.array(F.lit(f"{below}{field}: missing"))).otherwise(F.array().cast("array<string>")))
        for field, own in schema.get("properties", {}).items():
            found += _check(F.try_element_at(fields, F.lit(field)), own, f"{below}{field}")
        if schema.get("additionalProperties", True) is False:
            extra = F.filter(F.map_keys(fields), lambda k: ~k.isin(*schema.get("properties", {})))
            text = F.concat(F.lit(f"{below}unexpected: "), F.array_join(F.array_sort(extra), ","))
            found.append(F.when(F.size(extra) > 0, F.array(text)).otherwise(F.array().cast("array<string>")))
    if {"items", "minItems"} & set(schema):
        items = F.when(is_("array"), F.try_variant_get(value, "$", "array<variant>"))
        if "minItems" in schema:
            found.append(one(F.coalesce(F.size(items) < schema["minItems"], F.lit(False)), f"fewer than {schema['minItems']}"))
        if "items" in schema:
            found.append(F.coalesce(F.flatten(F.transform(items, lambda v: F.concat(*_check(v, schema["items"], f"{path}[]")))), F.array().cast("array<string>")))
    return found or [F.array().cast("array<string>")]


def problems(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """Sorted list of what is wrong with the arguments."""
    def judged(value: Column) -> Column:
        object_ = F.coalesce(F.rlike(F.schema_of_variant(value), F.lit(_KINDS["object"])), F.lit(False))
        found = F.when(~object_, F.array(F.lit("not an object"))).otherwise(F.array().cast("array<string>"))
        unknown = F.when(~F.coalesce(name.isin(*schemas), F.lit(False)), F.array(F.lit("unknown function"))).otherwise(F.array().cast("array<string>"))
        own = [F.when((name == function) & object_, F.concat(*_check(value, schema, ""))).otherwise(F.array().cast("array<string>")) for function, schema in schemas.items()]
        return F.array_sort(F.array_distinct(F.concat(found, unknown, *own)))
    return let(F.try_parse_json(arguments), judged)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows of ``formatted`` conversation by conversation, calls behind their predecessors: sorted by ranges, so that a conversation of any length
    is spread over tasks. Calls without level come last, results without call behind them."""
    return rows.orderBy(F.asc_nulls_first("conv_id"), F.asc_nulls_last("level"), F.asc_nulls_last("turn"), F.asc_nulls_last("result_turn"), "call_id", "status", "json")


def canonical(*fields: tuple[str, Column]) -> Column:
    """JSON of a flat object with sorted keys; NULL fields are left out."""
    return F.to_json(F.struct(*[value.alias(name) for name, value in sorted(fields, key=lambda f: f[0])]))


def formatted(messages: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call and per unlinked result: conv_id, call_id, turn, result_turn, level, status, valid, problems, json."""
    calls, results = events(messages)
    calls = written(_first(calls, ["name", "arguments", "after"]), "calls")
    results = written(_first(results, ["content"]), "results")
    part = F.coalesce(F.concat(F.lit("v"), F.col("conv").cast("string")), F.lit("n"))
    parents = F.transform(predecessors(F.col("after")), lambda own: F.concat(part, F.lit("/v"), own))
    linked = calls.where("linked")
    depth = levels(linked.select("key", parents.alias("parents"))).withColumnRenamed("key", "deep")
    answer = results.where("linked").select(F.col("key").alias("answered"), F.col("turn").alias("result_turn"), "content")
    first = linked.join(depth, F.col("key") == F.col("deep"), "left").join(answer, F.col("key") == F.col("answered"), "left")
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("answered").isNull(), "open").otherwise("linked")
    none = F.lit(None)
    columns = ["conv", "id", "turn", "name", "arguments", "result_turn", "content", "level", "status", "times"]
    rows = first.withColumn("status", status).select(*columns)
    more = calls.where("not linked").select("conv", "id", "turn", "name", "arguments", none.cast("bigint").alias("result_turn"), none.cast("string").alias("content"),
                                            none.cast("bigint").alias("level"), F.lit("duplicate").alias("status"), "times")
    loose = (results.join(linked.select(F.col("key").alias("asked")), F.col("key") == F.col("asked"), "left").where("asked IS NULL OR not linked")
             .select("conv", "id", none.cast("bigint").alias("turn"), none.cast("string").alias("name"), none.cast("string").alias("arguments"), F.col("turn").alias("result_turn"),
                     "content", none.cast("bigint").alias("level"), F.when(F.col("asked").isNull(), "orphan").otherwise("duplicate").alias("status"), "times"))
    out = rows.unionByName(more).unionByName(loose)
    wrong = F.when(F.col("name").isNull() & F.col("arguments").isNull(), F.array().cast("array<string>")).otherwise(problems(F.col("name"), F.col("arguments"), schemas))
    out = out.withColumn("problems", F.array_join(wrong, "; "))
    # A parsed value writes its keys sorted at every depth; what is no JSON stays a string.
    line = canonical(("arguments", F.expr("coalesce(try_parse_json(arguments), cast(arguments as variant))")), ("content", F.col("content")), ("id", F.col("id")), ("level", F.col("level")),
                     ("name", F.col("name")), ("status", F.col("status")))
    return out.withColumn("json", line).select(
        F.col("conv").alias("conv_id"), F.col("id").alias("call_id"), "turn", "result_turn", "level", "status", (F.col("problems") == "").alias("valid"), "problems", "json", "times")
