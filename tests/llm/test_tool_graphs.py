"""Levels of call graphs, nested argument schemas and the order of conversations, against plain versions."""

import json

import numpy as np
import pytest

from cohortwise.llm import tool_calls
from cohortwise.shipping import ship

ROWS = "conv_id bigint, turn bigint, role string, text string"


def plain_levels(parents):
    known = {}

    def level(key, behind):
        if key in behind:
            return None
        if key not in known:
            above = [level(p, behind | {key}) for p in parents[key] if p in parents]
            known[key] = None if None in above else max(above, default=-1) + 1
        return known[key]
    # A call met inside a walk around a cycle must not keep a level of that walk: each key is asked afresh.
    out = {}
    for key in parents:
        known.clear()
        out[key] = level(key, frozenset())
    return out


def plain_problems(value, schema, path=""):
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def fits(kind):
        if kind in ("integer", "number"):
            return not isinstance(value, bool) and isinstance(value, int if kind == "integer" else (int, float))
        return isinstance(value, kinds[kind])
    found, name, below = [], path or "arguments", f"{path}." if path else ""
    types = schema.get("type", [])
    types = [types] if isinstance(types, str) else types
    if types and not any(map(fits, types)):
        found.append(f"{name}: not {' or '.join(types)}")
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{name}: not a listed value")
    if fits("number"):
        found += [f"{name}: below {limit}" for limit in [schema.get("minimum")] if limit is not None and value < limit]
        found += [f"{name}: above {limit}" for limit in [schema.get("maximum")] if limit is not None and value > limit]
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{name}: below {schema['minLength']}")
    if isinstance(value, dict):
        found += [f"{below}{f}: missing" for f in schema.get("required", []) if f not in value]
        for field, own in schema.get("properties", {}).items():
            found += plain_problems(value[field], own, f"{below}{field}") if field in value else []
        extra = sorted(set(value) - set(schema.get("properties", {})))
        found += [f"{below}unexpected: {','.join(extra)}"] if extra and schema.get("additionalProperties", True) is False else []
    if isinstance(value, list):
        found += [f"{name}: fewer than {limit}" for limit in [schema.get("minItems", 0)] if len(value) < limit]
        for item in value:
            found += plain_problems(item, schema.get("items", {}), f"{path}[]")
    return sorted(set(found))


@pytest.mark.parametrize("seed", [0, 1])
def test_levels_of_graphs(spark, seed):
    ship(spark)
    rng = np.random.default_rng(seed)
    parents = {f"n{k}": [f"n{p}" for p in rng.integers(0, max(k, 1), rng.integers(0, 3))] if k % 7 else [] for k in range(80)}
    parents |= {f"c{k}": [f"c{k - 1}"] for k in range(1, 60)} | {"c0": ["gone"], "m": ["c59", "c10", "n79"], "m2": ["m", "c3"], "tail": ["m2"]}
    parents |= {"x": ["y"], "y": ["x"], "behind": ["x", "c1"], "z": ["z"], "after z": ["z"], "p": ["q", "c0"], "q": ["p", "c0"]}
    rows = [(k, ps) for k, ps in parents.items()]
    got = {r.key: r.level for r in tool_calls.levels(spark.createDataFrame(rows, "key string, parents array<string>")).collect()}
    assert got == plain_levels(parents)
    assert got["m2"] == max(60, (got["n79"] or 0) + 1) + 1 and got["tail"] == got["m2"] + 1 and got["behind"] is got["after z"] is got["q"] is None
    assert tool_calls.levels(spark.createDataFrame([], "key string, parents array<string>")).count() == 0


def test_nested_schemas(spark):
    schema = {"search": {"type": "object", "required": ["query", "filters"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 2}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}, "exact": {"type": "boolean"},
        "mode": {"type": ["string", "null"], "enum": ["fast", "full", None]},
        "filters": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["field"], "properties": {"field": {"type": "string"}, "range": {"type": "array", "items": {"type": "number"}}}}}}}}
    good = {"query": "ab", "filters": [{"field": "x"}]}
    values = [good, {}, [], "text", 5, None, {**good, "limit": "3"}, {**good, "limit": 2.5}, {**good, "limit": 0}, {**good, "limit": 51}, {**good, "exact": "yes"}, {**good, "exact": True},
              {**good, "mode": None}, {**good, "mode": "slow"}, {**good, "mode": 3}, {**good, "query": 5}, {**good, "query": "a"}, {**good, "query": None}, {**good, "other": 1, "a": 2},
              {**good, "filters": []}, {**good, "filters": {}}, {**good, "filters": [{"field": 1}, {}, 7, {"field": "y", "range": [1, 2.5, "3"]}]}, {**good, "query": "x" * 300_000}]
    texts = [json.dumps(v) for v in values] + ["{broken", "", None, '{"query":"ab","query":"cd","filters":[{"field":"x"}]}']
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, arguments string").selectExpr("*", "if(k = 1000, null, 'search') AS name")
    from pyspark.sql import functions as F
    got = {r.k: r.found for r in df.select("k", tool_calls.problems(F.col("name"), F.col("arguments"), schema).alias("found")).collect()}
    for k, v in enumerate(values):
        assert got[k] == (plain_problems(v, schema["search"]) if isinstance(v, dict) else ["not an object"]), v
    assert all(got[k] == ["not an object"] for k in range(len(values), len(texts)))
    assert spark.range(1).select(tool_calls.problems(F.lit(None).cast("string"), F.lit("{}"), schema)).first()[0] == ["unknown function"]


def test_calls_with_several_predecessors_in_order(spark):
    ship(spark)
    call = lambda i, after=None, **arguments: {"id": i, "name": "respond", "arguments": json.dumps({"prompt": "p", "words": 1, **arguments}), "after": after}
    said = lambda turn, *calls, conv=1: (conv, turn, "assistant", json.dumps({"tool_calls": list(calls)}))
    rows = [said(0, call("sum", ["a", "b", "unknown"]), call("a")), said(1, call("b", "a"), call("last", ["sum"])), said(2, call("u", ["v"]), call("v", ["u", "a"])),
            (1, 3, "tool", '{"tool_call_id":"a","content":"done"}'), (1, 4, "tool", '{"tool_call_id":"?","content":"x"}'), said(0, call("[odd", "[odd2"), call("[odd2", words="3"), conv=2)]
    docs = spark.createDataFrame(rows, ROWS).selectExpr("*", "'clash' AS key", "'clash' AS level", "'clash' AS top")
    got = tool_calls.ordered(tool_calls.formatted(docs)).collect()
    assert [(r.conv_id, r.call_id, r.level, r.status) for r in got] == [
        (1, "a", 0, "linked"), (1, "b", 1, "open"), (1, "sum", 2, "open"), (1, "last", 3, "open"), (1, "u", None, "cycle"), (1, "v", None, "cycle"), (1, "?", None, "orphan"),
        (2, "[odd2", 0, "open"), (2, "[odd", 1, "open")]
    assert {r.call_id: r.problems for r in got if not r.valid} == {"[odd2": "words: not integer"}
