"""Compiled schemas against a plain walk over random documents and schemas."""

import json
import random
import re

import pytest

from tallyforge.sources import schema


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return a == b


def is_a(v, kind):
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    if kind in ("number", "integer"):
        return number and (kind == "number" or float(v).is_integer())
    return isinstance(v, {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}[kind])


def walk(s, v, root, path="$"):
    """(path, message) of all errors, keyword by keyword."""
    if isinstance(s, bool):
        return [] if s else [(path, "is not allowed")]
    out = []
    if "$ref" in s:
        out += walk(schema.json_pointer(root, s["$ref"][1:]), v, root, path)
    kinds = s.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(is_a(v, k) for k in kinds):
        return [*out, (path, f"is not of type {' or '.join(kinds)}")]
    bad = lambda c, m: out.append((path, m)) if c else None
    ok = lambda inner, x=v: not walk(inner, x, root)
    bad("enum" in s and not any(same(v, e) for e in s["enum"]), "is not one of the values allowed")
    bad("const" in s and not same(v, s.get("const")), f"is not {json.dumps(s.get('const'))}")
    if is_a(v, "number"):
        bad("minimum" in s and v < s["minimum"], f"breaks minimum {s.get('minimum')}")
        bad("exclusiveMaximum" in s and v >= s["exclusiveMaximum"], f"breaks exclusiveMaximum {s.get('exclusiveMaximum')}")
    if isinstance(v, str):
        bad(len(v) < s.get("minLength", 0), f"is shorter than {s.get('minLength')}")
        bad("pattern" in s and not re.search(s["pattern"], v), "doesn't match the pattern")
    if isinstance(v, list):
        bad(len(v) < s.get("minItems", 0), f"has under {s.get('minItems')} items")
        bad(len(v) > s.get("maxItems", 99), f"has over {s.get('maxItems')} items")
        bad(s.get("uniqueItems") and any(same(a, b) for i, a in enumerate(v) for b in v[:i]), "has equal items")
        bad("contains" in s and sum(ok(s["contains"], x) for x in v) < s.get("minContains", 1), "lacks an item that it must contain")
        for i, x in enumerate(v):
            out += walk(s.get("items", True), x, root, f"{path}[{i}]")
    if isinstance(v, dict):
        out += [(path, f"lacks {k}") for k in s.get("required", []) if k not in v]
        for k, x in v.items():
            out += walk(s.get("properties", {}).get(k, s.get("additionalProperties", True)), x, root, f"{path}.{k}")
    for inner in s.get("allOf", []):
        out += walk(inner, v, root, path)
    bad("anyOf" in s and not any(ok(x) for x in s["anyOf"]), "fits none of the alternatives")
    bad("oneOf" in s and sum(ok(x) for x in s["oneOf"]) != 1, "doesn't fit exactly one alternative")
    bad("not" in s and ok(s["not"]), "fits what it must not")
    if "if" in s:
        branch = "then" if ok(s["if"]) else "else"
        out += walk(s.get(branch, True), v, root, path)
    return out


def random_schema(r, depth=0):
    scalar = lambda: r.choice([None, True, False, 0, 1, 1.0, 2.5, "a", "ab"])
    s = {}
    if r.random() < 0.5:
        s["type"] = r.choice(["object", "array", "string", "number", "integer", "boolean", "null", ["string", "null"], ["object", "array"]])
    for word, make in {
        "enum": lambda: [scalar() for _ in range(3)], "const": scalar, "minimum": lambda: r.choice([0, 1.5]), "exclusiveMaximum": lambda: 2, "minLength": lambda: 2, "pattern": lambda: "^a",
        "minItems": lambda: 1, "maxItems": lambda: 2, "uniqueItems": lambda: r.random() < 0.8, "required": lambda: r.sample(["a", "b", "c"], r.randint(0, 2)),
        "additionalProperties": lambda: r.choice([True, False, {"type": "integer"}]),
    }.items():
        if r.random() < 0.13:
            s[word] = make()
    if depth < 2:
        sub = lambda: random_schema(r, depth + 1)
        for word, make in {
            "properties": lambda: {k: sub() for k in r.sample(["a", "b", "x y", "q'.r"], 2)}, "items": sub, "contains": sub, "allOf": lambda: [sub(), sub()], "anyOf": lambda: [sub(), sub()],
            "oneOf": lambda: [sub(), sub()], "not": sub, "if": sub, "$ref": lambda: "#/$defs/d",
        }.items():
            if r.random() < 0.22:
                s[word] = make()
        if "if" in s:
            s |= {w: sub() for w in ("then", "else") if r.random() < 0.7}
        if "contains" in s and r.random() < 0.5:
            s["minContains"] = r.choice([0, 2])
    return s


def random_value(r, depth=0):
    kind = r.random()
    if depth < 3 and kind < 0.35:
        return {k: random_value(r, depth + 1) for k in r.sample(["a", "b", "c", "x y", "q'.r"], r.randint(0, 4))}
    if depth < 3 and kind < 0.6:
        return [random_value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return r.choice([None, True, False, 0, 1, 1.0, 2.5, -3, "a", "ab", "", "ü"])


@pytest.mark.parametrize("seed", range(12))
def test_random_schemas_and_documents(spark, seed):
    r = random.Random(seed)
    s = random_schema(r) | {"$defs": {"d": random_schema(r, 2)}}
    values = [random_value(r) for _ in range(80)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id long, d string")
    got = sorted((x.id, x.path, x.message) for x in schema.schema_errors(df, "id", "d", {"s": s}, "s").collect())
    assert got == sorted({(i, p, m) for i, v in enumerate(values) for p, m in walk(s, v, s)}), s


def test_keywords_that_are_not_known_raise(spark):
    df = spark.createDataFrame([(1, "{}")], "id long, d string")
    for bad in ({"patternProperties": {}}, {"properties": {"a": {"format": "uri"}}}, {"type": "text"}, {"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}):
        with pytest.raises(ValueError):
            schema.schema_errors(df, "id", "d", {"s": bad}, "s")
    with pytest.raises(KeyError):
        schema.schema_errors(df, "id", "d", {"s": {"$ref": "gone.json"}}, "s")


def test_strictness_and_odd_documents(spark):
    rows = [(1, None), (2, "{"), (3, '{"a": 1, "a": 2}'), (4, '{"a": NaN}'), (5, "9" * 400), (6, "[" * 3000 + "]" * 3000), (7, "true"), (8, "1"), (9, "1.0"), (10, '"2024-02-30T00:00:00Z"'), (11, '"2024-02-28t00:00:00.5+01:00"'), (12, '"2024-02-28"')]
    df = spark.createDataFrame(rows, "id long, d string")
    got = {}
    for x in schema.schema_errors(df, "id", "d", {"s": {"enum": [1], "format": "date-time"}}, "s").collect():
        got.setdefault(x.id, set()).add(x.message)
    assert all(got[i] == {"is not JSON"} for i in (1, 2, 3, 4)) and 5 in got and 6 in got
    one = "is not one of the values allowed"
    assert got[7] == {one} and 8 not in got and 9 not in got
    assert got[10] == {one, "is not a date-time"} and got[11] == {one} and got[12] == {one, "is not a date-time"}


def test_references_between_schemas(spark):
    s = {"a": {"type": "object", "properties": {"x": {"$ref": "b#/$defs/list"}}, "allOf": [{"if": {"required": ["y"]}, "then": {"required": ["z"]}}]}, "b": {"$defs": {"list": {"type": "array", "items": {"$ref": "#/$defs/n"}, "minContains": 2, "contains": {"const": 1}}, "n": {"type": "integer"}}}}
    df = spark.createDataFrame([(1, '{"x": [1, 1, "q"], "y": 0}'), (2, '{"x": [1]}'), (3, "{}")], "id long, d string")
    got = sorted((x.id, x.path, x.message) for x in schema.schema_errors(df, "id", "d", s, "a").collect())
    assert got == [(1, "$", "lacks z"), (1, "$.x[2]", "is not of type integer"), (2, "$.x", "lacks an item that it must contain")]
