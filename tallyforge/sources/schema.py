"""JSON documents against schemas: one row per error.

A set of schemas is a small mapping of names; ``$ref`` may point into the same schema or into another one
(``other.json#/$defs/row``).  A schema is compiled once, on the driver, to a Column over a variant: references are put in
place, every keyword becomes an expression, objects are maps of their fields and lists are transformed item by item.
So documents are checked inside the JVM, where they lie.  A keyword that isn't known raises at once; nothing is skipped.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import strict_json

_ERRORS = "array<struct<path:string,message:string>>"
_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
#: Keywords that say nothing about a document.
NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly"}
#: Times of day with an offset, as RFC 3339 writes them.
_DATE_TIME = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[Tt]([01][0-9]|2[0-3]):[0-5][0-9]:([0-5][0-9]|60)([.][0-9]+)?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
_BOUNDS = {"minimum": lambda a, b: a < b, "maximum": lambda a, b: a > b, "exclusiveMinimum": lambda a, b: a <= b, "exclusiveMaximum": lambda a, b: a >= b}
_SIZES = {
    "minLength": (True, "is shorter than {}"), "maxLength": (False, "is longer than {}"), "minItems": (True, "has under {} items"), "maxItems": (False, "has over {} items"),
    "minProperties": (True, "has under {} fields"), "maxProperties": (False, "has over {} fields"),
}


def json_pointer(document, pointer: str):
    """What ``/a/0/b`` points to; KeyError where nothing is there."""
    for raw in pointer.split("/")[1:]:
        part = raw.replace("~1", "/").replace("~0", "~")
        try:
            document = document[int(part)] if isinstance(document, list) else document[part]
        except (IndexError, ValueError, TypeError) as e:
            raise KeyError(pointer) from e
    return document


def _none() -> Column:
    return F.array().cast(_ERRORS)


def _error(path: Column, message: str | Column) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(path.alias("path"), message.alias("message"))).cast(_ERRORS)


def _unless(good: Column, path: Column, message: str) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), _none()).otherwise(_error(path, message))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.flatten(F.transform(F.array(value), use))


class _Value:
    """A variant inside an expression, with its shape."""

    def __init__(self, bound: Column):
        self.variant, self.shape = bound["v"], bound["s"]

    def typed(self, kind: str) -> Column:
        return F.try_variant_get(self.variant, "$", kind)

    def is_(self, kind: str) -> Column:
        if kind == "integer":
            return self.shape.rlike(_NUMBER) & (self.shape.startswith("BIGINT") | (self.typed("double") % 1 == 0))
        tests = {
            "number": self.shape.rlike(_NUMBER), "object": self.shape.startswith("OBJECT"), "array": self.shape.startswith("ARRAY"), "string": self.shape == "STRING",
            "boolean": self.shape == "BOOLEAN", "null": self.shape == "VOID",
        }
        if kind not in tests:
            raise ValueError(f"unknown type {kind}")
        return tests[kind]

    def equals(self, wanted) -> Column:
        """JSON equality; numbers are equal by value, but no number equals a boolean.  Inside lists and objects numbers
        compare as they are written."""
        if wanted is None:
            return self.is_("null")
        if isinstance(wanted, bool):
            return self.is_("boolean") & (self.typed("boolean") == wanted)
        if isinstance(wanted, (int, float)):
            return self.is_("number") & (self.typed("double") == float(wanted))
        if isinstance(wanted, str):
            return self.is_("string") & (self.typed("string") == wanted)
        return F.to_json(self.variant) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))


def _bound(variant: Column) -> Column:
    return F.struct(variant.alias("v"), F.schema_of_variant(variant).alias("s"))


class SchemaSet:
    """Schemas by name, compiled on demand."""

    def __init__(self, schemas: dict[str, dict]):
        self.schemas = schemas

    def resolve(self, ref: str, name: str) -> tuple[dict, str]:
        file, _, pointer = ref.partition("#")
        name = file or name
        if name not in self.schemas:
            raise KeyError(f"unknown schema {name}")
        return json_pointer(self.schemas[name], pointer), name

    def errors(self, document: Column, name: str) -> Column:
        """An array of (path, message) of every error of a variant that isn't null."""
        return self._check(self.schemas[name], name, document, F.lit("$"), ())

    def _check(self, schema, home: str, variant: Column, path: Column, seen: tuple) -> Column:
        if isinstance(schema, bool):
            return _none() if schema else _error(path, "is not allowed")
        return _let(_bound(variant), lambda b: self._keywords(schema, home, _Value(b), path, seen))

    def _keywords(self, schema: dict, home: str, value: _Value, path: Column, seen: tuple) -> Column:
        unknown = set(schema) - NOTES - set(_KEYWORDS) - {"type", "$ref", "then", "else", "minContains", "maxContains"}
        if unknown:
            raise ValueError(f"unknown keywords: {', '.join(sorted(unknown))}")
        found = [rule(self, schema, home, value, path, seen) for word, rule in _KEYWORDS.items() if word in schema]
        out = F.concat(*found) if found else _none()
        if "type" in schema:
            kinds = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            fits = F.lit(False)
            for k in kinds:
                fits = fits | F.coalesce(value.is_(k), F.lit(False))
            out = F.when(fits, out).otherwise(_error(path, f"is not of type {' or '.join(kinds)}"))
        if "$ref" in schema:
            target, where = self.resolve(schema["$ref"], home)
            step = (where, schema["$ref"].partition("#")[2])
            if step in seen:
                raise ValueError(f"{schema['$ref']} leads back to itself")
            out = F.concat(self._check(target, where, value.variant, path, (*seen, step)), out)
        return out

    def _fails(self, schema, home, variant, seen) -> Column:
        return F.size(self._check(schema, home, variant, F.lit(""), seen)) > 0


def _when(kind: str, value: _Value, out: Column) -> Column:
    return F.when(F.coalesce(value.is_(kind), F.lit(False)), out).otherwise(_none())


def _enum(s, schema, home, value, path, seen):
    hit = F.lit(False)
    for wanted in schema["enum"]:
        hit = hit | F.coalesce(value.equals(wanted), F.lit(False))
    return _unless(hit, path, "is not one of the values allowed")


def _const(s, schema, home, value, path, seen):
    return _unless(value.equals(schema["const"]), path, f"is not {json.dumps(schema['const'])}")


def _bound_rule(word):
    def rule(s, schema, home, value, path, seen):
        number = value.typed("double")
        return _when("number", value, F.when(_BOUNDS[word](number, F.lit(float(schema[word]))), _error(path, f"breaks {word} {schema[word]}")).otherwise(_none()))

    return rule


def _size_rule(word):
    kind = "string" if word.endswith("Length") else "array" if word.endswith("Items") else "object"
    least, message = _SIZES[word]

    def rule(s, schema, home, value, path, seen):
        size = F.char_length(value.typed("string")) if kind == "string" else F.size(value.typed("array<variant>" if kind == "array" else "map<string,variant>"))
        return _when(kind, value, _unless(size >= schema[word] if least else size <= schema[word], path, message.format(schema[word])))

    return rule


def _pattern(s, schema, home, value, path, seen):
    return _when("string", value, _unless(value.typed("string").rlike(schema["pattern"]), path, "doesn't match the pattern"))


def _format(s, schema, home, value, path, seen):
    if schema["format"] != "date-time":
        raise ValueError(f"unknown format {schema['format']}")
    text = value.typed("string")
    day = F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull()
    return _when("string", value, _unless(text.rlike(_DATE_TIME) & day, path, "is not a date-time"))


def _unique(s, schema, home, value, path, seen):
    if not schema["uniqueItems"]:
        return _none()
    items = F.transform(value.typed("array<variant>"), lambda v: F.coalesce(F.when(F.schema_of_variant(v).rlike(_NUMBER), F.try_variant_get(v, "$", "double").cast("string")), F.to_json(v)))
    return _when("array", value, _unless(F.size(F.array_distinct(items)) == F.size(items), path, "has equal items"))


def _items(s, schema, home, value, path, seen):
    each = lambda v, i: s._check(schema["items"], home, v, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), seen)
    return _when("array", value, F.flatten(F.transform(value.typed("array<variant>"), each)))


def _contains(s, schema, home, value, path, seen):
    least, most = schema.get("minContains", 1), schema.get("maxContains")
    n = F.size(F.filter(value.typed("array<variant>"), lambda v: ~s._fails(schema["contains"], home, v, seen)))
    good = (n >= least) & (F.lit(True) if most is None else n <= most)
    return _when("array", value, _unless(good, path, "lacks an item that it must contain" if most is None else f"doesn't contain {least} to {most} such items"))


def _required(s, schema, home, value, path, seen):
    lost = F.array_except(F.array(*map(F.lit, schema["required"])).cast("array<string>"), F.map_keys(value.typed("map<string,variant>")))
    return _when("object", value, F.transform(lost, lambda k: F.struct(path.alias("path"), F.concat(F.lit("lacks "), k).alias("message"))).cast(_ERRORS))


def _properties(s, schema, home, value, path, seen):
    if not schema["properties"]:
        return _none()

    def of(held, key, inner):
        check = lambda v: s._check(inner, home, v, F.concat(path, F.lit(f".{key}")), seen)
        return F.when(F.map_contains_key(held, key), _let(F.try_element_at(held, F.lit(key)), check)).otherwise(_none())

    def fields(held):
        return F.concat(*[of(held, key, inner) for key, inner in schema["properties"].items()])

    return _when("object", value, _let(value.typed("map<string,variant>"), fields))


def _additional(s, schema, home, value, path, seen):
    inner = schema["additionalProperties"]
    if inner is True:
        return _none()
    known = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
    others = F.filter(F.map_entries(value.typed("map<string,variant>")), lambda e: ~F.array_contains(known, e["key"]))
    place = lambda e: F.concat(path, F.lit("."), e["key"])
    return _when("object", value, F.flatten(F.transform(others, lambda e: s._check(inner, home, e["value"], place(e), seen))))


def _all_of(s, schema, home, value, path, seen):
    return F.concat(*[s._check(inner, home, value.variant, path, seen) for inner in schema["allOf"]])


def _count(s, schema, home, value, seen, word):
    return sum((F.when(s._fails(inner, home, value.variant, seen), 0).otherwise(1) for inner in schema[word]), F.lit(0))


def _any_of(s, schema, home, value, path, seen):
    return _unless(_count(s, schema, home, value, seen, "anyOf") > 0, path, "fits none of the alternatives")


def _one_of(s, schema, home, value, path, seen):
    return _unless(_count(s, schema, home, value, seen, "oneOf") == 1, path, "doesn't fit exactly one alternative")


def _not(s, schema, home, value, path, seen):
    return _unless(s._fails(schema["not"], home, value.variant, seen), path, "fits what it must not")


def _if(s, schema, home, value, path, seen):
    branch = lambda word: s._check(schema[word], home, value.variant, path, seen) if word in schema else _none()
    return F.when(s._fails(schema["if"], home, value.variant, seen), branch("else")).otherwise(branch("then"))


_KEYWORDS = {
    "enum": _enum, "const": _const, "pattern": _pattern, "format": _format, "uniqueItems": _unique, "items": _items, "contains": _contains, "required": _required, "properties": _properties,
    "additionalProperties": _additional, "allOf": _all_of, "anyOf": _any_of, "oneOf": _one_of, "not": _not, "if": _if, **{w: _bound_rule(w) for w in _BOUNDS}, **{w: _size_rule(w) for w in _SIZES},
}


def schema_errors(df: DataFrame, key: str, document: str, schemas: dict[str, dict], name: str) -> DataFrame:
    """(key, path, message) of every error of every document; one that isn't strict JSON (repeated keys, NaN), or null, has
    the error of its own at ``$``.  A key may repeat; an empty table gives no rows."""
    errors = SchemaSet(schemas).errors(F.col("_doc"), name)
    rows = df.select(F.col(key), strict_json.parse(F.col(document)).alias("_doc"))
    found = F.when(F.col("_doc").isNull(), _error(F.lit("$"), "is not JSON")).otherwise(errors)
    return rows.select(F.col(key), F.inline(F.array_distinct(found)))
