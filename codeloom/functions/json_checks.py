"""Checks of JSON texts against a small schema language, as columns over Variant values: no Python worker, a bad text hides no other.

A schema is a dict of ``type, const, enum, oneOf, pattern, visibleContent, minLength, maxLength, minimum, maximum, minItems, maxItems,
uniqueItems, items, required, properties, additionalProperties``, compiled into one expression.  A number without a fraction is an integer.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a document.
MAX_DEPTH, MAX_ITEMS, MAX_VALUES, MAX_ERRORS = 64, 1000, 500_000, 100
_KINDS = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "boolean": "^BOOLEAN$", "null": "^VOID$", "integer": r"^(?:BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(.*\))$"}


def _none() -> Column:
    return F.array().cast("array<string>")


def _if(wrong: Column, *message: Column | str) -> Column:
    text = F.concat(*[m if isinstance(m, Column) else F.lit(m) for m in message])
    return F.when(wrong, F.array(text)).otherwise(_none())


def _member(value: Column, name: str, kind: str = "variant") -> Column:
    path = f"$.{name}" if re.fullmatch(r"[A-Za-z_]\w*", name) else f"$['{name}']"
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(_KINDS[kind]), F.lit(False))


def _equals(value: Column, wanted: Any) -> Column:
    kind = {bool: "boolean", str: "string", int: "integer", float: "number"}[type(wanted)]
    got = F.try_variant_get(value, "$", {"integer": "decimal(38,0)", "number": "double"}.get(kind, kind))
    return _is(value, kind) & F.coalesce(got == F.lit(wanted), F.lit(False))


def errors_of(value: Column, schema: Mapping[str, Any], at: Column | str = "$") -> Column:
    """What a Variant breaks of a schema, as an array of texts; ``at`` is the path of the value."""
    at = F.lit(at) if isinstance(at, str) else at
    found = []
    if "const" in schema:
        found.append(_if(~_equals(value, schema["const"]), at, f": expected {schema['const']!r}"))
    if "enum" in schema:
        known = F.lit(False)
        for wanted in schema["enum"]:
            known = known | _equals(value, wanted)
        found.append(_if(~known, at, ": not one of the allowed values"))
    if "oneOf" in schema:
        fits = F.lit(0)
        for way in schema["oneOf"]:
            fits = fits + (F.size(errors_of(value, way, at)) == 0).cast("int")
        found.append(_if(fits != 1, at, ": fits ", fits.cast("string"), " of the alternatives"))
    found += [*_text_errors(value, schema, at), *_number_errors(value, schema, at), *_array_errors(value, schema, at), *_object_errors(value, schema, at)]
    every = F.concat(_none(), *found)
    if "type" not in schema:
        return every
    return F.when(_is(value, schema["type"]), every).otherwise(F.array(F.concat(at, F.lit(f": expected {schema['type']}"))))


def _text_errors(value: Column, schema: Mapping[str, Any], at: Column) -> list[Column]:
    text, found = F.when(_is(value, "string"), F.try_variant_get(value, "$", "string")), []
    if "pattern" in schema:
        found.append(_if(~text.rlike(schema["pattern"]), at, ": does not have the expected form"))
    if schema.get("visibleContent"):
        found.append(_if(~text.rlike(r"[^\p{C}\p{Z}]"), at, ": has no visible content"))
    if "minLength" in schema or "maxLength" in schema:
        found.append(_if(~F.char_length(text).between(schema.get("minLength", 0), schema.get("maxLength", 1 << 30)), at, ": wrong length"))
    return found


def _number_errors(value: Column, schema: Mapping[str, Any], at: Column) -> list[Column]:
    if "minimum" not in schema and "maximum" not in schema:
        return []
    number = F.when(_is(value, "number"), F.try_variant_get(value, "$", "double"))
    wrong = F.lit(False)
    if "minimum" in schema:
        wrong = wrong | (number < schema["minimum"])
    if "maximum" in schema:
        wrong = wrong | (number > schema["maximum"])
    return [_if(wrong, at, ": out of range")]


def _array_errors(value: Column, schema: Mapping[str, Any], at: Column) -> list[Column]:
    if not schema.keys() & {"items", "minItems", "maxItems", "uniqueItems"} and schema.get("type") != "array":
        return []
    items = F.when(_is(value, "array"), F.try_variant_get(value, "$", "array<variant>"))
    found = [_if(~F.size(items).between(schema.get("minItems", 0), schema.get("maxItems", MAX_ITEMS)) & items.isNotNull(), at, ": wrong number of items")]
    if schema.get("uniqueItems"):
        texts = F.transform(items, lambda item: F.to_json(item))
        found.append(_if(F.size(F.array_distinct(texts)) < F.size(texts), at, ": items repeat"))
    if schema.get("items"):
        each = F.transform(F.slice(items, 1, MAX_ITEMS), lambda item, n: errors_of(item, schema["items"], F.concat(at, F.lit("["), n.cast("string"), F.lit("]"))))
        found.append(F.coalesce(F.flatten(each), _none()))
    return found


def _object_errors(value: Column, schema: Mapping[str, Any], at: Column) -> list[Column]:
    known = schema.get("properties", {})
    is_object = _is(value, "object")
    found = [_if(is_object & _member(value, name).isNull(), at, f".{name}: missing") for name in schema.get("required", ())]
    for name, form in known.items():
        member = _member(value, name)
        found.append(F.when(is_object & member.isNotNull(), errors_of(member, form, F.concat(at, F.lit(f".{name}")))).otherwise(_none()))
    if schema.get("additionalProperties") is False:
        names = F.map_keys(F.when(is_object, F.try_variant_get(value, "$", "map<string,variant>")))
        more = F.filter(names, lambda n: ~n.isin(*known)) if known else names
        found.append(F.coalesce(F.transform(more, lambda n: F.concat(at, F.lit("."), n, F.lit(": not allowed"))), _none()))
    return found


def limit_errors(text: Column, max_depth: int = MAX_DEPTH, max_values: int = MAX_VALUES) -> Column:
    """Whether a JSON text is nested too deep or has too many values, told by its brackets and commas outside strings."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "s"), r"\s+", "")
    bare = F.regexp_replace(bare, r"\[\]|\{\}", "s")  # an empty one is a value like others
    signs = F.regexp_replace(bare, r"[^\[\]{},]+", "")
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, sign: Column) -> Column:
        now = acc["now"] + F.when(sign.isin("[", "{"), 1).when(sign.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    depth = F.aggregate(F.split(F.replace(signs, F.lit(",")), ""), state, step)["most"] + 1
    # a container with n values has n - 1 commas
    values = 1 + F.char_length(F.regexp_replace(signs, r"[\]}]", ""))
    return F.when(depth > max_depth, F.array(F.lit("$: nested too deep"))).when(values > max_values, F.array(F.lit("$: too many values"))).otherwise(_none())


def text_errors(text: Column, schema: Mapping[str, Any], *more: Column) -> Column:
    """What a JSON text breaks: it is none, it breaks limits, or else the schema, or else ``more`` (arrays of errors over the same text)."""
    value = F.try_parse_json(text)
    limits, form = limit_errors(text), errors_of(value, schema)
    then = F.concat(_none(), *more)
    found = F.when(value.isNull(), F.array(F.lit("$: no JSON"))).when(F.size(limits) > 0, limits).when(F.size(form) > 0, form).otherwise(then)
    return F.slice(found, 1, MAX_ERRORS)
