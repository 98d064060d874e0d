"""A JSON schema as one column expression.

``violations`` turns a schema into an expression over a variant: for each
document of a table an array of all its faults, each a JSON pointer and a
message.  Nothing is collected and no Python runs for a row, so a schema checks a
table of documents like any other column.

Understood are ``type``, ``required``, ``properties``, ``additionalProperties``,
``patternProperties``, ``items``, ``minItems``, ``maxItems``, ``uniqueItems``,
``pattern``, ``minLength``, ``maxLength``, ``minimum``, ``maximum``,
``exclusiveMinimum``, ``exclusiveMaximum``, ``enum``, ``const``, ``allOf``,
``anyOf``, ``oneOf``, ``not`` and ``$ref`` within the schema.  As usual a keyword
says nothing about values of other types.  Any other keyword that would decide
something is an error when the expression is built, not silence.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FAULTS = "array<struct<pointer:string,message:string>>"
#: keywords that decide nothing
_NOTES = {"$schema", "$id", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly"}
_KNOWN = {"type", "required", "properties", "additionalProperties", "patternProperties", "items", "minItems", "maxItems", "uniqueItems", "pattern", "minLength", "maxLength", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "enum", "const", "allOf", "anyOf", "oneOf", "not", "$ref"}

Schema = Mapping[str, object] | bool


def _none() -> Column:
    return F.array().cast(FAULTS)


def _fault(at: Column, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.array(F.struct(F.when(at == "", "/").otherwise(at).alias("pointer"), text.alias("message")))


def _if(condition: Column, at: Column, message: Column | str) -> Column:
    return F.when(condition, _fault(at, message)).otherwise(_none())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.flatten(F.transform(F.array(value), body))


def _step(at: Column, key: Column | str) -> Column:
    name = F.lit(key) if isinstance(key, str) else key
    return F.concat(at, F.lit("/"), F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def _resolved(ref: str, root: Mapping) -> Schema:
    if not ref.startswith("#"):
        raise ValueError(f"{ref}: only references within the schema are followed")
    found: object = root
    for part in ref[1:].split("/")[1:]:
        found = found[part.replace("~1", "/").replace("~0", "~")]  # type: ignore[index]
    return found  # type: ignore[return-value]


_KIND = {"object": "OBJECT", "array": "ARRAY", "string": "STRING", "boolean": "BOOLEAN", "null": "VOID"}
_NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


def _is(kind: Column, value: Column, name: str) -> Column:
    number = F.regexp_extract(kind, "^[A-Z]+", 0).isin(*_NUMBERS)
    if name == "number":
        return number
    if name == "integer":
        real = F.try_variant_get(value, "$", "double")
        return number & (~kind.startswith("D") & (kind != "FLOAT") | (real == F.rint(real)))
    return kind.startswith(_KIND[name])


def _same(value: Column, kind: Column, other: object) -> Column:
    """Whether a value equals a constant; numbers by value, others by their
    canonical text (the keys of a variant are sorted)."""
    if isinstance(other, int | float) and not isinstance(other, bool):
        return _is(kind, value, "number") & (F.try_variant_get(value, "$", "double") == float(other))
    text = json.dumps(other, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(text)))


def _faults(value: Column, at: Column, schema: Schema, root: Mapping, seen: tuple[str, ...]) -> Column:
    """Faults of a value that is present; ``seen`` are the references followed."""
    if schema is True or schema == {}:
        return _none()
    if schema is False:
        return _fault(at, "no value is allowed")
    unknown = set(schema) - _KNOWN - _NOTES
    if unknown:
        raise ValueError(f"keywords that are not understood: {', '.join(sorted(unknown))}")

    def below(v: Column, where: Column, sub: Schema) -> Column:
        return _faults(v, where, sub, root, seen)

    def of_kind(kind: Column) -> Column:
        parts = []
        if "$ref" in schema:
            ref = str(schema["$ref"])
            if ref in seen:
                raise ValueError(f"{ref} refers to itself: documents of any depth have no finite expression")
            parts.append(_faults(value, at, _resolved(ref, root), root, (*seen, ref)))
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])  # type: ignore[call-overload]
            fits = _is(kind, value, names[0])
            for name in names[1:]:
                fits = fits | _is(kind, value, name)
            parts.append(_if(~fits, at, "value is not of type " + " or ".join(names)))
        if "const" in schema:
            parts.append(_if(~_same(value, kind, schema["const"]), at, f"value is not {json.dumps(schema['const'])}"))
        if "enum" in schema:
            fits = F.lit(False)
            for other in schema["enum"]:  # type: ignore[attr-defined]
                fits = fits | _same(value, kind, other)
            parts.append(_if(~fits, at, f"value is not one of {json.dumps(schema['enum'])}"))
        for name, limit, wrong in (("minimum", "less than", lambda n, b: n < b), ("maximum", "greater than", lambda n, b: n > b), ("exclusiveMinimum", "not greater than", lambda n, b: n <= b), ("exclusiveMaximum", "not less than", lambda n, b: n >= b)):
            if name in schema:
                number = F.try_variant_get(value, "$", "double")
                parts.append(_if(_is(kind, value, "number") & wrong(number, float(schema[name])), at, f"value is {limit} {json.dumps(schema[name])}"))  # type: ignore[arg-type]
        text = F.when(kind == "STRING", F.variant_get(value, "$", "string"))
        if "pattern" in schema:
            parts.append(_if(F.coalesce(~text.rlike(str(schema["pattern"])), F.lit(False)), at, f"value does not match {schema['pattern']}"))
        if "minLength" in schema:
            parts.append(_if(F.coalesce(F.length(text) < schema["minLength"], F.lit(False)), at, f"value is shorter than {schema['minLength']}"))
        if "maxLength" in schema:
            parts.append(_if(F.coalesce(F.length(text) > schema["maxLength"], F.lit(False)), at, f"value is longer than {schema['maxLength']}"))
        if set(schema) & {"required", "properties", "additionalProperties", "patternProperties"}:
            fields = F.when(kind.startswith("OBJECT"), F.variant_get(value, "$", "map<string,variant>"))
            parts.append(F.coalesce(_let(fields, of_object), _none()))
        if set(schema) & {"items", "minItems", "maxItems", "uniqueItems"}:
            items = F.when(kind.startswith("ARRAY"), F.variant_get(value, "$", "array<variant>"))
            parts.append(F.coalesce(_let(items, of_array), _none()))
        for sub in schema.get("allOf", []):  # type: ignore[attr-defined]
            parts.append(below(value, at, sub))
        if "anyOf" in schema or "oneOf" in schema or "not" in schema:
            fits = lambda sub: F.size(below(value, at, sub)) == 0
            if "anyOf" in schema:
                some = F.lit(False)
                for sub in schema["anyOf"]:  # type: ignore[attr-defined]
                    some = some | fits(sub)
                parts.append(_if(~some, at, "value fits none of the schemas of anyOf"))
            if "oneOf" in schema:
                hits = F.lit(0)
                for sub in schema["oneOf"]:  # type: ignore[attr-defined]
                    hits = hits + fits(sub).cast("int")
                parts.append(_if(hits != 1, at, "value does not fit exactly one schema of oneOf"))
            if "not" in schema:
                parts.append(_if(fits(schema["not"]), at, "value fits a schema that it must not"))  # type: ignore[arg-type]
        return F.concat(_none(), *parts)

    def matching(pattern: str, wanted: bool = True) -> Callable[[Column], Column]:
        return lambda key: key.rlike(pattern) if wanted else ~key.rlike(pattern)

    def of_object(fields: Column) -> Column:
        def each(keys: Column, sub: Schema) -> Column:
            return F.flatten(F.transform(keys, lambda k: below(F.try_element_at(fields, k), _step(at, k), sub)))

        parts = [_if(~F.map_contains_key(fields, name), _step(at, name), f"'{name}' is a required property") for name in schema.get("required", [])]  # type: ignore[attr-defined]
        named = schema.get("properties", {})
        for name, sub in named.items():  # type: ignore[attr-defined]
            if sub is not True and sub != {}:
                parts.append(F.when(F.map_contains_key(fields, name), below(F.try_element_at(fields, F.lit(name)), _step(at, name), sub)).otherwise(_none()))
        patterns = schema.get("patternProperties", {})
        for pattern, sub in patterns.items():  # type: ignore[attr-defined]
            parts.append(each(F.filter(F.map_keys(fields), matching(pattern)), sub))
        more = schema.get("additionalProperties", True)
        if more is not True and more != {}:
            rest = F.filter(F.map_keys(fields), lambda k: ~k.isin(*named) if named else F.lit(True))  # type: ignore[misc]
            for pattern in patterns:  # type: ignore[attr-defined]
                rest = F.filter(rest, matching(pattern, False))
            if more is False:
                parts.append(F.transform(F.array_sort(rest), lambda k: _fault(_step(at, k), "property is not allowed")[0]))
            else:
                parts.append(each(F.array_sort(rest), more))  # type: ignore[arg-type]
        return F.concat(_none(), *parts)

    def of_array(items: Column) -> Column:
        parts = []
        if "minItems" in schema:
            parts.append(_if(F.size(items) < schema["minItems"], at, f"value has less than {schema['minItems']} items"))
        if "maxItems" in schema:
            parts.append(_if(F.size(items) > schema["maxItems"], at, f"value has more than {schema['maxItems']} items"))
        if schema.get("uniqueItems"):
            texts = F.transform(items, lambda x: F.to_json(x))
            parts.append(_if(F.size(F.array_distinct(texts)) < F.size(items), at, "items are not unique"))
        if schema.get("items", True) is not True:
            parts.append(F.flatten(F.transform(items, lambda x, i: below(x, F.concat(at, F.lit("/"), i.cast("string")), schema["items"]))))  # type: ignore[arg-type]
        return F.concat(_none(), *parts)

    return _let(F.schema_of_variant(value), of_kind)


def violations(document: Column, schema: Schema) -> Column:
    """All faults of a JSON text by a schema, sorted by pointer, then message:
    ``array<struct<pointer, message>>``.  A null text and one that is no JSON
    have one fault at the root.  Raises ValueError for schemas without a finite
    expression, and for keywords that are not understood."""
    root = schema if isinstance(schema, Mapping) else {}
    parsed = F.try_parse_json(document)
    found = F.array_sort(F.array_distinct(_faults(parsed, F.lit(""), schema, root, ())))
    return F.when(document.isNull() | parsed.isNull(), _fault(F.lit(""), "document is not JSON")).otherwise(found)
