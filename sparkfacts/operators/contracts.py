"""Contracts: a JSON schema compiled to Column expressions that list what a payload breaks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = {"type", "enum", "const", "pattern", "format", "minimum", "maximum", "minLength", "maxLength", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "anyOf", "$schema", "title", "description", "default"}
_KINDS = {"object": ["OBJECT"], "array": ["ARRAY"], "string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"]}
_FORMATS = {"uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$", "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"}


def _get(value: Column, key: str) -> Column:
    if "'" in key and '"' in key:  # no path can say it
        return F.try_variant_get(value, "$", "map<string,variant>")[key]
    mark = '"' if "'" in key else "'"
    return F.try_variant_get(value, f"$[{mark}{key}{mark}]", "variant")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """The array ``use(value)``, where the value is worked out once, however often it is used."""
    return F.flatten(F.transform(F.array(value), use))


def problems(schema: dict, value: Column, at: Column) -> Column:
    """array<string> of "place: rule" for what a variant breaks, in the schema's order; empty if nothing.

    Covers the keywords of KEYWORDS; another one is an error when the expression is made.
    The value and its kind are worked out once, whatever number of rules ask for them.
    """
    if unknown := schema.keys() - KEYWORDS:
        raise ValueError(f"contract uses {sorted(unknown)}")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return _once(value, lambda v: _once(F.struct(v.alias("value"), kind(v).alias("kind")), lambda x: _problems(schema, x["value"], x["kind"], at)))


def _problems(schema: dict, value: Column, kind: Column, at: Column) -> Column:
    none = F.array().cast("array<string>")
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_ = lambda name: kind.isin(*_KINDS[name])
    out = []

    def rule(name: str, broken: Column) -> None:
        out.append(F.when(broken, F.array(F.concat(at, F.lit(f": {name}")))).otherwise(none))

    if "type" in schema:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        ok = F.lit(False)
        for name in names:
            ok = ok | ((is_("number") & (number % 1 == 0)) if name == "integer" else is_(name))
        rule("type", ~ok)
    for word in ("enum", "const"):
        if word in schema:
            allowed = schema[word] if word == "enum" else [schema[word]]
            rule(word, ~F.to_json(value).isin(*(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in allowed)))
    if "pattern" in schema:
        rule("pattern", is_("string") & ~text.rlike(schema["pattern"]))
    if "format" in schema:
        good = (text.rlike(r"^\d{4}-\d{2}-\d{2}$") & text.try_cast("date").isNotNull()) if schema["format"] == "date" else text.rlike(_FORMATS[schema["format"]])
        rule("format", is_("string") & ~good)
    for word, broken in (("minLength", lambda n: F.length(text) < n), ("maxLength", lambda n: F.length(text) > n)):
        if word in schema:
            rule(word, is_("string") & broken(schema[word]))
    for word, broken in (("minimum", lambda n: number < n), ("maximum", lambda n: number > n)):
        if word in schema:
            rule(word, is_("number") & broken(schema[word]))
    if "anyOf" in schema:
        least = F.array_min(F.array(*(F.size(problems(s, value, at)) for s in schema["anyOf"])))
        rule("anyOf", least > 0)
    for key in schema.get("required", ()):
        out.append(F.when(is_("object") & _get(value, key).isNull(), F.array(F.concat(at, F.lit(f".{key}: required")))).otherwise(none))
    known = schema.get("properties", {})
    for key, below in known.items():
        inner = lambda v: F.when(v.isNotNull(), problems(below, v, F.concat(at, F.lit(f".{key}")))).otherwise(none)  # noqa: B023, E731
        out.append(F.when(is_("object"), _once(_get(value, key), inner)).otherwise(none))
    if schema.get("additionalProperties") is False:
        keys = F.array_sort(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
        extra = F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))
        out.append(F.when(is_("object"), F.transform(extra, lambda k: F.concat(at, F.lit("."), k, F.lit(": additionalProperties")))).otherwise(none))
    items = F.try_variant_get(value, "$", "array<variant>")
    for word, broken in (("minItems", lambda n: F.size(items) < n), ("maxItems", lambda n: F.size(items) > n)):
        if word in schema:
            rule(word, is_("array") & broken(schema[word]))
    if "items" in schema:
        each = F.transform(items, lambda x, i: problems(schema["items"], x, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
        out.append(F.when(is_("array"), F.flatten(each)).otherwise(none))
    return F.concat(*out) if out else none


def _found(payload: str, schema: dict) -> Column:
    """What a JSON payload breaks; it is parsed once."""
    return _once(F.try_parse_json(payload), lambda v: F.when(v.isNull(), F.array(F.lit("$: malformed"))).otherwise(problems(schema, v, F.lit("$"))))


def violations(rows: DataFrame, key: str, payload: str, schema: dict) -> DataFrame:
    """(key, place, rule): one row for each rule that a JSON payload breaks; text that is no JSON breaks ``malformed``."""
    told = rows.select(key, F.explode_outer(_found(payload, schema)).alias("m")).filter("m is not null")  # explode would add filters that check each payload again
    return told.select(key, F.regexp_extract("m", r"(?s)^(.*): (\w+)$", 1).alias("place"), F.regexp_extract("m", r"(?s)^(.*): (\w+)$", 2).alias("rule"))


def checked(rows: DataFrame, payload: str, schema: dict) -> DataFrame:
    """``rows`` with ``valid`` and ``problems`` of a JSON payload."""
    return rows.withColumn("problems", _found(payload, schema)).withColumn("valid", F.size("problems") == 0)
