"""JSON Schema documents compiled to Catalyst expressions over variants, and checks of workflow configurations."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.extract import bound, rows_of
from tessera.operators.text import whole_json

ERROR = "array<struct<path:string, code:string>>"
#: Types of a schema and the types that a variant says of itself.
TYPES = {"string": ["STRING"], "integer": ["BIGINT", "INT", "SMALLINT", "TINYINT"], "number": ["BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"], "null": ["VOID"]}
KNOWN = {"type", "properties", "required", "additionalProperties", "items", "enum", "const", "minLength", "maxLength", "pattern", "minItems", "maxItems", "minimum", "maximum", "$schema", "title", "description", "format", "default", "$id"}
NODE_TYPES = ["analyzer", "retriever", "domain_expert", "validator", "refiner", "router", "vlm"]


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)


def _said(path: str, code: str, wrong: Column) -> Column:
    return F.when(wrong, F.array(F.struct(F.lit(path or "$").alias("path"), F.lit(code).alias("code")))).otherwise(F.array().cast(ERROR))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _equals(v: Column, value) -> Column:
    """Whether a variant is a value of JSON: numbers by their value, objects whatever the order of their keys."""
    kind = _kind(v)
    if value is None:
        return kind == "VOID"
    if isinstance(value, bool):
        return (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(v, "$", "boolean") == value, F.lit(False))
    if isinstance(value, int | float):
        return kind.isin(TYPES["number"]) & F.coalesce(F.try_variant_get(v, "$", "double") == float(value), F.lit(False))
    if isinstance(value, str):
        return (kind == "STRING") & (_text(v) == value)
    return kind.isin("OBJECT", "ARRAY") & (F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value)))))


def _is_type(v: Column, kind: Column, name: str) -> Column:
    """Whether a variant is of a type of the schema; a number without a fraction is an integer, however it is written."""
    if name != "integer":
        return kind.isin(TYPES[name])
    number = F.try_variant_get(v, "$", "double")
    return kind.isin(TYPES["integer"]) | (kind.isin(TYPES["number"]) & F.coalesce(number == F.rint(number), F.lit(False)))


def violations(v: Column, schema: dict, path: str = "") -> Column:
    """An array of (path, code) of what a variant breaks: REQUIRED, TYPE, ENUM, CONST, PATTERN, MIN_LENGTH, MAX_LENGTH, MINIMUM,
    MAXIMUM, MIN_ITEMS, MAX_ITEMS, ADDITIONAL. Items of an array have the path ``key[]``. Rules for a type hold where a
    value is of that type; a keyword that isn't known is an error when the schema is compiled. A value, its kind and its keys
    are bound, so each is computed once however deep it stands."""
    unknown = set(schema) - KNOWN
    if unknown:
        raise ValueError(f"keywords at {path or '$'} that aren't supported: {sorted(unknown)}")
    return bound(F.struct(v.alias("v"), _kind(v).alias("kind")), lambda x: _broken(x["v"], x["kind"], schema, path))


def _broken(v: Column, kind: Column, schema: dict, path: str) -> Column:
    out = []
    wanted = schema.get("type")
    if wanted:
        fits = [_is_type(v, kind, w) for w in ([wanted] if isinstance(wanted, str) else wanted)]
        out.append(_said(path, "TYPE", ~reduce(lambda a, b: a | b, fits)))
    is_text, is_list, is_object = kind == "STRING", kind == "ARRAY", kind == "OBJECT"
    size = F.size(F.try_variant_get(v, "$", "array<variant>"))
    if "enum" in schema:
        out.append(_said(path, "ENUM", ~reduce(lambda a, b: a | b, [_equals(v, x) for x in schema["enum"]], F.lit(False))))
    if "const" in schema:
        out.append(_said(path, "CONST", ~_equals(v, schema["const"])))
    rules = [
        ("minLength", "MIN_LENGTH", lambda x: is_text & (F.length(_text(v)) < x)), ("maxLength", "MAX_LENGTH", lambda x: is_text & (F.length(_text(v)) > x)), ("pattern", "PATTERN", lambda x: is_text & ~_text(v).rlike(x)),
        ("minimum", "MINIMUM", lambda x: F.coalesce(F.try_variant_get(v, "$", "double") < float(x), F.lit(False)) & kind.isin(TYPES["number"])), ("maximum", "MAXIMUM", lambda x: F.coalesce(F.try_variant_get(v, "$", "double") > float(x), F.lit(False)) & kind.isin(TYPES["number"])),
        ("minItems", "MIN_ITEMS", lambda x: is_list & (size < x)), ("maxItems", "MAX_ITEMS", lambda x: is_list & (size > x)),
    ]
    for key, code, wrong in rules:
        if key in schema:
            out.append(_said(path, code, wrong(schema[key])))
    if {"required", "additionalProperties", "properties"} & set(schema):
        held = F.when(is_object, F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
        out.append(bound(held, lambda keys: _members(v, is_object, keys, schema, path)))
    if schema.get("items"):
        each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: violations(x, schema["items"], f"{path}[]"))
        out.append(F.when(is_list, F.array_distinct(F.flatten(each))).otherwise(F.array().cast(ERROR)))
    return F.concat(*out) if out else F.array().cast(ERROR)


def _members(v: Column, is_object: Column, keys: Column, schema: dict, path: str) -> Column:
    """What the keys of an object and their values break."""
    out = []
    for name in schema.get("required", []):
        out.append(_said(f"{path}.{name}".lstrip("."), "REQUIRED", is_object & ~F.array_contains(keys, name)))
    if schema.get("additionalProperties") is False:
        out.append(_said(path, "ADDITIONAL", is_object & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))) > 0)))
    for name, inner in schema.get("properties", {}).items():
        if inner:
            there = F.try_variant_get(v, f"$['{name}']", "variant")
            out.append(F.when(is_object & F.array_contains(keys, name), violations(there, inner, f"{path}.{name}".lstrip("."))).otherwise(F.array().cast(ERROR)))
    return F.concat(*out) if out else F.array().cast(ERROR)


def schema_errors(rows: DataFrame, raw: str, schema: dict, keep: list[str]) -> DataFrame:
    """(keep, path, code) of every rule that a row's JSON text breaks; text that is no JSON is JSON_PARSE."""
    v = F.col("_v")
    found = F.when(v.isNull(), F.array(F.struct(F.lit("$").alias("path"), F.lit("JSON_PARSE").alias("code")))).otherwise(violations(v, schema))
    return rows_of(rows.withColumn("_v", whole_json(F.col(raw))), keep, found, "path")


def workflow_errors(configs: DataFrame, by: str, raw: str, types: list[str] | None = None) -> DataFrame:
    """(by, error, detail) of workflow configurations as JSON text: missing sections, and then nodes without id or type,
    unsupported types and edges whose ends are no nodes."""
    node, edge = "array<struct<id:string, type:string>>", "array<struct<`from`:string, `to`:string>>"
    c = configs.select(by, *[F.get_json_object(raw, f"$.{s}").alias(s) for s in ("nodes", "connections", "node_thresholds")])
    gaps = c.select(by, F.explode(F.array_compact(F.array(*[F.when(F.col(s).isNull(), s) for s in ("nodes", "connections", "node_thresholds")]))).alias("detail")).select(by, F.lit("missing section").alias("error"), "detail")
    whole = c.where("nodes is not null and connections is not null and node_thresholds is not null")
    nodes = whole.select(by, F.inline(F.from_json("nodes", node)))
    ends = whole.select(by, F.inline(F.from_json("connections", edge)))
    wrong = nodes.select(by, F.when(F.col("id").isNull(), "node without id").when(F.col("type").isNull(), "node without type").when(~F.col("type").isin(types or NODE_TYPES), "unsupported type").alias("error"), F.coalesce("id", "type", F.lit("")).alias("detail")).where("error is not null")
    ids = nodes.where("id is not null").select(by, F.col("id").alias("detail")).distinct()
    lost = [ends.select(by, F.lit(f"no node for {w}").alias("error"), F.coalesce(w, F.lit("")).alias("detail")).join(ids, [by, "detail"], "left_anti").select(by, "error", "detail") for w in ("from", "to")]
    return gaps.unionByName(wrong).unionByName(lost[0]).unionByName(lost[1])


def guarded(configs: DataFrame, raw: str) -> DataFrame:
    """The rows as they are; one in the legacy form (``thresholds`` without ``node_thresholds``) fails the query."""
    legacy = F.get_json_object(raw, "$.thresholds").isNotNull() & F.get_json_object(raw, "$.node_thresholds").isNull()
    message = "legacy thresholds: convert the configuration to node_thresholds"
    return configs.where(F.when(legacy, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True)))
