"""JSON: schema checks of a Draft-07 subset, and the end of a leading JSON value in a longer or unfinished text."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .canonical import canonical_json

TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}
KNOWN = frozenset("$schema $id $ref title description type enum const properties required additionalProperties items minItems maxItems uniqueItems minLength maxLength pattern minimum maximum exclusiveMinimum exclusiveMaximum anyOf oneOf allOf not definitions default".split())


def compile_schema(schema: dict) -> dict:
    """Checks a schema: known words only, local references that exist, enums without repeats, types that exist."""

    def walk(s, path: str) -> None:
        if isinstance(s, bool):
            return
        if not isinstance(s, dict):
            raise ValueError(f"{path}: a schema is an object or a boolean")
        for word in s.keys() - KNOWN:
            raise ValueError(f"{path}: unsupported word {word}")
        if "$ref" in s and (not s["$ref"].startswith("#/definitions/") or s["$ref"][14:] not in schema.get("definitions", {})):
            raise ValueError(f"{path}: reference {s['$ref']} is not a local definition")
        kinds = s.get("type", [])
        if any(k not in TYPES for k in ([kinds] if isinstance(kinds, str) else kinds)):
            raise ValueError(f"{path}: unknown type")
        if "enum" in s and len({canonical_json(v) for v in s["enum"]}) != len(s["enum"]):
            raise ValueError(f"{path}: repeated enum value")
        for group in ("properties", "definitions"):
            for k, v in s.get(group, {}).items():
                walk(v, f"{path}/{group}/{k}")
        for word in ("items", "additionalProperties", "not"):
            if word in s:
                walk(s[word], f"{path}/{word}")
        for word in ("anyOf", "oneOf", "allOf"):
            for i, v in enumerate(s.get(word, [])):
                walk(v, f"{path}/{word}/{i}")

    walk(schema, "#")
    return schema


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    return isinstance(value, TYPES[kind]) and not (kind == "number" and isinstance(value, bool))


def schema_errors(schema, value, root: dict | None = None, path: str = "") -> list[str]:
    """Paths and words of what a value breaks."""
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{path or '/'} false"]
    if "$ref" in schema:
        return schema_errors(root["definitions"][schema["$ref"][14:]], value, root, path)
    out: list[str] = []
    miss = lambda word, bad: out.append(f"{path or '/'} {word}") if bad else None
    kinds = schema.get("type")
    if kinds is not None:
        miss("type", not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)))
    if "enum" in schema:
        miss("enum", canonical_json(value) not in {canonical_json(v) for v in schema["enum"]})
    if "const" in schema:
        miss("const", canonical_json(value) != canonical_json(schema["const"]))
    if isinstance(value, str):
        miss("minLength", len(value) < schema.get("minLength", 0))
        miss("maxLength", len(value) > schema.get("maxLength", math.inf))
        miss("pattern", "pattern" in schema and not re.search(schema["pattern"], value))
    if isinstance(value, int | float) and not isinstance(value, bool):
        miss("minimum", value < schema.get("minimum", -math.inf))
        miss("maximum", value > schema.get("maximum", math.inf))
        miss("exclusiveMinimum", value <= schema.get("exclusiveMinimum", -math.inf))
        miss("exclusiveMaximum", value >= schema.get("exclusiveMaximum", math.inf))
    if isinstance(value, list):
        miss("minItems", len(value) < schema.get("minItems", 0))
        miss("maxItems", len(value) > schema.get("maxItems", math.inf))
        miss("uniqueItems", schema.get("uniqueItems", False) and len({canonical_json(v) for v in value}) != len(value))
        for i, v in enumerate(value) if "items" in schema else ():
            out += schema_errors(schema["items"], v, root, f"{path}/{i}")
    if isinstance(value, dict):
        for k in schema.get("required", []):
            miss(f"required {k}", k not in value)
        for k, v in value.items():
            inner = schema.get("properties", {}).get(k, schema.get("additionalProperties", True))
            out += schema_errors(inner, v, root, f"{path}/{k}")
    for word, ok in (("anyOf", lambda n, _: n > 0), ("oneOf", lambda n, _: n == 1), ("allOf", lambda n, total: n == total)):
        if word in schema:
            n = sum(not schema_errors(s, value, root, path) for s in schema[word])
            miss(word, not ok(n, len(schema[word])))
    if "not" in schema:
        miss("not", not schema_errors(schema["not"], value, root, path))
    return out


def validator(schema: dict):
    """A vectorised function text -> array of errors, empty if the text is JSON that the schema allows."""
    compile_schema(schema)

    @F.pandas_udf(ArrayType(StringType()))
    def run(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return schema_errors(schema, json.loads(t, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))))
            except (ValueError, TypeError):
                return ["/ json"]

        return text.map(one)

    return run


def loose_key(value) -> str:
    """A value as text in which lists are objects by place and members are sorted by name."""
    if isinstance(value, list):
        value = {str(i): x for i, x in enumerate(value)}
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{loose_key(value[k])}" for k in sorted(value)) + "}"
    return canonical_json(value)


@F.pandas_udf(StringType())
def structural_key(text: pd.Series) -> pd.Series:
    """loose_key() of JSON texts; null for what isn't JSON."""

    def one(t):
        try:
            return loose_key(json.loads(t))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def value_end(text: str) -> tuple[str, int]:
    """(state, end) of the JSON value that a text starts with: complete with its end, partial, or invalid."""
    at = len(text) - len(text.lstrip(" \t\r\n"))
    if at == len(text):
        return "partial", at
    try:
        _, end = json.JSONDecoder(parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c))).raw_decode(text, at)
        if end == len(text) and text[at] in "-0123456789":
            return "partial", end  # more digits could follow
        return "complete", end
    except ValueError:
        pass
    depth, inside, escaped, i = [], False, False, at
    for i in range(at, len(text)):
        c = text[i]
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
            elif c < " ":
                return "invalid", i
        elif c == '"':
            inside = True
        elif c in "{[":
            depth.append(c)
        elif c in "}]":
            if not depth or depth.pop() != {"}": "{", "]": "["}[c]:
                return "invalid", i
            if not depth:
                return "invalid", i
        elif not depth and c in " \t\r\n":
            return "invalid", i
    body = text[at:]
    if inside or depth:
        return "partial", len(text)
    return ("partial", len(text)) if any(w.startswith(body) for w in ("true", "false", "null")) or re.fullmatch(r"-?(?:(?:0|[1-9]\d*)(?:\.\d*)?(?:[eE][+-]?\d*)?)?", body) else ("invalid", at)


@F.pandas_udf(StructType([StructField("state", StringType()), StructField("end", IntegerType())]))
def json_boundary(text: pd.Series) -> pd.DataFrame:
    found = [value_end(t or "") for t in text]
    return pd.DataFrame({"state": [s for s, _ in found], "end": pd.Series([e for _, e in found], dtype="int32")})
