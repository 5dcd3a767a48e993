"""Canonical JSON and content hashes."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Sorted keys, no absent members (None inside objects is kept as null only where it was given), finite numbers only."""
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("canonical JSON holds finite numbers only")
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if value is None or isinstance(value, bool | int | str):
        return json.dumps(value, ensure_ascii=False)
    raise TypeError(f"not JSON data: {type(value).__name__}")


def hash_value(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def json_string(text: Column) -> Column:
    """A text as a JSON string."""
    return F.substring(F.to_json(F.array(text)), F.lit(2), F.length(F.to_json(F.array(text))) - 2)


def canonical_struct(fields: dict[str, Column], numbers: set[str] = frozenset()) -> Column:
    """Canonical JSON of a flat record: keys sorted, null members left out."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(json.dumps(k) + ":"), c.cast("string") if k in numbers else json_string(c))) for k, c in sorted(fields.items())]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def ordered_digest(hashes: DataFrame) -> DataFrame:
    """One row: index_id, the hash of all (id, h) in the order of id as text, and documents. A listing of fixed-size hashes is
    what the identity is defined over, so they meet in one row, without the texts."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("id", "h"))), lambda x: x["h"])
    return hashes.agg(F.sha2(F.array_join(listed, ""), 256).alias("index_id"), F.count(F.lit(1)).alias("documents"))
