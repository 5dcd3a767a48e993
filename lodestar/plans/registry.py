"""Where query modules register what __spark_entry__ offers."""

from __future__ import annotations

from collections.abc import Callable

from ..storage import spread

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a (spark, sf_dir) function under its own name, with its DuckDB SQL if there is one."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark, sf_dir: str, name: str):
    """A table; those of texts, whose rows are costly, are spread over all cores if they have fewer splits."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df
