"""Shared helpers: storage in the folder that all executors see, and hashing of whole Arrow texts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import shared_dir

#: White space of the text contracts: \x20 and \x09-\x0D.
SPACES = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised step works on; longer texts make a step of their own.
STEP_BYTES = 1 << 20
#: The setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of up to some 100 bytes that steps which are repeated many times keep in one partition.
FEW_ROWS = 20_000


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, read again.

    The job's shuffle files are not needed once its rows are written, so Spark is told to remove them then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def together(df: DataFrame, few: bool) -> DataFrame:
    """Few rows as one partition: aggregates, windows and merge joins of such tables need no exchange, so a step is one task,
    and the driver has no stages to plan anew, no broadcasts to build and no threads that wait for them."""
    return df.coalesce(1) if few else df


def merging(df: DataFrame, few: bool) -> DataFrame:
    """A side of a join of few rows, which would else be broadcast."""
    return df.hint("merge") if few else df


def split_of(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5: 0 marks the held-out documents."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


_RNG = np.random.default_rng(0x5EED)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
for _b in SPACES:
    _BYTE[_b] = 0
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_WS = _BYTE == 0
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["p"]) < n:
        for key, base in (("p", _P), ("inv", _PINV)):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[key] = np.multiply.accumulate(table)
    return _POWERS["p"], _POWERS["inv"]


def text_steps(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of an Arrow string column: (first row, end row, bytes, offsets of the rows in them), nulls as empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, 8 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + STEP_BYTES, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash of each word, byte position of each word, index of each row's first word; one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~_WS[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    heads = off[:-1][off[:-1] < len(data)]
    start[heads] = word[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, np.uint64), at, np.zeros(len(off), np.int64)
    p, inv = _powers(max(len(data), STEP_BYTES))
    value = (_BYTE_LOW if lower else _BYTE)[data]
    value *= p[: len(data)]
    return mix(np.add.reduceat(value, at) * inv[at]), at, np.searchsorted(at, off)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of a sequence; a shorter sequence is one shingle, an empty one has none."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[i : n - size + 1 + i]
    return mix(out)
