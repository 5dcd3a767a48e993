"""Exact dedup over an extendible-hash index. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of the hash from which the directory is built: it has at most 2**MAX_DEPTH slots.
MAX_DEPTH = 14


def normalised(text):
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def directory(counts: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """(slot at max_depth, bucket, local depth). Starts with one bucket and splits each overfull one; a split of a bucket
    as deep as the directory doubles the directory. A bucket of max_depth chains what it holds beyond its capacity."""
    full, open_, done = sum(counts.values()), [(0, 0)], []
    sums = {max_depth: dict(counts)}
    for depth in range(max_depth - 1, -1, -1):
        level: dict[int, int] = {}
        for slot, n in sums[depth + 1].items():
            level[slot >> 1] = level.get(slot >> 1, 0) + n
        sums[depth] = level
    assert sums[0].get(0, 0) == full
    while open_:
        prefix, depth = open_.pop()
        if depth < max_depth and sums[depth].get(prefix, 0) > capacity:
            open_ += [(prefix * 2 + 1, depth + 1), (prefix * 2, depth + 1)]
        else:
            done.append((prefix, depth))
    return [
        (slot, bucket, depth)
        for bucket, (prefix, depth) in enumerate(sorted(done, key=lambda x: x[0] << (max_depth - x[1])))
        for slot in range(prefix << (max_depth - depth), (prefix + 1) << (max_depth - depth))
    ]


def build_index(docs: DataFrame, entries: DataFrame, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """The index as a table in the shared folder: (bucket, depth, h, chain, sha, keep_id, group_size), ranges of buckets a file.

    The directory comes from the distinct hashes of each slot (at most 2**MAX_DEPTH counts reach the driver). Owner tasks
    group the bytes themselves, so different texts of one hash are links of one chain; copies are combined before the shuffle.
    """
    spark = docs.sparkSession
    slot = F.shiftrightunsigned("h", 64 - MAX_DEPTH).cast("int")
    counts = entries.select("h").distinct().groupBy(slot.alias("slot")).count().collect()
    slots = spark.createDataFrame(directory({r["slot"]: r["count"] for r in counts}, capacity), "slot int, bucket int, depth int")
    texts = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("h", F.xxhash64("norm"))
    groups = texts.groupBy("h", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    keys = groups.select("h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size", slot.alias("slot"))
    owned = keys.join(F.broadcast(slots), "slot").drop("slot").repartitionByRange("bucket", "h")
    chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("sha"))
    return stored(owned.withColumn("chain", chain).sortWithinPartitions("bucket", "h", "chain"), "exact-index")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 50_000) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after white-space runs became one space; a null text is an empty one. The smallest
    id of a group stays. Rows repeated with the same id and text: one of them is kept. A null id is above all others: it
    stays only where its group has no other. An empty table gives no rows; other columns are not read.
    """
    norm = normalised(F.col(text_col))
    entries = stored(docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select("doc_id", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256")), "exact-entries")
    index = build_index(docs, entries, id_col, text_col, capacity).select("h", F.col("sha").alias("text_sha256"), "keep_id", "group_size")
    found = entries.join(index, ["h", "text_sha256"])
    turn = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy("h"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (turn == 1)).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_dedup() keeps, with their columns."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("__id"), "text_sha256")
    rows = docs.select(*columns, F.sha2(normalised(F.col(text_col)), 256).alias("__sha"))
    rows = rows.join(kept, (F.col("__sha") == kept["text_sha256"]) & rows[id_col].eqNullSafe(kept["__id"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy(id_col, "__sha").orderBy("__sha"))
    return rows.withColumn("__turn", turn).where("__turn = 1").select(*columns)
