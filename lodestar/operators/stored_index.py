"""A kept index: documents, postings by term bucket and statistics as tables, searched, updated, exported and imported."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored
from .index import TOP_K, chunk_table, contribution, exploded, term_counts, top_hits

#: Buckets of terms, each a folder of its own: a search reads those of its terms only. Buckets of document hashes in the identity.
BUCKETS, ID_BUCKETS, FORMAT = 64, 4096, 1
#: So many ids that go are sent along as hashes, and so many asked terms are put into the filter of a scan; more are joined.
MANY_GONE, MANY_TERMS = 1 << 20, 1 << 12


@dataclass(frozen=True)
class StoredIndex:
    """Tables of an index below a folder: documents (doc_id, text, version_id), lengths (chunk_id, doc_id, len), postings (bucket,
    term, chunk_id, doc_id, tf, len) and meta, one row (format, n, total, index_id)."""

    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _parts(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lengths and postings of chunks (doc_id, chunk_id, text)."""
    return term_counts(chunks, frozenset()).select("chunk_id", "doc_id", "len"), exploded(term_counts(chunks))


def index_identity(documents: DataFrame) -> str:
    """A hash over the versions of all documents in the order of their ids' hashes: those of each bucket, then of the buckets, so
    that no task lists more than a bucket and the driver no more than ID_BUCKETS hashes."""
    h = documents.select(F.sha2(F.concat_ws(":", F.lit(FORMAT), "doc_id", "version_id"), 256).alias("h"))
    per = h.groupBy(F.pmod(F.xxhash64("h"), F.lit(ID_BUCKETS)).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.format_string("%05d", "b"), "h"))), ""), 256).alias("id")).first()["id"]


def _write(spark: SparkSession, lengths: DataFrame, postings: DataFrame, path: str) -> StoredIndex:
    """The other tables beside the documents. Each task writes the postings of its own texts into all buckets, without a shuffle."""
    lengths.write.parquet(f"{path}/lengths")
    postings.withColumn("bucket", _bucket("term")).sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/postings")
    found = StoredIndex(spark, path)
    total = found.read("lengths").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))
    total.select(F.lit(FORMAT).alias("format"), "n", "total", F.lit(index_identity(found.read("documents"))).alias("index_id")).coalesce(1).write.parquet(f"{path}/meta")
    return found


def build_index(docs: DataFrame, path: str) -> StoredIndex:
    """docs (doc_id, text), each a chunk, as a new index; doc_ids must be unique and set, else it is an error."""
    docs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        raise ValueError("document ids must be set and unique")
    docs.withColumn("version_id", F.sha2("text", 256)).write.parquet(f"{path}/documents")
    return _write(docs.sparkSession, *_parts(chunk_table(StoredIndex(docs.sparkSession, path).read("documents"))), path)


def search_index(index: StoredIndex, terms: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank) for terms (query_id, term): reads the buckets of the asked terms; no text is read."""
    asked = [r["term"] for r in terms.select("term").distinct().collect()]  # bounded by the limit on a question's terms
    buckets = [r["b"] for r in index.spark.createDataFrame([(t,) for t in asked], "term string").select(_bucket("term").alias("b")).distinct().collect()]
    post = index.read("postings").where(F.col("bucket").isin(buckets))
    post = post.where(F.col("term").isin(asked)) if len(asked) <= MANY_TERMS else post.join(F.broadcast(terms.select("term").distinct()), "term")
    df = F.broadcast(post.groupBy("term").agg(F.count(F.lit(1)).alias("df")))  # a chunk has one posting of a term
    hits = post.join(F.broadcast(terms), "term")
    meta = index.read("meta").select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avg_len"))
    part = contribution(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("avg_len"))
    scored = hits.join(df, "term").join(F.broadcast(meta)).groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum(part), 9).alias("score"))
    return top_hits(scored, k)


def update_index(index: StoredIndex, changed: DataFrame, removed: DataFrame, path: str) -> StoredIndex:
    """The index with changed documents (doc_id, text) put in place and removed (doc_id) ones gone, as a new folder: only changed
    texts are split into terms, all other postings are taken over. Equal to building from the documents anew."""
    changed = changed.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if not changed.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        raise ValueError("changed ids must be set and unique")
    changed = stored(changed, "index-changed")
    gone = stored(changed.select("doc_id").unionAll(removed.select(F.col("doc_id").cast("string"))).distinct(), "index-gone")
    hashes = gone.select(F.xxhash64("doc_id").alias("gone")).distinct()
    hashes = F.broadcast(hashes) if gone.count() <= MANY_GONE else hashes
    exact = lambda df: df.join(gone, "doc_id", "left_anti")
    by_hash = lambda df, how: df.join(hashes, F.xxhash64("doc_id") == F.col("gone"), how)
    # An id that stays may share its hash with one that goes: then ids are compared as they are.
    clear = by_hash(exact(index.read("lengths").select("doc_id")), "left_semi").isEmpty()
    kept = lambda name: by_hash(index.read(name), "left_anti") if clear else exact(index.read(name))
    lengths, postings = _parts(chunk_table(changed))
    documents = kept("documents").unionByName(changed.withColumn("version_id", F.sha2("text", 256)))
    documents.select("doc_id", "text", "version_id").write.parquet(f"{path}/documents")
    return _write(index.spark, kept("lengths").unionByName(lengths), kept("postings").drop("bucket").unionByName(postings), path)


def export_index(index: StoredIndex, path: str) -> None:
    """The snapshot: source documents and the meta row, no postings."""
    index.read("documents").select("doc_id", "text").write.parquet(f"{path}/documents")
    index.read("meta").select("format", "index_id").coalesce(1).write.parquet(f"{path}/snapshot")


def import_index(spark: SparkSession, snapshot: str, path: str) -> StoredIndex:
    """An exported snapshot rebuilt; one whose documents don't give the stated identity, or of another format, is an error."""
    stated = spark.read.parquet(f"{snapshot}/snapshot").first()
    if stated["format"] != FORMAT:
        raise ValueError("unsupported index format")
    index = build_index(spark.read.parquet(f"{snapshot}/documents"), path)
    if index.read("meta").first()["index_id"] != stated["index_id"]:
        raise ValueError("the snapshot's documents don't match its identity")
    return index
