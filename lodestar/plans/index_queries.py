"""Queries of the kept index and of what searches return."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import index as I
from ..operators import stored_index as S
from ..operators import vectors as V
from ..storage import fresh_dir
from .registry import query, table
from .retrieval_queries import _TOKENS, QUESTIONS, _bm25, _chunks


def _built(spark, sf_dir):
    return S.build_index(table(spark, sf_dir, "documents"), fresh_dir(spark, "index"))


@query(f"WITH {_TOKENS} SELECT n AS documents, round(avg_len, 9) AS avg_len, (SELECT count(*) FROM p) AS postings, (SELECT count(*) FROM d) AS terms FROM s")
def index_build(spark, sf_dir):
    index = _built(spark, sf_dir)
    post = index.read("postings").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("term").alias("terms"))
    return index.read("meta").select(F.col("n").alias("documents"), F.round(F.col("total") / F.col("n"), 9).alias("avg_len")).join(F.broadcast(post))


@query(_bm25())
def index_search(spark, sf_dir):
    return S.search_index(_built(spark, sf_dir), I.query_terms(spark, QUESTIONS))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256(text) AS version_id, true AS same_id FROM documents")
def index_import(spark, sf_dir):
    """Built, exported, imported into another folder: the documents come back and the identity is the same."""
    index, snapshot = _built(spark, sf_dir), fresh_dir(spark, "snapshot")
    S.export_index(index, snapshot)
    again = S.import_index(spark, snapshot, fresh_dir(spark, "index"))
    same = again.read("meta").first()["index_id"] == index.read("meta").first()["index_id"]
    return again.read("documents").select("doc_id", "version_id", F.lit(same).alias("same_id"))


_CHANGED = "documents AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN substr(text, 1, 200) || ' changed words' ELSE text END AS text FROM main.documents WHERE doc_id % 11 <> 0)"


@query(f"WITH {_CHANGED}, {_TOKENS} SELECT id AS doc_id, len(terms) AS len, len(list_distinct(terms)) AS terms, true AS same_id FROM t")
def index_incremental(spark, sf_dir):
    """A seventh of the documents changed, an eleventh removed; equal to an index of the outcome."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    change = docs.where("doc_id % 7 = 0 and doc_id % 11 <> 0").withColumn("text", F.concat(F.substring("text", 1, 200), F.lit(" changed words")))
    index = S.update_index(_built(spark, sf_dir), change, docs.where("doc_id % 11 = 0").select("doc_id"), fresh_dir(spark, "index"))
    rest = docs.where("doc_id % 11 <> 0 and doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    anew = S.index_identity(rest.unionByName(change.withColumn("doc_id", F.col("doc_id").cast("string"))).withColumn("version_id", F.sha2("text", 256)))
    post = index.read("postings").groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"))
    same = index.read("meta").first()["index_id"] == anew
    lengths = index.read("lengths").select("doc_id", F.col("len").cast("long").alias("len"))
    return lengths.join(post, "doc_id", "left").select("doc_id", "len", F.coalesce("terms", F.lit(0)).alias("terms"), F.lit(same).alias("same_id"))


@query(f"WITH h AS ({_bm25()}) SELECT query_id, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) AS hits FROM h JOIN documents d ON CAST(d.doc_id AS VARCHAR) = chunk_id GROUP BY query_id")
def retained_characters(spark, sf_dir):
    """Characters of the hits that a question retains."""
    chunks = _chunks(spark, sf_dir)
    hits = I.attach_text(I.search(chunks, I.query_terms(spark, QUESTIONS)), chunks)
    return hits.groupBy("query_id").agg(F.sum(I.utf16_length(F.col("text"))).alias("characters"), F.count(F.lit(1)).alias("hits"))


@query("SELECT doc_id, 0 AS start_offset, length(text) AS end_offset, sha256(text) || ':0:' || length(text) AS version_id FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents) WHERE trim(text, chr(9) || chr(10) || chr(13) || ' ') <> ''")
def chunk_versions(spark, sf_dir):
    """Versions of chunks: the document's version and the offsets. Chunks here are as long as any document."""
    docs = table(spark, sf_dir, "documents")
    chunks = I.chunk_documents(docs, 1 << 30).join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.sha2("text", 256).alias("v")), "doc_id")
    return chunks.select("doc_id", "start_offset", "end_offset", F.concat_ws(":", "v", "start_offset", "end_offset").alias("version_id"))


@query("""
    WITH c AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN substr(text, 2, 20) WHEN 1 THEN substr(text, 2, 20) || chr(1) ELSE NULL END AS claim, text FROM documents)
    SELECT doc_id AS claim_id, coalesce(contains(text, claim), false) AS supported FROM c""")
def answer_support(spark, sf_dir):
    """A claim of each document: words of it, words that it hasn't, or a claim that cites nothing."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    part = F.substring("text", 2, 20)
    claims = d.select(F.col("doc_id").alias("claim_id"), F.when(k == 1, F.concat(part, F.lit("\x01"))).otherwise(part).alias("text"))
    cited = d.where("doc_id % 3 <> 2").select(F.col("doc_id").alias("claim_id"), F.col("text").alias("chunk_text"))
    return I.supported_answers(claims, cited)


@query("""
    WITH c AS (SELECT doc_id, CAST(1 + length(text) % 7 AS DOUBLE) AS a, CAST(length(text) % 5 AS DOUBLE) AS b FROM documents)
    SELECT doc_id, round(a / sqrt(a * a + b * b), 5) AS x, round(b / sqrt(a * a + b * b), 5) AS y FROM c""")
def embedder_seam(spark, sf_dir):
    """A host's embedder, here two numbers of a text's length, called for batches and checked."""
    embed = V.embed_with(lambda texts: [[1 + len(t) % 7, len(t) % 5] for t in texts], 2)
    v = table(spark, sf_dir, "documents").select("doc_id", embed("text").alias("v"))
    return v.select("doc_id", *(F.round(F.col("v")[i].cast("double"), 5).alias(n) for i, n in enumerate("xy")))


@query("SELECT doc_id, sha256(text) AS version_id FROM documents WHERE doc_id % 4 = 1")
def live_vectors(spark, sf_dir):
    """Stored vectors of an earlier state, of which half the documents have changed and half are gone."""
    d = table(spark, sf_dir, "documents")
    version = F.sha2("text", 256)
    was = d.where("doc_id % 2 = 1").select("doc_id", F.when(F.col("doc_id") % 4 == 1, version).otherwise(F.sha2(F.concat("text", F.lit("x")), 256)).alias("version_id"))
    return V.retained_vectors(was, d.select(version.alias("version_id")))
