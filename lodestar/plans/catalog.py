"""The registered queries of the reference's own operators, and their SQL; the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, index
from ..sources import html
from ..storage import stored
from . import evaluation_queries, evidence_queries, index_queries, page_queries, report_queries, retrieval_queries, stream_queries, structure_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES, query, table

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to evidence: extract, chunk, search, quote, audit, and the coverage of each found page's extractive report."""
    pages = html.extract_pages(table(spark, sf_dir, "pages"), mode="main")
    paragraphs = stored(html.child_rows(pages, "paragraphs").select("page_id", "ordinal", "paragraph_id", "text"), "paragraphs")  # pages are parsed once
    docs = stored(evidence.document_from_paragraphs(paragraphs).select(F.col("page_id").alias("doc_id"), "text"), "documents")
    hits = stored(index.attach_chunks(index.search(index.chunk_documents(docs), index.query_terms(spark, retrieval_queries.QUESTIONS)), docs), "hits")
    claim = F.element_at(evidence.sentences("text"), 1)
    named = hits.select(F.concat_ws("#", "query_id", "chunk_id").alias("claim_id"), "query_id", "rank", "doc_id", claim.alias("claim"), F.col("text").alias("quote"))
    audits = evidence.audit_claims(named.select("claim_id", "claim"), named.select("claim_id", "quote")).select("claim_id", "status")
    found = hits.select(F.col("doc_id").cast("long").alias("page_id")).distinct()  # at most the hits of the questions
    facts = evidence.source_facts(paragraphs.join(F.broadcast(found), "page_id", "left_semi"))
    coverage = evidence.report_coverage(facts, evidence.extractive_claims(facts)).withColumn("doc_id", F.col("page_id").cast("string"))
    return named.join(audits, "claim_id").join(coverage, "doc_id").select("query_id", "rank", "doc_id", "claim", "status", "quotes", "characters")


@query()
def evidence_pipeline(spark, sf_dir):
    return flagship(spark, sf_dir)
