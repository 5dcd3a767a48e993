"""Queries of retrieval: terms, BM25, coverage, maintenance, quotes, vectors, fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, with_terms
from ..operators import index as I
from ..operators import vectors as V
from .registry import query, table

#: Rows of a ranking that fusion takes.
CANDIDATES = 100
QUESTIONS = {"q1": "the ering of thought", "q2": "tion und keit heit", "q3": "que mente ción los"}
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = rf"""
    t AS (SELECT CAST(doc_id AS VARCHAR) AS id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: NOT list_contains([{_STOP}], x)) AS terms FROM documents),
    e AS (SELECT id, len(terms) AS len, unnest(terms) AS term FROM t),
    p AS (SELECT term, id, len, count(*) AS tf FROM e GROUP BY ALL),
    s AS (SELECT count(*) AS n, avg(len(terms)) AS avg_len FROM t),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term)"""
_ASKED = "q AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}')" for n, q in QUESTIONS.items() for t in q.split() if t not in STOP_WORDS) + ") v(query_id, term))"
_PART = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))"


def _bm25(where: str = "") -> str:
    return f"""
    WITH {_TOKENS}, {_ASKED},
    m AS (SELECT query_id, id, round(sum({_PART}), 9) AS score FROM q JOIN p USING (term) JOIN d USING (term), s {where} GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM m)
    SELECT query_id, id AS chunk_id, id AS doc_id, score, rank FROM r WHERE rank <= 8"""


def _chunks(spark, sf_dir):
    return I.chunk_table(table(spark, sf_dir, "documents"))


@query(f"WITH {_TOKENS} SELECT term, id AS chunk_id, tf, CAST(len AS INT) AS len FROM p")
def tokens_tf(spark, sf_dir):
    return I.postings(_chunks(spark, sf_dir)).select("term", "chunk_id", "tf", "len")


@query(f"WITH {_TOKENS} SELECT term, df FROM d ORDER BY df DESC, term LIMIT 100")
def term_df_top(spark, sf_dir):
    return I.postings(_chunks(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "term").limit(100)


@query(f"WITH {_TOKENS} SELECT n, round(avg_len, 9) AS avg_len FROM s")
def chunk_stats(spark, sf_dir):
    return I.index_stats(_chunks(spark, sf_dir)).select("n", F.round("avg_len", 9).alias("avg_len"))


@query(_bm25())
def bm25_topk(spark, sf_dir):
    return I.search(_chunks(spark, sf_dir), I.query_terms(spark, QUESTIONS))


@query(_bm25("WHERE CAST(id AS BIGINT) IN (SELECT doc_id FROM documents WHERE source = 'src3')"))
def bm25_restricted(spark, sf_dir):
    only = table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id")
    return I.search(_chunks(spark, sf_dir), I.query_terms(spark, QUESTIONS), restrict=only)


@query(f"""
    WITH {_TOKENS}, {_ASKED},
    f AS (SELECT query_id, id, term, tf, len, df FROM q JOIN p USING (term) JOIN d USING (term)),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY df, term) AS k FROM f),
    a AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY df, term, id) AS adm FROM o WHERE k = 1),
    m AS (SELECT query_id, id, round(sum({_PART}), 9) AS score FROM f JOIN a USING (query_id, id), s WHERE adm <= 100 GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM m)
    SELECT query_id, id AS chunk_id, id AS doc_id, score, rank FROM r WHERE rank <= 8""")
def bm25_capped(spark, sf_dir):
    return I.search(_chunks(spark, sf_dir), I.query_terms(spark, QUESTIONS), max_scored=100)


@query(rf"""
    WITH {_TOKENS},
    b AS (SELECT CAST(item_id AS VARCHAR) AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: NOT list_contains([{_STOP}], x))) AS ts FROM benchmark),
    q AS (SELECT query_id, unnest(ts) AS term FROM b),
    m AS (SELECT query_id, id, round(sum({_PART}), 6) AS score FROM q JOIN p USING (term) JOIN d USING (term), s GROUP BY ALL),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM m)
    SELECT query_id, id AS chunk_id, score, rank FROM r WHERE rank <= 3""")
def bm25_multi_query(spark, sf_dir):
    asked = with_terms(table(spark, sf_dir, "benchmark")).select(F.col("item_id").cast("string").alias("query_id"), F.explode(F.array_distinct("terms")).alias("term"))
    scored = I.matches(_chunks(spark, sf_dir), asked).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score"))
    return I.top_hits(scored, 3)


@query(f"""
    WITH {_TOKENS}, {_ASKED},
    m AS (SELECT query_id, count(DISTINCT id) AS reached, string_agg(DISTINCT term, ' ' ORDER BY term) AS matched FROM q JOIN p USING (term) GROUP BY query_id),
    a AS (SELECT query_id, string_agg(term, ' ' ORDER BY term) AS asked FROM q GROUP BY query_id)
    SELECT query_id, n AS chunks, n AS eligible, least(coalesce(reached, 0), 10000) AS scored, asked, coalesce(matched, '') AS matched, coalesce(reached, 0) > 10000 AS limit_reached FROM a LEFT JOIN m USING (query_id), s""")
def retrieval_coverage(spark, sf_dir):
    return I.coverage(_chunks(spark, sf_dir), I.query_terms(spark, QUESTIONS))


@query("""
    WITH c AS (SELECT doc_id, text, unnest(range(0, length(text), 1200)) AS s FROM documents)
    SELECT doc_id, CAST(s AS INT) AS start_offset, CAST(least(s + 1200, length(text)) AS INT) AS end_offset, sha256(substr(text, s + 1, 1200)) AS sha FROM c WHERE length(text) > 0""")
def chunks_fixed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    cut = d.withColumn("s", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(1200))))
    return cut.select("doc_id", F.col("s").alias("start_offset"), F.least(F.col("s") + 1200, F.length("text")).alias("end_offset"), F.sha2(F.substring(F.col("text"), F.col("s") + 1, F.lit(1200)), 256).alias("sha"))


@query()
def chunks_boundary(spark, sf_dir):
    return I.chunk_documents(table(spark, sf_dir, "documents")).select("doc_id", "chunk_id", "start_offset", "end_offset", F.sha2("text", 256).alias("version"))


@query()
def chunked_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return I.attach_chunks(I.search(I.chunk_documents(docs), I.query_terms(spark, QUESTIONS)), docs)


@query("""SELECT doc_id, CAST(instr(text, 'tion of') - 1 AS INT) AS start, CAST(instr(text, 'tion of') + 6 AS INT) AS "end", 'tion of' AS quote FROM documents WHERE instr(text, 'tion of') > 0""")
def quote_offsets(spark, sf_dir):
    return I.quotes(table(spark, sf_dir, "documents"), F.lit("tion of"))


@query("""
    SELECT doc_id, CAST(instr(text, ' the ') - 1 + doc_id % 2 AS INT) AS start, doc_id % 3 <> 0 AND doc_id % 2 = 0 AS valid FROM documents WHERE instr(text, ' the ') > 0""")
def citation_validate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    version = F.when(F.col("doc_id") % 3 != 0, F.sha2("text", 256)).otherwise("stale")
    cites = I.quotes(docs, F.lit(" the ")).join(docs.select("doc_id", version.alias("version_id")), "doc_id")
    shift = (F.col("doc_id") % 2).cast("int")
    cites = cites.withColumn("start", F.col("start") + shift).withColumn("end", F.col("end") + shift)
    return I.valid_citations(cites, docs).select("doc_id", "start", "valid")


@query("""
    SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS version FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0""")
def incremental_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = docs.where("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit("!")))
    return I.upsert(docs, changed, docs.where("doc_id % 5 = 0 and doc_id % 7 <> 0")).select("doc_id", F.sha2("text", 256).alias("version"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN 'added' ELSE 'same' END AS change FROM documents""")
def changed_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.where("doc_id % 5 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return I.changed_documents(docs.where("doc_id % 11 <> 0 or doc_id % 5 = 0 or doc_id % 7 = 0"), new)


@query("""SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_duplicate_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query()
def context_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = I.attach_chunks(I.search(I.chunk_documents(docs), I.query_terms(spark, QUESTIONS), k=20), docs)
    return I.pack_context(hits.withColumn("tokens", F.ceil(F.length("text") / 4).cast("int")), 1500)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, true AS ok, CAST(len(embedding) AS INT) AS dims FROM embeddings""")
def vector_unit(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), V.valid_vector(v, 64).alias("ok"), F.size(V.unit(v)).alias("dims"))


def _cosine(floor: str) -> str:
    return f"""
    WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM n),
    s AS (SELECT q.vec_id AS query_id, u.vec_id, round(list_sum(list_transform(list_zip(q.v, u.v), lambda p: p[1] * p[2])), 9) AS score FROM u q JOIN u ON q.vec_id % 20 = 0 AND u.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INT) AS rank FROM s {floor})
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 10"""


@query(_cosine(""))
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.cosine_ranking(e, e.where("vec_id % 20 = 0"), 10)


@query(_cosine("WHERE score >= 0.3"))
def cosine_floor(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return V.cosine_ranking(e, e.where("vec_id % 20 = 0"), 10, floor=0.3)


@query(f"""
    WITH {_TOKENS}, {_ASKED},
    lex AS (SELECT id, row_number() OVER (ORDER BY round(sum({_PART}), 9) DESC, id) AS rank FROM q JOIN p USING (term) JOIN d USING (term), s WHERE query_id = 'q1' GROUP BY id),
    n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM n),
    sem AS (SELECT z.vec_id AS query_id, CAST(u.vec_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY z.vec_id ORDER BY round(list_sum(list_transform(list_zip(z.v, u.v), lambda p: p[1] * p[2])), 9) DESC, CAST(u.vec_id AS VARCHAR)) AS rank FROM u, u z WHERE z.vec_id % 20 = 0 AND u.vec_id <> z.vec_id),
    every AS (SELECT DISTINCT vec_id AS query_id FROM u WHERE vec_id % 20 = 0),
    f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM (SELECT query_id, id, rank FROM every, lex WHERE rank <= 100 UNION ALL SELECT * FROM sem WHERE rank <= 100) GROUP BY query_id, id)
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM f QUALIFY rank <= 10""")
def rrf_hybrid(spark, sf_dir):
    """One question with each vector whose id is divisible by 20: the first CANDIDATES of both rankings are fused."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0")
    hits = I.search(_chunks(spark, sf_dir), I.query_terms(spark, {"q1": QUESTIONS["q1"]}), CANDIDATES).select(F.col("chunk_id").alias("id"), "rank")
    lexical = asked.select(F.col("vec_id").alias("query_id")).distinct().join(F.broadcast(hits))  # CANDIDATES rows
    semantic = V.cosine_ranking(e, asked, CANDIDATES).select("query_id", F.col("vec_id").cast("string").alias("id"), "rank")
    return V.reciprocal_rank_fusion(lexical.unionByName(semantic), 10)


@query("""SELECT doc_id, sha256(text) AS version_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label < 5) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN embeddings ON vec_id = doc_id WHERE label < 5)""")
def vector_cache_missing(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("version_id"))
    have = table(spark, sf_dir, "embeddings").where("label < 5").join(chunks, F.col("vec_id") == F.col("doc_id")).select("version_id", F.lit("e1").alias("embedder_id"))
    return V.missing_vectors(chunks, have, "e1")
