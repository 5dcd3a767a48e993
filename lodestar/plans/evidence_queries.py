"""Queries of evidence: paragraphs, ledgers, audits, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import AUDIT
from ..operators import evidence as E
from ..storage import stored
from .registry import query, table

_LINES = r"""
    l AS (SELECT doc_id AS page_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM documents),
    p AS (SELECT page_id, CAST(unnest(range(1, len(ls) + 1)) AS INT) AS ordinal, unnest(ls) AS text FROM l)"""


def _paragraphs(spark, sf_dir):
    return E.paragraphs_of_lines(table(spark, sf_dir, "documents"))


@query(f"""WITH {_LINES}
    SELECT page_id, ordinal, 'p' || ordinal AS paragraph_id, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start,
           CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS INT) AS "end" FROM p""")
def paragraph_offsets(spark, sf_dir):
    return E.with_offsets(_paragraphs(spark, sf_dir)).drop("text")


@query(f"WITH {_LINES} SELECT page_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY ordinal)) AS sha FROM p GROUP BY page_id")
def doc_from_paragraphs(spark, sf_dir):
    return E.document_from_paragraphs(_paragraphs(spark, sf_dir)).select("page_id", F.sha2("text", 256).alias("sha"))


@query(f"""WITH {_LINES}
    SELECT page_id, ordinal, last_value(CASE WHEN length(text) < 40 THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM p""")
def heading_asof(spark, sf_dir):
    return E.with_heading(_paragraphs(spark, sf_dir), F.length("text") < 40).select("page_id", "ordinal", "heading")


@query("""
    WITH b AS (SELECT doc_id, CAST(n_chars AS INT) AS n, CAST(n_chars // 4 AS INT) AS a1, CAST(n_chars // 3 AS INT) AS a2, CAST(n_chars // 2 AS INT) AS a3, CAST(n_chars * 3 // 4 AS INT) AS a4 FROM documents),
    r AS (SELECT doc_id, 'b1' AS name, a1 AS start, a2 AS "end" FROM b UNION ALL SELECT doc_id, 'b2', a3, a4 FROM b UNION ALL SELECT doc_id, NULL, 0, a1 FROM b UNION ALL SELECT doc_id, NULL, a2, a3 FROM b UNION ALL SELECT doc_id, NULL, a4, n FROM b)
    SELECT * FROM r WHERE name IS NOT NULL OR start < "end" """)
def gap_fill_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("int").alias("n"))
    part = lambda name, a, b: d.select("doc_id", F.lit(name).alias("name"), F.expr(a).cast("int").alias("start"), F.expr(b).cast("int").alias("end"))
    return E.fill_gaps(part("b1", "n div 4", "n div 3").unionByName(part("b2", "n div 2", "n * 3 div 4")), d.select("doc_id", F.col("n").alias("length")))


@query(f"""WITH {_LINES}, t AS (SELECT *, page_id % 4 AS k FROM p)
    SELECT page_id, 'p' || ordinal AS paragraph_id, CASE WHEN k = 1 THEN 'quote differs' ELSE 'does not reach the end' END AS reason FROM t WHERE ordinal = 1 AND k IN (1, 2)
    UNION ALL SELECT page_id, 'p' || ordinal, 'no fact' FROM t WHERE ordinal = 1 AND k = 3""")
def ledger_tiling(spark, sf_dir):
    """Ledgers tampered with in three ways on known pages; the checks must name each and no other."""
    p = _paragraphs(spark, sf_dir)
    facts = E.source_facts(p)
    first, k = F.col("ordinal") == 1, F.col("page_id") % 4
    facts = facts.where(~(first & (k == 3))).withColumn("quote", F.when(first & (k == 1), F.concat(F.lit("\u0001"), F.substring(F.col("quote"), F.lit(2), F.length("quote")))).when(first & (k == 2), F.substring(F.col("quote"), F.lit(1), F.length("quote") - 1)).otherwise(F.col("quote")))
    facts = facts.withColumn("end", F.when(first & (k == 2), F.col("end") - 1).otherwise(F.col("end")))
    facts = facts.where(~(first & (k == 2) & (F.col("end") == 0)))
    return E.ledger_breaks(facts, p)


@query(f"""WITH {_LINES} SELECT page_id || ':' || ordinal AS target, CASE page_id % 3 WHEN 1 THEN 'overlap' ELSE 'tail' END AS reason FROM p WHERE length(text) >= 12 AND page_id % 3 <> 0""")
def span_coverage(spark, sf_dir):
    """Two claims over each paragraph: whole on a third of the pages, overlapping or short of the end on the others."""
    p = _paragraphs(spark, sf_dir).where(F.length("text") >= 12).select(F.concat_ws(":", "page_id", "ordinal").alias("target"), "text", (F.col("page_id") % 3).alias("k"), F.length("text").alias("n"))
    half = F.floor(F.col("n") / 2).cast("int")
    end = F.length(F.rtrim(F.substring(F.col("text"), F.lit(1), F.col("n") - 3)))
    first = p.select("target", F.lit(0).alias("start"), half.alias("end"))
    second = p.select("target", F.when(F.col("k") == 1, half - 1).otherwise(half).alias("start"), F.when(F.col("k") == 2, F.least(end, F.col("n") - 1)).otherwise(F.col("n")).alias("end"))
    return E.span_breaks(first.unionByName(second), p.select("target", "text"))


@query()
def audit_status(spark, sf_dir):
    """Claims are sentences, changed by page: as they are, with a number added, negated; held against their paragraph."""
    p = _paragraphs(spark, sf_dir).where(~F.col("text").rlike("[0-9]"))
    one = p.select(F.concat_ws(":", "page_id", "ordinal").alias("claim_id"), (F.col("page_id") % 3).alias("k"), F.element_at(E.sentences("text"), 1).alias("s"), "text")
    one = stored(one, "audit-claims").where("s is not null")  # claims and quotes are made of the same rows; a filter before would cut the sentences twice
    quotes = one.select("claim_id", F.when(F.col("k") == 1, F.concat(F.lit("7 "), "text")).otherwise(F.col("text")).alias("quote"))
    claims = one.select("claim_id", F.when(F.col("k") == 1, F.concat(F.lit("8 "), "s")).when(F.col("k") == 2, F.concat(F.lit("not "), "s")).otherwise(F.col("s")).alias("claim"))
    return E.audit_claims(claims, quotes)


@query("""
    SELECT kind AS claim_id, CASE WHEN kind = 'same' THEN 'supported' WHEN kind = 'other' THEN 'unknown' ELSE 'contradicted' END AS status
    FROM (VALUES ('numbers'), ('units'), ('dates'), ('entities'), ('negation'), ('ranges'), ('same'), ('other')) v(kind)""")
def audit_kinds(spark, sf_dir):
    """One pair of sentences for each kind of conflict."""
    pairs = [
        ("numbers", "The gate fee is 7 coins.", "The gate fee is 8 coins."), ("units", "The lane runs 4 km.", "The lane runs 4 m."), ("dates", "It starts on 2026-10-03.", "It starts on 2026-10-04."),
        ("entities", "The depot is in Paris.", "The depot is in Berlin."), ("negation", "Dogs are not allowed.", "Dogs are allowed."), ("ranges", "Depth is 2-4 m here.", "Depth is 3-5 m here."),
        ("same", "Same words.", "Same words."), ("other", "Some words.", "Other meaning."),
    ]
    df = spark.createDataFrame(pairs, "claim_id string, quote string, claim string")
    return E.audit_claims(df.select("claim_id", "claim"), df.select("claim_id", "quote")).select("claim_id", "status")


@query(f"""WITH {_LINES} SELECT page_id, count(*) AS quotes, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) + 2 AS claims, 'q1' AS summary_facts FROM p GROUP BY page_id""")
def report_extractive_coverage(spark, sf_dir):
    facts = E.source_facts(_paragraphs(spark, sf_dir))
    return E.report_coverage(facts, E.extractive_claims(facts))


@query(rf"""WITH {_LINES}, m AS (SELECT page_id, ordinal, text, replace(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\', '\\'), '([`*_{{}}\[\]()#+.!|>])', '\\\1', 'g'), chr(10), '  ' || chr(10)) AS md FROM p)
    SELECT page_id, ordinal, '- q' || ordinal || ' (p' || ordinal || ':0–' || length(text) || ') — ' || md AS line FROM m""")
def report_markdown_lines(spark, sf_dir):
    return E.markdown_lines(E.source_facts(_paragraphs(spark, sf_dir)))


@query()
def report_markdown(spark, sf_dir):
    p = _paragraphs(spark, sf_dir)
    facts = E.source_facts(p)
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("title"), F.col("source").alias("url"))
    return E.render_markdown(pages, facts, E.extractive_claims(facts))


@query(f"""WITH {_LINES} SELECT page_id, ordinal, sha256('{{"id":"p' || ordinal || '","text":' || CAST(to_json(text) AS VARCHAR) || '}}') AS version_id FROM p""")
def paragraph_versions(spark, sf_dir):
    return E.source_facts(_paragraphs(spark, sf_dir)).select("page_id", "ordinal", "version_id")


@query("""
    WITH a AS (SELECT user_id AS run_id, event_type AS stage, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt, event_id, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
    SELECT run_id, stage FROM a GROUP BY run_id, stage HAVING run_id % 10 = 0""")
def attempt_ledger(spark, sf_dir):
    """Attempts made of events, the last of each stage a success, but for every tenth run, which has none."""
    from pyspark.sql import Window

    by = Window.partitionBy("run_id", "stage")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), "event_id")
    a = e.withColumn("attempt", F.row_number().over(by.orderBy("event_id"))).withColumn("n", F.count(F.lit(1)).over(by))
    return E.attempt_breaks(a.select("run_id", "stage", "attempt", ((F.col("attempt") == F.col("n")) & (F.col("run_id") % 10 != 0)).alias("ok"))).select("run_id", "stage")


@query("""SELECT user_id, count(*) AS calls, round(sum(value), 6) AS usage, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY user_id""")
def usage_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 6).alias("usage"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("tokens"))


assert set(AUDIT) == {"numbers", "units", "dates", "entities", "negation", "ranges"}
