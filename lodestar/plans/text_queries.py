"""Queries of scalar text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import query, table

# The patterns as RE2 writes them, where \b is ASCII.
SQL_AUDIT = {
    "numbers": r"[+-]?[0-9]+(?:[,.][0-9]+)*(?:%|％)?",
    "units": rf"(?i)\b(?:{T.UNITS})\b|°[CF]|公斤|公里|公尺|毫秒|小時|分鐘|美元|元|%|％",
    "dates": rf"(?i)\b[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}\b|\b(?:{T.MONTHS})\s+[0-9]{{1,2}}(?:,?\s+[0-9]{{4}})?\b|[0-9]{{4}}年[0-9]{{1,2}}月[0-9]{{1,2}}日",
    "entities": r"\b[A-Z][\p{L}\p{N}]*(?:\s+[A-Z][\p{L}\p{N}]*)*\b",
    "negation": rf"(?i)\b(?:{T.NEGATIONS.replace(chr(39), chr(39) * 2)})\b|並非|不是|沒有|未曾|不會|不",
    "ranges": r"(?i)[0-9]+(?:\.[0-9]+)?\s*(?:[-–—]|to|至|到)\s*[0-9]+(?:\.[0-9]+)?",
}


def _audit(kind: str):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", F.size(v := T.audit_values(F.col("text"), kind)).alias("n"), F.array_join(v, "|").alias("found"))

    run.__name__ = f"audit_{kind}"
    pattern = SQL_AUDIT[kind]
    return query(f"""
        WITH m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS a FROM documents),
        d AS (SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS v FROM m)
        SELECT doc_id, CAST(len(v) AS INT) AS n, array_to_string(v, '|') AS found FROM d""")(run)


for _kind in SQL_AUDIT:
    _audit(_kind)


@query("""SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) AS clean, CAST(length(text) AS INT) AS n_utf16, CAST(strlen(text) AS INT) AS n_bytes, CAST(length(text) AS INT) AS n_points FROM documents""")
def text_normalize(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(t).alias("clean"), T.utf16_length(t).alias("n_utf16"), F.octet_length(t).alias("n_bytes"), F.char_length(t).alias("n_points"))


@query(r"""SELECT doc_id, replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\', '\\'), '([`*_{}\[\]()#+.!|>])', '\\\1', 'g'), '\r\n?', chr(10), 'g'), chr(10), '  ' || chr(10)) AS md FROM documents""")
def markdown_escape(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.markdown_text(F.col("text")).alias("md"))


@query(r"""
    WITH c AS (SELECT doc_id, text, CAST(length(regexp_replace(text, '[^\p{Han}]', '', 'g')) AS INT) AS han, CAST(length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS INT) AS latin,
               CAST(len(regexp_extract_all(text, '\p{Latin}+')) AS INT) AS latin_words FROM documents)
    SELECT doc_id, han, latin, latin_words, (latin > 0 AND han <= latin) AS ok_en, (han > 0 AND latin_words * 2 <= han) AS ok_zh_tw FROM c""")
def language_gate(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(c.alias(n) for n, c in T.script_counts(t).items()), T.language_ok(t, "en").alias("ok_en"), T.language_ok(t, "zh-TW").alias("ok_zh_tw"))


@query("""
    WITH m AS (SELECT * FROM (VALUES (0, '89504E470D0A1A0A', 'image/png'), (1, 'FFD8FF', 'image/jpeg'), (2, '474946383961', 'image/gif'), (3, '424D', 'image/bmp'), (4, '49492A00', 'image/tiff'), (5, '524946460000000057454250', 'image/webp'), (6, '', NULL)) v(k, magic, kind))
    SELECT doc_id, hex((unhex(magic) || encode(text))[1:8]) AS head, kind FROM documents JOIN m ON k = doc_id % 7""")
def magic_sniff(spark, sf_dir):
    """Documents behind the first bytes of six raster types, and bare."""
    magic = ("89504E470D0A1A0A", "FFD8FF", "474946383961", "424D", "49492A00", "524946460000000057454250", "")
    lead = F.element_at(F.array(*map(F.lit, magic)), (F.col("doc_id") % 7 + 1).cast("int"))
    c = F.concat(F.unhex(lead), F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.hex(F.substring(c, 1, 8)).alias("head"), T.image_kind(c).alias("kind"))


@query("""SELECT doc_id, true AS ok, 'text/plain' AS type, sha256(text) AS sha FROM documents""")
def base64_canonical(spark, sf_dir):
    coded = F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit(""))
    url = F.concat(F.lit("data:text/plain;base64,"), coded)
    return table(spark, sf_dir, "documents").select("doc_id", T.base64_ok(coded).alias("ok"), (d := T.data_url(url))["type"].alias("type"), F.sha2(d["content"], 256).alias("sha"))


@query("""
    SELECT doc_id, substr(text, 1, CASE WHEN instr(text, ' of') > 0 AND (instr(text, '. ') = 0 OR instr(text, ' of') < instr(text, '. ')) THEN instr(text, ' of') - 1
                                        WHEN instr(text, '. ') > 0 THEN instr(text, '. ') - 1 ELSE length(text) END) AS kept FROM documents""")
def stop_strings(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.before_stop(F.col("text"), [" of", ". "]).alias("kept"))


@query(r"""
    WITH p AS (SELECT doc_id, text, instr(text, ' of ') AS pos FROM documents)
    SELECT doc_id, CAST(pos AS INT) AS pos, regexp_matches(regexp_extract(substr(text, 1, pos - 1), '([^.!?;]*)$', 1), '(?i)\b(?:no|not|never|without|neither|zero)\b(?:\s+[\p{L}-]+){0,3}\s*$') AS negated FROM p WHERE pos > 0""")
def negated_mentions(spark, sf_dir):
    at = F.instr("text", " of ")
    return table(spark, sf_dir, "documents").where(at > 0).select("doc_id", at.alias("pos"), T.negated_before(F.col("text"), at - 1).alias("negated"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_valid(props) AS ok FROM events""")
def json_validate_props(spark, sf_dir):
    props = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(props, "$.k", "bigint").alias("k"), props.isNotNull().alias("ok"))


@query("""SELECT doc_id, sha256('{"id":"' || doc_id || '","n":' || n_chars || ',"source":"' || source || '"}') AS version_id FROM documents""")
def doc_version_sha256(spark, sf_dir):
    from ..functions.canonical import canonical_struct

    fields = {"source": F.col("source"), "id": F.col("doc_id").cast("string"), "n": F.col("n_chars")}
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(canonical_struct(fields, numbers={"n"}), 256).alias("version_id"))


@query("""SELECT sha256(string_agg(h, '' ORDER BY id)) AS index_id, count(*) AS documents FROM (SELECT CAST(doc_id AS VARCHAR) AS id, sha256(text) AS h FROM documents)""")
def index_identity(spark, sf_dir):
    from ..functions.canonical import ordered_digest

    return ordered_digest(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.sha2("text", 256).alias("h")))
