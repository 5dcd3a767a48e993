"""Queries of evaluation, conversations and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import chat as C
from ..operators import quality as Q
from .registry import query, table

# A closed set of facts and rules of our own for the driver's invented words.
FACTS = [("T1", "tion", "zzz"), ("T2", "ering", "ing the"), ("T3", "keit", "zzz"), ("T4", "mente", "zzz")]
RULES = [("R1", "contradiction", "edthth"), ("R2", "unsupported", "lynd|heer")]
_FACTS = "f AS (SELECT * FROM (VALUES ('T1', 'tion', 'zzz'), ('T2', 'ering', 'ing the'), ('T3', 'keit', 'zzz'), ('T4', 'mente', 'zzz')) v(id, pattern, negated_by))"
_OUT = """
    o AS (SELECT doc_id AS case_id, unnest(list_transform(string_split(text, chr(10)), lambda x: replace(x, chr(13), ''))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents),
    l AS (SELECT case_id, CAST(line_number AS INT) AS line_number, 'T' || (1 + (case_id + line_number) % 5) AS id, trim(line) AS statement FROM o WHERE trim(line) <> '')"""
_JUDGED = f"""WITH {_FACTS}, {_OUT},
    m AS (SELECT l.*, f.id IS NOT NULL AS known, coalesce(regexp_matches(statement, '(?i)' || pattern) AND NOT regexp_matches(statement, '(?i)' || negated_by), false) AS own,
          row_number() OVER (PARTITION BY case_id, l.id ORDER BY line_number) AS turn FROM l LEFT JOIN f ON l.id = f.id),
    x AS (SELECT DISTINCT case_id, line_number FROM l JOIN f ON l.id <> f.id WHERE regexp_matches(statement, '(?i)' || pattern) AND NOT regexp_matches(statement, '(?i)' || negated_by)),
    j AS (SELECT m.case_id, m.line_number, m.id, CASE WHEN NOT known THEN 'unknown-id' WHEN turn > 1 THEN 'duplicate' WHEN NOT own AND x.case_id IS NOT NULL THEN 'cross-id' WHEN NOT own THEN 'oracle-miss' END AS reason FROM m LEFT JOIN x USING (case_id, line_number))"""


def _lines(spark, sf_dir):
    """Each line of a document as a claim about one of five ids."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim(F.replace("line", F.lit("\r"), F.lit(""))) != "")
    name = F.concat(F.lit("FACT T"), 1 + (F.col("case_id") + F.col("at") + 1) % 5)
    texts = lines.select("case_id", F.concat(name, F.lit(": "), "line").alias("text"), (F.col("at") + 1).alias("n"))
    return Q.claim_lines(texts.select(F.struct("case_id", "n").alias("case_id"), "text")).select("case_id.case_id", F.col("case_id.n").alias("line_number"), "id", "statement", "format_error")


def _facts(spark):
    return spark.createDataFrame(FACTS, "id string, pattern string, negated_by string")


@query(f"{_JUDGED} SELECT * FROM j")
def claim_eval(spark, sf_dir):
    return Q.evaluate_claims(_lines(spark, sf_dir), _facts(spark))


@query(f"""{_JUDGED}, c AS (SELECT case_id, count(*) FILTER (reason IS NULL) AS tp, count(*) FILTER (reason IS NOT NULL) AS fp FROM j GROUP BY case_id)
    SELECT case_id, tp, fp, 4 - tp AS fn, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CAST(tp AS DOUBLE) / 4 AS recall FROM c""")
def claim_precision_recall(spark, sf_dir):
    return Q.precision_recall(Q.evaluate_claims(_lines(spark, sf_dir), _facts(spark)), _facts(spark))


@query()
def cross_rules(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule_id string, kind string, pattern string")
    return Q.rule_findings(_lines(spark, sf_dir).where("id is not null"), rules)


_REC = """
    r AS (SELECT l_orderkey AS k, 'H' || lpad(CAST(l_partkey % 300 AS VARCHAR), 3, '0') AS code, 'S' || lpad(CAST(l_suppkey % 90 AS VARCHAR), 3, '0') AS station, CAST(l_quantity AS INT) AS v, l_linenumber AS n FROM lineitem)"""


def _record_texts(spark, sf_dir):
    code = F.concat(F.lit("H"), F.lpad((F.col("l_partkey") % 300).cast("string"), 3, "0"))
    station = F.concat(F.lit("S"), F.lpad((F.col("l_suppkey") % 90).cast("string"), 3, "0"))
    text = F.concat(code, F.lit(": station "), station, F.lit(" at Elm plot measured rainfall "), F.col("l_quantity").cast("int"), F.lit(" millimeters on 2024-03-05. See H999."))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("case_id"), text.alias("text"))


@query(f"""WITH {_REC} SELECT k * 10 + n AS case_id, 0 AS place, code, CASE WHEN CAST(substr(code, 2) AS INT) >= 200 THEN 'unsupported' WHEN station = 'S' || lpad(CAST(CAST(substr(code, 2) AS INT) % 90 AS VARCHAR), 3, '0') AND v = CAST(substr(code, 2) AS INT) % 50 THEN 'true' ELSE 'contradiction' END AS verdict FROM r""")
def tuple_extract_score(spark, sf_dir):
    """Record sentences made of order lines against an oracle of 200 codes."""
    o = spark.range(200)
    oracle = o.select(
        F.concat(F.lit("H"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("code"), F.concat(F.lit("S"), F.lpad((F.col("id") % 90).cast("string"), 3, "0")).alias("station"), F.lit("Elm").alias("site"),
        F.lit("rainfall").alias("field"), (F.col("id") % 50).cast("string").alias("value"), F.lit("millimeters").alias("unit"), F.lit("2024-03-05").alias("date"),
    )
    return Q.score_records(Q.records(_record_texts(spark, sf_dir)), F.broadcast(oracle))


@query("SELECT l_orderkey * 10 + l_linenumber AS case_id, 1 AS strays FROM lineitem")
def stray_codes(spark, sf_dir):
    return Q.stray_codes(_record_texts(spark, sf_dir))


@query("""
    WITH m AS (SELECT d.source AS scope, avg(CAST(quality AS DOUBLE)) AS v FROM labels JOIN documents d USING (doc_id) GROUP BY 1), s AS (SELECT DISTINCT source AS scope FROM documents)
    SELECT scope, 'quality' AS metric, round(v, 9) AS value, CAST(0.85 AS DOUBLE) AS least FROM s LEFT JOIN m USING (scope) WHERE v IS NULL OR v < 0.85""")
def quality_gate(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    metrics = labels.join(docs.select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("scope")).agg(F.avg("quality").alias("value")).withColumn("metric", F.lit("quality"))
    policy = docs.select(F.col("source").alias("scope")).distinct().select("scope", F.lit("quality").alias("metric"), F.lit(0.85).alias("least"))
    return Q.gate(metrics, policy).withColumn("value", F.round("value", 9))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 5 = 0 THEN 'source' END, CASE WHEN doc_id % 3 = 0 THEN 'n_chars' END) AS differs FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 3 = 0)
    UNION ALL SELECT doc_id, 'only left' FROM documents WHERE doc_id % 7 = 0""")
def artifact_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    other = d.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("n_chars")).alias("n_chars"))
    return Q.compare_artifacts(d, other, "doc_id", ["source", "n_chars"])


@query("""
    WITH t AS (SELECT conv_id, turn, text, CASE WHEN conv_id % 5 = 0 AND turn = 2 THEN 'system' WHEN conv_id % 7 = 0 AND turn = 1 THEN 'robot' WHEN conv_id % 11 = 0 AND turn = 3 THEN 'user' ELSE role END AS role FROM conversations),
    m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS was FROM t),
    r AS (SELECT conv_id, turn, CASE WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 'role' WHEN role = 'system' AND n > 1 THEN 'system not first'
          WHEN role <> 'system' AND role <> CASE WHEN was IS NULL OR was IN ('system', 'assistant') THEN 'user' ELSE 'assistant' END THEN 'alternation' WHEN n = 129 THEN 'too many' END AS reason FROM m)
    SELECT * FROM r WHERE reason IS NOT NULL""")
def conv_alternation(spark, sf_dir):
    """Conversations with roles changed in three ways."""
    at = lambda m, turn: (F.col("conv_id") % m == 0) & (F.col("turn") == turn)
    role = F.when(at(5, 2), "system").when(at(7, 1), "robot").when(at(11, 3), "user").otherwise(F.col("role"))
    return C.chat_faults(table(spark, sf_dir, "conversations").withColumn("role", role))


def _window(most: int, tokens: int) -> str:
    """Every even number of dropped messages is tried; the least that fits is the policy's."""
    return f"""
    WITH s AS (SELECT *, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tk, role <> 'system' AS own, row_number() OVER (PARTITION BY conv_id, role <> 'system' ORDER BY turn, role, text) - 1 AS place FROM conversations),
    k AS (SELECT DISTINCT conv_id, unnest(range(0, 300, 2)) AS d FROM s),
    c AS (SELECT conv_id, d, count(*) FILTER (NOT own OR place >= d) AS n, sum(tk) FILTER (NOT own OR place >= d) AS t, count(*) FILTER (own AND place >= d) AS r FROM k JOIN s USING (conv_id) GROUP BY conv_id, d),
    b AS (SELECT conv_id, min(d) AS d FROM c WHERE n <= {most} AND t <= {tokens} AND (r > 0 OR d = 0) GROUP BY conv_id)"""


@query(f"{_window(6, 400)} SELECT conv_id, turn, role, text FROM s JOIN b USING (conv_id) WHERE NOT own OR place >= d")
def conv_drop_oldest(spark, sf_dir):
    return C.drop_oldest(table(spark, sf_dir, "conversations"), 6, 400)


@query(f"{_window(6, 40)} SELECT DISTINCT conv_id, 'CONTEXT_LIMIT' AS code FROM s WHERE conv_id NOT IN (SELECT conv_id FROM b)")
def conv_context_limit(spark, sf_dir):
    return C.over_context(table(spark, sf_dir, "conversations"), 6, 40)


@query("""SELECT conv_id, '{"version":1,"messages":[' || string_agg('{"role":"' || role || '","text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn, role, text) || ']}' AS session FROM conversations GROUP BY conv_id""")
def conv_export(spark, sf_dir):
    return C.export_sessions(table(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn, role, text FROM conversations""")
def conv_import(spark, sf_dir):
    return C.import_sessions(C.export_sessions(table(spark, sf_dir, "conversations")))


@query("""
    WITH c AS (SELECT user_id AS conv_id, event_id AS id, event_type AS name FROM events)
    SELECT conv_id, id, 'no result' AS reason FROM c WHERE id % 11 = 0 UNION ALL SELECT conv_id, id, 'other name' FROM c WHERE id % 13 = 0 AND id % 11 <> 0 UNION ALL SELECT conv_id, -id - 1, 'no call' FROM c WHERE id % 17 = 0""")
def tool_integrity(spark, sf_dir):
    """Events as calls; their answers miss some, rename some and add some."""
    calls = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    answers = calls.where("id % 11 <> 0").withColumn("name", F.when(F.col("id") % 13 == 0, "x").otherwise(F.col("name"))).unionAll(calls.where("id % 17 = 0").withColumn("id", -F.col("id") - 1)).withColumn("status", F.lit("ok"))
    return C.tool_faults(calls, answers, [r[0] for r in calls.select("name").distinct().collect()])


@query("""SELECT event_id, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN '/k maximum' ELSE '' END AS errors FROM events""")
def json_schema_check(spark, sf_dir):
    check = jsonx.validator({"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False})
    return table(spark, sf_dir, "events").select("event_id", F.array_join(check("props"), ";").alias("errors"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'partial' ELSE 'complete' END AS state, CAST(CASE WHEN event_id % 3 = 0 THEN length(props) - 1 ELSE length(props) END AS INT) AS "end" FROM events""")
def json_boundary(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.concat("props", F.lit(" and more")))
    return table(spark, sf_dir, "events").select("event_id", jsonx.json_boundary(text).alias("b")).select("event_id", "b.state", "b.end")
