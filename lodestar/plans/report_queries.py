"""Queries of report records, tables, layout and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions import text as T
from ..operators import evidence as E
from ..operators import geometry as G
from ..operators import quality as Q
from ..operators import relations as R
from ..operators import reports as P
from ..sources import html as H
from .evaluation_queries import _JUDGED, _facts, _lines
from .evidence_queries import _LINES, _paragraphs
from .registry import query, table

_TOKENS = "least(192, 1 + length(text) // 4)"


def _planned(spark, sf_dir):
    facts = E.source_facts(_paragraphs(spark, sf_dir))
    return P.planned_sections(facts, F.least(F.lit(192), 1 + F.floor(F.length("quote") / 4)), 400)


_PLAN = f"""WITH RECURSIVE {_LINES}, k AS (SELECT page_id, ordinal, {_TOKENS} AS tk FROM p),
    g AS (SELECT page_id, ordinal, 0 AS section, 1 AS held, tk AS used FROM k WHERE ordinal = 1
          UNION ALL SELECT k.page_id, k.ordinal, CASE WHEN held = 4 OR used + tk > 400 THEN section + 1 ELSE section END, CASE WHEN held = 4 OR used + tk > 400 THEN 1 ELSE held + 1 END, CASE WHEN held = 4 OR used + tk > 400 THEN tk ELSE used + tk END
          FROM g JOIN k ON k.page_id = g.page_id AND k.ordinal = g.ordinal + 1)"""


@query(f"{_PLAN} SELECT page_id, ordinal, CAST(section AS INT) AS section FROM g")
def report_plan(spark, sf_dir):
    """Facts in sections of at most four within a budget of tokens."""
    return _planned(spark, sf_dir).select("page_id", "ordinal", "section")


@query(f"{_PLAN} SELECT page_id, CAST(section AS INT) AS section, string_agg('p' || ordinal, ',' ORDER BY ordinal) AS paragraphs FROM g GROUP BY page_id, section")
def section_paragraphs(spark, sf_dir):
    return P.section_paragraphs(_planned(spark, sf_dir)).select("page_id", "section", F.array_join("paragraph_ids", ",").alias("paragraphs"))


@query(f"""WITH {_LINES}, n AS (SELECT page_id, max(ordinal) AS m FROM p GROUP BY page_id),
    c AS (SELECT page_id, ordinal, 'sections.' || ordinal || '.keyPoints.1' AS target FROM p UNION ALL SELECT page_id, 1, 'page.summary' FROM n UNION ALL SELECT page_id, m, 'conclusion' FROM n)
    SELECT page_id, target, 'q' || ordinal AS fact_id, 'p' || ordinal AS paragraph_id, sha256(text) AS quote FROM c JOIN p USING (page_id, ordinal)""")
def evidence_citations(spark, sf_dir):
    facts = E.source_facts(_paragraphs(spark, sf_dir))
    cited = P.cited_evidence(E.extractive_claims(facts).select("page_id", "target", "fact_id"), facts)
    return cited.select("page_id", "target", "fact_id", "paragraph_id", F.sha2("quote", 256).alias("quote"))


@query(f"""WITH {_LINES}, n AS (SELECT page_id, count(*) AS n, max(CASE WHEN ordinal = 1 THEN length(text) END) AS l FROM p GROUP BY page_id)
    SELECT page_id, CAST(CASE WHEN page_id % 5 = 3 THEN 0 ELSE n END AS INT) AS n_facts, CAST(CASE WHEN page_id % 5 = 3 THEN 0 ELSE n + 2 END AS INT) AS n_claims,
           CASE page_id % 5 WHEN 1 THEN 'checksum' WHEN 2 THEN 'version' WHEN 3 THEN 'json' ELSE '' END AS faults FROM n""")
def report_roundtrip(spark, sf_dir):
    """Reports written and read again; on some pages the checksum or the version is changed or the end is cut off."""
    facts = E.source_facts(_paragraphs(spark, sf_dir))
    made = P.serialized_reports(facts, E.extractive_claims(facts))
    k = F.col("page_id") % 5
    checksum = F.regexp_replace("report", '"checksum":"[0-9a-f]{64}"', '"checksum":"0"')
    bad = F.when(k == 1, checksum).when(k == 2, F.regexp_replace("report", '"schemaVersion":3', '"schemaVersion":2')).when(k == 3, F.expr("left(report, length(report) - 1)")).otherwise(F.col("report"))
    return P.parsed_reports(made.withColumn("report", bad))


@query(f"""WITH {_LINES}, u AS (SELECT doc_id AS page_id, source AS url FROM documents)
    SELECT page_id, sha256('{{"images":[],"paragraphs":[' || string_agg('{{"id":"p' || ordinal || '","text":' || CAST(to_json(text) AS VARCHAR) || '}}', ',' ORDER BY ordinal) || '],"url":' || CAST(to_json(url) AS VARCHAR) || '}}') AS snapshot_id FROM p JOIN u USING (page_id) GROUP BY page_id, url""")
def page_snapshots(spark, sf_dir):
    urls = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"))
    return P.page_snapshots(_paragraphs(spark, sf_dir), urls)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'unknown' ELSE 'repeated' END AS reason FROM orders WHERE o_orderkey % 3 <> 0")
def reference_faults(spark, sf_dir):
    """Lists of references: as they should be, with one that isn't there, with one twice."""
    k = F.col("o_orderkey") % 3
    listed = F.when(k == 0, F.array(F.lit("p1"), F.lit("p2"))).when(k == 1, F.array(F.lit("p1"), F.lit("p9"))).otherwise(F.array(F.lit("p2"), F.lit("p2")))
    return P.reference_faults(table(spark, sf_dir, "orders"), "o_orderkey", listed, F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")))


@query("SELECT doc_id, list, count(*) AS n FROM (SELECT doc_id, 'source' AS list FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels UNION ALL SELECT doc_id, 'source' FROM documents WHERE doc_id % 2 = 0) GROUP BY ALL")
def fact_lists(spark, sf_dir):
    """Facts of several lists, repeated ones kept."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", F.lit("source").alias("list")), table(spark, sf_dir, "labels").select("doc_id", F.lit("labels").alias("list"))
    return P.all_facts(d, l, d.where("doc_id % 2 = 0")).groupBy("doc_id", "list").agg(F.count(F.lit(1)).alias("n"))


_GRID = "n AS (SELECT page_id, CAST(1 + page_id % 4 AS INT) AS r, CAST(2 + page_id % 3 AS INT) AS c FROM pages)"


def _tables(spark, sf_dir):
    """Pages with a table of 1 to 4 rows of 2 to 4 columns: a head row, then rows whose first cell is a head; the last cell names it."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", (1 + F.col("page_id") % 4).cast("int").alias("r"), (2 + F.col("page_id") % 3).cast("int").alias("c"))
    head = F.array_join(F.transform(F.sequence(F.lit(1), F.col("c")), lambda j: F.concat(F.lit("<th id=h"), j, F.lit(">H"))), "")
    row = F.concat(F.lit("<tr><th rowspan=99 colspan=1>r</th>"), F.repeat(F.lit("<td>v</td>"), F.col("c") - 2), F.lit("<td headers='h1 h2 zz'>v</td></tr>"))
    rows = F.when(F.col("r") > 1, F.concat(row, F.repeat(F.concat(F.lit("<tr>"), F.repeat(F.lit("<td>v</td>"), F.col("c") - 2), F.lit("<td headers='h1 h2 zz'>v</td></tr>")), F.col("r") - 2))).otherwise("")
    return H.extract_pages(p.withColumn("html", F.concat(F.lit("<table><tr>"), head, F.lit("</tr>"), rows, F.lit("</table>"))))


@query(f"WITH {_GRID} SELECT page_id, r AS rows, c AS columns, CAST(c + CASE WHEN r > 1 THEN 1 + (r - 1) * (c - 1) ELSE 0 END AS INT) AS cells, CAST(CASE WHEN r > 1 THEN r - 1 ELSE 1 END AS INT) AS tallest FROM n")
def table_dims(spark, sf_dir):
    """Sizes of tables, and the height of a cell whose span is larger than what is left of the table."""
    t = H.child_rows(_tables(spark, sf_dir), "tables")
    return t.select("page_id", "rows", "columns", F.size("cells").alias("cells"), F.array_max(F.transform("cells", lambda x: x["row_span"])).alias("tallest"))


@query(f"""WITH {_GRID}, w AS (SELECT page_id, c, unnest(range(2, r + 1)) AS i FROM n)
    SELECT page_id || ':t1' AS table_id, 't1r' || i || 'c' || c AS cell_id, h AS header_id FROM w, (VALUES ('t1r1c1'), ('t1r1c2')) v(h)""")
def explicit_header_links(spark, sf_dir):
    return R.explicit_headers(H.table_cell_rows(_tables(spark, sf_dir)))


@query("""
    WITH f AS (SELECT l_orderkey AS page_id, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS ord, 'u' || (l_partkey % 3) AS url, CASE l_returnflag WHEN 'A' THEN 'img' WHEN 'N' THEN 'picture' ELSE 'background' END AS kind, CASE WHEN l_suppkey % 2 = 0 THEN 'a' || l_suppkey END AS alt, CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'c' || l_suppkey END AS caption FROM lineitem),
    k AS (SELECT DISTINCT page_id, url, kind FROM f)
    SELECT page_id, url, min(ord) AS ord, arg_min(alt, ord) FILTER (alt IS NOT NULL AND alt <> '') AS alt, arg_min(caption, ord) FILTER (caption <> '') AS caption, (SELECT string_agg(kind, ',' ORDER BY kind) FROM k WHERE k.page_id = f.page_id AND k.url = f.url) AS kinds FROM f GROUP BY page_id, url""")
def image_groups(spark, sf_dir):
    """Images found several times, one row for each URL of a page."""
    c = F.col
    kind = F.when(c("l_returnflag") == "A", "img").when(c("l_returnflag") == "N", "picture").otherwise("background")
    found = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("page_id"), (c("l_linenumber").cast("long") * 1000000000 + c("l_partkey") * 10000 + c("l_suppkey")).alias("ord"), F.concat(F.lit("u"), c("l_partkey") % 3).alias("url"), kind.alias("kind"),
        F.when(c("l_suppkey") % 2 == 0, F.concat(F.lit("a"), "l_suppkey")).alias("alt"), F.when(c("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("c"), "l_suppkey")).alias("caption"),
    )
    return R.image_groups(found).select("page_id", "url", "ord", "alt", "caption", F.array_join("discovered_by", ",").alias("kinds"))


@query("SELECT 'H' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS code, 'S' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS station, 'Elm' AS site, 'wind speed' AS field, CAST(p_size AS VARCHAR) AS value, 'kilometers per hour' AS unit, '2024-03-05' AS date FROM part")
def record_lines(spark, sf_dir):
    """Lines that are each one record entirely."""
    pad = lambda a, x: F.concat(F.lit(a), F.lpad(x.cast("string"), 3, "0"))
    line = F.concat(F.lit("Observation "), pad("H", F.col("p_partkey") % 1000), F.lit(": station "), pad("S", F.col("p_size")), F.lit(" at Elm plot measured wind speed "), F.col("p_size"), F.lit(" kilometers per hour on 2024-03-05."))
    return Q.parse_record_lines(table(spark, sf_dir, "part").select(line.alias("line")))


@query(r"SELECT doc_id, sha256(regexp_replace(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')), '[.!?。！？]+$', '')) AS key FROM documents")
def sentence_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.sentence_key(F.col("text")), 256).alias("key"))


@query("SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN replace(replace(url || '(a)', '(', '%28'), ')', '%29') END AS href FROM pages")
def markdown_links(spark, sf_dir):
    """URLs for Markdown; those of another protocol are none."""
    url = F.concat(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url")), F.lit("(a)"))
    return table(spark, sf_dir, "pages").select("page_id", T.markdown_url(url).alias("href"))


@query("""
    WITH i AS (SELECT p_partkey AS id, 100 + p_size * 90 AS w, 50 + (p_partkey % 70) * 40 AS h FROM part), s AS (SELECT *, least(1.0::DOUBLE, 1280.0::DOUBLE / greatest(w, h)) AS k FROM i)
    SELECT id, CAST(greatest(1, floor(w * k)) AS INT) AS width, CAST(greatest(1, floor(h * k)) AS INT) AS height FROM s""")
def resize_dims(spark, sf_dir):
    r = G.resize_target(100 + F.col("p_size") * 90, 50 + (F.col("p_partkey") % 70) * 40)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), r.alias("r")).select("id", "r.*")


@query("""
    WITH b AS (SELECT l_orderkey AS page_id, l_linenumber AS ord, CAST(l_partkey % 700 AS DOUBLE) AS x, CAST(l_suppkey % 900 AS DOUBLE) AS y, CAST(l_quantity AS DOUBLE) AS w, 10.0::DOUBLE AS h FROM lineitem),
    c AS (SELECT page_id, ord, greatest(0, least(612.0, x * 1.5)) AS x1, greatest(0, least(792.0, 792 - 1.5 * y)) AS y1, w * 1.5 AS w1, h * 1.5 AS h1 FROM b)
    SELECT page_id, ord, round(x1, 6) AS x, round(y1, 6) AS y, round(least(w1, 612 - x1), 6) AS w, round(least(h1, 792 - y1), 6) AS h FROM c""")
def text_boxes(spark, sf_dir):
    """Text items under a page's affine map, within the page."""
    c = F.col
    b = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("page_id"), c("l_linenumber").alias("ord"), G.transformed((c("l_partkey") % 700).cast("double"), (c("l_suppkey") % 900).cast("double"), c("l_quantity").cast("double"), F.lit(10.0), (1.5, 0.0, 0.0, -1.5, 0.0, 792.0), 612.0, 792.0).alias("b"),
    )
    return b.select("page_id", "ord", *(F.round(f"b.{k}", 6).alias(k) for k in "xywh"))


@query("""
    SELECT l_orderkey AS page_id, l_linenumber AS ord, round((l_partkey % 50) * (612.0::DOUBLE / 1700), 6) AS x, round((l_suppkey % 20) * (792.0::DOUBLE / 2200), 6) AS y, round(CAST(5 + l_quantity AS INT) * (612.0::DOUBLE / 1700), 6) AS w, round((3 + l_linenumber) * (792.0::DOUBLE / 2200), 6) AS h FROM lineitem""")
def ocr_rescale(spark, sf_dir):
    """Boxes of a recognised image in points of its page."""
    from .structure_queries import _boxes

    b = G.rescaled(_boxes(spark, sf_dir), 1700, 2200, 612.0, 792.0)
    return b.select("page_id", "ord", *(F.round(k, 6).alias(k) for k in "xywh"))


@query("""
    SELECT l_orderkey AS page_id, CAST(l_linenumber AS VARCHAR) AS block_id, CASE WHEN l_partkey % 5 = 0 THEN 'no size' WHEN l_partkey % 50 + 5 + l_quantity > 90 THEN 'out of bounds' WHEN l_linenumber = 2 THEN 'cell fields' WHEN l_linenumber = 3 THEN 'cell without a place' END AS reason FROM lineitem
    WHERE l_partkey % 5 = 0 OR l_partkey % 50 + 5 + l_quantity > 90 OR l_linenumber IN (2, 3)""")
def ocr_block_faults(spark, sf_dir):
    c = F.col
    kind = F.when(c("l_linenumber").isin(1, 3), "cell").otherwise("text")
    blocks = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("page_id"), c("l_linenumber").cast("string").alias("block_id"), kind.alias("kind"), (c("l_partkey") % 50).alias("x"), F.lit(1).alias("y"), F.when(c("l_partkey") % 5 == 0, 0).otherwise(5 + c("l_quantity")).alias("w"), F.lit(5).alias("h"),
        F.lit(90).alias("page_w"), F.lit(50).alias("page_h"), F.when(c("l_linenumber").isin(1, 2), 1).alias("row"), F.when(c("l_linenumber").isin(1, 2), 1).alias("col"),
    )
    return G.block_faults(blocks)


@query(f"""{_JUDGED}, t AS (SELECT DISTINCT case_id, id FROM j WHERE reason IS NULL)
    SELECT c.case_id, f.id FROM (SELECT DISTINCT case_id FROM j) c, f WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.case_id = c.case_id AND t.id = f.id)""")
def missed_facts(spark, sf_dir):
    return Q.missed_facts(Q.evaluate_claims(_lines(spark, sf_dir), _facts(spark)), _facts(spark))


@query("""
    WITH c AS (SELECT event_id, event_type AS name, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'unknown tool' WHEN event_id % 7 = 0 THEN 'repeated id' WHEN k > 50 THEN 'arguments: /k maximum' END AS reason FROM c WHERE event_id % 9 = 0 OR event_id % 7 = 0 OR k > 50""")
def tool_calls(spark, sf_dir):
    """Calls with an unknown tool, an id used before, or arguments that the tool's schema doesn't allow."""
    from ..operators import chat as C

    schema = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}, "additionalProperties": False}
    tools = C.tool_registry({n: schema for n in ("click", "view", "purchase", "login", "logout", "signup", "error", "search", "add_to_cart", "share")})
    e = table(spark, sf_dir, "events")
    known = F.when(F.col("event_id") % 9 == 0, "nothing").otherwise("click")
    used = F.when(F.col("event_id") % 7 == 0, "again").otherwise(F.col("event_id").cast("string"))
    return C.call_faults(e.select("event_id", F.lit(0).alias("conv_id"), used.alias("id"), known.alias("name"), F.col("props").alias("arguments")), tools, "event_id")


@query("""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"0":1,"1":{"a":null,"b":"x"}}' ELSE '{"0":' || event_id || '}' END AS key FROM events""")
def structural_keys(spark, sf_dir):
    """Keys that are equal for values that a schema's uniqueness takes as equal: lists are objects by place, members are sorted."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 2 == 0, F.lit('[1.0, {"b": "x", "a": null}]')).otherwise(F.concat(F.lit('{"0": '), "event_id", F.lit("}")))
    return e.select("event_id", jsonx.structural_key(value).alias("key"))


@query("SELECT event_id, 'k' AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, true AS own FROM events")
def map_members(spark, sf_dir):
    """Members of a JSON object as rows, and whether a name is its own."""
    m = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return m.select("event_id", F.explode(F.map_entries("m")).alias("x"), F.map_contains_key("m", "k").alias("own")).select("event_id", "x.key", "x.value", "own").withColumnRenamed("key", "name")


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id")
def diagnostics(spark, sf_dir):
    """Run rows reduced to an allow list of fields, whatever else they hold, and counted."""
    e = P.allowed_fields(table(spark, sf_dir, "events"), ("user_id", "event_type", "missing"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("""
    WITH r AS (SELECT l_orderkey AS case_id, 'H' || lpad(CAST(l_partkey % 300 AS VARCHAR), 3, '0') AS code, CAST(substr('H' || lpad(CAST(l_partkey % 300 AS VARCHAR), 3, '0'), 2) AS INT) AS c, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'retained' WHEN 1 THEN 'generated' ELSE 'overview' END AS part FROM lineitem),
    v AS (SELECT *, CASE WHEN c >= 200 THEN 'unsupported' WHEN n = 7 THEN 'contradiction' WHEN row_number() OVER (PARTITION BY case_id, part, code, n = 7 ORDER BY n) > 1 THEN 'duplicate' ELSE 'true' END AS verdict FROM r)
    SELECT part, verdict, count(*) AS n FROM v GROUP BY ALL""")
def hierarchy_eval(spark, sf_dir):
    """Record sentences in three parts of reports, each scored apart; a code counts once in a part."""
    code = F.concat(F.lit("H"), F.lpad((F.col("l_partkey") % 300).cast("string"), 3, "0"))
    site = F.when(F.col("l_linenumber") == 7, "Oak").otherwise("Elm")
    text = F.concat(code, F.lit(": station S001 at "), site, F.lit(" plot measured rainfall 5 millimeters on 2024-03-05."))
    k = F.col("l_linenumber") % 3
    part = F.when(k == 0, "retained").when(k == 1, "generated").otherwise("overview")
    texts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), part.alias("part"), F.col("l_linenumber").alias("n"), text.alias("text"))
    oracle = spark.range(200).select(F.concat(F.lit("H"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("code"), *(F.lit(v).alias(f) for f, v in zip(Q.FIELDS[1:], ("S001", "Elm", "rainfall", "5", "millimeters", "2024-03-05"), strict=True)))
    return Q.hierarchy_scores(texts, F.broadcast(oracle)).groupBy("part", "verdict").agg(F.count(F.lit(1)).alias("n"))
