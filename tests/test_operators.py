"""Small literal cases of the operators, and differential checks against plain Python."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestar.functions import canonical, jsonx
from lodestar.functions import text as T
from lodestar.operators import chat, evidence, geometry, index, quality, relations, vectors
from lodestar.sources import html
from lodestar.streaming import streams


def test_terms_of_cjk_astral_and_compatibility_forms(spark):
    assert T.terms_of("銀河観測") == ["銀", "銀河", "河", "河観", "観", "観測", "測"]
    assert T.terms_of("The ﬁle １２ of 🌳 x") == ["file", "12", "x"]
    assert T.terms_of("the銀河") == ["銀", "銀河", "河"] and T.terms_of("佐々木") == ["佐", "佐々", "々", "々木", "木"] and T.terms_of("データ") == ["デ", "ー", "タ"]
    df = spark.createDataFrame([(1, "The ﬁle 観測"), (2, "plain Text, the end"), (3, None)], "id int, text string")
    got = {r["id"]: r["terms"] for r in T.with_terms(df).collect()}
    assert got == {1: ["file", "観", "観測", "測"], 2: ["plain", "text", "end"], 3: []}


def test_search_cases(spark):
    docs = spark.createDataFrame([("z", "庭園には四本の樫の木があります。"), ("a", "銀河観測の開始日は十月三日です。")], "doc_id string, text string")
    assert index.search(index.chunk_table(docs), index.query_terms(spark, {"q": "銀河観測"}), 1).first()["doc_id"] == "a"
    rare = spark.createDataFrame([(f"d{i:02}", "Common observation.") for i in range(20)] + [("e", "Common zirconium observation.")], "doc_id string, text string")
    hits = index.search(index.chunk_table(rare), index.query_terms(spark, {"q": "common zirconium"}), 8, max_scored=1).collect()
    assert [r["doc_id"] for r in hits] == ["e"]
    cover = index.coverage(index.chunk_table(rare), index.query_terms(spark, {"q": "common zirconium"}), max_scored=1).first()
    assert cover["scored"] == 1 and cover["limit_reached"]


def test_chunks_cover_everything_in_utf16_units():
    text = "".join(f"Line {i} of the log.\n" for i in range(300)) + "🌌 The comet came at 03:17."
    spans = index.chunk_spans(text, 128)
    raw = text.encode("utf-16-le")
    assert spans[0][1] == 0 and spans[-1][2] == len(raw) // 2
    assert all(a[2] == b[1] for a, b in zip(spans, spans[1:])) and all(raw[2 * s : 2 * e].decode("utf-16-le") == t and e - s <= 128 for _, s, e, t in spans)
    assert [s[:3] for s in index.chunk_spans("ab🌳cd", 64, [("b1", 2, 4)])] == [(None, 0, 2), ("b1", 2, 4), (None, 4, 6)]
    assert index.chunk_spans("x" * 63 + "🌳" + "y" * 10, 64)[0][2] == 63
    assert [s[1:3] for s in index.chunk_spans("x" * 40 + ". " + "y" * 40, 64)] == [(0, 42), (42, 82)]
    assert [s[1:3] for s in index.chunk_spans("x" * 40 + "\r" + "y" * 40, 64)] == [(0, 64), (64, 81)]  # a lone CR is no line end
    assert [s[1:3] for s in index.chunk_spans("x" * 62 + "." + " " * 40 + "y" * 40, 64)] == [(0, 64), (64, 128), (128, 143)]


def test_chunks_equal_a_scan_of_each_stretch():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(("a", "b ", ". ", ".", "\n", "\n\n", "  ", "🌳", "。", "! \n")) for _ in range(rng.randint(0, 300)))
        size, raw, at, want = rng.choice((8, 16, 64)), text.encode("utf-16-le"), 0, []
        while at < len(raw) // 2:
            end = min(at + size, len(raw) // 2)
            end -= end < len(raw) // 2 and 0xDC <= raw[2 * end + 1] <= 0xDF
            piece = raw[2 * at : 2 * end].decode("utf-16-le")
            if end < len(raw) // 2:
                ends = [len(piece[: m.end()].encode("utf-16-le")) // 2 for m in re.finditer(r"\n+|[.!?。！？][ \n]+", piece)]
                end = max([at + e for e in ends if e >= size / 2], default=end)
            piece = raw[2 * at : 2 * end].decode("utf-16-le")
            if piece.strip():
                want.append((None, at, end, piece))
            at = end
        assert index.chunk_spans(text, size) == want


def test_incremental_equals_rebuilt(spark):
    rng = random.Random(4)
    words = "ash birch cedar elm fir oak pine rowan yew".split()
    make = lambda: " ".join(rng.choice(words) for _ in range(30))
    docs = {f"d{i}": make() for i in range(12)}
    df = lambda d: spark.createDataFrame(list(d.items()), "doc_id string, text string")
    current = df(docs)
    for _ in range(3):
        changed = {rng.choice(list(docs)): make(), f"n{rng.randint(0, 99)}": make()}
        gone = rng.choice(list(docs.keys() - changed.keys()))
        docs.update(changed)
        del docs[gone]
        current = index.upsert(current, df(changed), spark.createDataFrame([(gone,)], "doc_id string"))
    rows = lambda x: sorted(map(tuple, index.postings(index.chunk_table(x)).collect()))
    assert rows(current) == rows(df(docs))


def test_answers_and_context(spark):
    hits = spark.createDataFrame([("q", 1, "a", 60), ("q", 2, "b", 60), ("q", 3, "c", 30)], "query_id string, rank int, chunk_id string, tokens int")
    assert {r["chunk_id"]: r["admitted"] for r in index.pack_context(hits, 100).collect()} == {"a": True, "b": False, "c": True}
    claims = spark.createDataFrame([("1", "red"), ("2", "blue"), ("3", "x")], "claim_id string, text string")
    cited = spark.createDataFrame([("1", "a red car"), ("1", "red"), ("2", "a blue car"), ("2", "red")], "claim_id string, chunk_text string")
    assert {r["claim_id"]: r["supported"] for r in index.supported_answers(claims, cited).collect()} == {"1": True, "2": False, "3": False}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None)], "id int, v array<double>")
    assert [r[0] for r in df.orderBy("id").select(vectors.valid_vector(F.col("v"), 2)).collect()] == [True, False, False, False, False]
    assert df.where("id = 1").select(vectors.unit(F.col("v"))).first()[0] == [0.6, 0.8]
    embed = vectors.embed_with(lambda ts: [[0.001 + ("car" in t), 0.0, 0.001] for t in ts], 3)
    assert abs(spark.createDataFrame([("a car",)], "t string").select(vectors.norm(embed("t"))).first()[0] - 1) < 1e-6
    with pytest.raises(Exception, match="zero"):
        spark.createDataFrame([("x",)], "t string").select(vectors.embed_with(lambda ts: [[0, 0, 0] for _ in ts], 3)("t")).collect()


PAGE = (
    "<title> My  page </title><body><div>Intro <b>text</b><h2>Heading</h2><p>Paragraph</p>Ending text<script>no</script></div>"
    '<p hidden>gone</p><img src="/a.png" alt="A" srcset="b.png 1x, data:image/png;base64,AA== 2x"><div style="color:red; background-image: url( \'c.png\' )">x</div></body>'
)


def test_page_structure():
    page = html.extract_page(1, "https://e.org/d/", PAGE)
    assert page["title"] == "My page" and [p["text"] for p in page["paragraphs"]] == ["Intro text", "Heading", "Paragraph", "Ending text", "x"]
    third = page["paragraphs"][2]
    assert third["heading"] == "Heading" and PAGE[third["start"] : third["end"]] == "<p>Paragraph</p>"
    assert [i["url"] for i in page["images"]] == ["https://e.org/a.png", "https://e.org/d/b.png", "data:image/png;base64,AA==", "https://e.org/d/c.png"]
    with pytest.raises(ValueError):
        html.extract_page(1, "", PAGE, max_images=1)
    with pytest.raises(ValueError):
        html.extract_page(1, "", PAGE, max_bytes=4)
    with pytest.raises(ValueError):
        html.resolve("file:///x", "https://e.org")


def test_main_content_and_chrome():
    assert (html.extract_page(1, "", "<main>a</main>", mode="main")["root"]) == "main"
    two = html.extract_page(1, "", "<body><main>a</main><main>b</main></body>", mode="main")
    assert two["root"] == "body" and two["fallback"]
    pruned = html.extract_page(1, "", "<body><nav>menu</nav><ul><li><a href=x>link one</a></li></ul><p>" + "long words here " * 20 + "</p></body>", prune=True)
    assert [p["text"][:4] for p in pruned["paragraphs"]] == ["long"]
    bare = html.extract_page(1, "", "<body><nav>only a menu of some length</nav><p>x</p></body>", prune=True)
    assert len(bare["paragraphs"]) == 2


def test_hostile_markup_is_read_in_linear_time():
    import time

    began = time.time()
    html.css_urls("background:" + "url(" + " " * 200_000)
    html.srcset_urls("," * 200_000 + "a.png")
    html.parse("<" * 20_000)
    assert time.time() - began < 5


def brute_links(cells):
    out = set()
    for c in cells:
        for h in cells:
            if h["kind"] == "header" and h is not c:
                scope = h["scope"] or "none"
                rows = h["row"] < c["row"] + c["row_span"] and c["row"] < h["row"] + h["row_span"]
                cols = h["col"] < c["col"] + c["col_span"] and c["col"] < h["col"] + h["col_span"]
                if scope == "rowgroup" and h["row_group"] == c["row_group"] or scope in ("row", "none") and rows and h["col"] < c["col"]:
                    out.add((c["table_id"], c["cell_id"], h["cell_id"], "row"))
                if cols and (scope == "colgroup" or scope in ("col", "none") and h["row"] < c["row"]):
                    out.add((c["table_id"], c["cell_id"], h["cell_id"], "column"))
    return out


def test_header_links_equal_a_scan_of_random_tables(spark):
    rng, cells = random.Random(9), []
    for t in range(60):
        body = "".join("<tr>" + "".join(f"<{k} rowspan={rng.randint(0, 3)} colspan={rng.randint(1, 3)} scope={rng.choice(('row', 'col', 'rowgroup', 'colgroup', 'x'))}>v</{k}>" for k in rng.choices(("td", "th"), k=rng.randint(1, 4))) + "</tr>" for _ in range(rng.randint(1, 4)))
        page = html.extract_page(t, "", f"<table><thead>{body}</thead><tbody>{body}</tbody></table>")
        cells.append([{**c, "table_id": f"{t}"} for c in page["tables"][0]["cells"]])
    flat = [c for t in cells for c in t]
    df = spark.createDataFrame(flat, "table_id string, cell_id string, row int, col int, row_span int, col_span int, row_group int, kind string, scope string, html_id string, headers string, paragraph_ids array<string>")
    assert {tuple(r) for r in relations.header_links(df).select("table_id", "cell_id", "header_id", "axis").collect()} == set().union(*map(brute_links, cells))
    assert relations.overlapping_cells(df).count() == 0


def test_header_links_send_no_cells_through_the_driver(spark):
    cells = spark.range(20000).select(F.concat(F.col("id").cast("string"), F.lit(":t1")).alias("table_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("row"))
    head = F.when(F.col("row") == 0, "header").otherwise("data")
    cells = cells.select("table_id", F.concat(F.lit("r"), "row").alias("cell_id"), "row", F.lit(0).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.lit(0).alias("row_group"), head.alias("kind"), F.lit("col").alias("scope"))
    links = relations.header_links(cells)  # 160,000 cells in files of well under a megabyte
    assert links.count() == 140000 and "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_explicit_headers_and_images(spark):
    page = html.extract_page(1, "", "<table><tr><th id=a>A<th id=b>B<th id=b>C</tr><tr><td headers='a b zz'>1</td></tr></table>")
    df = spark.createDataFrame([{**c, "table_id": "t"} for c in page["tables"][0]["cells"]], "table_id string, cell_id string, row int, col int, row_span int, col_span int, row_group int, kind string, scope string, html_id string, headers string, paragraph_ids array<string>")
    assert [tuple(r) for r in relations.explicit_headers(df).collect()] == [("t", "t1r2c1", "t1r1c1")]
    found = spark.createDataFrame([(1, 1, "u", "img", None, None), (1, 2, "u", "picture", "alt", "cap")], "page_id int, ord int, url string, kind string, alt string, caption string")
    row = relations.image_groups(found).first()
    assert row["alt"] == "alt" and row["discovered_by"] == ["img", "picture"]


def test_selection_and_cycles(spark):
    boxes = spark.createDataFrame([("c1", ["p1", "p2"]), ("c2", ["p3"])], "container_id string, paragraph_ids array<string>")
    assert [tuple(r) for r in relations.cascade_selection(boxes, ["p2"]).collect()] == [("c1", ["p2"])]
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("x", "y"), ("y", "x")], "id string, parent_id string")
    assert {r["id"] for r in relations.cyclic_parents(nodes).collect()} == {"x", "y"}
    chain = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(150)] + [("x", "y"), ("y", "x"), ("z", "x")], "id string, parent_id string")
    assert {r["id"] for r in relations.cyclic_parents(chain).collect()} == {"x", "y", "z"}
    assert relations.ancestry(chain.where("id < 'x'").where("cast(substr(id, 2) as int) < 12")).count() == 12 * 13 // 2
    with pytest.raises(ValueError, match="cycle"):
        relations.ancestry(nodes)


def test_tiles_regions_and_nucleus(spark):
    image = spark.createDataFrame([(1, 10, 6)], "id int, width int, height int")
    got = [tuple(r)[3:] for r in geometry.tiles(image, 4, 4, 0.25).orderBy("row", "column").collect()]
    assert got == [(0, 0, 4, 4), (3, 0, 4, 4), (6, 0, 4, 4), (0, 3, 4, 3), (3, 3, 4, 3), (6, 3, 4, 3)]
    with pytest.raises(Exception, match="more tiles"):
        geometry.tiles(image, 4, 4, 0.25, 5).collect()
    logits = spark.createDataFrame([(1, i, float(3 - i)) for i in range(4)], "id int, token int, logit double")
    assert geometry.nucleus(logits, 0.7, 2).count() == 1 and geometry.nucleus(logits, 0.7, 2, 5.0).count() == 2


def test_layout_of_a_small_page(spark):
    items = [(1, "Inventory", 30, 40), (2, "Fruit", 30, 80), (3, "Count", 200, 80), (4, "Apples", 30, 100), (5, "7", 200, 100)]
    boxes = spark.createDataFrame([(1, i, t, x, y, 40, 10) for i, t, x, y in items], "page_id int, ord int, text string, x int, y int, w int, h int")
    lines = geometry.row_clusters(boxes, 3.0)
    runs = geometry.table_runs(lines.select("page_id", "line", F.lit(0).alias("cell"), "x"))
    assert [tuple(r) for r in runs.collect()] == [(1, 1, 2, 2)]
    bad = spark.createDataFrame([(1, "b1", "cell", -1.0, 0.0, 5.0, 5.0, 100.0, 100.0, 0, 0), (1, "b2", "text", 0.0, 0.0, 5.0, 5.0, 100.0, 100.0, 1, None), (1, "b3", "text", 0.0, 0.0, 5.0, 5.0, 100.0, 100.0, None, None)], "page_id int, block_id string, kind string, x double, y double, w double, h double, page_w double, page_h double, row int, col int")
    assert {(r["block_id"], r["reason"]) for r in geometry.block_faults(bad).collect()} == {("b1", "out of bounds"), ("b2", "cell fields")}


def test_claim_evaluation(spark):
    facts = spark.createDataFrame([("A1", "costs 7", "not"), ("A2", "opens at 9", "never"), ("A3", "blue", "zzz")], "id string, pattern string, negated_by string")
    text = "FACT A1: it costs 7 coins\nA2: it opens at 9\n\nfree words\nFACT A9: x\nFACT A1: again costs 7\nFACT A3: it costs 7"
    lines = quality.claim_lines(spark.createDataFrame([("c", text)], "case_id string, text string"))
    assert {(r["line_number"], r["format_error"]) for r in lines.collect() if r["format_error"]} == {(2, "missing-fact-prefix"), (4, "unparsed-line")}
    judged = quality.evaluate_claims(lines, facts)
    assert {r["line_number"]: r["reason"] for r in judged.collect()} == {1: None, 2: None, 5: "unknown-id", 6: "duplicate", 7: "cross-id"}
    row = quality.precision_recall(judged, facts).first()
    assert (row["tp"], row["fp"], row["fn"], row["precision"]) == (2, 3, 1, 0.4)
    rules = spark.createDataFrame([("r", "unsupported", "gold")], "rule_id string, kind string, pattern string")
    found = quality.rule_findings(spark.createDataFrame([("c", 1, "there is no gold"), ("c", 2, "gold here")], "case_id string, line_number int, statement string"), rules)
    assert [r["line_number"] for r in found.collect()] == [2]


def test_record_lines(spark):
    line = "Observation H007: station S012 at Fen plot measured wind speed 12 kilometers per hour on 2024-01-02."
    row = quality.parse_record_lines(spark.createDataFrame([(line,)], "line string")).first()
    assert tuple(row) == ("H007", "S012", "Fen", "wind speed", "12", "kilometers per hour", "2024-01-02")
    with pytest.raises(Exception, match="not a record line"):
        quality.parse_record_lines(spark.createDataFrame([(line + " x",)], "line string")).collect()


def test_conversations(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "one"), (1, 2, "assistant", "A"), (1, 3, "user", "two"), (1, 4, "assistant", "A"), (1, 5, "user", "three"), (1, 6, "assistant", "A")]
    df = spark.createDataFrame(turns + [(2, 0, "user", "a"), (2, 1, "user", "b"), (3, 0, "robot", "x")], "conv_id long, turn long, role string, text string")
    assert [r["text"] for r in chat.drop_oldest(df.where("conv_id = 1"), 5, 10_000).orderBy("turn").collect()] == ["s", "two", "A", "three", "A"]
    assert {(r["conv_id"], r["reason"]) for r in chat.chat_faults(df).collect()} == {(2, "alternation"), (3, "role")}
    assert sorted(map(tuple, chat.import_sessions(chat.export_sessions(df)).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(Exception, match="version"):
        chat.import_sessions(spark.createDataFrame([(1, '{"version":2,"messages":[]}')], "conv_id long, session string")).collect()
    assert chat.branch(df, 1, 9, 2).count() == 3
    odd = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(5)] + [(2, 0, "system", "s"), (2, 1, "user", "x" * 99)], "conv_id long, turn long, role string, text string")
    assert [r["text"] for r in chat.drop_oldest(odd, 2, 10).orderBy("turn").collect()] == ["m4"]  # no half turn is left
    assert [r["conv_id"] for r in chat.over_context(odd, 2, 10).collect()] == [2]


def test_evidence(spark):
    p = spark.createDataFrame([(1, 1, "p1", "Admission costs 7 dollars."), (1, 2, "p2", "Doors <open> at 9.")], "page_id long, ordinal int, paragraph_id string, text string")
    facts = evidence.source_facts(p)
    assert evidence.ledger_breaks(facts, p).count() == 0
    assert {r["reason"] for r in evidence.ledger_breaks(facts.withColumn("quote", F.lit("x")), p).collect()} == {"quote differs"}
    pages = spark.createDataFrame([(1, None, "https://e.org")], "page_id long, title string, url string")
    md = evidence.render_markdown(pages, facts, evidence.extractive_claims(facts)).first()["markdown"]
    assert "## Summary\n\nAdmission costs 7 dollars\\." in md and "Doors &lt;open&gt; at 9\\." in md and "<open>" not in md
    astral = spark.createDataFrame([(1, 1, "p1", "A 🌳 tree.")], "page_id long, ordinal int, paragraph_id string, text string")
    assert evidence.ledger_breaks(evidence.source_facts(astral), astral).count() == 0
    spans = spark.createDataFrame([("t", 0, 4), ("t", 4, 10)], "target string, start int, end int")
    assert evidence.span_breaks(spans, spark.createDataFrame([("t", "A 🌳 tree.")], "target string, text string")).count() == 0
    assert evidence.split_sentences("One. Two! 三。 four") == ["One.", "Two!", "三。", "four"]


def test_markdown_url_and_data_url(spark):
    df = spark.createDataFrame([("https://e.org/(a)",), ("javascript:x",), ("data:image/png;base64,iVBORw0KGgo=",), ("data:image/png;base64,iVBORw0KGgp=",)], "u string")
    assert [r[0] for r in df.select(T.markdown_url(F.col("u"))).collect()] == ["https://e.org/%28a%29", None, None, None]
    kinds = [r[0] for r in df.select(T.image_kind(T.data_url(F.col("u"))["content"])).collect()]
    assert kinds == [None, None, "image/png", None]


def test_json():
    assert canonical.canonical_json({"b": [1, 2.0, None], "a": "é\n"}) == '{"a":"é\\n","b":[1,2,null]}'
    with pytest.raises(ValueError):
        canonical.canonical_json(float("nan"))
    for whole in ('{"a": [1, "}"]}', "[]", '"x\\""', "true", "null"):
        assert jsonx.value_end(whole + " tail") == ("complete", len(whole))
        for cut in range(1, len(whole)):
            assert jsonx.value_end(whole[:cut])[0] == "partial", (whole, cut)
    for bad in ("}", "{]", "nope", "[1}", '"a\nb"'):
        assert jsonx.value_end(bad)[0] == "invalid", bad
    schema = {"type": "object", "properties": {"n": {"$ref": "#/definitions/n"}}, "required": ["n"], "definitions": {"n": {"enum": [1, 2]}}}
    assert jsonx.schema_errors(jsonx.compile_schema(schema), {"n": 3}) == ["/n enum"] and not jsonx.schema_errors(schema, {"n": 2})
    for wrong in ({"enum": [1, 1.0]}, {"$ref": "http://x"}, {"type": "x"}, {"if": {}}):
        with pytest.raises(ValueError):
            jsonx.compile_schema(wrong)
    assert json.loads(canonical.canonical_json({"x": True})) == {"x": True}


def test_streams(spark, tmp_path):
    rows = [(1, 0, "safe E"), (1, 1, "ND OF"), (1, 2, " more"), (2, 0, "STO"), (2, 1, "NE done")]
    schema = "stream_id long, seq long, text string"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    query = streams.stop_buffer(stream, ["END", "END OF", "STOP"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("stream_id", "seq").collect():
        got[r["stream_id"]] = got.get(r["stream_id"], "") + r["text"]
    assert got == {1: "safe ", 2: "STONE done"}
    many = spark.createDataFrame([(1, "x")] * 3, "stream_id long, text string")
    assert streams.bounded(many, 3).first()["events"] == 3
    with pytest.raises(Exception, match="over its bounds"):
        streams.bounded(many, 2).collect()


def test_cosine_ranking_of_many_queries_in_blocks(spark, sf, monkeypatch):
    import numpy as np

    from lodestar.plans import catalog

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in e.collect()}
    ids = sorted(rows)
    u = np.stack([rows[i] / np.sqrt((rows[i] ** 2).sum()) for i in ids])
    dots = u @ u.T
    for floor, name in ((None, "cosine_topk"), (0.3, "cosine_floor")):
        monkeypatch.setattr(vectors, "BLOCK", 7)
        got = {(r["query_id"], r["rank"]): (r["vec_id"], round(r["score"], 7)) for r in catalog.QUERIES[name](spark, sf).collect()}
        want = {}
        for q in (i for i in ids if i % 20 == 0):
            scored = sorted((-round(float(d), 9), str(i), i) for i, d in zip(ids, dots[ids.index(q)], strict=True) if i != q and (floor is None or round(float(d), 9) >= floor))
            want |= {(q, n): (i, round(-s, 7)) for n, (s, _, i) in enumerate(scored[:10], 1)}
        assert got == want
    many = spark.range(4100).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    monkeypatch.setattr(vectors, "BLOCK", 1024)
    assert vectors.cosine_ranking(many, many, 1).count() == 4100


def test_audit_of_values_that_differ_by_any_length(spark):
    pairs = [
        ("repeated", "Codes: " + "7, " * 40 + "end.", "Codes: " + "123456, " * 40 + "end."), ("marks", "The gate fee is 7 coins.", "The gate fee is 8 coins" + "." * 90),
        ("spaces", "The gate fee is 7 coins.", "The gate fee is" + " " * 90 + "8 coins."), ("other", "The gate fee is 7 coins.", "The gate fee is 8 coins" + " and more" * 20 + "."),
    ]
    claims = spark.createDataFrame([p[:2] for p in pairs], "claim_id string, claim string")
    quotes = spark.createDataFrame([(p[0], p[2]) for p in pairs], "claim_id string, quote string")
    got = {r["claim_id"]: (r["status"], r["numbers"]) for r in evidence.audit_claims(claims, quotes).collect()}
    assert got == {k: ("contradicted", "conflict") for k in ("repeated", "marks", "spaces")} | {"other": ("unknown", "unresolved")}


def test_audit_of_runs_of_any_length_is_one_pass(spark):
    units = [("entities", "La "), ("entities", "Teieö  "), ("entities", "Thor_x "), ("numbers", "1,"), ("negation", "not "), ("dates", "May 1 "), ("ranges", "1 - 2 ")]
    claims = spark.createDataFrame([(f"{k} {u}", u * 40000) for k, u in units], "claim_id string, claim string")
    got = {r["claim_id"]: r for r in evidence.audit_claims(claims, claims.select("claim_id", F.concat(F.lit("So "), "claim").alias("quote"))).collect()}
    assert {r["status"] for r in got.values()} == {"supported"} and all(got[f"{k} {u}"][k] == ("absent" if u == "Thor_x " else "matched") for k, u in units)
    one = spark.createDataFrame([("La " * 40000 + "7 coins", "La " * 40000 + "8 coins")], "claim string, quote string").select(F.lit(1).alias("claim_id"), "*")
    assert evidence.audit_claims(one.select("claim_id", "claim"), one.select("claim_id", "quote")).first()["numbers"] == "conflict"


def test_audit_values_and_sentences_equal_the_plain_patterns(spark):
    name = "[A-Z][\\p{L}\\p{N}]*"
    plain = {"entities": f"{T._L}{name}(?:\\s+{name})*{T._W}", "numbers": "[+-]?[0-9]+(?:[,.][0-9]+)*(?:%|％)?"}
    rng = random.Random(12)
    texts = ["".join(rng.choice(["A", "Bö", "C1", "é", "É", "x", "_", " ", "  ", "\n", "7", "1,2", ".", ",", "!", "？", "。", '"', ")", "%", "-", "銀", "𝐀"]) for _ in range(rng.randint(0, 14))) for _ in range(20000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for kind, pattern in plain.items():
        assert df.where(~T.audit_values(F.col("t"), kind).eqNullSafe(F.array_distinct(F.regexp_extract_all("t", F.lit(f"({pattern})"), 1)))).isEmpty()
    assert df.where(T.sentence_key(F.col("t")) != F.regexp_replace(T.normalize(F.col("t")), "[.!?。！？]+$", "")).isEmpty()
    end = re.compile(r"[^.!?。！？]*[.!?。！？]+(?:[\"'”’)\]]*)(?:\s+|$)|[^.!?。！？]+$", re.S)
    for t in texts:
        assert evidence.split_sentences(t) == [s.strip() for s in end.findall(t) if s.strip()]
    began = time.perf_counter()
    assert evidence.split_sentences("Thor " * 200000 + ".x" + "!" * 200000 + "y z.") == ["y z."] and time.perf_counter() - began < 5


def test_quick_terms_are_the_terms():
    rng = random.Random(6)
    parts = ["The ", "x1_y", "-", "İx", "ẞ", "ΑΣ ", "ﬁ", "１２", "é", "é", "銀河", "데이터", "ー", "🌳", " ", "\x1c", "²", "½", "Ⅳ", "ª", "'s ", "a ", "who "]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert T.quick_terms(text) == T.terms_of(text)
    every = [" ".join(chr(c) for c in range(i, i + 256) if not 0xD800 <= c < 0xE000) for i in range(0, 0x110000, 256)]
    assert all(T.quick_terms(x) == T.terms_of(x) for x in every) and T.quick_terms(None) == []


def _counting(spark, docs):
    """Documents that count how often a text is made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(t):
        made.add(1)
        return t

    return docs.select("doc_id", text("text").alias("text")), made


def test_a_search_makes_each_text_once(spark):
    rows = [(f"d{i:02}", f"Common term{i % 3} oak. Oak again") for i in range(30)]
    docs, made = _counting(spark, spark.createDataFrame(rows, "doc_id string, text string"))
    hits = index.search(index.chunk_table(docs), index.query_terms(spark, {"q": "oak term1"}), 40).collect()
    assert len(hits) == 30 and hits[0]["doc_id"] == "d01" and made.value == 30
    docs, made = _counting(spark, spark.createDataFrame(rows, "doc_id string, text string"))
    cover = index.coverage(index.chunk_table(docs.withColumn("text", F.col("text"))), index.query_terms(spark, {"q": "oak term1 none"})).first()
    assert (cover["chunks"], cover["scored"], cover["matched"]) == (30, 30, "oak term1") and made.value == 30


def test_a_search_of_more_terms_than_are_sent_is_the_same(spark, monkeypatch):
    rows = [("a", "oak oak elm"), ("a", "fir oak elm"), ("b", "oak"), ("c", None), (None, "elm")]
    docs, terms = index.chunk_table(spark.createDataFrame(rows, "doc_id string, text string")), index.query_terms(spark, {"q": "oak elm", "r": "fir"})
    want = sorted(map(str, index.search(docs, terms).collect()))
    monkeypatch.setattr(index, "ASKED", 1)
    assert sorted(map(str, index.search(docs, terms).collect())) == want and any("chunk_id='a', doc_id='a'" in x for x in want)


def test_only_found_documents_are_cut_again(spark):
    rows = [("a", "x" * 1300 + " oak."), (None, "oak here"), ("b", "elm"), ("c", "ash")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    hits = index.search(index.chunk_documents(docs), index.query_terms(spark, {"q": "oak"}))
    want = {(r["chunk_id"], r["text"]) for r in index.chunk_documents(docs).collect() if "oak" in r["text"]}
    assert {(r["chunk_id"], r["text"]) for r in index.attach_chunks(hits, docs).collect()} == want and len(want) == 2


def test_a_kept_index_splits_into_all_buckets_without_a_shuffle(spark, tmp_path, monkeypatch):
    from lodestar.operators import stored_index as S

    docs = {f"d{i}": f"oak term{i} elm{i % 4}" for i in range(40)} | {"empty": "", "none": None}
    df = lambda d: spark.createDataFrame(list(d.items()), "doc_id string, text string")
    made = S.build_index(df(docs).repartition(3), f"{tmp_path}/a")
    assert max(len(list(d.glob("*.parquet"))) for d in (tmp_path / "a/postings").glob("bucket=*")) == 3  # each task wrote its own
    changed, gone = {"d3": "oak new", "d41": "fir"}, ["d5", "empty"]
    after = {k: v for k, v in (docs | changed).items() if k not in gone}
    rows = lambda x, n: sorted(map(str, x.read(n).select(*sorted(x.read(n).columns)).collect()))
    fresh = S.build_index(df(after), f"{tmp_path}/b")
    for name, many in (("c", S.MANY_GONE), ("d", 0)):
        monkeypatch.setattr(S, "MANY_GONE", many)
        new = S.update_index(made, df(changed), spark.createDataFrame([(x,) for x in gone], "doc_id string"), f"{tmp_path}/{name}")
        assert all(rows(new, n) == rows(fresh, n) for n in ("documents", "lengths", "postings", "meta"))
    hits = S.search_index(fresh, index.query_terms(spark, {"q": "oak fir"}), 50).select("chunk_id", "score", "rank").collect()
    assert hits == index.search(index.chunk_table(df(after)), index.query_terms(spark, {"q": "oak fir"}), 50).select("chunk_id", "score", "rank").collect()


def test_page_records_leave_in_steps():
    import pandas as pd

    pages = pd.DataFrame({"page_id": range(150), "url": "http://x/", "html": "<title>a&amp</title><p>b</p>"})
    steps = list(html.page_steps(iter([pages])))
    assert [len(s) for s in steps] == [64, 64, 22] and steps[0]["title"][0] == "a&" and steps[0]["title_source"][0] == "a&amp"
    pages["html"] = "<p>" + "x" * 1_500_000
    assert max(len(s) for s in html.page_steps(iter([pages[:7]]))) == 3


def test_page_title_equals_its_sql(spark, tmp_path):
    import duckdb

    from lodestar.plans import catalog

    rows = [(1, "u", "<html><title>a &amp;amp; b &lt;c&amp</title>"), (2, "u", "<p>none"), (3, "u", "<title>  two  blanks\n&copy; &#39;&quot;&gt; </title><title>x</title>"), (4, "u", "<title></title>"), (5, "u", "<title>a <b>c</b></title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.connect().sql(catalog.ORACLE["page_title"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, catalog.QUERIES["page_title"](spark, str(tmp_path)).collect())) == sorted(want)


def test_the_flagship_parses_pages_once(spark, sf):
    from lodestar.plans import catalog

    assert "MapInPandas" not in catalog.flagship(spark, sf)._jdf.queryExecution().toString()


def test_paragraphs_are_the_lines_and_made_once(spark):
    rng = random.Random(9)
    text = lambda: "".join(rng.choice(("a", "b.", " ", "\t", "\n", "\r\n", "\n\n", " ", "　", " ", "\x0b", "🌳")) for _ in range(rng.randint(0, 30)))
    rows = [(i, text()) for i in range(400)] + [(400, None), (401, ""), (402, " \n\n ")]
    got = evidence.paragraphs_of_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = []
    for i, t in rows:
        lines = [re.sub("[ \t\n\x0b\f\r  　]+", " ", x).strip(" ") for x in (t or "").split("\n")]
        want += [(i, n + 1, f"p{n + 1}", x) for n, x in enumerate(x for x in lines if x)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 2
