import importlib
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import components as components_of
from lodestar.llm import langid, mixing
from lodestar.llm.common import stored
from lodestar.llm.queries import tokenizer_path

from .test_text_dedup import components, words


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf), "test")
        held[name] = docs
        was = {r["doc_id"]: r["text"] for r in before.collect()}
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            now = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert now.items() <= was.items() and len(now) == docs.count()
        if name == "language_id":
            assert set(was) - set(now) == {i for i, t in was.items() if not any(c.isalpha() for c in t or "")}
            pred = {r["doc_id"]: r["lang_pred"] for r in langid.identify(before).collect()}
            lang = {r["doc_id"]: r["lang"] for r in before.collect()}
            assert all(r["lang"] == (lang[r["doc_id"]] or pred[r["doc_id"]]) for r in docs.collect())
        if name == "exact_dedup":
            first = {}
            for i in sorted(was):
                first.setdefault(" ".join(("x" + was[i] + "x").split()), i)
            assert set(now) == set(first.values())
        if name == "near_duplicates":
            assert set(now) == {c for _, _, c in components(list(was.items()), 5, 80, 100)}
        if name == "mixing":
            assert set(now) == {r["doc_id"] for r in mixing.mix_sources(before).where("selected").collect()}
        if name == "packing":
            check_packing(was, docs.collect())
    assert words("a  b") == ["a", "b"]


def check_packing(texts, rows):
    library = Tokenizer.from_file(tokenizer_path())
    pieces, places = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 2], 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, at, zlib.crc32(part)) and r["length"] <= 1024
            at += r["length"]
        assert at == len(ids) and (len(ids) > 1024 or len(pieces[i]) == 1)
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 1024


def test_language_stage_without_labels_or_with_clashing_columns(spark):
    rows = [(1, "some words", None, "s", 10, "x"), (2, None, None, "s", 0, "x"), (3, "123", None, None, 3, "x"), (1, "some words", None, "s", 10, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string")
    got = corpus_pipeline.identify_language(spark, docs, None)
    assert got.columns == list(corpus_pipeline.COLUMNS) and [tuple(r) for r in got.collect()] == [rows[0][:5]] * 2
    near = corpus_pipeline.drop_near_copies(spark, docs.withColumn("component_id", docs["n_chars"]), None).collect()
    assert sorted(r["doc_id"] for r in near) == [1, 1, 2, 3]


def test_pipeline_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "empty")
    assert docs.count() == 0


def test_entry_lists_the_eleven_queries():
    names = importlib.import_module("__spark_entry__").queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_repeated_steps_on_few_rows_have_no_exchange_and_give_the_same(spark, sf, monkeypatch):
    """Each stage that the driver plans costs it memory, so plans of repeated steps are to be small."""
    plans = []

    def noted(df, tag):
        plans.append((tag, df._jdf.queryExecution().executedPlan().toString()))
        return stored(df, tag)

    for module in (mixing, components_of):
        monkeypatch.setattr(module, "stored", noted)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    edges = spark.createDataFrame([(i, i // 2) for i in range(2, 60)] + [(70, 71)], "a long, b long")

    def both():
        mixed = {(r["doc_id"], r["selected"], round(r["probability"], 9)) for r in mixing.mix_sources(docs).collect()}
        return mixed, {tuple(r) for r in components_of.connected_components(edges).collect()}

    few = both()
    repeated = [plan for tag, plan in plans if tag in ("mix-round", "cc-round")]
    assert len(repeated) > 2 and not any("Exchange" in plan for plan in repeated)
    assert max(plan.count("Join") for tag, plan in plans if tag == "mix-cells") <= 4
    for module in (mixing, components_of):
        monkeypatch.setattr(module, "FEW_ROWS", 0)
    plans.clear()
    assert both() == few and any("Exchange" in plan for tag, plan in plans if tag == "mix-round")
