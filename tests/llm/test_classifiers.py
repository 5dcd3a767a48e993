import itertools
import random
import re

import numpy as np

from lodestar.llm import html, langid, quality

DOCS = "doc_id long, text string, lang string, source string, score string, held_out string"


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.identify(docs, columns=("lang",)).where("held_out").collect()
    assert sum(r["lang_pred"] == r["in_lang"] for r in rows) >= 0.95 * len(rows) > 0
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    base = [(i, ("the cat and the dog sat on this mat " if i % 2 else "der hund und die katze saß auf dieser matte ") * 3, "en" if i % 2 else "de", "s", "x", "x") for i in range(60)]
    odd = [(100, None, "en", None, None, None), (101, "", None, None, None, None), (102, "123 -- 456", "xx", None, None, None), (None, "the dog and the cat", "en", None, None, None), (103, "the mat " * 50_000, None, None, None, None), (104, "the", "en", None, None, None), (104, "the", "en", None, None, None)]
    got = langid.identify(spark.createDataFrame(base + odd, DOCS)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 67 and [by[i]["lang_pred"] for i in (100, 101, 102)] == ["und"] * 3
    assert by[None]["lang_pred"] == "en" and not by[None]["held_out"] and by[103]["lang_pred"] == "en"
    assert langid.identify(spark.createDataFrame([], DOCS)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(spark.createDataFrame([(1, "abc", None, None, None, None)], DOCS)).collect()} == {"und"}


def test_grams_in_steps_equal_grams_at_once(monkeypatch):
    text = "".join(random.Random(1).choice("abcdé ß1") for _ in range(5000))
    whole = set(langid.grams(text).tolist())
    monkeypatch.setattr(langid, "STEP_CHARS", 97)
    assert set(langid.grams(text).tolist()) == whole and len(langid.grams(text)) == len(whole)
    assert langid.grams(None).size == langid.grams("12 -").size == 0


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, *"abcd"), (2, "", *"abcd"), (None, "good text here", *"abcd"), (3, "word " * 100_000, *"abcd"), (4, "a", *"abcd"), (4, "a", *"abcd")], DOCS)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (2, 5, 0), (1, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}


def test_main_text_on_unseen_labelled_pages():
    model, rng, wrong, total = html.train(), random.Random(5), 0, 0
    for _ in range(100):
        page, main = html.labelled_page(rng)
        found = html.blocks(page)
        for block, y in zip(found, html.decode(model, html.features(found))):
            total += 1
            wrong += y != (block[0] in main)
    assert wrong <= 0.02 * total


def test_main_text_of_a_page(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">More</a></li></ul></nav><div class="ad">Buy this now.</div>'
        "<article><h1>A   title</h1><p><b>First &amp; &eacute; line.<br><p>Second\n line with <i>more</i> words in it.</p><p></p></article><footer>&copy; us &middot; Words.</footer>"
    )
    rows = [(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<<<>&#0;<p", "x"), (4, "u", "<article><p>" + "long text here. " * 20_000, "x"), (1, "u", page, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 6 and by[1]["text"] == "A title\nFirst & é line.\nSecond line with more words in it." and by[2]["text"] == by[3]["text"] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in got) and by[4]["n_chars"] == 16 * 20_000 - 1
    assert html.extract(df.limit(0)).collect() == []


def presence(text):
    """Grams of 1 to 3 characters in plain sets: letters stand for themselves, all else alike; grams without a letter don't count."""
    line = "".join(c if c.isalpha() else " " for c in text.lower())
    return {line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)} - {" ", "  ", "   "}


def test_language_kernel_and_scores_equal_plain_sets():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefgh" if i % 2 else "efghijkl") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(5, 30))) for i in range(60)]
    sample = [("xy"[i % 2], langid.grams(t)) for i, t in enumerate(texts[:40])]
    model = langid.fit(sample, landmarks=10)
    marks = [texts[i] for lang in "xy" for i in [j for j in range(40) if "xy"[j % 2] == lang][:5]]
    shared = lambda a, b: len(presence(a) & presence(b)) / np.sqrt(len(presence(a)) * len(presence(b)))
    plain = lambda ts: np.array([[shared(t, m) for m in marks] for t in ts])
    assert np.allclose(langid.kernel(model, [langid.grams(t) for t in texts]), plain(texts), atol=1e-5)
    k, m = plain(texts[:40]), plain(marks)
    y = np.array([[1.0 if x == lang else -1.0 for lang in "xy"] for x, _ in sample])
    beta = np.linalg.solve(k.T @ k / 20 + langid.RIDGE * m + 1e-6 * np.eye(10), k.T @ y / 20)
    out = plain(texts[40:]) @ beta
    want = [("xy"[row.argmax()], min(1, max(0, (1 + row.max()) / 2))) for row in out]
    got = langid.predict(model, texts[40:])
    assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-3)


def test_every_language_is_learned_whatever_their_number_and_lengths(spark, monkeypatch):
    rng, rows = random.Random(7), []
    names = [f"l{i:03}" for i in range(104)]
    for n, name in enumerate(names):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 6)
        for i in range(8):
            rows.append((n * 8 + i, " ".join("".join(rng.choices(letters, k=4)) for _ in range(40)), name, "s", "x", "x"))
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(langid, "SHORT", 100)  # all texts are longer
    model = langid.train(df)
    assert model["langs"] == names
    got = langid.identify(df, model, columns=("lang",)).collect()
    assert sum(r["lang_pred"] == r["in_lang"] for r in got) >= 0.9 * len(got)


def test_votes_equal_a_plain_loop():
    rng = np.random.default_rng(3)
    tf = rng.poisson(0.3, (90, quality.TERMS)).astype(np.float32)
    tf[20:25] = tf[10]  # ties
    model = quality.fit(tf[:60], rng.integers(0, 2, 60), rank=8)
    got = quality.vote(model, tf[60:], 5)
    for row, score in zip(tf[60:], got, strict=True):
        x = np.log1p(row) * model["idf"]
        x = x / np.linalg.norm(x) @ model["basis"]
        x = x / np.linalg.norm(x)
        near = sorted((-float(x @ v), i) for i, v in enumerate(model["vectors"]))[:5]
        w = [min(1, max(1e-3, -s)) ** 10 for s, _ in near]
        assert abs(score - sum(a * model["labels"][i] for a, (_, i) in zip(w, near, strict=True)) / sum(w)) < 1e-3


def test_viterbi_and_gradient_equal_enumeration():
    rng = np.random.default_rng(1)
    pages = [([[f"f{rng.integers(6)}" for _ in range(rng.integers(1, 4))] for _ in range(n)], rng.integers(0, 2, n).tolist()) for n in (1, 2, 3, 5, 5)]
    pages = [([sorted(set(block)) for block in page], y) for page, y in pages]
    model = html.fit(pages)
    value = lambda page, y: sum(model["w"][model["names"][f], a] for block, a in zip(page, y, strict=True) for f in block) + sum(model["trans"][a, b] for a, b in zip(y, y[1:]))
    for page, _ in pages:
        best = max(itertools.product((0, 1), repeat=len(page)), key=lambda y: value(page, y))
        assert value(page, html.decode(model, page)) >= value(page, best) - 1e-9
        scores = np.array([[model["w"][[model["names"][f] for f in block]].sum(0) for block in page]])
        fwd, bwd, z = html._lattice(scores, model["trans"])
        every = {y: value(page, y) for y in itertools.product((0, 1), repeat=len(page))}
        assert abs(z[0] - np.logaddexp.reduce(list(every.values()))) < 1e-9
        share = np.exp(fwd + bwd - z[:, None, None])[0]
        for t in range(len(page)):
            assert abs(share[t, 1] - sum(np.exp(v - z[0]) for y, v in every.items() if y[t])) < 1e-9


def test_hidden_elements_end_where_they_end():
    text = lambda page: [b[0] for b in html.blocks(page)]
    assert text("<div hidden><p>gone</div><article><p>Here it is.</p></article>") == ["Here it is."]
    assert text("<div hidden></b>secret</div><p>shown") == ["shown"]
    assert text("<b><div aria-hidden=true></b>secret<div>more</div></div><p>shown") == ["shown"]
    assert text("<p hidden>gone<p>shown<ul><li hidden>gone<li>two</ul>") == ["shown", "two"]
    assert text("<template><p>no</template><svg><text>no</text></svg>yes") == ["yes"]


def test_main_text_of_pages_labelled_by_hand(spark, sf):
    """The pages of the tables have one article of a heading, paragraphs and junk; the rest is menu, advert and footer."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    model = html.train()
    for r in rows[:20]:
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])
        if article:
            want = [b[0] for b in html.blocks(article[1])]
            assert html.main_text(model, r["html"]).split("\n") == want
