import hashlib
import random
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestar.llm import mixing, packing, warc
from lodestar.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, rank string"


def test_encoder_equals_the_library(sf):
    import duckdb
    from tokenizers import Tokenizer

    own, library = packing.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    texts = ["", "  ", "a  b\n\n c ", "it's 12½ §§ ...  \n", "日本 語 é\x85y\x1c z", "don't  'll 're", " \t\n x\n", "œuvre “q” – x… ß", "<|endoftext|> x", "🌳 a", "x" * 5000]
    texts += [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall()]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def naive(lengths, size):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(gaps, x)
        gap = gaps.pop(at) if at < len(gaps) else size
        n += gap == size and at >= len(gaps)
        if gap > x:
            insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("seed", range(60))
def test_best_fit_equals_one_by_one(seed):
    rng = random.Random(seed)
    size = rng.choice((10, 37, 100))
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 300))]
    ranks, bins = defaultdict(list), defaultdict(list)
    for length, r0, r1, first, offset in packing.best_fit(Counter(lengths), size):
        ranks[length] += range(r0, r1)
        for i in range(r1 - r0):
            bins[first + i].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in Counter(lengths).items()}
    check_full(bins, size)
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(gaps, x)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, n = size, n + 1
        if gap > x:
            insort(gaps, gap - x)
    assert len(bins) == n


def check_full(bins, size):
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size


def test_packing_round_trip(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BUCKET_ROWS", 5)
    library = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(("tion", "the", "ering", "ß", "keit,")) for _ in range(rng.choice((0, 3, 50, 500, 3000))))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "x"), (102, "same"), (102, "same")]
    df = spark.createDataFrame([(i, t, None, None, None, "x", "x") for i, t in rows], DOCS)
    got = packing.pack_documents(df, tokenizer_path()).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    bins, parts = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
    check_full(bins, 1024)
    for i, p in parts.items():
        p = sorted(p)[:: 2 if i == 102 else 1]
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == len(ids[i]) and all(x[2] == 1024 for x in p[1:])
    assert len(bins) <= 1 + sum(map(len, ids.values())) / 1024 * 1.1
    assert packing.pack_documents(df.limit(0), tokenizer_path()).collect() == []


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefgh <>&é") for _ in range(1500))
    rows = [(1, "http://a/x", big), (7, "http://a/y", big), (3, "http://b/ü z\r\nX: 1", big), (4, "u", "small"), (5, "u", "small"), (6, None, None), (8, "u", ""), (9, "u", "x" * 300_000), (None, "u", big), (7, "http://a/y", big)]
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, digest string, last string").repartition(2)
    got = warc.warc_round_trip(df).collect()
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = h == big and i != 7
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 7 if again else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert warc.warc_round_trip(df.limit(0)).collect() == []


def test_archive_format(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i} some words of a page " * 60) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("part-*")
    data = file.read_bytes()
    magic, size = struct.unpack_from("<II", data)
    assert magic == warc.DICT_MAGIC
    words = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    frame = data[8 + size + 8 :]
    first = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(frame)
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and first.endswith(b"\r\n\r\n")
    assert len(list(warc.frames(data))) == 200
    broken = first.replace(b"some words", b"some wordz", 1)
    with pytest.raises(ValueError):
        warc.parse(broken)


def test_raking_meets_the_targets_and_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "wort " * rng.randint(1, 90) + ("#$% " * 30 if i % 7 == 0 else ""), rng.choice(("en", "de", None)), "big" if rng.random() < 0.6 else f"s{i % 4}", 1, "x", "x") for i in range(900)]
    rows += [(2000, None, "en", "big", 0, "x", "x"), (2001, "", None, None, 0, "x", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(df).collect()
    assert len(got) == 902 and not any(r["selected"] for r in got if r["n_tokens"] == 0)
    cells = defaultdict(float)
    for r in got:
        if r["n_tokens"]:
            cells[r["source"], r["lang"], r["topic"]] += r["n_tokens"]
    total = sum(cells.values())
    targets = []
    for axis in range(3):
        share = defaultdict(float)
        for c, n in cells.items():
            share[c[axis]] += n
        t = {k: v**0.7 for k, v in share.items()}
        targets.append({k: v / sum(t.values()) for k, v in t.items()})
    w = dict(cells)
    for _ in range(200):
        for axis in range(3):
            s = defaultdict(float)
            for c, x in w.items():
                s[c[axis]] += x
            w = {c: x * targets[axis][c[axis]] / s[c[axis]] for c, x in w.items()}
    for r in got:
        if r["n_tokens"]:
            c = r["source"], r["lang"], r["topic"]
            assert abs(r["probability"] - min(1, 0.5 * w[c] / (cells[c] / total))) < 1e-4
    assert abs(sum(r["selected"] for r in got) - sum(r["probability"] for r in got)) < 60
    again = {r["doc_id"] for r in mixing.mix_sources(df.repartition(7)).where("selected").collect()}
    assert again == {r["doc_id"] for r in got if r["selected"]}
    assert mixing.mix_sources(df.where(F.lit(False))).collect() == []


def test_raking_makes_up_for_cells_taken_whole(spark):
    rng = random.Random(3)
    rows, sources = [], {"big": 500, "mid": 160, "rare": 40}
    for source, many in sources.items():
        for _ in range(many):
            rows.append((len(rows), "wort " * rng.randint(70, 90), "de" if rng.random() < 0.3 else "en", source, 1, "x", "x"))
    df = spark.createDataFrame(rows, DOCS)
    want = {"source": {"big": 0.55, "mid": 0.35, "rare": 0.1}, "lang": {"de": 0.45, "en": 0.55}, "topic": {"prose": 1.0}}
    targets = {a: spark.createDataFrame(list(t.items()), f"{a} string, target double") for a, t in want.items()}
    got = mixing.mix_sources(df, targets)
    assert got.where("probability = 1").count() > 0 and got.agg(F.max("probability")).first()[0] <= 1
    for r in mixing.gaps(got, targets).collect():
        assert r["target"] == pytest.approx(want[r["axis"]][r["value"]]) and abs(r["share"] - r["target"]) < 1e-4
    kept = got.agg(F.sum(F.col("n_tokens") * F.col("probability")) / F.sum("n_tokens")).first()[0]
    assert abs(kept - 0.5) < 1e-4


def test_raking_tells_of_targets_beyond_what_is_held(spark):
    rows = [(i, "wort " * 70, "en", "rare" if i < 10 else "big" if i < 600 else "mid", 1, "x", "x") for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    want = {"source": {"big": 0.4, "mid": 0.4, "rare": 0.2}, "lang": {"en": 1.0}, "topic": {"prose": 1.0}}
    targets = {a: spark.createDataFrame(list(t.items()), f"{a} string, target double") for a, t in want.items()}
    with pytest.warns(UserWarning, match="not the target"):
        got = mixing.mix_sources(df, targets)
    share = {r["value"]: r["share"] for r in mixing.gaps(got, targets).where("axis = 'source'").collect()}
    assert share == pytest.approx({"big": 0.49, "mid": 0.49, "rare": 0.02}, abs=1e-5)


def test_archives_are_read_once(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 1500), (2, "u", "x" * 1500), (3, "u", "y")], "page_id long, url string, html string")
    got = warc.warc_round_trip(pages)
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got.collect()) == [(1, 1500, "revisit", 2), (2, 1500, "response", None), (3, 1, "response", None)]
