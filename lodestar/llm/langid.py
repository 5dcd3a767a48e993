"""Language ID by string kernels: blended-spectrum n-gram presence, Nyström landmarks, kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import split_of

#: Bounds of the labelled sample that the model is fitted on: rows of a language, and of all (one of each at least); texts of
#: up to SHORT characters are taken first. And the number of landmarks, of which each language has one at least.
PER_LANG, SAMPLE, SHORT, LANDMARKS = 300, 6000, 20_000, 128
RIDGE = 1e-2
#: Symbols of the alphabet, orders of the blended spectrum, and the numbers of grams of lower order before each order's.
SYMBOLS, ORDERS = 128, (1, 2, 3)
OFFSETS = {1: 0, 2: SYMBOLS, 3: SYMBOLS + SYMBOLS**2}
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
#: Characters that one step turns into grams, and documents of one matrix product.
STEP_CHARS, BATCH = 1 << 20, 256
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """symbol: of each code point, 0 for no letter, a to z their own, other letters by code point; seen, mark: scratch."""
    if not _TABLES:
        cps = np.arange(0x110000)
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        symbol = np.where(letter, 27 + cps % (SYMBOLS - 27), 0)
        symbol[97:123] = np.arange(1, 27)
        _TABLES.update(symbol=symbol.astype(np.int32), seen=np.zeros(GRAMS, bool), mark=np.zeros(GRAMS, np.int32))
    return _TABLES


def grams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a whole text that hold a letter, as numbers below GRAMS; in steps, so of any length."""
    t = _tables()
    found = []
    text = (text or "").lower()
    for at in range(0, len(text), STEP_CHARS):
        piece = text[max(0, at - max(ORDERS) + 1) : at + STEP_CHARS]
        s = t["symbol"][np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
        for n in ORDERS:
            if len(s) < n:
                continue
            code = s[: len(s) - n + 1].copy()
            for i in range(1, n):
                code = code * SYMBOLS + s[i : len(s) - n + 1 + i]
            code = code[code > 0] + OFFSETS[n]
            code = code[~t["seen"][code]]
            turn = np.arange(len(code), dtype=np.int32)
            t["mark"][code] = turn
            code = code[t["mark"][code] == turn]
            t["seen"][code] = True
            found.append(code)
    out = np.concatenate(found) if found else np.zeros(0, np.int32)
    t["seen"][out] = False
    return out


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> dict:
    """Nyström kernel ridge regression, one language against the rest, on (language, grams) rows in a fixed order.

    Landmarks are dealt evenly to the languages. With K = kernel of rows and landmarks and M of landmarks among themselves,
    beta solves (K'K + ridge * n * M) beta = K'Y, Y of +1 and -1 (each language's rows weigh the same).
    """
    langs = sorted({x for x, _ in sample})
    by = {x: [g for y, g in sample if y == x] for x in langs}
    marks = [g for x in langs for g in by[x][: max(1, landmarks // len(langs))]]
    vocabulary = np.unique(np.concatenate(marks))
    place = np.full(GRAMS, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    table = np.zeros((len(vocabulary), len(marks)), np.float32)
    for j, g in enumerate(marks):
        table[place[g], j] = 1 / np.sqrt(len(g))
    model = {"langs": langs, "vocabulary": vocabulary, "table": table, "beta": np.zeros((len(marks), len(langs)), np.float32)}
    k = np.concatenate([kernel(model, [g for _, g in sample[at : at + BATCH]], place) for at in range(0, len(sample), BATCH)]).astype(float)
    m = np.concatenate([kernel(model, marks[at : at + BATCH], place) for at in range(0, len(marks), BATCH)]).astype(float)
    weight = np.array([1 / len(by[x]) for x, _ in sample])[:, None]
    y = np.array([[1.0 if x == lang else -1.0 for lang in langs] for x, _ in sample])
    a = k.T @ (k * weight) + ridge * m + 1e-6 * np.eye(len(marks))
    return model | {"beta": np.linalg.solve(a, k.T @ (y * weight)).astype(np.float32)}


def kernel(model: dict, docs: list[np.ndarray], place: np.ndarray | None = None) -> np.ndarray:
    """The normalised presence kernel of documents and landmarks: shared grams over the root of both counts, as a product."""
    if place is None:
        place = np.full(GRAMS, -1, np.int32)
        place[model["vocabulary"]] = np.arange(len(model["vocabulary"]))
    x = np.zeros((len(docs), len(model["vocabulary"])), np.float32)
    for i, g in enumerate(docs):
        at = place[g]
        x[i, at[at >= 0]] = 1 / np.sqrt(max(1, len(g)))
    return x @ model["table"]


def predict(model: dict | None, texts: list[str | None], place: np.ndarray | None = None) -> list[tuple[str, float]]:
    docs = [grams(x) for x in texts]
    if not model:
        return [("und", 0.0)] * len(docs)
    out = kernel(model, docs, place) @ model["beta"]
    best = out.argmax(1)
    score = np.clip((1 + out[np.arange(len(docs)), best]) / 2, 0, 1)
    return [(model["langs"][b], float(s)) if len(g) else ("und", 0.0) for b, s, g in zip(best, score, docs, strict=True)]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "grams": [grams(x).astype(np.int32).tobytes() for x in pdf["text"]]})


def train(docs: DataFrame, per_lang: int = PER_LANG) -> dict | None:
    """The model, from the rows that are not held out; None if there is no such row. Features are made on the executors."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.coalesce(split_of(), F.lit(1)) != 0)
    base = base.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}")).withColumn("h", F.xxhash64("text"))
    per_lang = max(1, min(per_lang, SAMPLE // max(1, base.select("lang").distinct().count())))
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("doc_id"), "doc_id", "h")
    ids = base.select("doc_id", "lang", "h", (F.length("text") > SHORT).alias("long"))
    picked = ids.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_lang).select("doc_id", "lang", "h").distinct()
    same = base["doc_id"].eqNullSafe(picked["doc_id"]) & (base["lang"] == picked["lang"]) & (base["h"] == picked["h"])
    texts = base.join(F.broadcast(picked), same, "left_semi").dropDuplicates(["doc_id", "lang", "h"])  # repeated rows come once
    rows = texts.select("doc_id", "lang", "text").mapInPandas(_features, "doc_id long, lang string, grams binary").collect()
    sample = [(r["lang"], np.frombuffer(r["grams"], np.int32)) for r in sorted(rows, key=lambda r: (r["lang"], -1 if r["doc_id"] is None else r["doc_id"], bytes(r["grams"])))]
    sample = [x for x in sample if len(x[1])]
    return fit(sample) if sample else None


def identify(docs: DataFrame, model: dict | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, then ``columns`` as they came, named in_*. One pass without a shuffle.

    Whole texts. Learns from text and lang of the rows that are not held out unless a model is given. A text that is null,
    empty or has no letter is ``und`` with score 0, as is every text where no row could be learned from. Of languages with
    equal scores the first in order of name is predicted. Every language with a labelled text is learned, whatever their number
    and the texts' lengths. held_out is false for a null id. Repeated rows each get their row, and count once in learning; an
    empty table gives none; columns not named are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or train(docs))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m, place = shipped.value, None
        if m:
            place = np.full(GRAMS, -1, np.int32)
            place[m["vocabulary"]] = np.arange(len(m["vocabulary"]))
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                found = predict(m, part.column("__text").to_pylist(), place)
                out = {"doc_id": part.column("__id"), "held_out": part.column("__held"), "lang_pred": [x for x, _ in found], "score": pa.array([s for _, s in found], pa.float64())}
                yield pa.RecordBatch.from_pydict(out | {f"__{c}_": part.column(f"__{c}_") for c in columns})

    base = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce(split_of() == 0, F.lit(False)).alias("__held"), F.col("text").alias("__text"), *(F.col(c).alias(f"__{c}_") for c in columns))
    kinds = "".join(f", `__{c}_` {docs.schema[c].dataType.simpleString()}" for c in columns)
    found = base.mapInArrow(run, f"doc_id long, held_out boolean, lang_pred string, score double{kinds}")
    return found.select("doc_id", "held_out", "lang_pred", "score", *(F.col(f"__{c}_").alias(f"in_{c}") for c in columns))
