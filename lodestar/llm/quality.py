"""Quality by nearest-neighbour voting over latent-semantic vectors of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_of, text_steps, word_hashes

#: Bounds of the labelled sample: rows that are voted with, rank of the vectors, neighbours that vote.
LABELLED, RANK, NEIGHBOURS = 4000, 48, 15
#: Kinds of bytes: white space, line ends, lower, upper, digits, parts of longer characters, then groups of marks.
KINDS = (b" \t\x0b\x0c\r", b"\n", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".", b",;:", b"!?", b"|", b"#$%&*", b"-_", b"()[]{}", b"<>=/\\+", b"'\"`")
_KIND = np.full(256, 15, np.int32)
for _i, _bytes in enumerate(KINDS):
    for _b in _bytes:
        _KIND[_b] = _i
#: Terms: three kinds in a row, words by hash, then the shares of words equal to the one before and of different words, in
#: steps of SHARES; a share counts as SHARE_WEIGHT terms.
SHAPES, WORDS, SHARES, SHARE_WEIGHT = 16**3, 2048, 10, 20
TERMS = SHAPES + WORDS + 2 * (SHARES + 1)


def counts(column) -> Iterator[np.ndarray]:
    """Term counts of each text of an Arrow column."""
    for i, j, data, off in text_steps(column):
        words, _, at = word_hashes(data, off)
        kind = _KIND[data]
        shape = (kind[:-2] * 16 + kind[1:-1]) * 16 + kind[2:] if len(kind) > 2 else kind[:0]
        slot = (words % np.uint64(WORDS)).astype(np.int64) + SHAPES
        for r in range(j - i):
            own, w = shape[off[r] : max(off[r], off[r + 1] - 2)], slice(at[r], at[r + 1])
            out = np.bincount(own, minlength=TERMS).astype(np.float32)
            out += np.bincount(slot[w], minlength=TERMS)
            if n := len(own_words := words[w]):
                again, kinds = (own_words[1:] == own_words[:-1]).sum() / n, len(np.unique(own_words)) / n
                out[SHAPES + WORDS + int(SHARES * again)] = out[SHAPES + WORDS + SHARES + 1 + int(SHARES * kinds)] = SHARE_WEIGHT
            yield out


def weigh(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log counts times idf, at unit length."""
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def fit(tf: np.ndarray, labels: np.ndarray, rank: int = RANK) -> dict:
    """idf and the leading right singular vectors of the sample (by subspace iteration), and its rows' unit vectors in them."""
    idf = np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))).astype(np.float32) + 1
    x = weigh(tf, idf)
    basis = np.random.default_rng(1).standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
    for _ in range(5):
        basis = np.linalg.qr(x.T @ (x @ basis))[0].astype(np.float32)
    _, _, v = np.linalg.svd(x @ basis, full_matrices=False)
    basis = (basis @ v.T)[:, :rank]
    return {"idf": idf, "basis": basis, "vectors": unit(x @ basis), "labels": labels.astype(np.float32), "prior": float(labels.mean())}


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vote(model: dict | None, tf: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores of documents: labels of the k labelled vectors of the largest cosine, weighted by its tenth power;
    of equal cosines the earlier rows of the sample, which is in order of ids. A document without terms gets the labels' mean."""
    if not model:
        return np.full(len(tf), 0.5)
    x = unit(weigh(tf, model["idf"]) @ model["basis"])
    sims = x @ model["vectors"].T
    k = min(k, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(sims, near, 1).min(1, keepdims=True)
    for i in np.flatnonzero((sims >= last).sum(1) > k):  # more than one choice of the last neighbours
        near[i] = np.argsort(-sims[i], kind="stable")[:k]
    w = np.clip(np.take_along_axis(sims, near, 1), 1e-3, 1).astype(float) ** 10
    score = (w * model["labels"][near]).sum(1) / w.sum(1)
    return np.where(tf.any(1), np.clip(score, 0, 1), model["prior"])


def _features(batches) -> Iterator:
    import pyarrow as pa

    for b in batches:
        rows = list(counts(b.column("text")))
        packed = [(np.flatnonzero(x).astype(np.int32), x[x > 0]) for x in rows]
        yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "label": b.column("label"), "at": [a.tobytes() for a, _ in packed], "tf": [v.tobytes() for _, v in packed]})


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", bound: int = LABELLED) -> dict | None:
    """The model, from at most ``bound`` labelled rows that are not held out, in hash order of their ids; None without any.

    Labels other than 0 and 1, and ids that carry both, are left out; repeated rows count once. Features are made on the executors.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(split_of() != 0).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    picked = texts.select("doc_id", "h").join(known.select("doc_id", "label"), "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(bound)
    sample = texts.join(F.broadcast(picked), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])  # repeated rows come once
    rows = sample.select("doc_id", "text", "label").mapInArrow(_features, "doc_id long, label int, at binary, tf binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["tf"])))
    if not rows:
        return None
    tf = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        tf[i, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["tf"], np.float32)
    return fit(tf, np.array([r["label"] for r in rows]))


def score(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Whole texts; one pass without a shuffle.

    The labelled vectors are broadcast (at most LABELLED rows of RANK numbers) and each block of documents is held against
    all of them by one product. A text without a term, empty or null, gets the mean of the labels; 0.5 is the score where
    nothing could be learned. held_out is false for a null id. Repeated rows each get their row; an empty table gives none.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, target))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out, block = [], []
            for x in counts(b.column("text")):
                block.append(x)
                if len(block) == 128:
                    out.append(vote(shipped.value, np.array(block)))
                    block = []
            if block:
                out.append(vote(shipped.value, np.array(block)))
            s = np.concatenate(out).astype(float) if out else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(split_of() == 0, F.lit(False)).alias("held_out"), "text")
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
