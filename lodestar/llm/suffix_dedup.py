"""Repeated passages by sparse suffix arrays: suffixes at minimiser positions, sorted and compared with their neighbours; then the
windows around them that may be held twice, sorted and compared in turn."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, shingle_hashes, stored, text_steps, word_hashes

#: Bits of a word's place within a step (a step holds fewer words), below those of its gram's hash.
PLACE = 24
SUFFIX = "key long, right binary, left binary, doc_id long, pos long, held int"
WINDOW = "hash long, doc_id long, start long"
REPEAT = f"{WINDOW}, other long, edge boolean"


def minimisers(words: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the least k-gram of each window of ``span`` words, by hash, ties to the first: what a window holds alone
    decides, so equal windows keep it at equal places. With each position the first of its windows, and how many follow on."""
    n = len(words)
    if n < span:
        return (np.zeros(0, np.int64),) * 3
    grams = shingle_hashes(words, k)
    value = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(grams), dtype=np.uint64)
    width, done = span - k + 1, 1
    while done < width:
        step = min(done, width - done)
        value = np.minimum(value[: len(value) - step], value[step:])
        done += step
    return np.unique((value & np.uint64((1 << PLACE) - 1)).astype(np.int64), return_index=True, return_counts=True)


def contexts(words: np.ndarray, at: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """16-bit hashes, never 0, of the span - k words right of each position's k-gram and left of it (nearest first); 0 beyond the text."""
    reach = span - k
    short = ((words >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(">u2")
    line = np.concatenate([np.zeros(reach, ">u2"), short, np.zeros(reach + k, ">u2")])
    steps = np.arange(reach)
    return line[at[:, None] + reach + k + steps], line[at[:, None] + reach - 1 - steps]


def _suffixes(batches: Iterator, k: int, span: int) -> Iterator:
    import pyarrow as pa

    def table(out: list) -> pa.RecordBatch:
        keys, rights, lefts, docs, places, held = zip(*out, strict=True)
        side = lambda xs: pa.array([r.tobytes() for x in xs for r in x], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), side(rights), side(lefts), pa.array([d for d, p in zip(docs, places, strict=True) for _ in p], pa.int64()), pa.array(np.concatenate(places)), pa.array(np.concatenate(held), pa.int32())], ["key", "right", "left", "doc_id", "pos", "held"])

    for b in batches:
        ids, out, held = b.column("doc_id").to_pylist(), [], 0
        for i, j, data, off in text_steps(b.column("text")):
            words, _, first = word_hashes(data, off)
            for r in range(j - i):
                own = words[first[r] : first[r + 1]]
                for base in range(0, max(1, len(own)), 1 << (PLACE - 1)):  # steps of a very long text overlap
                    part = own[base : base + (1 << (PLACE - 1)) + 2 * span]
                    at, start, many = minimisers(part, k, span)
                    if len(at):
                        right, left = contexts(part, at, k, span)
                        out.append((mix(shingle_hashes(part, k)[at]), right, left, ids[i + r], at + base, (at - start) * span + many))
                        held += len(at)
                if held > 4000:
                    yield table(out)
                    out, held = [], 0
        if out:
            yield table(out)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading entries that agree, row by row; 0 agrees with nothing."""
    differ = np.ones((len(a), a.shape[1] + 1), bool)
    differ[:, :-1] = (a != b) | (a == 0)
    return differ.argmax(1)


def depths(key: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of sorted suffixes the longest right context shared with another document's of the same key: one of the nearest before
    and after has it. -1 where the key has no other document; all of the context where the nearest is beyond the rows."""
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    heads, run = np.flatnonzero(new), np.cumsum(new) - 1
    best = np.full(n, -1)
    for j in (heads[run] - 1, np.append(heads[1:], n)[run]):
        inside = (j >= 0) & (j < n)
        best[~inside] = right.shape[1]
        ok = np.flatnonzero(inside)
        ok = ok[key[ok] == key[j[ok]]]
        best[ok] = np.maximum(best[ok], _shared(right[ok], right[j[ok]]))
    return best


def _prefixes(side: np.ndarray) -> np.ndarray:
    """Hashes of the first 0, 1, ... entries, a row for each length."""
    out = np.zeros((side.shape[1] + 1, len(side)), np.uint64)
    for j in range(side.shape[1]):
        out[j + 1] = out[j] * np.uint64(0xD6E8FEB86659FD93) + side[:, j]
    return mix(out)


def _windows(batches: Iterator, k: int, span: int) -> Iterator:
    """The windows of sorted suffixes that another document may hold: those whose part right of the gram is no longer than the
    longest right context that another document shares."""
    import pyarrow as pa

    reach = span - k
    for b in batches:
        if not b.num_rows:
            continue
        wide = lambda c: np.frombuffer(b"".join(b.column(c).to_pylist()), ">u2").reshape(-1, reach)  # noqa: B023, E731
        key, doc, pos, held = (b.column(c).to_numpy() for c in ("key", "doc_id", "pos", "held"))
        right = wide("right")
        deep = depths(key, right, doc)
        lead, many = held // span, held % span
        many = np.where(deep < 0, 0, np.minimum(many, lead - reach + deep + 1))
        rows = np.flatnonzero(many > 0)
        if not len(rows):
            continue
        many = many[rows]
        at = np.repeat(np.arange(len(rows)), many)
        before = lead[rows][at] - (np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many))
        rights, lefts = _prefixes(right[rows].astype(np.uint64)), _prefixes(wide("left")[rows].astype(np.uint64))
        value = mix(mix(key[rows].view(np.uint64)[at] + rights[reach - before, at]) + lefts[before, at] * np.uint64(3) + before.astype(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(doc[rows][at]), pa.array(pos[rows][at] - before)], ["hash", "doc_id", "start"])


def _repeats(batches: Iterator, edges: bool) -> Iterator:
    """Of windows sorted by hash and document those whose hash has two documents, with the least other one met.

    What later rows need of the last hash goes on to the next batch: all windows of its only document, or one window of each
    of its first two, which then come out again. With edges the first and the last hash of the rows come out so too."""
    import pyarrow as pa

    def batch(t: np.ndarray, other: np.ndarray | None) -> pa.RecordBatch:
        edge = other is None
        last = pa.nulls(t.shape[1], pa.int64()) if edge else pa.array(other)
        return pa.RecordBatch.from_arrays([*map(pa.array, t), last, pa.array(np.full(t.shape[1], edge))], ["hash", "doc_id", "start", "other", "edge"])

    def brief(group: np.ndarray) -> np.ndarray:
        unlike = np.flatnonzero(group[1] != group[1, 0])[:1]
        return group[:, [0, *unlike]] if len(unlike) else group

    t, first = np.zeros((3, 0), np.int64), edges
    for b in batches:
        if not b.num_rows:
            continue
        t = np.concatenate([t, np.stack([b.column(c).to_numpy() for c in ("hash", "doc_id", "start")])], axis=1)
        n = t.shape[1]
        new = np.ones(n, bool)
        new[1:] = t[0, 1:] != t[0, :-1]
        heads, run = np.flatnonzero(new), np.cumsum(new) - 1
        least = t[1, heads][run]
        unlike = np.flatnonzero(t[1] != least)
        second = np.full(len(heads), n)
        np.minimum.at(second, run[unlike], unlike)
        rows = np.flatnonzero(second[run] < n)
        if len(rows):
            yield batch(t[:, rows], np.where(t[1, rows] == least[rows], t[1, second[run[rows]]], least[rows]))
        if first and len(heads) > 1:
            yield batch(brief(t[:, : heads[1]]), None)
            first = False
        t = brief(t[:, heads[-1] :])
    if edges and t.shape[1]:
        yield batch(t, None)


def repeated_passages(docs: DataFrame, min_words: int = 50, gram: int = 8) -> DataFrame:
    """Passages of at least min_words words that another document holds too: doc_id, start_word, n_words, other_doc_id.

    Words stand between white space and are compared as they are. Each window of min_words words keeps the position of its
    least gram; the suffixes there, cut to what decides a match of min_words, are range-partitioned by their content, so a
    passage in a third of all documents is spread over many tasks, and sorted. The nearest of another document on both sides
    tell how far right of its gram a suffix can be repeated. The windows within that go on by hash, are range-partitioned and
    sorted in turn, and those that two documents hold are found whatever partition or batch they stand in. Repeated windows
    that meet or overlap are one row; other_doc_id is the smallest document met. Words are compared by hashes (64 bits for the
    gram, 16 for each further word, 64 for a window of these). A passage counts once for each document that holds it; repeats
    within one document alone don't.

    Null, empty and shorter texts have no passage; null ids take no part; rows repeated with one id are one document. An
    empty table gives no rows; other columns are not read.
    """
    k, span = gram, min_words
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    order = ["key", "right", "left", "doc_id", "pos"]
    suffixes = base.mapInArrow(lambda b: _suffixes(b, k, span), SUFFIX)
    windows = stored(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _windows(b, k, span), WINDOW), "suffix-windows")
    order = ["hash", "doc_id", "start"]
    found = stored(windows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _repeats(b, True), REPEAT), "suffix-repeats")
    rim = found.where("edge").select(*order).repartition(1).sortWithinPartitions(*order).mapInArrow(lambda b: _repeats(b, False), REPEAT)
    spans = found.where("not edge").unionAll(rim).select("doc_id", "start", "other")
    past = Window.partitionBy("doc_id").orderBy("start")
    islands = spans.withColumn("new", F.when(F.col("start") <= F.lag("start").over(past) + span, 0).otherwise(1)).withColumn("island", F.sum("new").over(past.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("doc_id", "island").agg(F.min("start").alias("start_word"), (F.max("start") + span).alias("end"), F.min("other").alias("other_doc_id"))
    return merged.select("doc_id", "start_word", (F.col("end") - F.col("start_word")).alias("n_words"), "other_doc_id")
