"""Inverted-index retrieval: chunks, postings, BM25, coverage, incremental maintenance, quotes, context packing."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from ..functions.text import quick_terms, slice_utf16, terms_of, utf16_length

#: Asked terms that are sent along with a scan; pairs of a chunk and a term in an Arrow batch.
ASKED, STEP = 1 << 16, 1 << 16
# Fixed values of the scoring and of its limits.
K1, B, CHUNK, TOP_K, MAX_SCORED, MAX_TERMS = 1.2, 0.75, 1200, 8, 10_000, 256
#: White space of the chunk contract, and the two kinds of break.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_END, SENTENCE_END = re.compile("\n+"), re.compile(f"[.!?。！？]([{BLANK}]+)")
CHUNKS = "doc_id string, chunk_id string, start_offset int, end_offset int, block_id string, text string"


def utf16_places(text: str):
    """The UTF-16 offset of each code point and of the end."""
    return np.concatenate([[0], np.cumsum(1 + (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) > 0xFFFF))])


def chunk_spans(text: str, size: int = CHUNK, blocks: list[tuple[str, int, int]] = ()) -> list[tuple[str | None, int, int, str]]:
    """(block, start, end, text) of a document's chunks, offsets in UTF-16 units.

    The breaks of the whole text are found once. A range is cut every ``size`` units, or at the last break in the second half
    of that stretch, which a binary search finds; white space that goes on beyond the stretch counts up to its end. No
    surrogate pair is split, no chunk crosses an edge of a block, and blank chunks are passed over.
    """
    places = utf16_places(text)
    lines = [(m.start(), m.start(), m.end()) for m in LINE_END.finditer(text)]
    marks = [(m.start(), m.start(1), m.end()) for m in SENTENCE_END.finditer(text)]
    tables = [np.array([places[list(x)] for x in found]).reshape(-1, 3) for found in (lines, marks)]  # from, blank from, to

    def last_break(start: int, end: int) -> int:
        best = -1
        for table, inside in zip(tables, (2, 0), strict=True):  # of line ends a part is enough, of sentence ends the mark is needed
            i = int(np.searchsorted(table[:, 1], end)) - 1
            if i >= 0 and (table[i, 2] > start if inside else table[i, 0] >= start):
                best = max(best, min(int(table[i, 2]), end))
        return best

    edges = [0, *(e for _, a, b in sorted(blocks, key=lambda x: x[1]) for e in (a, b)), int(places[-1])]
    names = [None, *(n for name, _, _ in sorted(blocks, key=lambda x: x[1]) for n in (name, None))]
    out = []
    for name, at, stop in zip(names, edges, edges[1:], strict=False):
        while at < stop:
            end = min(at + size, stop)
            end = int(places[np.searchsorted(places, end, "right") - 1])
            if end < stop and 2 * ((cut := last_break(at, end)) - at) >= size:
                end = cut
            piece = text[np.searchsorted(places, at) : np.searchsorted(places, end)]
            if piece.strip(BLANK):
                out.append((name, at, end, piece))
            at = end
    return out


def chunk_documents(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Chunks of documents (doc_id string, text, optionally blocks of id, start and end): a recurrence, so in Python, a row at
    a time within Arrow batches and without a shuffle."""
    blocks = "blocks" in docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                own = [(b["id"], b["startOffset"], b["endOffset"]) for b in r.blocks] if blocks and r.blocks is not None else []
                for name, start, end, piece in chunk_spans(r.text or "", size, own):
                    out.append((r.doc_id, json.dumps([r.doc_id, start, end], ensure_ascii=False, separators=(",", ":")), start, end, name, piece))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "start_offset", "end_offset", "block_id", "text"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", *(["blocks"] if blocks else [])).mapInPandas(run, CHUNKS)


def chunk_table(docs: DataFrame) -> DataFrame:
    """Whole documents as one chunk each: the identity is the text form of the id."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text")


def term_counts(chunks: DataFrame, asked: frozenset[str] | None = None) -> DataFrame:
    """(chunk_id, doc_id, len, hits): of each chunk its number of terms and how often it holds each one, or each of the asked
    ones. One pass over the texts without a shuffle; nothing but counts leaves Python."""
    import pyarrow as pa

    pair = pa.struct([("term", pa.string()), ("tf", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                names, tfs, lens, ends = [], [], [], [0]
                for text in batch["text"][at:]:
                    terms = quick_terms(text.as_py())
                    lens.append(len(terms))
                    found = Counter(terms if asked is None else [x for x in terms if x in asked])
                    names += found.keys()
                    tfs += found.values()
                    ends.append(len(names))
                    if len(names) >= STEP:
                        break
                hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(tfs, pa.int64())], fields=list(pair)))
                yield pa.RecordBatch.from_arrays([batch["chunk_id"][at : at + len(lens)], batch["doc_id"][at : at + len(lens)], pa.array(lens, pa.int32()), hits], ["chunk_id", "doc_id", "len", "hits"])
                at += len(lens)

    return chunks.select("chunk_id", "doc_id", "text").mapInArrow(run, "chunk_id string, doc_id string, len int, hits array<struct<term: string, tf: bigint>>")


def exploded(counts: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, len, tf) of counts."""
    return counts.select("chunk_id", "doc_id", "len", F.explode("hits").alias("x")).select("x.term", "chunk_id", "doc_id", "len", "x.tf")


def merged(hits: DataFrame) -> DataFrame:
    """Hits of rows with one id and length as one."""
    return hits.groupBy("term", "chunk_id", "doc_id", "len").agg(F.sum("tf").alias("tf"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, tf, len): counts are combined before the shuffle."""
    return merged(exploded(term_counts(chunks)))


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length in terms, which counts repeats."""
    return term_counts(chunks, frozenset()).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))


def query_terms(spark, questions: dict[str, str]) -> DataFrame:
    """(query_id, term) of a set of questions; distinct terms, bounded for each."""
    rows = []
    for name, text in questions.items():
        terms = list(dict.fromkeys(terms_of(text)))
        if len(terms) > MAX_TERMS:
            raise ValueError(f"question {name} has more than {MAX_TERMS} terms")
        rows += [(name, t) for t in terms]
    return spark.createDataFrame(rows, "query_id string, term string")


def contribution(tf: Column, df: Column, length: Column, n: Column, avg_len: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    mean = F.when(avg_len > 0, avg_len).otherwise(1.0)
    return idf * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length / mean))


def asked_hits(chunks: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences (term, chunk_id, doc_id, len, tf) of asked terms, the number of chunks of each term, and the statistics of all
    chunks: texts are read once, and of each chunk its length and the asked terms in it are stored. More terms than ASKED are
    joined instead of sent along."""
    frequency = lambda hits: hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    asked = [r["term"] for r in terms.select("term").distinct().limit(ASKED + 1).collect()]
    if len(asked) > ASKED:
        hits = exploded(term_counts(chunks)).join(terms.select("term").distinct(), "term")
        hits = stored(merged(hits), "hits")
        return hits, frequency(hits), index_stats(chunks)
    counts = stored(term_counts(chunks, frozenset(asked)), "counts")
    hits = exploded(counts)
    if not counts.groupBy("chunk_id", "doc_id", "len").count().where("count > 1").isEmpty():
        hits = merged(hits)
    return hits, F.broadcast(frequency(hits)), counts.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))


def matches(chunks: DataFrame, terms: DataFrame, restrict: DataFrame | None = None, max_scored: int | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, term, part): contributions of matched terms.

    Only occurrences of asked terms leave the scan. Counts of chunks for each term are over all chunks, whatever the
    restriction. With max_scored, terms are taken by rising frequency and chunks in order until so many chunks are admitted.
    """
    hits, frequency, stats = asked_hits(chunks, terms)
    counted = hits.join(frequency, "term").join(F.broadcast(stats))
    if restrict is not None:
        counted = counted.join(restrict.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = counted.join(terms, "term")
    if max_scored is not None:
        first = Window.partitionBy("query_id", "chunk_id")
        order = found.withColumn("turn", F.min(F.struct("df", "term", "doc_id", "chunk_id")).over(first))
        heads = order.select("query_id", "chunk_id", "turn").distinct()
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))
        found = found.join(heads.withColumn("rank", rank).where(F.col("rank") <= max_scored).select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    return found.select("query_id", "chunk_id", "doc_id", "term", contribution(F.col("tf"), F.col("df"), F.col("len"), F.col("n"), F.col("avg_len")).alias("part"))


def top_hits(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query by falling score, ties by rising chunk id; rank limits are pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def search(chunks: DataFrame, terms: DataFrame, k: int = TOP_K, restrict: DataFrame | None = None, max_scored: int | None = None) -> DataFrame:
    """(query_id, chunk_id, doc_id, score, rank) of the best chunks."""
    scored = matches(chunks, terms, restrict, max_scored).groupBy("query_id", "chunk_id", "doc_id").agg(F.round(F.sum("part"), 9).alias("score"))
    return top_hits(scored, k)


def coverage(chunks: DataFrame, terms: DataFrame, restrict: DataFrame | None = None, max_scored: int = MAX_SCORED) -> DataFrame:
    """One row a query: chunks, eligible and scored chunks, asked and matched terms, whether the limit cut."""
    found = matches(chunks, terms, restrict)
    ids = chunks.select("chunk_id", "doc_id")
    eligible = ids if restrict is None else ids.join(restrict.select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
    totals = ids.agg(F.count(F.lit(1)).alias("chunks")).join(F.broadcast(eligible.agg(F.count(F.lit(1)).alias("eligible"))))
    per = found.groupBy("query_id").agg(F.countDistinct("chunk_id").alias("reached"), F.array_join(F.array_sort(F.collect_set("term")), " ").alias("matched"))
    asked = terms.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("term")), " ").alias("asked"))
    both = asked.join(per, "query_id", "left").join(F.broadcast(totals))
    reached = F.coalesce("reached", F.lit(0))
    return both.select("query_id", "chunks", "eligible", F.least(reached, F.lit(max_scored)).alias("scored"), "asked", F.coalesce("matched", F.lit("")).alias("matched"), (reached > max_scored).alias("limit_reached"))


def upsert(current: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """The next version of a document table: changed rows replace those of their id, removed ids go, the rest stays as it is."""
    gone = changed.select("doc_id") if removed is None else changed.select("doc_id").unionByName(removed.select("doc_id"))
    return current.join(gone.distinct(), "doc_id", "left_anti").unionByName(changed)


def changed_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, change): added, removed, changed or same, by version hashes; only added and changed ones need new postings."""
    left = old.select("doc_id", F.sha2("text", 256).alias("was"))
    both = left.join(new.select("doc_id", F.sha2("text", 256).alias("now")), "doc_id", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return both.select("doc_id", change.alias("change"))


def quotes(docs: DataFrame, phrase: Column) -> DataFrame:
    """(doc_id, start, end, quote): the first place of a phrase in each document, in UTF-16 units."""
    at = F.instr(F.col("text"), phrase)
    start = utf16_length(F.substring(F.col("text"), F.lit(1), at - 1))
    return docs.where(at > 0).select("doc_id", start.alias("start"), (start + utf16_length(phrase)).alias("end"), phrase.alias("quote"))


def valid_citations(citations: DataFrame, docs: DataFrame) -> DataFrame:
    """citations (doc_id, version_id, start, end, quote) with valid: the version, the bounds and the slice all agree."""
    known = docs.select("doc_id", "text", F.sha2("text", 256).alias("now"))
    joined = citations.join(known, "doc_id", "left")
    bounds = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= utf16_length(F.col("text")))
    ok = (F.col("version_id") == F.col("now")) & F.when(bounds, slice_utf16(F.col("text"), F.col("start"), F.col("end")) == F.col("quote")).otherwise(False)
    return joined.select(*citations.columns, F.coalesce(ok, F.lit(False)).alias("valid"))


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """hits (query_id, rank, chunk_id, tokens) with admitted: in order of rank each hit that still fits is taken; one that
    doesn't is left out and later ones are tried. A query's hits are at most top-k, so a group is small."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, used, taken = pdf.sort_values("rank"), 0, []
        for n in pdf["tokens"]:
            taken.append(used + n <= budget)
            used += n * taken[-1]
        return pdf.assign(admitted=taken)

    return hits.select("query_id", "rank", "chunk_id", "tokens").groupBy("query_id").applyInPandas(run, "query_id string, rank int, chunk_id string, tokens int, admitted boolean")


def supported_answers(claims: DataFrame, cited: DataFrame) -> DataFrame:
    """claims (claim_id, text) and cited (claim_id, chunk_text): supported if every cited chunk holds the claim, and one does."""
    joined = claims.join(cited, "claim_id", "left")
    return joined.groupBy("claim_id").agg(F.coalesce(F.bool_and(F.contains("chunk_text", "text")), F.lit(False)).alias("supported"))


def _small(df: DataFrame) -> DataFrame:
    """A table marked for broadcasting if it has at most ASKED rows."""
    return F.broadcast(df) if df.limit(ASKED + 1).count() <= ASKED else df


def attach_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's text; hits are the small side, and up to ASKED of them go to the texts."""
    return chunks.select("chunk_id", "text").join(_small(stored(hits, "hits")), "chunk_id")


def attach_chunks(hits: DataFrame, docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Hits in chunks of documents with their chunk's text: only documents that hold one are cut again."""
    hits = stored(hits, "hits")
    asked = _small(hits.select(F.col("doc_id").alias("asked_id")).distinct())
    found = docs.join(asked, F.col("doc_id").cast("string").eqNullSafe(F.col("asked_id")), "left_semi")
    return attach_text(hits, chunk_documents(found, size))
