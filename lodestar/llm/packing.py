"""Best-fit packing of tokenised documents into sequences of one length, in bulk-synchronous steps."""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SEQUENCE, END_ID = 1024, 2
#: Pieces that one bucket of equal lengths holds, and token strings that a worker remembers.
BUCKET_ROWS, CACHE = 50_000, 400_000
#: Fixed classes of the byte-level tokenizer's split, for texts of these characters only; other texts go to the library whole.
LETTER, NUMBER = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e -ſ‐-‧]")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The split is context-free, so a string's ids are kept for the next text. Strings not met yet are merged by tiktoken from
    the same vocabulary, whose ids are the ranks of its merges: several times faster than the tokenizers library and equal
    to it, as tests check. Texts beyond the split's characters, or with the special token, go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printed]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t) and t not in self.special}
        self.merge = tiktoken.Encoding("vocabulary", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if OTHER.search(text) or any(t in text for t in self.special):
            return self.packed(self.library.encode(text, add_special_tokens=False).ids)
        parts = SPLIT.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            if len(self.known) > CACHE:
                self.known.clear()
            for p in set(parts).difference(self.known):
                self.known[p] = self.packed(self.merge(p))
            return b"".join(map(self.known.__getitem__, parts))

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole if it fits, else the remainder first and then full pieces."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return [(0, first)] * (first > 0) + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, salt) of each document; tokenizer is the path of its file, on each machine."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, end, turn = Encoder(tokenizer), end_id.to_bytes(4, "little"), 0
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = memoryview(encoder.encode(text.as_py() or "") + end)
                for i, (s, n) in enumerate(cut(len(ids) // 4, size)):
                    out.append((doc, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), turn))
                    turn += 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, salt long")


def best_fit(lengths: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first rank, end rank, first sequence, offset): which ranks of a length go to which run of sequences.

    Documents of one length, and gaps of one size, can stand for each other, so both range-sorted lists are run-length coded:
    at most ``size`` runs each, whatever the corpus. One superstep for each length, the longest first: a sweep finds the
    successor of the length among the gaps; all documents of the length claim it at once and their ranks settle which gets
    which gap; the gaps are updated, and what is left over sweeps on, to new sequences where no gap fits.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    moves, following = [], 0

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            at = bisect_left(order, length)
            if at < len(order):
                gap = order[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap, first, n = size, following, -(-left // (size // length))
                following += n
            each = gap // length
            used = min(n, -(-left // each))
            full = min(used, left // each)
            for j in range(each):
                filled = used if j < left - full * each else full
                if filled:
                    moves.append((length, rank, rank + filled, first, size - gap + j * length))
                    rank += filled
            taken = full * each
            give(gap - each * length, first, full)
            if used > full:
                rest = left - taken
                give(gap - rest * length, first + full, 1)
                taken += rest
            give(gap, first + used, n - used)
            left -= taken
    return moves


def pack(found: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Pieces with sequence_id and offset: no sequence is over ``size``, none has a hole.

    Ranks within a length come from buckets by hash, so a frequent length (that of full pieces, say) is shared out; one count
    for each length reaches the driver, at most ``size`` of them, and the moves go to all tasks.
    """
    found = stored(found, "pack-pieces")
    spark = found.sparkSession
    lengths = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    moves = best_fit(lengths, size)
    plan = spark.createDataFrame(moves, "length long, r0 long, r1 long, first long, offset long")
    parts = max(1, -(-max(lengths.values(), default=1) // BUCKET_ROWS))
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "bucket").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    turn = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("turn", turn).join(sums, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("turn"))
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("r0")) & (F.col("rank") < F.col("r1"))).drop(plan["length"])
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank") - F.col("r0")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenises whole documents, cuts those beyond ``size`` and packs all pieces: one row a piece.

    A null or empty text is the end id alone. Repeated rows are packed each. A null id stays null. An empty table gives no
    rows; other columns are not read.
    """
    return pack(pieces(docs, tokenizer, size, end_id), size)
