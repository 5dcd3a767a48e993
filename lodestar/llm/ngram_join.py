"""Exact n-gram Jaccard join: T-occurrence search by DivideSkip within groups that share a part of their shingle sets."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, shingle_hashes, stored, text_steps, word_hashes
from .components import connected_components

#: Sets and shingles of one search block; members of one list, or of one block of a longer one; DivideSkip's weight of a probe.
BLOCK_SETS, BLOCK_SHINGLES, LIST_BLOCK, PROBE = 250, 500_000, 1000, 0.5
#: Least number of parts that a set is cut into, and the growth from one number to the next.
PARTS, GROWTH = 4, 1.5
#: Classes of keys of which each member of a list knows its least one, so that a pair in many lists is given by one of them.
KEY_CLASSES = 16
#: Bits of the map of hashed ids that spares most texts a shuffle; it has a row for 64 of them, which bounds its broadcast.
MARKS = 1 << 24
EDGES = "a long, b long"


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, k))


def sets_of(column, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow column, as sorted hashes."""
    for i, j, data, off in text_steps(column):
        words, _, at = word_hashes(data, off, lower=True)
        for r in range(j - i):
            yield shingle_set(words[at[r] : at[r + 1]], k)


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of n shares at least with any set it links with."""
    return -(-num * n // den)


def most_apart(n: int, num: int, den: int) -> int:
    """Shingles, at most, that a set of n and a larger one it links with don't share: (1 - t) / (1 + t) of both sizes, where the
    larger has at most n / t."""
    return n * (den - num) // num


def parity(mixed: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of the set's mixed hashes ends in i. Of two sets, bits that differ are at most elements that
    differ, so they bound the overlap from above. Sizes are powers of two and fold by xor of the halves."""
    bits = 1 << max(6, (len(mixed) - 1).bit_length())
    return np.packbits(np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


@cache
def _edges(parts: int) -> np.ndarray:
    """The hashes at which each part begins."""
    return np.array([(i << 64) // parts for i in range(parts)], np.uint64)


@cache
def _level(need: int) -> int:
    level, parts = 0, PARTS
    while parts < need:
        level, parts = level + 1, math.ceil(parts * GROWTH)
    return level


def _need(apart: int) -> int:
    """Parts for sets that differ in so many shingles: two more, and a tenth for parts that are empty."""
    return apart + 2 + -(-apart // 10)


@cache
def _parts(level: int) -> tuple[int, int]:
    """The number of parts of a level, and the most shingles that sets may differ in for it."""
    parts = PARTS
    for _ in range(level):
        parts = math.ceil(parts * GROWTH)
    return parts, max(d for d in range(parts) if _need(d) <= parts)


def part_keys(s: np.ndarray, mixed: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of which any two linked, unequal sets share two at least.

    The smaller set's size sets the number of parts that both are cut into by ranges of the hash: more than the shingles that
    they don't share, by two or more, so at least two parts are equal. A set of n meets smaller ones down to t * n, so it
    has the keys of each number of parts that those call for. Empty parts have no key, but where a set has so many that fewer
    than two others need be equal: then they count as parts like others, and so they do in its partner.
    """
    need = lambda m: _need(most_apart(m, num, den))
    n = len(s)
    if not most_apart(n, num, den):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    out = []
    for level in range(_level(need(least_overlap(n, num, den))), _level(need(n)) + 1):
        parts, apart = _parts(level)
        at = np.append(np.searchsorted(s, _edges(parts)), n)
        name = mix(np.arange(parts, dtype=np.uint64) + np.uint64(parts << 32))
        keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ name)
        full = at[1:] > at[:-1]
        out.append(keys if full.sum() < min(apart, most_apart(n, num, den)) + 2 else keys[full])
    return np.concatenate(out)


def sketches(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(row, doc_id, n, d1, d2, keys, bits, low): size, 128-bit digest, part keys, parity bits and least hash of each document's set."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = b.column("doc_id")
            for at in range(0, len(ids), 2000):
                found = list(sets_of(b.column("text").slice(at, 2000), k))
                mixed = [mix(s) for s in found]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids.slice(at, 2000), "n": pa.array([len(s) for s in found], pa.int64()),
                        "d1": pa.array([int(m.sum().view(np.int64)) for m in mixed], pa.int64()), "d2": pa.array([int(mix(s ^ np.uint64(0xA5A5A5A5)).sum().view(np.int64)) for s in found], pa.int64()),
                        "keys": pa.array([part_keys(s, m, num, den).view(np.int64) for s, m in zip(found, mixed, strict=True)], pa.list_(pa.int64())),
                        "bits": [parity(m).tobytes() for m in mixed], "low": pa.array([s[0].view(np.int64).item() if len(s) else None for s in found], pa.int64()),
                    }
                )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, keys array<long>, bits binary, low long")
    return stored(base.withColumn("row", F.monotonically_increasing_id()), "join-sketches")


def marked(rows: DataFrame, number, marks: DataFrame, bounded: bool = False) -> DataFrame:
    """Rows whose number is among the marks: (mark) numbers, packed as a bit each, 64 to a row, so that the planner can mostly
    broadcast them. Bounded are those below MARKS: at most MARKS / 64 rows of 16 bytes, 4 MB, are broadcast in any case."""
    packed = marks.groupBy(F.shiftright("mark", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(mark & 63 as int))")).alias("__bits"))
    at = rows.withColumn("__at", number)
    packed = F.broadcast(packed) if bounded else stored(packed, "join-marks")  # of known size, so the rows aren't shuffled in vain
    return at.join(packed, F.shiftright("__at", 6) == packed["__word"]).where("(shiftrightunsigned(__bits, cast(__at & 63 as int)) & 1) = 1").drop("__at", "__word", "__bits")


def t_occurrence(lists: list[list[int]], low: int, need: int) -> Iterator[tuple[int, int]]:
    """(id, number of lists) of the ids from ``low`` on that are in ``need`` of the sorted lists at least.

    DivideSkip: the L longest lists are put by; the others are merged by a heap of their fronts. An id in need - L of them or
    more is probed for in the long ones by binary search; else need - L - 1 fronts are popped and each jumps to the new top,
    past ids that can't be in enough lists.
    """
    lists = sorted(lists, key=len)
    n_long = min(need - 1, int(need / (PROBE * math.log2(len(lists[-1]) + 1) + 1)))
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    least = need - n_long
    places = [bisect_left(x, low) for x in short]
    heap = [(x[p], i) for i, (x, p) in enumerate(zip(short, places, strict=True)) if p < len(x)]
    heapq.heapify(heap)
    while len(heap) >= least:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            total = len(popped)
            for left, x in zip(range(n_long - 1, -1, -1), reversed(long_), strict=True):
                p = bisect_left(x, top)
                total += p < len(x) and x[p] == top
                if total + left < need:
                    break
            if total >= need:
                yield top, total
            to = top + 1
        else:
            while heap and len(popped) < least - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                return
            to = heap[0][0]
        for i in popped:
            places[i] = p = bisect_left(short[i], to, places[i])
            if p < len(short[i]):
                heapq.heappush(heap, (short[i][p], i))


def link_block(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Component of each set under links, as its least member, by T-occurrence search among the sets of a block.

    Sets are queried by rising size against the inverted lists of those before them, so a match shares at least least_overlap
    of the query's size. A query ends as soon as all that it could still meet are in its component.
    """
    n = len(sets)
    order = sorted(range(n), key=lambda i: (len(sets[i]), i))
    sizes = np.array([len(sets[i]) for i in order])
    values, inverse, count = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    lists: dict[int, list[int]] = {}
    comp = np.arange(n)
    for i in range(n):
        own = inverse[ends[i] - sizes[i] : ends[i]]
        own = own[count[own] > 1].tolist()
        need = least_overlap(int(sizes[i]), num, den)
        low = int(np.searchsorted(sizes[:i], need))
        met = [lists[x] for x in own if x in lists] if low < i and len(own) >= need else []
        if len(met) >= need:
            for j, both in t_occurrence(met, low, need):
                if comp[j] != comp[i] and den * both >= num * (sizes[i] + sizes[j] - both):
                    comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
                    if (comp[low:i] == comp[i]).all():
                        break
        for x in own:
            lists.setdefault(x, []).append(i)
    back = np.array(order)
    out, least = np.empty(n, np.int64), np.full(n, n)
    np.minimum.at(least, comp, back)
    out[back] = least[comp]
    return out


def _runs(batches: Iterator, keys: list[str]) -> Iterator:
    """Tables of the rows of each key, from batches sorted by the keys."""
    import pyarrow as pa

    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None and len(held) else t
        if not len(t):
            continue
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(len(t), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for s, e in zip(cuts, cuts[1:], strict=False):
            yield t.slice(s, e - s)
        held = t.slice(cuts[-1]).combine_chunks()
    if held is not None and len(held):
        yield held


def _search(batches: Iterator, k: int, num: int, den: int) -> Iterator:
    """Star edges of the components of each group of rows (key, block, cid, d1, text)."""
    import pyarrow as pa

    for t in _runs(batches, ["key", "block"]):
        text = t.column("text").combine_chunks()
        found = {}
        for c, d1, s in zip(t.column("cid").to_pylist(), t.column("d1").to_pylist(), sets_of(text, k), strict=True):
            if int(mix(s).sum().view(np.int64)) == d1:  # else another text under a repeated id
                found[c] = s
        ids = sorted(found)
        if len(ids) > 1:
            root = link_block([found[c] for c in ids], num, den)
            edges = [(ids[i], ids[r]) for i, r in enumerate(root) if r != i]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def searched(groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges (a, b) that T-occurrence search finds in each group of (key, block, cid, d1, text)."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: what a group costs isn't seen in its bytes
    dealt = groups.select("key", "block", "cid", "d1", "text").repartition(parts, "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(lambda b: _search(b, k, num, den), EDGES)


def folded(bits: list[bytes], size: int) -> np.ndarray:
    """Parity bits as rows of ``size`` bits; those of fewer are not used and stay 0."""
    out = np.zeros((len(bits), size // 8), np.uint8)
    for i, b in enumerate(bits):
        x = np.frombuffer(b, np.uint8)
        while len(x) > size // 8:
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        if len(x) == size // 8:
            out[i] = x
    return out


def given_here(key: int, one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of the pairs of one list member with others, given their least keys of each class (0: none): whether this list gives them.

    If two have the same least key of a class, they meet in that list; the least such key is the one list that gives the pair.
    Without such a key all lists that both are in give it."""
    most = np.iinfo(np.int64).max
    least = np.where((others == one) & (one != 0), one, most).min(1, initial=most)
    return (least == key) | (least == most)


def _suspects(batches: Iterator, num: int, den: int, best: bool) -> Iterator:
    """Pairs (a, b) of a list (key, i, j) whose components differ and whose sizes and parity bits allow a link. With best only as
    many, the likeliest first, as would join the list's components if all were links; else those that this list is to give."""
    import pyarrow as pa

    for t in _runs(batches, ["key", "i", "j"]):
        n, cid, comp, blk = (t.column(c).to_numpy() for c in ("n", "cid", "comp", "blk"))
        key, i, j = (t.column(c)[0].as_py() for c in ("key", "i", "j"))
        bits = t.column("bits").to_pylist()
        least = None if best else t.column("least").combine_chunks().flatten().to_numpy().reshape(len(t), KEY_CLASSES)
        order = np.lexsort((cid, n))
        least = least if best else least[order]
        n, cid, comp, blk, bits = n[order], cid[order], comp[order], blk[order], [bits[x] for x in order]
        out, rows = [], {}
        for x in range(1, len(n)):
            low = int(np.searchsorted(n[:x], least_overlap(int(n[x]), num, den)))
            y = np.arange(low, x)
            y = y[(comp[y] != comp[x]) & ((blk[y] != blk[x]) if i != j else True)]
            if not best:
                y = y[given_here(key, least[x], least[y])]
            if len(y):
                size = 8 * len(bits[int(y[0])])
                if size not in rows:
                    rows[size] = folded(bits, size)
                differ = np.bitwise_count(rows[size][y] ^ rows[size][x]).sum(1, dtype=np.int64)
                most = (n[x] + n[y] - differ) // 2
                ok = den * most >= num * (n[x] + n[y] - most)
                out += [(float(m / n[x]), x, int(z)) for z, m in zip(y[ok], most[ok], strict=True)]
        if best and out:
            joined, kept = {c: c for c in comp.tolist()}, []
            for pair in sorted(out, reverse=True):
                a, b = joined[int(comp[pair[1]])], joined[int(comp[pair[2]])]
                if a != b:
                    joined = {c: a if r == b else r for c, r in joined.items()}
                    kept.append(pair)
            out = kept
        if out:
            ends = [(int(max(cid[x], cid[z])), int(min(cid[x], cid[z]))) for _, x, z in out]
            yield pa.RecordBatch.from_pydict({"key": pa.array([key] * len(out), pa.int64()), "a": pa.array([a for a, _ in ends], pa.int64()), "b": pa.array([b for _, b in ends], pa.int64())})


def posted_lists(classes: DataFrame) -> DataFrame:
    """(key, cid): the lists of part keys that two classes or more have. Of lists of up to LIST_BLOCK members with the very same
    members one is enough."""
    by = Window.partitionBy("key")
    posted = classes.select("cid", F.explode("keys").alias("key")).withColumn("m", F.count(F.lit(1)).over(by)).where("m > 1")
    lists = stored(posted.select("key", "cid"), "join-posted")
    members = lists.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "cid")).alias("x2"))
    alike = F.when(F.col("m") > LIST_BLOCK, F.col("key"))
    single = members.groupBy("m", "x1", "x2", alike.alias("own")).agg(F.min("key").alias("key")).select("key")
    return stored(lists.join(single, "key", "left_semi"), "join-lists")


def mixed_lists(lists: DataFrame) -> DataFrame:
    """(key, cid, comp, m) of the lists (key, cid, comp) that hold two components, with the number of their members. Counts are
    combined before the shuffle, so a hot key isn't gathered."""
    sizes = lists.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
    return lists.join(sizes.where("lo <> hi").select("key", "m"), "key")


def least_keys(lists: DataFrame) -> DataFrame:
    """(cid, least): the least key of each class among the lists (key, cid) of a member, 0 where it has none."""
    least = [F.coalesce(F.min(F.when(F.col("key").bitwiseAND(KEY_CLASSES - 1) == c, F.col("key"))), F.lit(0)) for c in range(KEY_CLASSES)]
    return lists.groupBy("cid").agg(F.array(*least).alias("least"))


def residual_links(shared: DataFrame, labels: DataFrame, near: DataFrame, reps: DataFrame, base: DataFrame, k: int, num: int, den: int, best: bool) -> DataFrame:
    """(a, b) components that a link joins, from the lists whose members are not yet of one component.

    With best each component sends one member to a list, so few pairs are enough to join most. A list of more than LIST_BLOCK
    members gives way to lists by two such keys: linked sets share two parts, and if one is in a list that isn't long they
    meet there. What is still longer is cut into blocks, of which each two meet. The pairs that sizes and parity bits can't rule
    out go to one of their lists, and T-occurrence search over the whole sets of its members decides. Near copies meet in many
    lists; in the round over all members only the one with the least key that both know of gives the pair.
    """
    lists = shared.join(labels, "cid").select("key", "cid", "comp")
    if best:
        lists = lists.groupBy("key", "comp").agg(F.min("cid").alias("cid")).select("key", "cid", "comp")
    lists = stored(mixed_lists(lists), "join-mixed")
    hot = lists.where(F.col("m") > LIST_BLOCK).select("key", "cid", "comp")
    twice = hot.alias("x").join(hot.alias("y"), (F.col("x.cid") == F.col("y.cid")) & (F.col("x.key") < F.col("y.key")))
    twice = mixed_lists(twice.select(F.xxhash64("x.key", "y.key").alias("key"), F.col("x.cid").alias("cid"), F.col("x.comp").alias("comp")))
    lists = lists.where(F.col("m") <= LIST_BLOCK).unionByName(twice)
    known = near.select("cid", "n", "bits")
    if not best:
        lists = stored(lists, "join-met")
        known = known.join(least_keys(lists), "cid")
    parts = F.ceil(F.col("m") / F.lit(LIST_BLOCK)).cast("int")
    lists = lists.withColumn("blk", F.pmod(F.xxhash64("cid"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    lists = lists.select("key", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "cid", "comp")
    known = lists.join(known, "cid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = stored(known.mapInArrow(lambda b: _suspects(b, num, den, best), f"key long, {EDGES}"), "join-pairs")
    pairs = pairs.groupBy("a", "b").agg(F.min("key").alias("key"))
    members = pairs.select(F.explode(F.array("a", "b")).alias("cid"), "key", F.lit(0).alias("block")).distinct()
    links = searched(with_texts(members, reps, base), k, num, den)
    side = lambda x: labels.select(F.col("cid").alias(x), F.col("comp").alias(f"c{x}"))
    return links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()


def with_texts(members: DataFrame, reps: DataFrame, base: DataFrame) -> DataFrame:
    """members (cid, key, block) with d1 and the text of each class, of its first document. The documents are read again and a
    bounded map of hashed ids keeps back almost all others, so no more texts are shuffled than are searched."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKS))
    wanted = marked(reps, F.col("cid"), members.select(F.col("cid").alias("mark"))).join(members, "cid")
    wanted = stored(wanted.select("cid", "rep", "d1", "key", "block"), "join-wanted")
    few = marked(base, place("doc_id"), wanted.select(place("rep").alias("mark")), True)
    return few.join(wanted, few["doc_id"].eqNullSafe(wanted["rep"])).select("cid", "d1", "key", "block", "text")


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    links = stored(links, "join-links")
    if links.isEmpty():
        return labels
    roots = connected_components(links)
    return stored(labels.join(roots, labels["comp"] == roots["node"], "left").select("cid", F.coalesce("root", "comp").alias("comp")), "join-labels")


def ngram_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, for links of den * intersection >= num * union of k-word sets.

    1. Equal sets become one class, before any shuffle of more than digests. 2. Each set is cut into parts, two of which it
    shares with any set it links with; the keys of parts that no other class has are dropped. 3. The classes of equal least
    hash are searched together by T-occurrence, in blocks of bounded size. 4. The key lists that still hold two components
    are searched in the same way, first with one member of each component, then, after those have been joined, with all.
    So no link between components is missed, and no list is expanded into its pairs while its members are connected.

    A null or empty text has no shingle, its own component and no links. Rows repeated with one id share the component of
    their text; an id with several texts has a row and a component for each. A null id has its row; component_id is null only
    if a whole component has no id. An empty table gives none; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = sketches(base, k, num, den)
    reps = stored(sketch.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("row").alias("cid")), "join-classes")
    classes = marked(sketch, F.col("row"), reps.select(F.col("cid").alias("mark")))
    shared = posted_lists(classes.select(F.col("row").alias("cid"), "keys"))
    near = stored(marked(sketch, F.col("row"), shared.select(F.col("cid").alias("mark"))).select(F.col("row").alias("cid"), "n", "bits", F.col("low").alias("key")), "join-near")
    groups = near.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).where("m > 1")
    parts = F.greatest(F.ceil(F.col("m") / F.lit(BLOCK_SETS)), F.ceil(F.col("s") / F.lit(BLOCK_SHINGLES)))
    blocks = near.join(groups, "key").select("cid", "key", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("block"))
    found = searched(with_texts(blocks, reps, base), k, num, den)
    labels = reps.select("cid").join(found, reps["cid"] == found["a"], "left").select("cid", F.coalesce("b", "cid").alias("comp"))
    labels = stored(labels, "join-labels")
    for best in (True, False):
        labels = relabel(labels, residual_links(shared, labels, near, reps, base, k, num, den, best))
    members = reps.join(labels, "cid")
    lowest = members.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of = members.join(lowest, "comp").select("d1", "d2", "n", "component_id")
    return sketch.join(of, ["d1", "d2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
