import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestar.llm import exact_dedup, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, h string, n string, row string, cid string, comp string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 5) for i, t in rows], DOCS).repartition(3)


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def near_copies(seed=1, groups=25):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 900)}" for _ in range(rng.choice((1, 3, 4, 5, 30, 120, 300)))]
        for _ in range(rng.randint(1, 6)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, len(t) // 40))):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 10**6)}"
            rows.append((" " if rng.random() < 0.5 else "\n\t").join(t))
    passage = " ".join(f"common{i}" for i in range(60))
    rows += [f"{passage} own{i} tail{i}" for i in range(8)] + ["A B C D", "a b c d", "", None, "  ", "x", "x", "é " * 50, "many " * 3000]
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def components(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 3)  # hot groups in many blocks
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", 3)
    rows = near_copies()
    got = {tuple(r) for r in ngram_join.ngram_components(table(spark, rows), k, num, den).collect()}
    assert got == components(rows, k, num, den)


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.ngram_components(table(spark, [])).collect() == []
    got = sorted(map(tuple, ngram_join.ngram_components(table(spark, [(1, None), (None, "a b"), (2, "a b"), (2, "a b"), (3, "")])).collect()), key=str)
    assert got == sorted([(1, 0, 1), (None, 1, 2), (2, 1, 2), (2, 1, 2), (3, 0, 3)], key=str)


def test_ngram_join_of_one_id_with_several_texts(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (1, " ".join(f"u{i}" for i in range(60))), (2, " ".join([*base[:-1], "end"])), (2, " ".join([*base[:-1], "end"])), (3, " ".join([f"u{i}" for i in range(59)] + ["end"]))]
    got = sorted(tuple(r) for r in ngram_join.ngram_components(table(spark, rows), 4, 85, 100).collect())
    assert got == [(1, 57, 1), (1, 57, 1), (2, 57, 1), (2, 57, 1), (3, 57, 1)]


@pytest.mark.parametrize("num", [80, 85])
def test_linked_sets_share_two_part_keys(num):
    rng = np.random.default_rng(num)
    for _ in range(3000):
        n = int(rng.choice((6, 8, 13, 25, 60, 300, 700)))
        whole = rng.integers(0, 1 << 63, 2 * n + 2).astype(np.uint64) * np.uint64(2)
        gone, new = rng.integers(0, 1 + n // 8), rng.integers(0, 1 + n // 5)
        a, b = np.unique(whole[:n]), np.unique(np.concatenate([whole[gone:n], whole[n : n + new]]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= num * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
            keys = [ngram_join.part_keys(s, ngram_join.mix(s), num, 100) for s in (a, b)]
            assert len(np.intersect1d(*keys)) >= 2


def test_t_occurrence_equals_counting():
    rng = random.Random(6)
    for _ in range(300):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 40))) for _ in range(rng.randint(1, 30))]
        need, low = rng.randint(1, len(lists)), rng.randint(0, 20)
        want = [(i, n) for i in range(low, 40) if (n := sum(i in x for x in lists)) >= need]
        assert list(ngram_join.t_occurrence(lists, low, need)) == want


def test_t_occurrence_search_of_a_block_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(40, 60), replace=False), rng.integers(0, 1 << 40, rng.integers(0, 8)).astype(np.uint64)])) for _ in range(30)]
        found = ngram_join.link_block(sets, 80, 100)
        root = list(range(30))
        for i in range(30):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root[i], root[j]
                    root = [min(a, b) if r in (a, b) else r for r in root]
        same = lambda r: {frozenset(i for i in range(30) if r[i] == x) for x in set(r)}
        assert same(list(found)) == same(root)


def test_parity_never_overstates_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 5000, rng.integers(1, 900)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, len(a) + 1)], rng.integers(0, 5000, 20).astype(np.uint64)]))
        x, y = (ngram_join.parity(ngram_join.mix(s)).tobytes() for s in (a, b))
        size = 8 * min(len(x), len(y))
        differ = int(np.bitwise_count(ngram_join.folded([x], size) ^ ngram_join.folded([y], size)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_each_pair_is_given_by_a_list_that_both_are_in():
    rng = np.random.default_rng(6)
    for share in (0.05, 0.5, 0.9):
        pool = rng.integers(-(1 << 62), 1 << 62, 60)
        own = [{int(k) for k in pool if rng.random() < share} for _ in range(25)]
        least = np.array([[min((k for k in s if k % ngram_join.KEY_CLASSES == c), default=0) for c in range(ngram_join.KEY_CLASSES)] for s in own])
        for i in range(25):
            for j in range(i):
                given = [k for k in own[i] & own[j] if ngram_join.given_here(k, least[i], least[[j]])[0]]
                classes = [k for k in least[i] if k and k in least[j]]
                assert given == [min(classes)] if classes else set(given) == own[i] & own[j]


def test_least_keys(spark):
    keys = [-33, -17, -1, 15, 31, 0, 16, 5]
    got = ngram_join.least_keys(spark.createDataFrame([(k, 7) for k in keys] + [(4, 8)], "key long, cid long")).collect()
    want = {7: [0] * 16, 8: [0] * 16}
    want[7][15], want[7][5], want[8][4] = -33, 5, 4
    assert {r["cid"]: r["least"] for r in got} == want


def test_exact_dedup(spark):
    rows = [(5, "a  b"), (3, "a\n\tb"), (9, "a b"), (1, None), (2, ""), (7, " "), (8, "\t\n"), (4, "b a"), (4, "b a"), (None, "a b"), (None, "only")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(table(spark, rows)).collect()), key=str)
    want = [(5, 3, 4, False), (3, 3, 4, True), (9, 3, 4, False), (None, 3, 4, False), (1, 1, 2, True), (2, 1, 2, False), (7, 7, 2, True), (8, 7, 2, False), (4, 4, 2, True), (4, 4, 2, False), (None, None, 1, True)]
    assert got == sorted(want, key=str)
    assert exact_dedup.exact_dedup(table(spark, [])).collect() == []
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.without_copies(table(spark, rows[:9]), ("doc_id", "text")).collect()) == [(1, None), (3, "a\n\tb"), (4, "b a"), (7, " ")]


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(0)
    counts = {rng.randrange(64): rng.randint(1, 30) for _ in range(40)} | {5: 500}
    slots = exact_dedup.directory(counts, 60, 6)
    assert [s for s, _, _ in slots] == list(range(64))
    held = defaultdict(int)
    for s, b, _ in slots:
        held[b] += counts.get(s, 0)
    depth = {b: d for _, b, d in slots}
    assert all(n <= 60 or depth[b] == 6 for b, n in held.items()) and max(depth.values()) == 6 and min(depth.values()) < 6


def repeated(rows, span):
    where = defaultdict(set)
    own = {}
    for i, t in rows:
        own.setdefault(i, []).append(words(t))
    for i, ts in own.items():
        for w in ts:
            for a in range(len(w) - span + 1):
                where[tuple(w[a : a + span])].add(i)
    return {i: {a + x for w in ts for a in range(len(w) - span + 1) if len(where[tuple(w[a : a + span])]) > 1 for x in range(span)} for i, ts in own.items()}


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: [f"v{rng.randint(0, 5000)}" for _ in range(n)]
    shared = [text(rng.randint(50, 130)) for _ in range(12)]
    rows = []
    for i in range(120):
        t = text(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(shared[: 6 if rng.random() < 0.7 else 12])
        rows.append((i, "  ".join(t)))
    rows += [(200, " ".join(text(60) * 2)), (201, " ".join(shared[0][:49])), (202, None), (203, ""), (204, " ".join(["same"] * 400)), (205, " ".join(["same"] * 300))]
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(table(spark, rows)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert r["n_words"] >= 50 and r["other_doc_id"] != r["doc_id"]
    want = {i: s for i, s in repeated(rows, 50).items() if s}
    assert set(got) == set(want)
    assert all(got[i] <= want[i] for i in want)
    assert sum(len(want[i] - got[i]) for i in want) <= 0.01 * sum(map(len, want.values()))


def test_repeated_passages_of_odd_tables(spark):
    assert suffix_dedup.repeated_passages(table(spark, [])).collect() == []
    long = " ".join(f"q{i}" for i in range(70))
    got = suffix_dedup.repeated_passages(table(spark, [(1, long), (1, long), (None, long), (2, None)])).collect()
    assert got == []


def covered(rows):
    got = defaultdict(set)
    for r in rows:
        got[r["doc_id"]].update(range(r["start_word"], r["start_word"] + r["n_words"]))
    return got


def test_repeated_passages_of_edited_copies_equal_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for share in (0.01, 0.02, 0.03):
        for _ in range(3):
            base = [f"v{rng.randint(0, 5000)}" for _ in range(300)]
            rows += [" ".join(f"e{rng.randint(0, 10**6)}" if rng.random() < share else w for w in base) for _ in range(14)]
    for _ in range(60):  # a third text with a longer right and a shorter left match than the true partner
        p, x, y = ([f"{c}{rng.randint(0, 10**6)}" for _ in range(n)] for c, n in (("p", 60), ("x", 20), ("y", 20)))
        rows += [" ".join(t) for t in (x + p + y, [w + "u" for w in x] + p + [w + "v" for w in y], [w + "w" for w in x] + p[20:] + y[:5])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert covered(suffix_dedup.repeated_passages(table(spark, rows)).collect()) == {i: s for i, s in repeated(rows, 50).items() if s}


def test_repeated_passages_wherever_batches_and_partitions_end(spark):
    line = [f"l{i}" for i in range(40)]
    rows = [(1, " ".join(line * 60)), (2, " ".join(line * 60)), (3, " ".join(["same"] * 900)), (4, " ".join(["same"] * 700)), (5, " ".join(line * 2 + ["end"] * 60))]
    want = {i: s for i, s in repeated(rows, 50).items() if s}
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": "50", "spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {c: spark.conf.get(c, None) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        assert covered(suffix_dedup.repeated_passages(table(spark, rows)).collect()) == want
    finally:
        for c, v in was.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
