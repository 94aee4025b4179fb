"""Bit-sliced search, hard negatives and the prefix trie against brute force on awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plaint.llm import bitslice, negatives, trie, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string, x string"
TURNS = "conv_id long, turn long, role string, text string, depth string, n_convs string"


def some_vectors(seed=3):
    """Clusters with ties and copies, other lengths, nulls, nans, infinities and repeated ids."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 8))
    rows = []
    for i in range(360):
        x = (centres[i % 6] + 0.4 * rng.standard_normal(8)) / 6
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(0, 4))))
    hot = rows[100][1]
    rows += [(1000 + i, hot, i % 3) for i in range(150)]
    rows += [(500, [0.0] * 8, 1), (600, [1.0, 2.0], 1), (601, [1.0, -2.0], 2), (700, [], 1), (701, [], 2), (702, [], 1),
             (800, None, 1), (802, [None] + [0.1] * 7, 1), (803, [math.nan] + [0.1] * 7, 1), (900, [math.inf] + [0.1] * 7, 1),
             (None, hot, 1), (30, hot, 3), (100, rows[7][1], 2), (200, rows[200][1], None), (1100, [-0.0] * 8, 0)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, x, y, "s", "d", "e") for i, x, y in rows], SCHEMA).repartition(5)


def taking_part(rows, scale, labels):
    return [(i, [math.floor(scale * float(np.float32(v))) for v in x], y) for i, x, y in rows
            if i is not None and x is not None and (not labels or y is not None) and all(v is not None and math.isfinite(v) for v in x)]


def inner(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("slices", [1, 4, 12])
def test_top_k_equals_brute_force(spark, monkeypatch, slices):
    """With blocks of a few rows and few slices, so that the boundary does most of the work, and with all bits."""
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 400)
    monkeypatch.setattr(bitslice, "SLICES", slices)
    rows = some_vectors()
    part = taking_part(rows, 1024, labels=False)
    want = []
    for i, q, _ in part:
        if i % 100 == 0:
            ranked = sorted((-inner(q, x), j) for j, x, _ in part if j != i and len(x) == len(q))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    got = bitslice.top_k(frame(spark, rows))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_top_k_in_chunks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_VALUES", 24)
    rows = some_vectors()
    whole = sorted(map(tuple, bitslice.top_k(frame(spark, rows), k=3, every=20).collect()))
    monkeypatch.setattr(vectors, "CHUNK_VALUES", 1 << 18)
    assert whole == sorted(map(tuple, bitslice.top_k(frame(spark, rows), k=3, every=20).collect()))
    assert len({q for q, *_ in whole}) > 10


def test_top_k_of_nothing_few_and_huge(spark):
    assert bitslice.top_k(frame(spark, [])).count() == 0
    assert bitslice.top_k(frame(spark, [(1, [1.0], 0), (2, [1.0], 0)])).count() == 0
    assert bitslice.top_k(frame(spark, [(0, [1.0], 0)])).count() == 0
    huge = [(0, [1e30, 1.0], 0), (1, [1e30, -1.0], 0), (2, [-1e30, 0.5], 0), (3, [1e-3, 2.0], 0), (4, [3e9, 0.0], 0)]
    got = [tuple(r) for r in bitslice.top_k(frame(spark, huge)).orderBy("rank").collect()]
    most, top = 1 << 53, (1 << 63) - 1
    assert got == [(0, 1, 1, top), (0, 2, 4, top), (0, 3, 3, most + 1024 * 2048), (0, 4, 2, -1 << 63)]


def test_bitmap_sums_equal_integers():
    rng = np.random.default_rng(1)
    for n, dim, size in ((1, 1, 1), (70, 5, 900), (200, 40, 30), (64, 3, 1 << 20)):
        x = rng.integers(-size, size + 1, (n, dim))
        block = vectors.Block(vectors._block(np.arange(n), np.zeros(n, np.int64), x))
        index = bitslice.Index(block)
        q = rng.integers(-size, size + 1, dim)
        total, base, slack = index.total(q)
        planes = [np.unpackbits(t.view(np.uint8), bitorder="little")[:n] for t in total]
        a = sum((p.astype(object) << i for i, p in enumerate(planes)), np.zeros(n, object))
        exact = x.astype(object) @ q.astype(object)
        low = base + a * (1 << index.drop)
        assert ((low <= exact) & (exact <= low + slack)).all()
        for k in {1, n // 2 or 1, n}:
            limit = index.nth(total, k)
            assert limit == sorted(a)[-k]
            assert sorted(index.at_least(total, limit)) == sorted(np.flatnonzero(a >= limit))


def mined(rows, positives=5, negatives_=10):
    part = taking_part(rows, 256, labels=True)
    want = []
    for i, q, y in part:
        if i % 100:
            continue
        best = sorted((-inner(q, x), j) for j, x, z in part if z == y and j != i and len(x) == len(q))[:positives]
        for p, positive in best:
            p = -p
            inside = sorted((-inner(q, x), j) for j, x, z in part
                            if z != y and len(x) == len(q) and 30 * p <= 100 * inner(q, x) <= 90 * p)[:negatives_]
            want += [(i, positive, r + 1, j, p, -s) for r, (s, j) in enumerate(inside)]
    return sorted(want)


@pytest.mark.parametrize("block,chunk", [(400, 1 << 18), (1 << 20, 1 << 18), (4000, 24)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, chunk):
    """Small and large blocks, and anchors in chunks of three."""
    monkeypatch.setattr(vectors, "BLOCK_VALUES", block)
    monkeypatch.setattr(vectors, "CHUNK_VALUES", chunk)
    rows = some_vectors()
    got = negatives.mine(frame(spark, rows))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = mined(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 100 and max(r[2] for r in want) == 10


def test_hard_negatives_of_nothing(spark):
    assert negatives.mine(frame(spark, [])).count() == 0
    assert negatives.mine(frame(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)])).count() == 0
    lone = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 9.0], 2), (3, [0.5, 1e38], 2)]
    assert [tuple(r) for r in negatives.mine(frame(spark, lone)).orderBy("rank").collect()] == [
        (0, 1, 1, 2, 256 * 256, 256 * 128), (0, 1, 2, 3, 256 * 256, 256 * 128)]


def test_tree_bounds_hold_and_spare_work():
    """Intervals hold the true scores at every anchor, and near anchors need few rows scored again."""
    rng = np.random.default_rng(5)
    centres = 40 * rng.standard_normal((4, 16))
    anchors = np.round(np.repeat(centres, 25, axis=0) + rng.standard_normal((100, 16))).astype(np.int64)
    rows = np.round(np.repeat(centres, 500, axis=0) + 10 * rng.standard_normal((2000, 16))).astype(np.int64)
    tree = negatives.Tree(anchors, np.arange(100))
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1)) * (1 + 1e-12)
    seen, again = [], []

    def wanted(i, low, high):
        exact = rows @ anchors[i]
        assert ((low <= exact) & (exact <= high)).all()
        mark = high >= np.sort(exact)[-5]
        again.append(int((mark & (low < high)).sum()))
        return mark

    def take(i, at, scores):
        assert (scores == rows[at] @ anchors[i]).all()
        assert set(np.flatnonzero(rows @ anchors[i] >= np.sort(rows @ anchors[i])[-5])) <= set(at)
        seen.append(i)

    negatives.walk(tree, anchors, rows, norms, wanted, take)
    assert sorted(seen) == list(range(100)) and sum(again) < 100 * 2000 / 2


# --------------------------------------------------------------------------------- trie
def brute_trie(convs):
    """{(path): node} of {conv_id: [(role, text)]}."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p, members in nodes.items():
        cost = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += cost
    return sorted(
        (min(m), len(p), -1 if not p else min(nodes[p[:-1]]), len(m), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, m in nodes.items())


def turn_rows(rng):
    """Hot first turns, copies, prefixes of each other, one long conversation, gaps, ties and nulls."""
    rows = []
    for c in [*range(0, 160), 1005, 1007, -3]:
        for t in range(rng.randrange(0, 7)):
            word = rng.choice(["a", "a", "a", "bé", ""])
            rows.append((c, t * 2, rng.choice(["user", "user", None]), word if t else "hot"))
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 360) for t in range(4)]
    rows += [(400, t, "user", "long" if t < 30 else f"w{t}") for t in range(120)]
    rows += [(c, t, "user", "long") for c in (405, 410, 415) for t in range(60)]
    rows += [(500, None, "user", "x"), (500, 1, None, None), (500, 1, "user", "y"), (500, 1, "user", "y"), (500, None, None, "z"), (None, 1, "user", "q")]
    return rows


def ordered_turns(rows):
    """Turns of each conversation, as the operator orders them."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    return {c: [turn for *_, turn in sorted(t)] for c, t in convs.items()}


def rebuild(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def spark_trie(spark, rows):
    turns = spark.createDataFrame([(*r, "d", "n") for r in rows], TURNS).repartition(4)
    convs = trie.conversations(turns)
    base = F.col("conv_id") - F.col("conv_id") % 5
    return trie.trie(convs), trie.trie(trie.rebuilt(convs, base, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9))


def collected(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.collect())


@pytest.mark.parametrize("parts", [1, 5, 60])
def test_trie_equals_brute_force(spark, parts):
    """In one block, and in so many that most prefixes cross several."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = turn_rows(random.Random(7))
        own, again = spark_trie(spark, rows)
        assert own.columns == [c.split()[0] for c in trie.NODES.split(", ")]
        convs = ordered_turns(rows)
        assert collected(own) == brute_trie(convs)
        assert collected(again) == brute_trie(rebuild(convs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)


def test_trie_of_nothing_and_of_turnless(spark):
    own, _ = spark_trie(spark, [])
    assert own.count() == 0
    turnless = spark.createDataFrame([(5, []), (3, []), (9, [])], "conv_id long, turns array<struct<digest: string, bytes: long>>")
    ends = hashlib.sha256(b"3,5,9").hexdigest()
    assert [tuple(r) for r in trie.trie(turnless).collect()] == [(3, 0, None, 3, 0, 1, 0, ends)]


def test_extents_by_range_minimum_equal_scans():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        lcp = rng.integers(0, 4, n)
        sparse = trie.Sparse(lcp)
        start, depth = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(5)))
        right, left = sparse.right(start, depth), sparse.left(start, depth)
        for s, d, r, l in zip(start, depth, right, left):
            assert (lcp[s + 1 : r + 1] >= d).all() and (r == n - 1 or lcp[r + 1] < d)
            assert (lcp[l + 1 : s + 1] >= d).all() and (l == 0 or lcp[l] < d)
        first, last = np.minimum(start, right), right
        assert (sparse.least(first, last) == [lcp[a : b + 1].min() for a, b in zip(first, last)]).all()
