"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles.  Its signature holds ``SYMBOLS`` MinHash
winners of 16 bits.  Symbols are split into chunks of ``SIZE``, and so many chunks are indexed
that by the pigeonhole principle two signatures within the distance threshold have a chunk
with at most one error: enumerating that error (leave one symbol of the chunk out) gives every
such pair a common key.  Keys that gather the same documents are looked at once.  Documents that share a key and are within the
signature-distance threshold form candidate clusters; links are then confirmed on the
full shingle sets, and components of confirmed links are the result.

Nothing grows with the square of a group: equal sets are one node from the start, large
key groups and clusters are cut into blocks, each pair of blocks is compared inside one
task with bounded memory, and a task returns a spanning forest of the links it found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import U64, bounded, chunks, constants, group_bounds, linked, release, runs, small_batches, spaced, splitmix, spread_join, utf8
from plaint.llm.components import components
from plaint.session import materialize

SYMBOLS, SIZE = 64, 4
#: Signatures, and documents with their full sets, that one block holds.
SIGNATURE_BLOCK, SET_BLOCK = 1024, 128


def chunk_count(percent: int, miss: float = 5e-6) -> int:
    """Chunks with which every pair within the signature distance has one of at most one error.

    Where all chunks of a signature cannot promise that, a pair at the threshold shares no key
    with probability below ``miss``; a similarity too low for that as well is refused.
    """
    needed, most = max_distance(percent) // 2 + 1, SYMBOLS // SIZE
    p = 1 - percent / 100
    lost = 1 - (1 - p) ** SIZE - SIZE * p * (1 - p) ** (SIZE - 1)
    if needed > most and lost**most > miss:
        raise ValueError(f"{percent} %: signatures have {most} chunks, {needed} are needed")
    return min(needed, most)


def max_distance(percent: int, miss: float = 1e-5) -> int:
    """Odd signature distance (as chunks reach) that a pair at the threshold exceeds with probability below ``miss``."""
    p, tail = 1 - percent / 100, 0.0
    for d in range(SYMBOLS, -1, -1):
        tail += math.comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
        if tail > miss:
            return d | 1
    return SYMBOLS


def _seeds(n: int, seed: int) -> np.ndarray:
    return (constants(n, seed) >> U64(32)).astype(np.uint32)


def _shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Distinct shingle hashes of one document's word hashes, sorted."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(k, n)
    total = np.full(n - k + 1, U64(k))
    for j in range(k):
        total = splitmix(total * U64(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j])
    return np.unique(total)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The shingle set of each row; null and wordless texts have an empty one."""
    words = _words()
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        _, _, h, row = words.split(data, offsets[i : j + 1])
        at = np.searchsorted(row, np.arange(j - i + 1))
        for a, b in zip(at[:-1], at[1:]):
            yield _shingles(h[a:b], k)


@lru_cache(None)
def _words():
    return spaced()


def _signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The low bits of the smallest permuted shingle under each of the permutations."""
    x = (shingles >> U64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    best = np.full(SYMBOLS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(best, (a[:, None] * x[None, i : i + 2048] + b[:, None]).min(axis=1), out=best)
    return ((best * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    release()
    a, b = _seeds(SYMBOLS, 101) | np.uint32(1), _seeds(SYMBOLS, 202)
    for batch in batches:
        sizes, keys, signs = [], [], []
        for s in _sets(batch.column(1), k):
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            signs.append(_signature(s, a, b) if len(s) else None)
        yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                               pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of each row."""
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        partial(_sign, k=words), "doc_id long, n_shingles long, set_key binary, signature binary")


def _keys(batches: Iterator[pa.RecordBatch], chunk_total: int) -> Iterator[pa.RecordBatch]:
    """One key for each chunk and each position of the one allowed error."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        node = batch.column(0).to_numpy()
        sign = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, SYMBOLS).astype(np.int64)
        keys = []
        for c in range(chunk_total):
            for gone in range(SIZE):
                a, b, d = (sign[:, c * SIZE + j] for j in range(SIZE) if j != gone)
                keys.append((np.int64(c * SIZE + gone) << 48) | (a << 32) | (b << 16) | d)
        yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.tile(node, len(keys)))], names=["key", "node"])


def _edges(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u = np.concatenate([p[0] for p in pairs]) if pairs else np.zeros(0, np.int64)
    v = np.concatenate([p[1] for p in pairs]) if pairs else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _forest(node: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    label = linked(near)
    moved = label != np.arange(len(label))  # nodes ascend, so all point to the smallest
    return node[moved], node[label[moved]]


def _crossing(block: np.ndarray, lo: int, hi: int) -> np.ndarray | bool:
    """In a pair of two blocks only pairs across them count; each block has a group of its own."""
    return True if lo == hi else block[:, None] != block[None, :]


def _near_signatures(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the signature pairs within ``most`` in each (key, lo, hi) group."""
    for batch in runs(batches, ["key", "lo", "hi"]):
        key, lo, hi, block, node = (batch.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "node"))
        sign = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(len(key), SYMBOLS)
        bounds = group_bounds([key, lo, hi])
        size = np.diff(bounds)
        out = []
        two = bounds[:-1][size == 2]
        two = two[((sign[two] != sign[two + 1]).sum(axis=1) <= most) & ((lo[two] == hi[two]) | (block[two] != block[two + 1]))]
        out.append((node[two], node[two + 1]))
        for g in np.flatnonzero(size > 2):
            a, b = bounds[g], bounds[g + 1]
            s = sign[a:b]
            near = np.empty((b - a, b - a), bool)
            step = max(1, (1 << 18) // (b - a))
            for i in range(0, b - a, step):
                part = np.zeros((min(step, b - a - i), b - a), np.uint8)
                for c in range(SYMBOLS):
                    part += s[i : i + step, c][:, None] != s[None, :, c]
                near[i : i + step] = part <= most
            out.append(_forest(node[a:b], near & _crossing(block[a:b], lo[a], hi[a])))
        yield _edges(out)


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Deals each group (column n: its rows) into blocks of about ``size`` and to all pairs of them."""
    df = df.withColumn("blocks", F.ceil(F.col("n") / F.lit(size)))
    df = df.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return df.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))


def candidates(nodes: DataFrame, percent: int, rows: int | None = None) -> DataFrame:
    """Links (u, v) whose components are the clusters of near signatures of ``nodes`` (node, signature; ``rows`` if counted)."""
    keys = nodes.mapInArrow(partial(_keys, chunk_total=chunk_count(percent)), "key long, node long")
    # Near documents share many keys: of the keys with the same members (96 bits of sums) one is kept.
    one, two = F.xxhash64("node"), F.xxhash64("node", F.lit(1))
    members = [F.sum(h.bitwiseAND(0xFFFFFFFF)) for h in (one, F.shiftright(one, 32), two)]
    common = keys.groupBy("key").agg(F.count("*").alias("n"), *[m.alias(f"_{i}") for i, m in enumerate(members)]).where("n > 1")
    common = common.groupBy("n", "_0", "_1", "_2").agg(F.min("key").alias("key")).select("key", "n")
    total = (nodes.count() if rows is None else rows) * chunk_count(percent) * SIZE
    members = spread_join(keys, common, "key", "node", total).join(nodes, "node")
    dealt = _blocks(members, SIGNATURE_BLOCK).select("key", "lo", "hi", "block", "node", "signature")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").mapInArrow(
        partial(_near_signatures, most=max_distance(percent)), "u long, v long")


def _write_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in _sets(batch.column("text"), k)], pa.binary())
        yield pa.record_batch([batch.column("cluster"), batch.column("n"), batch.column("node"), sets],
                              names=["cluster", "n", "node", "shingles"])


def _similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs reach the similarity, from exact intersection sizes."""
    size = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    shared = np.zeros((n, n), np.int64)
    if n <= 6:
        for i in range(n):
            for j in range(i):
                shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(n), size)
        term = np.unique(every, return_inverse=True)[1]
        often = np.bincount(term)
        keep = often[term] > 1
        term = (np.cumsum(often > 1) - 1)[term[keep]]
        owner = owner[keep]
        order = np.argsort(term, kind="stable")
        term, owner = term[order], owner[order]
        width = 4096
        for t in range(0, int(term[-1]) + 1 if len(term) else 0, width):
            a, b = np.searchsorted(term, (t, t + width))
            x = np.zeros((n, width), np.float32)
            x[owner[a:b], term[a:b] - t] = 1
            shared += (x @ x.T).astype(np.int64)
    near = 100 * shared >= percent * (size[:, None] + size[None, :] - shared)
    np.fill_diagonal(near, False)
    return near


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the confirmed links in each (cluster, lo, hi) group."""
    for batch in runs(batches, ["cluster", "lo", "hi"]):
        cluster, lo, hi, block, node = (batch.column(c).to_numpy() for c in ("cluster", "lo", "hi", "block", "node"))
        held = batch.column("shingles")
        bounds, out = group_bounds([cluster, lo, hi]), []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                sets = [np.frombuffer(held[i].as_py(), U64) for i in range(a, b)]
                out.append(_forest(node[a:b], _similar(sets, percent) & _crossing(block[a:b], lo[a], hi[a])))
        yield _edges(out)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``; ids are integers.

    A-Z are lower-cased; words lie between white space; a text of fewer than ``words``
    words is one shingle.  Rows whose sets have 100 * intersection >= percent * union
    are linked; component_id is the smallest doc_id reachable, kept marks its own row.
    Null and wordless texts have an empty set and are linked with nothing.  Rows of one
    doc_id are one node, each with its own n_shingles.  A null doc_id is linked with
    nothing, has a null component_id and is kept.  Other columns are ignored.
    """
    signed = materialize(signatures(docs, id_col, text_col, words))
    able = signed.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(able.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
    rows = classes.count()
    clusters = components(candidates(classes.select("node", "signature"), percent, rows)).withColumnRenamed("component", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    clusters = materialize(spread_join(clusters, sizes, "cluster", "node", rows).select("cluster", "node", "n"))
    chosen = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")).join(bounded(clusters), "node")
    sets = chosen.select("cluster", "n", "node", "text").mapInArrow(
        partial(_write_sets, k=words), "cluster long, n long, node long, shingles binary")
    dealt = _blocks(sets, SET_BLOCK).select("cluster", "lo", "hi", "block", "node", "shingles")
    confirmed = dealt.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "node").mapInArrow(
        partial(_confirm, percent=percent), "u long, v long")
    found = components(confirmed)
    labels = classes.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(labels, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
