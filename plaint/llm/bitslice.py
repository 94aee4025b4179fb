"""Exact top-k inner-product search over a bit-sliced index.

A block of rows keeps, for each dimension, bitmaps of the upper bits of its components
(quantised attribute slices).  A query adds the slices of all dimensions with bitmap
arithmetic: each set bit of a weight shifts its dimension's slices, a negative weight takes
their complement, and bitmaps of equal weight are reduced three to two, as in carry-save
adders.  The sum's slices give the k-th largest coarse score from the most significant slice
downward.  Rows that the dropped low bits could still lift to it, or to the k-th best score
of the blocks before, form the boundary; their exact scores are computed from the integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaint.llm.vectors import Block, Queries, blocks, chunks, dots, first, rows
from plaint.session import materialize

U64 = np.uint64
#: Upper bits of a component that the index keeps as slices.
SLICES = 7
FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Index:
    """The slices of a block: ``slices[dim, bit]`` is a bitmap over its rows."""

    def __init__(self, block: Block):
        self.block, n = block, block.n
        values = block.vectors.astype(np.int64)
        self.low = values.min(axis=0)
        above = values - self.low
        self.bits = int(above.max(initial=0)).bit_length()
        self.drop = max(0, self.bits - SLICES)
        words = -(-n // 64)
        planes = np.zeros((block.dim, self.bits - self.drop, words * 64), bool)
        for s in range(self.bits - self.drop):
            planes[:, s, :n] = ((above >> (self.drop + s)) & 1).T
        self.slices = np.packbits(planes, axis=-1, bitorder="little").view(U64)
        valid = np.zeros(words * 64, bool)
        valid[:n] = True
        self.valid = np.packbits(valid, bitorder="little").view(U64)

    def total(self, q: np.ndarray) -> tuple[list[np.ndarray], int, int]:
        """(slices of A, base, slack): a row's score lies in base + 2**drop * A + [0, slack]."""
        weights = [abs(int(x)) for x in q]
        full = (1 << self.bits) - 1
        base = sum(int(x) * (int(b) + (full if x < 0 else 0)) for x, b in zip(q, self.low))
        signed = np.where((q < 0)[:, None, None], ~self.slices, self.slices)
        return add(signed, weights), base, sum(weights) * ((1 << self.drop) - 1)

    def at_least(self, total: list[np.ndarray], limit: int) -> np.ndarray:
        """Positions of the rows whose A is ``limit`` or more, from the most significant slice downward."""
        if limit > 0:
            if limit.bit_length() > len(total):
                return np.zeros(0, np.int64)
            above, equal = np.zeros_like(self.valid), self.valid
            for i in reversed(range(len(total))):
                if limit >> i & 1:
                    equal = equal & total[i]
                else:
                    above, equal = above | (equal & total[i]), equal & ~total[i]
            chosen = above | equal
        else:
            chosen = self.valid
        return np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))

    def nth(self, total: list[np.ndarray], k: int) -> int:
        """The ``k``-th largest A (k at most the rows), from the most significant slice downward."""
        value, equal, before = 0, self.valid, 0
        for i in reversed(range(len(total))):
            ones = equal & total[i]
            n = int(np.bitwise_count(ones).sum())
            if before + n >= k:
                value, equal = value | 1 << i, ones
            else:
                before, equal = before + n, equal & ~total[i]
        return value


def add(slices: np.ndarray, weights: list[int]) -> list[np.ndarray]:
    """Slices of the sum over dimensions of weight * value, least significant first."""
    bits = max((w.bit_length() for w in weights), default=0)
    planes = slices.shape[1]
    set_bits = [np.array([j for j, w in enumerate(weights) if w >> b & 1], np.int64) for b in range(bits)]
    out: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    while len(out) < bits + planes - 1 or carried:
        w = len(out)
        column = [slices[set_bits[b], w - b] for b in range(max(0, w - planes + 1), min(bits, w + 1)) if len(set_bits[b])]
        column, carried = np.concatenate([*column, *carried, np.zeros((1, slices.shape[2]), U64)]), []
        while len(column) > 1:
            third = max(1, len(column) // 3)
            a, b = column[:third], column[third : 2 * third]
            if len(column) == 2:
                carried.append(a & b)
                column = a ^ b
            else:
                c, x = column[2 * third : 3 * third], a ^ b
                carried.append((a & b) | (x & c))
                column = np.concatenate([x ^ c, column[3 * third :]])
        out.append(column[0])
        carried = [c for c in carried if c.any()]
    return out


def search(index: Index, q: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(positions, exact scores) of rows that hold the block's ``k`` best and every score of ``least`` or more that may beat them.

    Rows with the id ``own`` are left out.
    """
    block = index.block
    need = k + int((block.ids == own).sum())
    if need < block.n:
        total, base, slack = index.total(q)
        limit = index.nth(total, need) - (slack >> index.drop)
        if least is not None:
            limit = max(limit, -(-(least - base - slack) >> index.drop))
        chosen = index.at_least(total, limit)
    else:
        chosen = np.arange(block.n)
    chosen = chosen[block.ids[chosen] != own]
    return chosen, dots(block.vectors[chosen], q)


def _search(batches: Iterator[pa.RecordBatch], sent, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best rows of all blocks of a task for each query of a chunk."""
    best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    asked: Queries = sent.value
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block({c: batch.column(c)[i].as_py() for c in batch.schema.names})
            if block.dim not in asked.by_dim:
                continue
            index = Index(block)
            numbers, ids, _, vectors = asked.by_dim[block.dim]
            for number, own, q in zip(numbers, ids, vectors):
                scores, found = best.get((number, own), (np.zeros(0, np.int64),) * 2)
                at, got = search(index, q, own, k, int(scores[-1]) if len(scores) == k else None)
                if len(at):
                    scores, found = np.concatenate([scores, got]), np.concatenate([found, block.ids[at]])
                    keep = first(scores, found, k)
                    best[number, own] = scores[keep], found[keep]
    for (number, own), (scores, found) in best.items():
        n = len(scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number, np.int64)), pa.array(np.full(n, own, np.int64)), pa.array(found), pa.array(scores)], schema=FOUND)


def top_k(df: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but
    those of the query's own id, ties going to the smaller id; fewer candidates give fewer
    rows.  Components become floor(scale * x), held to +-2**53; scores are exact and held to
    the range of a long.  Vectors meet those of their own length only (empty ones score 0).
    Rows with a null id or vector, or a null or non-finite component, take no part.  A
    repeated row is a candidate, and if divisible a query, as often as it occurs.  An empty
    table gives no rows; other columns are ignored.

    Each chunk of queries is one scan of the index; a task keeps ``k`` rows a query.
    """
    spark = df.sparkSession
    members = rows(df, id_col, vector_col)
    index, found = None, []
    for chunk in chunks(members, every, scale):
        index = index or materialize(blocks(members, scale))
        sent = spark.sparkContext.broadcast(chunk)
        hits = index.mapInArrow(lambda b, sent=sent: _search(b, sent, k), "q long, query_id long, vec_id long, score long")
        by_score = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
        ranked = hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
        found.append(materialize(ranked.select("query_id", "rank", "vec_id", "score")))
        sent.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
