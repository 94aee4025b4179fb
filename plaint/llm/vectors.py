"""Integer vectors of an embedding table, held in blocks; a query set in bounded chunks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import small_batches
from plaint.session import materialize

#: Components in a block of rows, and in a chunk of queries: both bound a worker's memory at any dimension.
BLOCK_VALUES, CHUNK_VALUES = 1 << 20, 1 << 18
#: Components are held to this size; a double holds integers exactly up to it.
LARGEST = 1 << 53
BLOCK = "dim int, n int, kind string, ids binary, labels binary, vectors binary"
LOW_BITS = 33


def rows(df: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """(id, label, x) of the rows that can take part: those without an id, vector or (if named) label do not."""
    label = F.lit(0) if label_col is None else F.col(label_col)
    out = df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector_col).alias("x"))
    return small_batches(out.where("id is not null and label is not null and x is not null"))


def whole(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, integer vectors) of the batch's rows, by dimension: floor(scale * x), x as double.

    Rows with a null or non-finite component are left out.
    """
    x = batch.column("x")
    size = pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = x.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    for dim in np.unique(size):
        at = np.flatnonzero((size == dim) & ~np.asarray(x.is_null()))
        values = flat[start[at][:, None] + np.arange(dim)]
        fine = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            values = np.clip(np.floor(values[fine] * float(scale)), -LARGEST, LARGEST)
        if fine.any():
            yield at[fine], values.astype(np.int64)


def _block(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict:
    order = np.argsort(labels, kind="stable")
    high = int(np.abs(vectors).max(initial=0))
    kind = next(k for k in (np.int16, np.int32, np.int64) if high <= np.iinfo(k).max)
    return {"dim": vectors.shape[1], "n": len(ids), "kind": np.dtype(kind).name, "ids": ids[order].tobytes(),
            "labels": labels[order].tobytes(), "vectors": vectors[order].astype(kind).tobytes()}


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    count: dict[int, int] = {}

    def flush(dim: int) -> pa.RecordBatch:
        parts = held.pop(dim)
        count.pop(dim)
        return pa.RecordBatch.from_pylist([_block(*(np.concatenate(p) for p in zip(*parts)))], schema)

    for batch in batches:
        ids, labels = (batch.column(c).to_numpy() for c in ("id", "label"))
        for at, vectors in whole(batch, scale):
            dim = vectors.shape[1]
            held.setdefault(dim, []).append((ids[at], labels[at], vectors))
            count[dim] = count.get(dim, 0) + len(at)
            if count[dim] * max(dim, 1) >= BLOCK_VALUES:
                yield flush(dim)
    for dim in list(held):
        yield flush(dim)


def blocks(members: DataFrame, scale: int) -> DataFrame:
    """Every row of ``members`` in blocks of about BLOCK_VALUES components, rows of a block by label.

    A block holds vectors of one dimension; the last ones of a partition are smaller.
    """
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()),
                        ("labels", pa.binary()), ("vectors", pa.binary())])
    return members.mapInArrow(partial(_blocks, scale=scale, schema=schema), BLOCK)


class Block:
    """A block as numpy arrays."""

    def __init__(self, row: dict):
        self.n, self.dim = row["n"], row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(self.n, self.dim)


def dots(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows with ``q``; held to the range of a long."""
    most = reach(vectors, q)
    if most < LARGEST:  # every partial sum is an integer that a double holds
        return (vectors.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return vectors.astype(np.int64) @ q
    exact = vectors.astype(object) @ q.astype(object) if len(vectors) else np.zeros(0, object)
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def reach(vectors: np.ndarray, q: np.ndarray) -> int:
    """A bound of the size of all partial sums of inner products with ``q``."""
    high = np.abs(vectors.astype(np.int64)).max(axis=0, initial=0)
    return sum(int(a) * abs(int(b)) for a, b in zip(high, q))


class Queries:
    """A chunk of queries: number, id, label and vectors, by dimension."""

    def __init__(self, table: pa.Table, scale: int):
        self.by_dim: dict[int, tuple[np.ndarray, ...]] = {}
        for batch in table.combine_chunks().to_batches():
            columns = [batch.column(c).to_numpy() for c in ("q", "id", "label")]
            for at, vectors in whole(batch, scale):
                self.by_dim[vectors.shape[1]] = (*(c[at] for c in columns), vectors)


def chunks(members: DataFrame, every: int, scale: int) -> Iterator[Queries]:
    """The rows whose id is divisible by ``every``, numbered, as chunks of about CHUNK_VALUES components.

    Numbers are fixed by a checkpoint; the driver holds one chunk and a count of each partition.
    """
    asked = materialize(members.where(F.col("id") % every == 0).withColumn("q", F.monotonically_increasing_id()))
    sizes = asked.groupBy(F.shiftrightunsigned("q", LOW_BITS).alias("part")).agg(
        F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).orderBy("part").collect()
    if not sizes:
        return
    per = max(1, CHUNK_VALUES // max(1, max(r.dim for r in sizes)))
    edges, room = [0], per
    for r in sizes:
        at = 0
        while r.n - at > room:
            at += room
            edges.append((r.part << LOW_BITS) + at)
            room = per
        room -= r.n - at
    for low, high in zip(edges, [*edges[1:], None]):
        chunk = asked.where(F.col("q") >= low)
        yield Queries((chunk if high is None else chunk.where(F.col("q") < high)).toArrow(), scale)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], ~scores[some]))[:k]]
    return np.lexsort((ids, ~scores))[:k]
