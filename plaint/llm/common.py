"""Shared helpers: table access, Arrow string buffers, vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Rows up to which a key set may be broadcast (longs: a few tens of MB); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000
CHUNK_BYTES = 1 << 20
#: Rows and bytes of text that a worker is given at a time (a longer row comes alone).
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

SPACES = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of its session bounded: whole texts of a batch lie in a worker's memory."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", conf.get(name)).group())
        if not 0 < now <= most:
            conf.set(name, str(most))
    return df


def release() -> None:
    """Hands memory that earlier work of this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL(None).malloc_trim(0)


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def bounded(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` with a broadcast hint if it is counted to hold at most ``rows`` rows."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


#: Parts that a join deals its rows into; also the most frequent keys that it may broadcast.
SPREAD_PARTS = 10_000


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """Joins ``rows`` with ``per_key`` (one row a key, n: its rows) on ``key``; no task gets one key's rows.

    ``total`` is at least the sum of n.  A key of more than total / SPREAD_PARTS rows is dealt
    by ``by`` into parts of about that size and its ``per_key`` row is repeated once a part.
    There are fewer than SPREAD_PARTS such keys, whatever the input: they are broadcast.
    """
    share = max(1, -(-total // SPREAD_PARTS))
    parts = per_key.withColumn("parts", F.ceil(F.col("n") / F.lit(share)))
    often = F.broadcast(parts.where("parts > 1").select(key, "parts"))
    dealt = rows.join(often, key, "left").withColumn(
        "part", F.pmod(F.xxhash64(by), F.coalesce("parts", F.lit(1)))).drop("parts")
    copies = parts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return dealt.join(copies, [key, "part"]).drop("part")


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return splitmix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Splits byte buffers into words and hashes each one without a loop over words.

    ``word``: 256 booleans, the bytes that belong to words (separators are ASCII, so
    UTF-8 sequences stay whole).  A-Z fold to a-z.  A word's hash is a polynomial over
    its bytes, from a prefix sum modulo 2**64, then finalised; equal words have equal hashes.
    """

    _BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, word: np.ndarray):
        self.word = word
        self.values = constants(256, 17)
        self.values[65:91] = self.values[97:123]
        self.power = self.inverse = np.zeros(0, U64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            base, back = U64(self._BASE), U64(pow(self._BASE, -1, 1 << 64))
            for name, x in (("power", base), ("inverse", back)):
                steps = np.full(n, x, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def split(self, data: np.ndarray, offsets: np.ndarray, stems: tuple[int, ...] = ()):
        """(first byte, end byte, hash, row) of each word; ``offsets`` are absolute in ``data``.

        ``stems`` adds a list: for each length the hashes of the words' first bytes.
        """
        low = int(offsets[0])
        buf, rows = data[low : int(offsets[-1])], offsets - low
        n = len(buf)
        if not n:
            nothing = (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64), np.zeros(0, np.int64))
            return (*nothing, [np.zeros(0, U64)] * len(stems)) if stems else nothing
        inside = self.word[buf]
        before, after = np.empty_like(inside), np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        full = rows[:-1] < rows[1:]
        before[rows[:-1][full]] = False
        after[rows[1:][full] - 1] = False
        first, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self._grow(n)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(self.values[buf] * self.power[:n], out=prefix[1:])

        def hashed(stop: np.ndarray, salt: int) -> np.ndarray:
            return splitmix((prefix[stop] - prefix[first]) * self.inverse[first] + (stop - first + salt).astype(U64))

        out = first + low, end + low, hashed(end, 0), np.searchsorted(rows, first, "right") - 1
        return (*out, [hashed(np.minimum(first + n, end), n << 32) for n in stems]) if stems else out


def spaced() -> Words:
    """Words between white space: ``[^\\x20\\x09-\\x0D]+``."""
    word = np.ones(256, bool)
    word[list(SPACES)] = False
    return Words(word)


def alphanumeric() -> Words:
    """Words of letters and digits: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing."""
    word = np.zeros(256, bool)
    word[128:] = True
    for a, b in ((48, 58), (65, 91), (97, 123)):
        word[a:b] = True
    return Words(word)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rebatches rows sorted by ``keys`` so that no group is cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        changed = np.zeros(batch.num_rows, bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            changed[0] = any(last.column(k)[-1].as_py() != c[0] for k, c in zip(keys, columns))
        cut = np.flatnonzero(changed)
        if held and len(cut):
            held.append(batch.slice(0, int(cut[0])))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, batch, cut = [], batch.slice(int(cut[0])), cut - cut[0]
        if len(cut) and cut[-1] > 0:
            yield batch.slice(0, int(cut[-1]))
            batch = batch.slice(int(cut[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def group_bounds(columns: list[np.ndarray]) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    n = len(columns[0])
    changed = np.zeros(n, bool)
    changed[0] = True
    for c in columns:
        changed[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(changed), n)


def linked(near: np.ndarray) -> np.ndarray:
    """Component (smallest member index) of each node of a symmetric boolean matrix."""
    n = len(near)
    label = np.arange(n)
    while True:
        best = np.minimum(label, np.where(near, label[None, :], n).min(axis=1, initial=n))
        best = np.minimum(best, best[best])
        if np.array_equal(best, label):
            return label
        label = best
