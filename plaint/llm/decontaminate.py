"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items (10 consecutive words; a shorter item
is one window).  The alphabet is the word, so blocks are pairs of neighbouring words.  A
shift table over block hashes tells how far the search may jump; where it says zero, a
table of suffix and prefix block selects windows, and comparing the words confirms them.
The documents are scanned once in place; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import CHUNK_BYTES, U64, alphanumeric, chunks, release, small_batches, splitmix, utf8
from plaint.session import materialize

WINDOW = 10
#: Bytes of item text that one broadcast set of tables is built from; more items take more scans.
TABLE_BYTES = 8 << 20
#: Candidate windows that are compared at a time.
_PAIRS = 1 << 20


def _pairs(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block (``width`` words: 2, or 1 for one-word windows) that ends at each word."""
    if width == 1:
        return splitmix(h)
    out = np.zeros(len(h), U64)
    out[1:] = splitmix(h[:-1] * U64(0x9FB21C651E98DF25) + h[1:])
    return out


def _keys(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return splitmix(suffix * U64(0x9FB21C651E98DF25) + prefix)


def _gather(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words at these bytes, lower-cased, as one binary array."""
    length = end - first
    at = np.concatenate(([0], np.cumsum(length)))
    take = np.repeat(first - at[:-1], length)
    take += np.arange(len(take))
    return pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(_LOWER[data[take]])])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _ranks(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for the ``n`` words from each position on; equal words, and no others, have equal numbers."""
    def join(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        m = max(0, min(len(a), len(b) - shift))
        return np.unique(a[:m] * (int(b.max(initial=0)) + 1) + b[shift : shift + m], return_inverse=True)[1]

    doubled, size, out, done = ids.astype(np.int64), 1, None, 0
    while True:
        if n & size:
            out, done = (doubled if out is None else join(out, doubled, done)), done + size
        if done == n:
            return out
        doubled, size = join(doubled, doubled, size), 2 * size


class Table:
    """The shift table and the buckets of the windows of one length; ``at``: where each window starts."""

    def __init__(self, length: int, at: np.ndarray, h: np.ndarray):
        self.length, self.width = length, min(2, length)
        block = _pairs(h, self.width)
        longest = length - self.width + 1
        self.bits = min(max(18, (8 * len(at)).bit_length()), 24)
        self.shift = np.full(1 << self.bits, longest, np.uint8)
        for k in range(longest):  # later blocks allow smaller shifts and overwrite
            self.shift[(block[at + self.width - 1 + k] >> U64(64 - self.bits)).astype(np.int64)] = longest - 1 - k
        keys = _keys(block[at + length - 1], block[at + self.width - 1])
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(last word, window) where shift and bucket allow an occurrence, some at a time; bounds: first word of each text, and the end."""
        block = _pairs(h, self.width)
        jumps = self.shift[(block >> U64(64 - self.bits)).astype(np.int64)].tobytes()
        stops, length = array("q"), self.length
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            at = a + length - 1
            while at < b:
                jump = jumps[at]
                if not jump:
                    stops.append(at)
                at += jump or 1
        last = np.frombuffer(stops, np.int64)
        keys = _keys(block[last], block[last - length + self.width])
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        held = np.flatnonzero(high > low)
        last, low, size = last[held], low[held], (high - low)[held]
        total = np.concatenate(([0], np.cumsum(size)))
        for done in range(0, int(total[-1]), _PAIRS):
            pair = np.arange(done, min(done + _PAIRS, int(total[-1])))
            which = np.searchsorted(total, pair, "right") - 1
            yield last[which], self.order[low[which] + pair - total[which]]


class Windows:
    """Search tables over a set of (item_id, text) rows: flat arrays of a few tens of bytes a word."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW):
        rows = [(str(item), text.encode()) for item, text in rows if item is not None and text]
        self.items = sorted({item for item, _ in rows})
        number = {item: i for i, item in enumerate(self.items)}
        item_of = np.array([number[item] for item, _ in rows], np.int32)
        data = np.frombuffer(b"".join(text for _, text in rows), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(text) for _, text in rows]))).astype(np.int64)
        parts = [(*_words().split(data, offsets[i : j + 1])[:3], _words().split(data, offsets[i : j + 1])[3] + i) for i, j in chunks(offsets)]
        first, end, h, row = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, U64, np.int64))
        coded = _gather(data, first, end).dictionary_encode()
        #: Number of the word at each position; the words, and their hashes in order.
        self.ids, self.vocabulary = coded.indices.to_numpy(), coded.dictionary
        hashes = np.zeros(len(self.vocabulary), U64)
        hashes[self.ids] = h
        self.by_hash = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.by_hash]
        words_of = np.minimum(np.bincount(row, minlength=len(rows)), window)
        #: Of each length: the search table, the windows' first positions, and the items of each (from, to, items).
        self.tables: list[tuple[Table, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(words_of[words_of > 0]).tolist():
            at = np.arange(max(0, len(h) - n + 1))
            at = at[(row[at + n - 1] == row[at]) & (words_of[row[at]] == n)]
            rank, item = _ranks(self.ids, n)[at], item_of[row[at]]
            order = np.lexsort((item, rank))
            at, rank, item = at[order], rank[order], item[order]
            fresh = np.concatenate(([True], (rank[1:] != rank[:-1]) | (item[1:] != item[:-1])))
            at, rank, item = at[fresh], rank[fresh], item[fresh]
            starts = np.flatnonzero(np.concatenate(([True], rank[1:] != rank[:-1])))
            first_at = at[starts].astype(np.int32)
            self.tables.append((Table(n, first_at, h), first_at, np.append(starts, len(at)).astype(np.int32), item))
        self.longest = max((t.length for t, *_ in self.tables), default=1)

    def _known(self, word: bytes, h: np.uint64) -> int:
        """The number of an item's word, -1 for any other; found by its hash, confirmed by its bytes."""
        k = int(np.searchsorted(self.hashes, h))
        while k < len(self.hashes) and self.hashes[k] == h:
            if self.vocabulary[int(self.by_hash[k])].as_py() == word:
                return int(self.by_hash[k])
            k += 1
        return -1

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first byte of each word, first word of each text and the end, whether a word is inside an occurrence, and the texts and items of occurrences)."""
        first, end, h, row = _words().split(data, offsets)
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        inside, found = np.zeros(len(first) + 1, np.int32), [np.zeros((0, 2), np.int64)]
        for table, at, items_from, items in self.tables:
            n = table.length
            for last, window in table.candidates(h, bounds):
                near = np.zeros(len(first) + 1, np.int32)
                np.add.at(near, last - n + 1, 1)
                np.add.at(near, last + 1, -1)
                used = np.flatnonzero(np.cumsum(near)[:-1])
                coded = _gather(data, first[used], end[used]).dictionary_encode()
                where = np.zeros(len(coded.dictionary), np.int64)
                kinds = coded.indices.to_numpy()
                where[kinds] = used
                known = np.array([self._known(w, h[i]) for w, i in zip(coded.dictionary.to_pylist(), where)], np.int64)
                ids = np.full(len(first), -1, np.int64)
                ids[used] = known[kinds]
                same = np.ones(len(last), bool)
                for j in range(n):
                    same &= ids[last - n + 1 + j] == self.ids[at[window] + j]
                last, window = last[same], window[same]
                np.add.at(inside, last - n + 1, 1)
                np.add.at(inside, last + 1, -1)
                pairs = np.unique(np.stack([row[last], window], axis=1), axis=0)
                size = (items_from[1:] - items_from[:-1])[pairs[:, 1]]
                take = np.repeat(items_from[pairs[:, 1]] - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(size.sum())
                found.append(np.stack([np.repeat(pairs[:, 0], size), items[take]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        return first, bounds, np.cumsum(inside)[:-1] > 0, pairs[:, 0], pairs[:, 1]


def _pieces(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Parts of a long text, of about CHUNK_BYTES, that end between words."""
    word = _words().word
    while a < b:
        end, ahead = min(a + CHUNK_BYTES, b), a
        while end < b:
            gaps = np.flatnonzero(~word[data[ahead:end]])
            if len(gaps):
                end = ahead + int(gaps[-1]) + 1
                break
            ahead, end = end, min(end + CHUNK_BYTES, b)  # a word longer than a part
        yield a, end
        a = end


def _long(data: np.ndarray, a: int, b: int, windows: Windows) -> tuple[int, np.ndarray, list[str]]:
    """One long text, searched in parts that repeat the last words of the part before."""
    total, again, resume = 0, 0, a
    hit, items = [np.zeros(0, np.int32)], set()
    for _, end in _pieces(data, a, b):
        first, _, inside, _, found = windows.search(data, np.array([resume, end]))
        hit.append((np.flatnonzero(inside) + (total - again)).astype(np.int32))
        items.update(found.tolist())
        total += len(first) - again
        again = min(windows.longest - 1, len(first))
        resume = int(first[len(first) - again]) if again else end
    return total, np.unique(np.concatenate(hit)), [windows.items[i] for i in sorted(items)]


def _matches(column: pa.Array, windows: Windows) -> Iterator[tuple[int, np.ndarray, list[str]]]:
    """(words, positions of words inside occurrences, items) of each text."""
    data, offsets = utf8(column)
    none = np.zeros(0, np.int32)
    for i, j in chunks(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > 2 * CHUNK_BYTES:
            yield _long(data, int(offsets[i]), int(offsets[j]), windows)
            continue
        _, bounds, inside, texts, items = windows.search(data, offsets[i : j + 1])
        hit = np.flatnonzero(inside)
        hit_from, item_from = np.searchsorted(hit, bounds), np.searchsorted(texts, np.arange(j - i + 1))
        for d, n in enumerate(np.diff(bounds).tolist()):
            a, b = hit_from[d], hit_from[d + 1]
            if a == b:
                yield n, none, []
            else:
                yield n, (hit[a:b] - bounds[d]).astype(np.int32), [windows.items[k] for k in items[item_from[d] : item_from[d + 1]]]


@lru_cache(1)
def _words():
    return alphanumeric()


def _keep(batches: Iterator[pa.RecordBatch], shared, text_col: str) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        column = batch.column(batch.schema.names.index(text_col))
        clean = [not len(hit) for _, hit, _ in _matches(column, shared.value)]
        yield batch.filter(pa.array(clean, pa.bool_()))


def _scan(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, marks, items = map(list, zip(*_matches(batch.column("text"), shared.value))) if batch.num_rows else ([], [], [])
        names = [n for n in batch.schema.names if n not in ("hits", "items", "n_words")]
        if "hits" in batch.schema.names:
            before = batch.column("hits")
            marks = [np.union1d(before[i].values.to_numpy(), m).astype(np.int32) if len(before[i]) else m for i, m in enumerate(marks)]
            items = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), items)]
        ends = np.concatenate(([0], np.cumsum([len(m) for m in marks]))).astype(np.int32)
        hits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *marks])))
        yield pa.record_batch([*(batch.column(n) for n in names), pa.array(counts, pa.int64()), hits, pa.array(items, pa.list_(pa.string()))],
                              names=[*names, "n_words", "hits", "items"])


def table_sets(benchmark: DataFrame, window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> list:
    """Broadcast search tables; distinct rows are dealt to as many sets as their text needs.

    A set holds about ``table_bytes`` of text, and a longer row whole.
    """
    spark = benchmark.sparkSession
    texts = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // table_bytes))
    dealt = (texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect() for part in range(parts))
    return [spark.sparkContext.broadcast(Windows([(r[0], r[1]) for r in rows], window)) for rows in dealt]


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any word inside an occurrence, unchanged.

    Rows with a null or wordless text stay; repeated rows stay or go alike.
    """
    parts = table_sets(benchmark, window)
    for shared in parts:
        docs = small_batches(docs).mapInArrow(partial(_keep, shared=shared, text_col=text_col), docs.schema)
        if len(parts) > 1:
            docs = materialize(docs)
    return docs


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items) of each row: positions of the words inside occurrences, and the items found.

    Benchmark text beyond ``table_bytes`` is dealt by item to several table sets, each of a
    bounded size and scanned in turn, so the broadcast does not grow with the benchmark.
    Texts of any length are searched in parts of about a megabyte.
    """
    out = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    parts = table_sets(benchmark, window, table_bytes)
    for shared in parts:
        out = out.mapInArrow(partial(_scan, shared=shared),
                             f"doc_id {kind}, text string, n_words long, hits array<int>, items array<string>")
        if len(parts) > 1:
            out = materialize(out)
    return out.drop("text")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of ``docs``.

    Null and wordless texts have no words and no hits; items without words or with a null
    id are ignored; repeated rows each get their result; an empty benchmark finds nothing.
    """
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return hits(docs, benchmark, id_col, text_col, window).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def item_digest(items: list[str]) -> str:
    """The digest of a list of item ids, as the query returns it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
