"""Byte-level BPE by replaying the merges over the distinct words of the corpus.

The words that stand in several blocks of text (runs of Arrow batches) are counted over the
whole corpus, dealt by hash and replayed there once: all words of a task lie in one symbol
array with an inverted index from pair rank to the positions where that pair stands.  Ranks
are taken in ascending order; each merge is applied to all its positions at once and only
the pairs that touch a merged symbol are looked up again.  Their ids form a codebook of
bounded size that workers get by broadcast.  A word of one block alone has nothing to share:
its block replays it in the same way.  Documents are then written as the ids of their words.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache, partial
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import chunks, release, small_batches, utf8
from plaint.session import materialize

NONE = np.int32(1 << 30)
#: Bytes of text whose distinct words are told apart together.
BLOCK_BYTES = 2 << 20
#: Most words of the codebook and bytes of their spelling; beyond it the words of fewest blocks stay in their blocks.
BOOK_WORDS, BOOK_BYTES = 1_000_000, 16 << 20
#: Code points of the longest word that is counted; longer ones stay in their blocks.
LONG_WORD = 256
#: Words that a task counts before it hands them on, and words that it replays together.
COUNTED_WORDS, REPLAYED_WORDS = 500_000, 20_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Texts below this code point are split by a pattern with the classes written out.
NEAR = 0x250


@lru_cache(None)
def _members(kind: str) -> str:
    """The code points below NEAR of a class of the pattern, as ranges."""
    has = regex.compile(kind)
    points = [c for c in range(NEAR) if has.match(chr(c))]
    starts = [c for c in points if c - 1 not in points]
    ends = [c for c in points if c + 1 not in points]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def written_out(pattern: str) -> re.Pattern | None:
    """``pattern`` for the standard library, for texts below NEAR; None if it has other escapes."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|\[\^?|.", pattern, re.S):
        if part in ("[", "[^"):
            inside = True
        elif part == "]":
            inside = False
        elif part == r"\S" and not inside:
            part = f"[^{_members(r'\s')}]"
        elif part == r"\s" or part.startswith(r"\p"):
            part = _members(part) if inside else f"[{_members(part)}]"
        elif part.startswith("\\"):
            return None
        out.append(part)
    return re.compile("".join(out))


def splitter(pattern: str):
    """A function from a text to its matches of ``pattern``."""
    full, near = regex.compile(pattern).findall, written_out(pattern)
    if near is None:
        return full
    far, near = re.compile(f"[^\\x00-{chr(NEAR - 1)}]").search, near.findall
    return lambda text: full(text) if far(text) else near(text)


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + size[i] - 1 of each i, one after the other."""
    end = np.cumsum(size)
    return np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Pieces:
    """Byte strings of the token ids 0, 1, ... laid end to end."""

    def __init__(self, pieces: list[bytes]):
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.first = np.cumsum(self.size) - self.size

    def spell(self, ids: np.ndarray, begin: np.ndarray) -> list[bytes]:
        """The pieces of ids[begin[i]:begin[i + 1]], joined, for each i."""
        size = self.size[ids]
        data = self.data[ranges(self.first[ids], size)].tobytes()
        cuts = np.concatenate(([0], np.cumsum(size)))[begin].tolist()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Replay:
    """Merges of a rank table, applied to many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        every = range(max(self.tokens) + 1)
        self.spelt = Pieces([self.tokens.get(i, b"") for i in every])
        self.decimal = Pieces([b"%d," % i for i in every])
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 24 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 24) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in one array, and where each word's begin (and the end):
        lowest rank first, leftmost first, a whole token at once."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        todo = [i for i in np.flatnonzero(whole < 0).tolist() if words[i]]
        ids, starts = self._replay([words[i] for i in todo]) if todo else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        size = (whole >= 0).astype(np.int64)
        size[todo] = np.diff(starts)
        begin = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(begin[-1], np.int32)
        out[begin[:-1][whole >= 0]] = whole[whole >= 0]
        own = np.repeat(begin[:-1][todo] - starts[:-1], np.diff(starts))
        out[own + np.arange(len(ids))] = ids
        return out, begin

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        n = int(end[-1])
        symbol = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[end - 1], before[end - size] = -1, -1
        rank = np.full(n, NONE)
        inner = np.flatnonzero(after >= 0).astype(np.int32)
        rank[inner] = self.pair_ranks(symbol[inner], symbol[inner + 1])
        index: dict[int, list[np.ndarray]] = defaultdict(list)

        def note(at: np.ndarray) -> list[int]:
            """Enters positions under the rank of their pair; the ranks entered."""
            r = rank[at]
            at, r = at[r < NONE], r[r < NONE]
            if not len(at):
                return []
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            found = r[np.concatenate(([0], cut))].tolist()
            for k, part in zip(found, np.split(at, cut) if len(cut) else [at]):
                index[k].append(part)
            return found

        heap = note(inner)
        queued = set(heap)
        heapq.heapify(heap)
        again: list[np.ndarray] = []
        while heap:
            r = heapq.heappop(heap)
            queued.discard(r)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == r]
            if not len(at):
                continue
            right = after[at]
            touching = right[:-1] == at[1:]
            if touching.any():
                position = np.arange(len(at))
                begin = np.maximum.accumulate(np.where(np.concatenate(([True], ~touching)), position, 0))
                at = at[(position - begin) % 2 == 0]
                right = after[at]
            symbol[at] = r
            symbol[right] = -1
            rank[right] = NONE
            beyond = after[right]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            rank[at] = NONE
            some = at[has]
            rank[some] = self.pair_ranks(symbol[some], symbol[after[some]])
            previous = before[at]
            previous = previous[previous >= 0]
            rank[previous] = self.pair_ranks(symbol[previous], symbol[after[previous]])
            fresh = np.concatenate((some, previous))
            low = rank[fresh] < r
            if low.any():
                again.append(fresh[low])
            for k in note(fresh):
                if k not in queued:
                    queued.add(k)
                    heapq.heappush(heap, k)
        alive = symbol >= 0
        ids, starts = symbol[alive].astype(np.int32), np.concatenate(([0], np.cumsum(np.add.reduceat(alive, end - size))))
        # A merge that gives rise to a lower rank must come before equal merges further right in its word.
        redo = sorted({int(x) for a in again for x in np.searchsorted(end, a, "right")})
        if redo:
            parts = np.split(ids, starts[1:-1])
            for w in redo:
                parts[w] = np.array(self.encode_alone(words[w]), np.int32)
            ids, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        return ids, starts

    def encode_alone(self, word: bytes) -> list[int]:
        """One word, one merge at a time."""
        ids = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word))) + [-1], list(range(-1, len(word) - 1))
        heap = [(k, i) for i in range(len(word) - 1) if (k := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            k, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j < 0 or self.ranks.get(parts[i] + parts[j]) != k:
                continue
            parts[i], ids[i], parts[j], after[i] = parts[i] + parts[j], k, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (k := self.ranks.get(parts[a] + parts[after[a]])) is not None:
                    heapq.heappush(heap, (k, a))
        return [t for t, p in zip(ids, parts) if p is not None]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(2)
def load(path: str) -> Replay:
    return Replay(read_ranks(path))


class Codebook:
    """Ids of words replayed over the whole corpus."""

    def __init__(self, words: pa.Array, ids: np.ndarray, begin: np.ndarray):
        self.words, self.ids, self.begin = words, ids, begin

    @cached_property
    def place(self) -> dict[str, int]:
        return {w: i for i, w in enumerate(self.words.to_pylist())}

    def encode(self, words: list[str], replay: Replay) -> tuple[np.ndarray, np.ndarray]:
        """As ``Replay.encode``, which gets the words that the book does not hold."""
        place = np.fromiter((self.place.get(w, -1) for w in words), np.int64, len(words))
        held, rest = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        place = place[held]
        own, cuts = replay.encode([words[i].encode() for i in rest.tolist()])
        size = np.zeros(len(words), np.int64)
        size[held], size[rest] = self.begin[place + 1] - self.begin[place], np.diff(cuts)
        begin = np.concatenate(([0], np.cumsum(size)))
        out = np.empty(begin[-1], np.int32)
        out[ranges(begin[held], size[held])] = self.ids[ranges(self.begin[place], size[held])]
        out[ranges(begin[rest], size[rest])] = own
        return out, begin


def _count(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """(word, n): words that are no token as a whole, and the blocks of text they stand in."""
    ranks, split = load(path).ranks, splitter(pattern)

    def emit(counted: Counter) -> pa.RecordBatch:
        words = [w for w in counted if len(w) <= LONG_WORD and w.encode() not in ranks]
        return pa.record_batch([pa.array(words, pa.string()), pa.array([counted[w] for w in words], pa.int64())], names=["word", "n"])

    counted, words, size = Counter(), set(), 0
    for batch in batches:
        _, offsets = utf8(batch.column("text"))
        for i, j in chunks(offsets):
            for text in batch.column("text").slice(i, j - i).to_pylist():
                words.update(split(text or ""))
            size += int(offsets[j] - offsets[i])
            if size >= BLOCK_BYTES:
                counted.update(words)
                words, size = set(), 0
                if len(counted) >= COUNTED_WORDS:
                    yield emit(counted)
                    counted = Counter()
    counted.update(words)
    yield emit(counted)


def _replay(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """(word, ids) of all words of a task, replayed together."""
    words = [batch.column("word") for batch in batches if batch.num_rows]
    if words:
        words = pa.concat_arrays(words)
        ids, begin = load(path).encode([w.encode() for w in words.to_pylist()])
        yield pa.record_batch([words, pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids))], names=["word", "ids"])


def codebook(texts: DataFrame, path: str, pattern: str) -> Codebook | None:
    """The ids of the words that stand in two blocks of ``texts`` or more; None without such words.

    Where these exceed BOOK_WORDS or BOOK_BYTES, those of the most blocks.
    """
    counted = texts.mapInArrow(partial(_count, path=path, pattern=pattern), "word string, n long")
    shared = materialize(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    # At most 64 + 64 levels, whatever the corpus: exact ones, then powers of two.
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.pow(F.lit(2), F.floor(F.log2("n"))).cast("long"))
    levels = shared.groupBy(level.alias("level")).agg(F.count("*"), F.sum(F.octet_length("word"))).collect()
    words = size = 0
    least = None
    for at, more, spelt in sorted(map(tuple, levels), reverse=True):
        if words + more > BOOK_WORDS or size + spelt > BOOK_BYTES:
            break
        words, size, least = words + more, size + spelt, at
    if least is None:
        return None
    chosen = shared.where(F.col("n") >= least).select("word").repartition(-(-words // REPLAYED_WORDS), "word")
    out = chosen.mapInArrow(partial(_replay, path=path), "word string, ids array<int>").toArrow().combine_chunks()
    ids = out.column("ids").combine_chunks()
    begin = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))))
    return Codebook(out.column("word").combine_chunks(), ids.flatten().to_numpy().astype(np.int32), begin)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool, shared=None) -> Iterator[pa.RecordBatch]:
    replay, split = load(path), splitter(pattern)
    book = Codebook(pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(1, np.int64)) if shared is None else shared.value

    def blocks() -> Iterator[tuple[list[pa.Array], list[np.ndarray], dict[str, int]]]:
        ids, spelt, number, size = [], [], defaultdict(count().__next__), 0
        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                ids.append(batch.column("doc_id").slice(i, j - i))
                spelt.extend(np.fromiter(map(number.__getitem__, split(text or "")), np.int32) for text in batch.column("text").slice(i, j - i).to_pylist())
                size += int(offsets[j] - offsets[i])
                if size >= BLOCK_BYTES:
                    yield ids, spelt, number
                    ids, spelt, number, size = [], [], defaultdict(count().__next__), 0
        if ids:
            yield ids, spelt, number

    for doc_ids, spelt, number in blocks():
        release()
        flat, begin = book.encode(list(number), replay)
        written, decoded = replay.decimal.spell(flat, begin), replay.spelt.spell(flat, begin)
        size = np.diff(begin)
        n_tokens, ids_hash, text_hash = [], [], []
        for words in spelt:
            at = words.tolist()
            n_tokens.append(int(size[words].sum()))
            ids_hash.append(hashlib.sha256(b"".join(map(written.__getitem__, at))[:-1]).hexdigest())
            text_hash.append(hashlib.sha256(b"".join(map(decoded.__getitem__, at))).hexdigest())
        columns = [pa.concat_arrays(doc_ids), pa.array(n_tokens, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            words = np.concatenate(spelt)
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n_tokens))), pa.int32()),
                                                    pa.array(flat[ranges(begin[words], size[words])])))
            names.append("ids")
        yield pa.record_batch(columns, names=names)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row of ``docs``.

    ``path``: a rank file that every worker can read; ``pattern``: splits text into the
    pieces that are encoded separately; text that no piece covers has no ids.  The decoded
    bytes come from the ids.  Null and empty texts have no ids; repeated rows are encoded
    as often as they stand, and an empty table gives no rows.
    """
    out = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = out.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    book = codebook(out.select("text"), path, pattern)
    shared = None if book is None else out.sparkSession.sparkContext.broadcast(book)
    return out.mapInArrow(partial(_encode, path=path, pattern=pattern, with_ids=with_ids, shared=shared), schema)


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    replay = load(path)
    for batch in batches:
        text = [None if ids is None else replay.decode(ids).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null ids give null text."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), f"doc_id {kind}, text string")
