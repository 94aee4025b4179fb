"""Language-model scoring from a log-frequency Bloom filter of quantised n-gram counts.

The pairs of neighbouring tokens of all training rows are counted.  A count c is quantised to
the level 1 + floor(log2 c), and a pair enters the filter once for each level up to its own; a
reader probes level after level until one is absent, and takes 2**(level - 1), at most c.  The
filter is made of segments, one for each hash shard, sized from the entries counted there, so
no pair is dropped.

The texts become blocks: distinct token hashes and the places of each.  Every block sends its
distinct tokens and pairs, each once, with its training counts, to their shards; a shard adds
them up, makes its segment, and answers each block with the tokens' exact counts and with the
levels that the segment gives the pairs.  A filter within its broadcast bound goes to the
workers instead, and blocks probe it themselves: the same segments, the same levels.

A token's probability after another is (q + PRIOR * p) / (c + PRIOR): q the pair's quantised
count, c the context's exact one, p the add-0.1 probability of the token alone.  Over all tokens
they add up to at most 1, but for what the filter takes for present by mistake; what is missing
is what quantisation rounds off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import U64, constants, group_bounds, remainder, runs, small_batches, spaced, splitmix, utf8, chunks
from plaint.session import materialize

#: Text bytes for each hash shard, and the fewest shards.
SHARD_BYTES, LEAST_SHARDS = 2 << 20, 64
#: Bits up to which the filter is broadcast; bits that it has at least; bits for each entry; probes of an entry.
PAIR_BITS, LEAST_BITS, ENTRY_BITS, PROBES = 1 << 28, 1 << 28, 10, 6
#: Weight, in pairs, of the token distribution when it smooths the pair distribution.
PRIOR = 200.0
END, START = constants(2, 5)
#: Tokens of a block.
BLOCK_TOKENS = 2_000_000
TOKEN, PAIR = 1, 2
#: Low bytes of a hash that are sent; its upper bits name the shard.
_WIDTH = {TOKEN: 7, PAIR: 5}


def _tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token hashes with an end after each row, first token of each row and the end) of blocks of rows."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        _, _, h, row = _words().split(data, offsets[i : j + 1])
        n = np.bincount(row, minlength=j - i)
        yield np.insert(h, np.cumsum(n), END), np.concatenate(([0], np.cumsum(n + 1)))


@lru_cache(1)
def _words():
    return spaced()


def _pairs(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it in its row, START for the first."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[bounds[:-1]] = START
    return splitmix(before * U64(0xA0761D6478BD642F) + h)


def _counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.diff(np.append(first, len(h)))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the upper 32 bits, so sorted hashes are sorted by shard."""
    return ((h >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def _probes(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The positions of one level of each key in a segment of ``bits``."""
    x = splitmix(keys ^ U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = (x >> U64(32)) | U64(1)
    for _ in range(PROBES):
        yield ((x & U64(0xFFFFFFFF)) * U64(bits) >> U64(32)).astype(np.int64)
        x = x + step


def segment(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter segment of all n-grams, of ``bits`` or as many more as its entries need."""
    level = levels(counts)
    bits = max(bits, -(-int(level.sum()) * ENTRY_BITS // 8) * 8)
    field = np.zeros(bits, bool)
    for k in range(1, int(level.max(initial=0)) + 1):
        for at in _probes(keys[level >= k], k, bits):
            field[at] = True
    return np.packbits(field, bitorder="little").tobytes()


class Filter:
    """Quantised counts of n-grams, from the segments of a kind."""

    def __init__(self, fields: dict[int, bytes], shards: int, bits: int):
        """``bits``: of the segments that are not there; the others have their own sizes."""
        held = [fields.get(s, bytes(bits // 8)) for s in range(shards)]
        self.shards, self.sizes = shards, np.array([8 * len(x) for x in held])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.field = np.frombuffer(b"".join(held), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key; 0 for absent keys."""
        shard = shard_of(keys, self.shards)
        base, bits = self.starts[shard], self.sizes[shard].astype(U64)
        low = keys & U64((1 << 8 * _WIDTH[PAIR]) - 1)
        level = np.zeros(len(keys), np.int64)
        there = np.arange(len(keys))
        k = 0
        while len(there):
            k += 1
            for part in range(PROBES):
                at = base[there] + self._position(low[there], k, part, bits[there])
                there = there[(self.field[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            level[there] = k
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The least count of each key's level; 0 for absent keys."""
        return least_count(self.levels(keys))

    @staticmethod
    def _position(keys: np.ndarray, level: int, part: int, bits: np.ndarray) -> np.ndarray:
        x = splitmix(keys ^ U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        x = x + ((x >> U64(32)) | U64(1)) * U64(part)
        return ((x & U64(0xFFFFFFFF)) * bits >> U64(32)).astype(np.int64)


def least_count(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level; 0 for level 0."""
    level = level.astype(np.int64)
    return np.where(level > 0, 2.0 ** np.maximum(level - 1, 0), 0.0)


# ------------------------------------------------------------------------------ blocks
def _packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((k + 1 for k in range(8) if planes[k].any()), default=0)
    body = planes[:used].tobytes()
    return np.array([len(values), used], "<i8").tobytes() + (pa.Codec("zstd").compress(body, asbytes=True) if body else b"")


def _unpacked(body: bytes) -> np.ndarray:
    n, used = np.frombuffer(body[:16], "<i8")
    planes = np.zeros((8, n), np.uint8)
    if n and used:
        planes[:used] = np.frombuffer(pa.Codec("zstd").decompress(body[16:], int(n * used), asbytes=True), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


class Block:
    """Rows of a block: token hashes in their order, row bounds, and which rows train."""

    def __init__(self, keys: bytes, places: bytes, sizes: bytes, train: bytes):
        self.keys = np.frombuffer(keys, "<u8").astype(U64)
        self.places, self.sizes = _unpacked(places), _unpacked(sizes)
        self.h = self.keys[self.places]
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        self.train = np.repeat(np.frombuffer(train, np.uint8).astype(bool), self.sizes)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct pairs, the place of each position's pair among them)."""
        return np.unique(_pairs(self.h, self.bounds), return_inverse=True)


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    ids: list[pa.Array] = []
    held: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    sizes: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        keys, places, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")  # small places for frequent tokens
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        flags = np.concatenate(held)
        row = [pa.array([pa.concat_arrays(ids).to_pylist()], schema.field("ids").type), pa.array([flags.tolist()], schema.field("held").type),
               *(pa.array([b], pa.binary()) for b in (keys[order].astype("<u8").tobytes(), _packed(rank[places]), _packed(np.concatenate(sizes)),
                                                      (~flags).astype(np.uint8).tobytes()))]
        for part in (ids, held, hashes, sizes):
            part.clear()
        return pa.RecordBatch.from_arrays(row, schema=schema)

    for batch in batches:
        at = 0
        flags = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for h, bounds in _tokens(batch.column("text")):
            n = len(bounds) - 1
            ids.append(batch.column("doc_id").slice(at, n))
            held.append(flags[at : at + n])
            hashes.append(h)
            sizes.append(np.diff(bounds))
            at += n
            if sum(map(len, hashes)) >= most:
                yield out()
    if hashes:
        yield out()


_SLICES = "kind int, shard long, block long, keys binary, counts binary"
_ANSWERS = "kind int, shard long, block long, body binary, total long, distinct long"


def _sliced(kind: int, block: int, keys: np.ndarray, counts: np.ndarray, shards: int) -> pa.RecordBatch:
    """Sorted keys and their counts, a row for each shard."""
    shard = shard_of(keys, shards)
    cut = np.append(np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))), len(keys))
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDTH[kind]]
    counts, m = counts.astype("<u4"), len(cut) - 1
    pieces = list(zip(cut[:-1], cut[1:]))
    return pa.record_batch(
        [pa.array(np.full(m, kind, np.int32)), pa.array(shard[cut[:-1]]), pa.array(np.full(m, block, np.int64)),
         pa.array([low[a:b].tobytes() for a, b in pieces], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in pieces], pa.binary())],
        names=["kind", "shard", "block", "keys", "counts"])


def _slices(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Each distinct token and pair of a block once, with its count in training rows (0 if in others only)."""
    for batch in batches:
        for i in range(batch.num_rows):
            number, *body = (batch.column(c)[i].as_py() for c in ("block", "keys", "places", "sizes", "train"))
            block = Block(*body)
            order = np.argsort(block.keys)
            yield _sliced(TOKEN, number, block.keys[order], np.bincount(block.places[block.train], minlength=len(order))[order], shards)
            pairs, place = block.distinct()
            yield _sliced(PAIR, number, pairs, np.bincount(place[block.train], minlength=len(pairs)), shards)


def _shard_answers(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Adds up each (kind, shard) and answers its blocks; a row of block -1 has the totals and, of pairs, the segment."""
    for batch in runs(batches, ["kind", "shard"]):
        kinds, shards = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
        bounds = group_bounds([kinds, shards])
        for a, b in zip(bounds[:-1], bounds[1:]):
            kind, shard, part = int(kinds[a]), int(shards[a]), batch.slice(a, b - a)
            held, blocks = part.column("keys").to_pylist(), part.column("block").to_numpy()
            low = np.frombuffer(b"".join(held), np.uint8).reshape(-1, _WIDTH[kind])
            full = np.zeros((len(low), 8), np.uint8)
            full[:, :_WIDTH[kind]] = low
            keys, place = np.unique(full.view("<u8").ravel().astype(U64), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, place, np.frombuffer(b"".join(part.column("counts").to_pylist()), "<u4").astype(np.int64))
            seen = counts > 0
            field, answer = b"", counts
            if kind == PAIR:
                field = segment(keys[seen], counts[seen], least)
                answer = Filter({0: field}, 1, 8).levels(keys)
            ends = np.cumsum([len(x) // _WIDTH[kind] for x in held])
            bodies = [_packed(answer[place[e - len(x) // _WIDTH[kind] : e]]) for x, e in zip(held, ends)]
            n = len(bodies) + 1
            yield pa.record_batch(
                [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, shard, np.int64)), pa.array(np.append(blocks, -1)),
                 pa.array([*bodies, field], pa.binary()), pa.array([0] * (n - 1) + [int(counts.sum())], pa.int64()),
                 pa.array([0] * (n - 1) + [int(seen.sum())], pa.int64())],
                names=["kind", "shard", "block", "body", "total", "distinct"])


class Model:
    """What a worker needs to score a block: the totals, and the filter of pairs if it is broadcast."""

    def __init__(self, pairs: Filter | None, total: int, distinct: int, rows: int):
        self.pairs, self.total, self.distinct, self.rows = pairs, total, distinct, rows

    def alone(self, counts: np.ndarray) -> np.ndarray:
        """Add-0.1 probability of tokens of these counts."""
        return (counts + 0.1) / (self.total + 0.1 * (self.distinct + 1))

    def after(self, level: np.ndarray, own: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Smoothed probability of a token after the one before it: level of the pair, counts of both."""
        return (np.minimum(least_count(level), context) + PRIOR * self.alone(own)) / (context + PRIOR)


def _score(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The scores of each block's rows, from the block (kind 0) and the answers of its shards, in their order."""
    model: Model = shared.value
    for batch in runs(batches, ["block"]):
        groups = group_bounds([batch.column("block").to_numpy()])
        for a, b in zip(groups[:-1], groups[1:]):
            part = batch.slice(a, b - a)
            kind, bodies = part.column("kind").to_numpy(), part.column("body").to_pylist()
            block = Block(*(part.column(c)[0].as_py() for c in ("keys", "places", "sizes", "train")))
            answers = {k: np.concatenate([_unpacked(bodies[i]) for i in np.flatnonzero(kind == k)] or [np.zeros(0, np.int64)]) for k in (TOKEN, PAIR)}
            # sorted keys are sorted by shard, so the answers one after the other are those of the sorted keys
            of_key = np.empty(len(block.keys), np.int64)
            of_key[np.argsort(block.keys)] = answers[TOKEN]
            own = of_key[block.places]
            context = np.empty_like(own)
            context[1:] = own[:-1]
            context[block.bounds[:-1]] = model.rows
            pairs, place = block.distinct()
            level = answers[PAIR] if model.pairs is None else model.pairs.levels(pairs)
            first = block.bounds[:-1]
            yield pa.RecordBatch.from_arrays(
                [part.column("ids")[0].values, part.column("held")[0].values, pa.array(block.sizes),
                 pa.array(np.add.reduceat((own > 0).astype(np.int64), first)), pa.array(np.full(len(first), model.total, np.int64)),
                 pa.array(np.add.reduceat(np.log10(model.alone(own)), first)),
                 pa.array(np.add.reduceat(np.log10(model.after(level[place], own, context)), first))], schema=schema)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Rows whose crc32(id) modulo ``folds`` is 0 are held out; a row with a null id is held
    out too.  A-Z are lower-cased, tokens are the words between white space and one end;
    null and empty texts have the end alone.  base_score: exact add-0.1 token model;
    score: the filter's pair model, smoothed with the token distribution.  Without training
    rows every token is unknown.  Repeated rows are trained on and scored as often as they stand.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                                      F.coalesce(remainder(id_col, folds) == 0, F.lit(True)).alias("held_out"))
    amount = rows.agg(F.sum(F.octet_length("text")), F.sum((~F.col("held_out")).cast("long"))).first()
    shards = max(LEAST_SHARDS, -(-(amount[0] or 0) // SHARD_BYTES))
    least = max(8, LEAST_BITS // shards // 8 * 8)
    kind = rows.schema["doc_id"].dataType
    id_type = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("keys", pa.binary()), ("places", pa.binary()),
                        ("sizes", pa.binary()), ("train", pa.binary())])
    blocks = rows.mapInArrow(partial(_blocks, schema=schema, most=BLOCK_TOKENS), f"ids array<{kind.simpleString()}>, held array<boolean>, "
                             "keys binary, places binary, sizes binary, train binary")
    blocks = materialize(blocks.withColumn("block", F.monotonically_increasing_id()))
    answers = _answered(blocks, shards, least)
    found = {r[0]: r for r in answers.where("block = -1").groupBy("kind").agg(
        F.sum("total"), F.sum("distinct"), F.sum(F.octet_length("body"))).collect()}
    total, distinct = (int(found[TOKEN][1]), int(found[TOKEN][2])) if TOKEN in found else (0, 0)
    pairs = None
    if PAIR in found and 8 * found[PAIR][3] <= PAIR_BITS:
        fields = answers.where(f"block = -1 and kind = {PAIR}").select("shard", "body").collect()
        pairs = Filter({r[0]: bytes(r[1]) for r in fields}, shards, least)
    shared = spark.sparkContext.broadcast(Model(pairs, total, distinct, int(amount[1] or 0)))
    needed = answers.where("block >= 0" if pairs is None else f"block >= 0 and kind = {TOKEN}").select("kind", "shard", "block", "body")
    both = needed.unionByName(blocks.withColumn("kind", F.lit(0)).withColumn("shard", F.lit(-1).cast("long")), allowMissingColumns=True)
    out = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return both.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(
        partial(_score, shared=shared, schema=out), f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, "
        "train_tokens long, base_score double, score double")


def _answered(blocks: DataFrame, shards: int, least: int) -> DataFrame:
    """The shards' answers, written; the files of the shuffle before them are free to go then."""
    slices = blocks.mapInArrow(partial(_slices, shards=shards), _SLICES)
    return materialize(slices.repartition("kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(
        partial(_shard_answers, least=least), _ANSWERS))
