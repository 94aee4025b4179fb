"""SimHash fingerprints of documents and a search by permuted block tables.

A fingerprint has ``BITS`` bits.  Each distinct word of a text votes on every bit with the
sign that its hash has there and a weight that grows with the logarithm of its count.  For
a search within ``radius`` bits a fingerprint is cut into ``radius + 1`` blocks: one block
of any near pair is equal, so a table keyed by each block (the permutation that brings it
to the front) holds every answer, and the bits that differ are then counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint.llm.common import U64, chunks, small_batches, spaced, splitmix, spread_join, utf8
from plaint.session import materialize

BITS = 128
#: Rows of a neighbouring-document bucket, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 500, 20_000


def fingerprints(column: pa.Array) -> list[bytes]:
    """The fingerprint of each text; wordless and null texts have all bits zero."""
    words = spaced()
    data, offsets = utf8(column)
    out: list[bytes] = []
    for i, j in chunks(offsets):
        _, _, h, row = words.split(data, offsets[i : j + 1])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        if not len(h):
            out.extend([bytes(BITS // 8)] * (j - i))
            continue
        first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
        weight = 1 + np.log(np.diff(np.append(first, len(h)))).astype(np.float32)
        h, row = h[first], row[first]
        both = np.stack([h, splitmix(h ^ U64(0x5851F42D4C957F2D))], axis=1)
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        bits = np.unpackbits(both.view(np.uint8).reshape(len(h), BITS // 8), axis=1)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            w = weight[a:b]
            ones = w @ bits[a:b].astype(np.float32)
            out.append(np.packbits(2 * ones > w.sum()).tobytes())
    return out


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([f.hex() for f in fingerprints(batch.column(1))])], names=["doc_id", "fingerprint"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as hexadecimal text) of each row; wordless and null texts have all bits zero, repeated rows each get theirs."""
    out = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return out.mapInArrow(_fingerprint, f"doc_id {out.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _half(fingerprint: Column, k: int) -> Column:
    return F.conv(F.substring(fingerprint, 16 * k + 1, 16), 16, -10).cast("long")


def distance(a: Column, b: Column) -> Column:
    """Bits in which two hexadecimal fingerprints differ."""
    return sum((F.bit_count(_half(a, k).bitwiseXOR(_half(b, k))) for k in range(1, BITS // 64)),
               F.bit_count(_half(a, 0).bitwiseXOR(_half(b, 0))))


#: Blocks with more than this share of all rows of the block tables are dealt over several tasks.
FREQUENT = 4000


def neighbours(queries: DataFrame, table: DataFrame, radius: int = 3) -> DataFrame:
    """(query, fingerprint, distance, n) of the distinct fingerprints of ``table`` within ``radius`` of each of ``queries``.

    Both have a column fingerprint; null ones take no part, equal ones are one query and one
    answer, ``n`` is the rows of ``table`` with it.  ``radius`` + 1 must divide the hexadecimal
    length.  A pair is found in the table of each block that it shares and kept in the first.
    A frequent block's fingerprints are dealt into parts and its queries repeated once a part;
    there are fewer than FREQUENT such blocks, so their sizes are broadcast.
    """
    width = BITS // 4 // (radius + 1)

    def block(fingerprint: str, k: int) -> Column:
        return F.substring(fingerprint, width * k + 1, width)

    def blocks(df: DataFrame) -> DataFrame:
        return df.select("*", F.posexplode(F.array(*(block(df.columns[0], k) for k in range(radius + 1)))).alias("k", "block"))

    answers = blocks(table.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n")))
    asked = blocks(queries.where("fingerprint is not null").select(F.col("fingerprint").alias("query")).distinct())
    sizes = answers.groupBy("k", "block").agg(F.count("*").alias("size"))
    share = max(1, -(-(radius + 1) * table.count() // FREQUENT))
    often = F.broadcast(sizes.where(F.col("size") > share).select("k", "block", F.ceil(F.col("size") / F.lit(share)).alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = answers.join(often, ["k", "block"], "left").withColumn("part", F.pmod(F.xxhash64("fingerprint"), parts)).drop("parts")
    copies = asked.join(often, ["k", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    pairs = copies.join(dealt, ["k", "block", "part"]).withColumn("distance", distance(F.col("query"), F.col("fingerprint")))
    near = pairs.where(F.col("distance") <= radius)
    for k in range(radius):
        near = near.where((F.col("k") <= k) | (block("query", k) != block("fingerprint", k)))
    return near.select("query", "fingerprint", "distance", "n")


def with_neighbours(rows: DataFrame, asks: Column, radius: int = 3) -> DataFrame:
    """``rows`` and n_near: how many other rows' fingerprints are within ``radius`` bits, where ``asks`` holds, else null."""
    rows = materialize(rows.withColumn("_asks", F.coalesce(asks, F.lit(False))))
    queries = rows.where("_asks")
    near = neighbours(queries, rows, radius).groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    per_key = near.join(queries.groupBy(F.col("fingerprint").alias("query")).agg(F.count("*").alias("n")), "query")
    found = spread_join(queries.withColumn("query", F.col("fingerprint")).withColumn("_row", F.monotonically_increasing_id()),
                        per_key, "query", "_row", queries.count())
    return found.select(*rows.drop("_asks").columns, "n_near").union(
        rows.where("not _asks").drop("_asks").withColumn("n_near", F.lit(None).cast("long")))


def _deal(batches: Iterator[pa.RecordBatch], starts: list[int], first: int | None) -> Iterator[pa.RecordBatch]:
    """Each row with its bucket; a bucket's first row also goes behind the bucket before it."""
    cuts = np.array(starts, np.int64)
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        keys = np.array([np.iinfo(np.int64).min if x is None else x for x in ids], np.int64)
        bucket = np.searchsorted(cuts, keys, "right")
        opens = (bucket > 0) & (keys == cuts[np.maximum(bucket - 1, 0)]) if len(cuts) else np.zeros(len(keys), bool)
        head = np.array([x == first for x in ids], bool)
        take = np.concatenate((np.arange(len(keys)), np.flatnonzero(opens), np.flatnonzero(head)))
        n, m = len(keys), int(opens.sum())
        where = np.concatenate((bucket, bucket[opens] - 1, np.full(int(head.sum()), len(cuts))))
        extra = np.concatenate((np.zeros(n, np.int32), np.full(m, 1, np.int32), np.full(len(take) - n - m, 2, np.int32)))
        rows = batch.take(pa.array(take))
        yield pa.record_batch([pa.array(where), pa.array(extra), *rows.columns], names=["bucket", "extra", *rows.schema.names])


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of buckets -> fingerprints of each row, of its edited text, and of the next row."""
    held = None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        ids, texts, marks, next_texts, next_marks = zip(*rows)
        edited = [_edit(a, b) for a, b in zip(texts, next_texts)]
        edited_marks = fingerprints(pa.array(edited, pa.large_string()))
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
             pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array([m.hex() for m in marks]),
             pa.array([m.hex() for m in edited_marks]), pa.array([likeness(a, b) for a, b in zip(marks, edited_marks)]),
             pa.array([likeness(a, b) for a, b in zip(marks, next_marks)])], names=_NAMES)

    for batch in batches:
        for small in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
            texts = [t or "" for t in small.column("text").to_pylist()]
            marks = fingerprints(small.column("text"))
            done = []
            for bucket, extra, doc, text, mark in zip(small.column("bucket").to_pylist(), small.column("extra").to_pylist(),
                                                      small.column("doc_id").to_pylist(), texts, marks):
                if held is not None and held[0] == bucket:
                    done.append((held[2], held[3], held[4], text, mark))
                held = None if extra else (bucket, extra, doc, text, mark)
            if done:
                yield out(done)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many
    (or all) of the next document in ascending doc_id; the first follows the last.  Rows
    are dealt into buckets by id, and the first row of a bucket also follows the bucket
    before it, so there is one shuffle and no global order.  Null texts are empty.  Rows
    of equal id follow one another by text; null ids come first; a single row follows itself.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total, first, nulls = rows.agg(F.count("*"), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    n = min(MOST_BUCKETS, max(1, total // BUCKET_ROWS))
    cuts = rows.agg(F.percentile_approx("doc_id", F.lit([k / n for k in range(1, n)]), 100_000)).first()[0] if n > 1 else []
    starts = sorted({c for c in cuts or [] if c > first})
    dealt = rows.mapInArrow(partial(_deal, starts=starts, first=None if nulls else first), "bucket long, extra int, doc_id long, text string")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text").mapInArrow(
        _edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                "near_edited double, near_next double")
