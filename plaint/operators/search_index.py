"""Keyword search through a trigram index of the stored complaints.

``index_batch`` lists, for each block of stored rows and each trigram of their IDs, texts and
names, lower-cased as ILIKE does, the complaints of the block that hold it, into
``<store>/_grams`` (partitioned like the store, lists in the order of grams, with bloom filters
on them).  A task lists the blocks that it reads, so no row per trigram is shuffled, sorted or
written.  ``search`` reads the lists of the term's own trigrams, intersects those of a block,
turns the few candidates into ID ranges that reach the store's scan, and verifies by ILIKE, so
its rows are those of a full scan.

Wildcards in a term (``%``, ``_``) split it; a term without three letters between wildcards
scans the store, and so does one with more than CANDIDATES candidates (joined, not collected).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.operators import store as ST
from plaint.operators.ids import id_text

POSTINGS = "gram string, block bigint, seqs array<bigint>, year int, batch string"
#: Code points of one block (at least one row).
BLOCK = 1 << 20
#: Stands for the year of a complaint without a time while it is listed.
NO_YEAR = -(1 << 31)
#: Candidates that the driver turns into ID ranges, and the most ranges; beyond the first the store is joined.
CANDIDATES, RANGES = 10_000, 100
LAYOUT = {"parquet.bloom.filter.enabled#gram": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(gram, row) of every trigram of ``texts`` (code points); 63 bits hold one."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    row = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy())
    whole = row[:-2] == row[2:]
    return ((points[:-2] << 42) | (points[1:-1] << 21) | points[2:])[whole], row[:-2][whole]


def _block_lists(rows: pa.RecordBatch, block: int) -> pa.RecordBatch:
    """One list of positions for each (year, gram) of a block."""
    found = [_grams(rows.column(c)) for c in ("id", "text", "name")]
    gram, row = (np.concatenate(x) for x in zip(*found))
    seq, year = (rows.column(c).to_numpy() for c in ("seq", "year"))
    order = np.lexsort((row, gram, year[row]))
    gram, row = gram[order], row[order]
    years = year[row]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (years[1:] != years[:-1])
    once = new.copy()
    once[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    ends = np.concatenate([np.cumsum(once)[first] - 1, [once.sum()]])
    points = np.stack([gram[first] >> 42, (gram[first] >> 21) & 0x1FFFFF, gram[first] & 0x1FFFFF], axis=1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return pa.record_batch([
        pa.array([text[i:i + 3] for i in range(0, len(text), 3)], pa.string()), pa.array(np.full(len(first), block)),
        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(seq[row[once]])), pa.array(years[first])],
        names=["gram", "block", "seqs", "year"])


def _lists(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        points = sum(pc.utf8_length(batch.column(c)).to_numpy().astype(np.int64) for c in ("id", "text", "name"))
        part = np.cumsum(points) // size
        bounds = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            block += 1
            yield _block_lists(batch.slice(a, b - a), block)


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}/_grams"


def index_batch(spark: SparkSession, path: str, batch: str) -> None:
    """(Re)writes the postings of one load of the store at ``path``."""
    rows = ST.read_stored(spark, path).where(F.col("batch") == batch)
    searched = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in (
        ("complaint_id", "id"), ("complaint", "text"), ("customer_name", "name"))]
    seq = F.substring("complaint_id", 10, 1 << 20).cast("bigint")
    year = F.coalesce("year", F.lit(NO_YEAR)).alias("year")
    lists = rows.select(*searched, seq.alias("seq"), year).mapInArrow(
        partial(_lists, size=BLOCK), "gram string, block bigint, seqs array<bigint>, year int")
    lists = lists.withColumn("year", F.nullif("year", F.lit(NO_YEAR))).withColumn("batch", F.lit(batch))
    (lists.sortWithinPartitions("year", "batch", "gram", "block")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**LAYOUT)
     .partitionBy("year", "batch").parquet(_folder(path)))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(POSTINGS).parquet(_folder(path))
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], POSTINGS)
        raise


def term_grams(spark: SparkSession, term: str) -> list[str]:
    """Trigrams that every match of ``term`` holds; lower-cased as a whole, as ILIKE does."""
    lowered = spark.range(1).select(F.lower(F.lit(term))).first()[0]
    parts = re.split("[%_]", lowered)
    return sorted({p[i:i + 3] for p in parts for i in range(len(p) - 2)})


def candidates(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    """(year, complaint_id) of the complaints that hold all ``wanted`` trigrams."""
    hits = read_postings(spark, path).where(F.col("gram").isin(wanted))
    lists = hits.groupBy("year", "batch", "block").agg(F.collect_list("seqs").alias("_lists")).where(F.size("_lists") == len(wanted))
    full = lists.select("year", F.explode(F.aggregate("_lists", F.get("_lists", 0), F.array_intersect)).alias("seq"))
    return full.select("year", id_text(F.col("year"), F.col("seq")).alias("complaint_id"))


def search(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The stored complaints that ``ST.list_complaints(search=term)`` finds, unordered.

    Every load of the store must be indexed: batches without postings are read in full.
    """
    stored, predicate = ST.read_stored(spark, path), ST.search_predicate(term)
    if predicate is None:
        return stored.select(*ST.COLUMNS)
    found = stored.where(predicate).select(*ST.COLUMNS)
    wanted = term_grams(spark, term.strip(D.WHITESPACE))
    if not wanted:
        return found
    indexed = [r[0] for r in read_postings(spark, path).select("batch").distinct().collect()]  # folders, not rows
    bare = found_in(stored, ~F.col("batch").isin(indexed), predicate)
    near = candidates(spark, path, wanted)
    few = near.limit(CANDIDATES + 1).collect()
    if len(few) > CANDIDATES:
        same = stored["year"].eqNullSafe(near["year"]) & (stored["complaint_id"] == near["complaint_id"])
        hits = stored.where(F.col("batch").isin(indexed)).join(near, same, "left_semi")
        return hits.where(predicate).select(*ST.COLUMNS).union(bare)
    if not few:
        return bare
    few.sort(key=lambda r: r.complaint_id)
    step = -(-len(few) // RANGES)
    ranges = []
    for year in {r.year for r in few}:
        ids = [r.complaint_id for r in few if r.year == year]
        pieces = [ids[i:i + step] for i in range(0, len(ids), step)]
        ranges.append(F.col("year").eqNullSafe(F.lit(year)) & reduce(
            Column.__or__, [F.col("complaint_id").between(p[0], p[-1]) for p in pieces]))
    return found_in(stored, F.col("batch").isin(indexed) & reduce(Column.__or__, ranges), predicate).union(bare)


def found_in(stored: DataFrame, where: Column, predicate: Column) -> DataFrame:
    return stored.where(where).where(predicate).select(*ST.COLUMNS)
