"""Dense yearly complaint IDs ``CMP-{year}-{seq:03d}``, continuing from the stored max."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint.operators.sequence import sequence_within

ID_PREFIX = "CMP-"


def id_text(year, seq):
    """``CMP-2024-007``; widths above three digits grow (never truncated, unlike lpad)."""
    return F.format_string("CMP-%d-%03d", year, seq)


def max_seq_per_year(existing: DataFrame) -> DataFrame:
    """(year, max_seq) of stored IDs — one row per year, bounded by the calendar."""
    year = F.substring(F.col("complaint_id"), 5, 4).try_cast("int")
    seq = F.substring(F.col("complaint_id"), 10, 1 << 20).try_cast("bigint")
    return (existing.filter(F.col("complaint_id").startswith(ID_PREFIX))
            .groupBy(year.alias("_year")).agg(F.max(seq).alias("_max")))


def assign_ids(df: DataFrame, key: str | list[str] = "source_id", existing: DataFrame | None = None,
               ts: str = "created_at", maxes: DataFrame | None = None) -> DataFrame:
    """Add ``complaint_id``: per year of ``ts`` in (ts, key) order, after the stored max.

    ``key`` (one or more columns) makes the order total.

    The per-year numbering is distributed (see :mod:`plaint.operators.sequence`).  The
    stored maxima — from ``maxes`` ``(_year, _max)`` or computed from ``existing`` IDs —
    are one row per year, so that table is broadcast.
    """
    staged = df.withColumn("_year", F.year(F.col(ts)))
    keys = [key] if isinstance(key, str) else key
    numbered = sequence_within(staged, ["_year"], [ts, *keys], out_col="_seq")
    if maxes is None and existing is not None:
        maxes = max_seq_per_year(existing)
    if maxes is not None:
        maxes = F.broadcast(maxes)
        numbered = numbered.join(maxes, "_year", "left").withColumn(
            "_seq", F.col("_seq") + F.coalesce(F.col("_max"), F.lit(0)))
    return numbered.withColumn("complaint_id", id_text(F.col("_year"), F.col("_seq"))).drop(
        "_year", "_seq", "_max")
