"""Gap-free positions within low-cardinality groups, without a one-task window.

``row_number().over(Window.partitionBy(year))`` would pull a whole year into one task.
Instead:

1. ``repartitionByRange`` on ``(group, order...)`` splits even a hot group across many
   tasks (the order key is unique, so range bounds can cut anywhere), then rows are
   sorted inside each partition and stamped with ``monotonically_increasing_id``
   (partition index in the high bits, position in the low 33 bits).
2. The stamped frame is checkpointed to the shared checkpoint folder, so the stamps
   are fixed: recomputing after a lost executor can not renumber.
3. Rows per (partition, group) are counted — at most ``partitions + groups`` rows —
   and a prefix sum over partitions gives each partition's offset within its group.
4. The offsets table is joined back (broadcast only when its measured size is small).

The result equals ``row_number() over (partition by group order by order...)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaint.session import materialize

LOW_BITS = 33
#: Rows of the offsets table up to which it is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def sequence_within(df: DataFrame, group_cols: list[str], order_cols: list[str],
                    out_col: str = "seq", partitions: int | None = None,
                    size_col: str | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based position of each row inside its group, by ``order_cols``.

    ``order_cols`` must make the order total within a group (end with a unique key).
    With ``size_col``, also add the group's row count (taken from the small offsets
    table, so it costs no extra pass over the data).
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group_cols, *order_cols]
    stamped = (df.repartitionByRange(n, *keys)
               .sortWithinPartitions(*keys)
               .withColumn("_mid", F.monotonically_increasing_id()))
    stamped = materialize(stamped)
    pid = F.shiftrightunsigned(F.col("_mid"), LOW_BITS)
    local = F.col("_mid").bitwiseAND(F.lit((1 << LOW_BITS) - 1))
    stamped = stamped.withColumn("_pid", pid).withColumn("_local", local)

    counts = stamped.groupBy("_pid", *group_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    w = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    renamed = {g: f"_og{i}" for i, g in enumerate(group_cols)}
    offsets = counts.select(F.col("_pid").alias("_opid"), *[F.col(g).alias(renamed[g]) for g in group_cols],
                            "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                            F.sum("_n").over(whole).alias("_gsize"))
    offsets = materialize(offsets)
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    # Null-safe keys: a null group is a group of its own, as in a window.
    cond = [F.col("_pid") == F.col("_opid")] + [F.col(g).eqNullSafe(F.col(renamed[g])) for g in group_cols]
    joined = stamped.join(offsets, cond, "inner")
    seq = F.col("_before") + F.col("_local") - F.col("_first") + 1
    extra = [F.col("_gsize").cast("bigint").alias(size_col)] if size_col else []
    return joined.select(*df.columns, seq.cast("bigint").alias(out_col), *extra)
