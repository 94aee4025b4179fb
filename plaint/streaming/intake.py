"""Structured Streaming jobs over the same Column expressions as the batch plans.

* R1 ``start_intake``: raw events -> validation/masking -> rule triage -> store, per
  micro-batch with ``foreachBatch``; each batch is written as its own store partition
  (dynamic overwrite), so a replayed batch id replaces rather than duplicates.
* R2 ``daily_counts`` / R3 ``rolling_category_counts``: event-time windows with a
  watermark; ``start_windows`` runs them in update mode, so late rows inside the watermark
  update their window, later ones are dropped, and closed windows leave the state store.
* R4 ``start_status_fold``: a status-change stream folded by a stateful ``max_by``
  aggregation; each batch writes only the complaints it changed (replays overwrite
  their own partition) and readers fold the deltas.
* ``compact`` folds the deltas of R2-R4 into one partition, so readers need not fold all history.

Streaming needs TIMESTAMP (not TIMESTAMP_NTZ) for watermarks; wall-clock times are read
as UTC explicitly, so results do not depend on the session time zone.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from plaint import jobs
from plaint.operators import store as ST
from plaint.session import materialize
from plaint.sources import fixtures as FX


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over the events table (schema taken from the table, never inferred per file)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("basePath", sf_dir)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{sf_dir}/events*.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def _intake_batch(store_path: str, quarantine_path: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        jobs.intake(batch, store_path, quarantine_path, f"stream-{batch_id:09d}")
    return run


def start_intake(raw_stream: DataFrame, store_path: str, quarantine_path: str, checkpoint: str,
                 available_now: bool = True) -> StreamingQuery:
    """Stream raw complaints into the store; rejects go to the quarantine table."""
    writer = (raw_stream.writeStream.foreachBatch(_intake_batch(store_path, quarantine_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


_EPOCH_NTZ = "1970-01-01 00:00:00"


def _event_time(df: DataFrame, col: str = "created_at") -> DataFrame:
    """TIMESTAMP_NTZ -> TIMESTAMP read as UTC, whatever the session time zone (watermarks
    need TIMESTAMP; a plain cast would shift wall-clock times by the session zone)."""
    micros = F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), F.col(col))
    return df.withColumn("event_time", F.timestamp_micros(micros))


def _as_ntz(ts: Column) -> Column:
    """The inverse of ``_event_time`` for window bounds: TIMESTAMP -> UTC wall clock NTZ."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.lit(_EPOCH_NTZ).cast("timestamp_ntz"))


def daily_counts(triaged: DataFrame, watermark: str = "1 day") -> DataFrame:
    """R2: complaints per day (tumbling 1-day windows), late data within the watermark."""
    t = _event_time(triaged).withWatermark("event_time", watermark)
    return t.groupBy(F.window("event_time", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("complaints")) \
        .select(F.to_date(_as_ntz(F.col("w.start"))).alias("day"), "complaints")


def rolling_category_counts(triaged: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Complaints per category over sliding 7-day windows, advancing daily.

    Windows are ``[start, end)``; the batch week report uses ``(now-7d, +inf)``, so they
    agree only when no row sits on a window edge and none is after ``now``.
    """
    t = _event_time(triaged).withWatermark("event_time", watermark)
    return (t.groupBy(F.window("event_time", "7 days", "1 day").alias("w"), "category")
            .agg(F.count(F.lit(1)).alias("n"))
            .select(_as_ntz(F.col("w.start")).alias("window_start"), _as_ntz(F.col("w.end")).alias("window_end"),
                    "category", "n"))


def daily_category_counts(triaged: DataFrame, watermark: str = "1 day") -> DataFrame:
    """One-day panes: complaints per day and category (R3's first step).

    A row goes into one pane, so what is shuffled and kept in state does not depend on the
    length of the windows that are made of the panes.
    """
    t = _event_time(triaged).withWatermark("event_time", watermark)
    return (t.groupBy(F.window("event_time", "1 day").alias("w"), "category").agg(F.count(F.lit(1)).alias("n"))
            .select(_as_ntz(F.col("w.start")).alias("pane"), "category", "n"))


def rolling_from_panes(panes: DataFrame, days: int = 7) -> DataFrame:
    """(window_start, window_end, category, n) over ``days``-day windows advancing daily, as sums of panes."""
    start = F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.timestamp_add("DAY", -i, F.col("pane"))))
    return (panes.select(start.alias("window_start"), "category", "n").groupBy("window_start", "category").agg(F.sum("n").alias("n"))
            .select("window_start", F.timestamp_add("DAY", F.lit(days), F.col("window_start")).alias("window_end"), "category", "n"))


def rolling_panes_stream(triaged: DataFrame, watermark: str = "1 day", days: int = 7) -> DataFrame:
    """R3 as chained stateful windows, for append mode: one-day panes, then ``days`` of them summed.

    Each window is given once, when the watermark has passed it.
    """
    t = _event_time(triaged).withWatermark("event_time", watermark)
    panes = t.groupBy(F.window("event_time", "1 day").alias("pane"), "category").agg(F.count(F.lit(1)).alias("_n"))
    rolled = panes.groupBy(F.window(F.window_time("pane"), f"{days} days", "1 day").alias("w"), "category").agg(F.sum("_n").alias("n"))
    return rolled.select(_as_ntz(F.col("w.start")).alias("window_start"), _as_ntz(F.col("w.end")).alias("window_end"), "category", "n")


def start_checked_daily_counts(rows: DataFrame, path: str, late_path: str, checkpoint: str, watermark: str = "INTERVAL 1 DAY",
                               available_now: bool = True) -> StreamingQuery:
    """R2 that loses nothing: day counts, and the rows that came too late for them kept aside.

    A batch's watermark is the newest ``created_at`` of all batches before it less
    ``watermark``; a row whose day had ended by then is late: it goes to ``late_path``
    with its batch and is not counted.  Each batch writes its counts, its marks and its late
    rows as partitions of its own, so a replay replaces them and no state is held; read them
    with ``checked_daily_counts`` and ``late_marks``.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = materialize(batch)
        passed = late_marks(spark, path).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        limit = F.lit(passed.isoformat(sep=" ") if passed else None).cast("timestamp_ntz") - F.expr(watermark)
        day = F.to_date("created_at")
        late = F.coalesce(F.date_add(day, 1).cast("timestamp_ntz") <= limit, F.lit(False))
        _write_delta(late_path)(kept.where(late), batch_id)
        _write_delta(f"{path}/days")(kept.where(~late).groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("complaints")), batch_id)
        _write_delta(f"{path}/marks")(kept.agg(F.max("created_at").alias("newest"), F.count(F.lit(1)).alias("n"),
                                               F.count_if(late).alias("late")), batch_id)

    writer = rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def late_marks(spark: SparkSession, path: str) -> DataFrame:
    """(newest, n, late, batch) of each batch of ``start_checked_daily_counts``."""
    try:
        return spark.read.schema("newest timestamp_ntz, n bigint, late bigint, batch bigint").parquet(f"{path}/marks")
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], "newest timestamp_ntz, n bigint, late bigint, batch bigint")
        raise


def checked_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """(day, complaints) over all batches of ``start_checked_daily_counts``."""
    days = spark.read.schema("day date, complaints bigint, batch bigint").parquet(f"{path}/days")
    return days.groupBy("day").agg(F.sum("complaints").alias("complaints"))


def _latest() -> Column:
    return F.max_by(F.struct("status", "changed_at", "change_id"), F.struct("changed_at", "change_id"))


def _write_delta(state_path: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch").parquet(state_path))
    return run


def start_status_fold(changes_stream: DataFrame, state_path: str, checkpoint: str,
                      available_now: bool = True) -> StreamingQuery:
    """Fold a status-change stream into the latest status per complaint.

    A stateful streaming aggregation (``max_by`` per complaint, update mode) keeps one row
    per complaint in the state store; each micro-batch writes only the complaints it
    changed, as its own partition (a replayed batch id overwrites itself).
    """
    valid = ST.valid_changes(changes_stream).select(
        "complaint_id", F.col("new_status").alias("status"), "changed_at", "change_id")
    folded = valid.groupBy("complaint_id").agg(_latest().alias("_l")).select(
        "complaint_id", "_l.status", "_l.changed_at", "_l.change_id")
    writer = (folded.writeStream.outputMode("update").foreachBatch(_write_delta(state_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


STATUS = "complaint_id string, status string, changed_at timestamp_ntz, change_id bigint"


def start_ending_status_fold(changes_stream: DataFrame, state_path: str, checkpoint: str, closed_for_ms: int,
                             available_now: bool = True) -> StreamingQuery:
    """R4 whose state ends: a complaint that is Closed and had no change for ``closed_for_ms`` leaves the state.

    Keyed state holds the last change of each complaint; a batch writes the complaints whose
    last change it moved.  Time is that of arrival, so no change is ever too late; state ends
    when later batches have moved the watermark far enough.  A change that comes after its complaint's state has ended starts a
    new one and is written; readers fold it with the deltas before it (``latest_status_table``),
    so results do not depend on when state ended.
    """
    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        moved, arrived = False, 0
        for frame in frames:
            arrived = max(arrived, int(frame["arrived_ms"].max()))
            for row in frame[["status", "changed_at", "change_id"]].itertuples(index=False):
                row = (row.status, row.changed_at.to_pydatetime(), int(row.change_id))
                if last is None or row[1:] > tuple(last)[1:]:
                    last, moved = row, True
        state.update(tuple(last))
        if last[0] == "Closed":
            state.setTimeoutTimestamp(max(arrived, state.getCurrentWatermarkMs()) + closed_for_ms)
        if moved:
            yield pd.DataFrame([(key[0], *last)], columns=["complaint_id", "status", "changed_at", "change_id"])

    valid = ST.valid_changes(changes_stream).select(
        "complaint_id", F.col("new_status").alias("status"), "changed_at", "change_id").where(
        "complaint_id is not null and changed_at is not null and change_id is not null")
    timed = valid.withColumn("arrived", F.current_timestamp()).withColumn("arrived_ms", F.unix_millis("arrived"))
    folded = timed.withWatermark("arrived", "0 seconds").groupBy("complaint_id").applyInPandasWithState(
        fold, STATUS, STATUS.partition(", ")[2], "update", GroupStateTimeout.EventTimeTimeout)
    writer = (folded.writeStream.outputMode("update").foreachBatch(_write_delta(state_path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def latest_status_table(spark: SparkSession, state_path: str) -> DataFrame:
    """(complaint_id, status, changed_at): the per-batch deltas folded with the same max_by."""
    try:
        deltas = spark.read.parquet(state_path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc) or "UNABLE_TO_INFER" in str(exc):
            return spark.createDataFrame([], "complaint_id string, status string, changed_at timestamp_ntz")
        raise
    return newest_status(deltas).drop("change_id")


def newest_status(deltas: DataFrame) -> DataFrame:
    """The last change of each complaint in the deltas of ``start_status_fold``."""
    return deltas.groupBy("complaint_id").agg(_latest().alias("_l")).select(
        "complaint_id", "_l.status", "_l.changed_at", "_l.change_id")


def raw_complaint_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The raw-complaint projection of the events file stream."""
    return FX.raw_from_events(events_stream(spark, sf_dir, max_files_per_trigger))


def start_windows(agg: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a windowed aggregate as per-batch deltas (update mode, read by ``current_windows``).

    Each micro-batch writes the windows it changed as its own partition; a replayed batch
    overwrites itself.  State holds only windows that the watermark has not passed.
    """
    writer = (agg.writeStream.outputMode("update").foreachBatch(_write_delta(path))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def current_windows(spark: SparkSession, path: str, value: str) -> DataFrame:
    """The newest ``value`` of each window and key of a ``start_windows`` table."""
    return newest_windows(spark.read.parquet(path), value)


def newest_windows(deltas: DataFrame, value: str) -> DataFrame:
    keys = [c for c in deltas.columns if c not in (value, "batch")]
    return deltas.groupBy(*keys).agg(F.max_by(value, "batch").alias(value))


def compact(spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame]) -> None:
    """Fold the deltas at ``path`` (``newest_status``, or ``newest_windows`` with its value) into one partition.

    The newest batch stays as it is, since a restarted stream may write it again; all before
    it are committed and go into the partition of the last of them.  Folding is idempotent:
    a run that dies before it has removed the old partitions leaves the same result, and the
    next run removes them.  Fewer than three batches are left alone.
    """
    deltas = spark.read.parquet(path)
    batches = sorted(r[0] for r in deltas.select("batch").distinct().collect())
    if len(batches) < 3:
        return
    *old, last, _ = batches
    folded = materialize(fold(deltas.where(F.col("batch") <= last)))
    _write_delta(path)(folded, last)
    jvm = spark._jvm
    for batch in old:
        gone = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/batch={batch}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
