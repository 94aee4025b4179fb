"""Stream = batch for the intake, window and status-fold jobs (availableNow)."""

import datetime as dt
import time
from functools import partial

from pyspark.sql import functions as F

from conftest import SF001
from plaint.operators import analytics as A
from plaint.operators import store as ST
from plaint.plans import views as V
from plaint.sources import fixtures as FX
from plaint.streaming import intake as S


def test_stream_intake_equals_batch(spark, tmpdir_path):
    q = S.start_intake(S.raw_complaint_stream(spark, SF001), f"{tmpdir_path}/store", f"{tmpdir_path}/quarantine",
                       f"{tmpdir_path}/ckpt")
    q.awaitTermination(300)
    got = ST.read(spark, f"{tmpdir_path}/store")
    want = V.complaints(spark, SF001)
    cols = ["complaint_id", "created_at", "customer_name", "complaint", "category", "priority", "sentiment",
            "response", "mode"]
    assert got.count() == want.count() > 0
    assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0
    rejected = spark.read.parquet(f"{tmpdir_path}/quarantine")
    assert rejected.count() == V.validated_raw(spark, SF001).filter("NOT ok").count()


def _memory(df, name, mode="complete"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name)


def test_daily_windows_equal_batch_trend(spark):
    stream = V.triage_raw(S.raw_complaint_stream(spark, SF001))
    got = {r.day: r.complaints for r in _memory(S.daily_counts(stream), "daily_t").collect()}
    want = {r.day: r.complaints for r in A.daily_trend(V.complaints_triaged(spark, SF001)).collect()
            if r.complaints > 0}
    assert got == want


def test_rolling_week_window_matches_week_report(spark):
    stream = V.triage_raw(S.raw_complaint_stream(spark, SF001))
    got = _memory(S.rolling_category_counts(stream), "rolling_t")
    end = dt.datetime(2024, 1, 31)
    last = {r.category: r.n for r in got.filter(F.col("window_end") == F.lit(end)).collect()}
    want = {r.category: r.last_7 for r in A.week_over_week_counts(V.complaints_triaged(spark, SF001), FX.as_of()).collect()
            if r.last_7 > 0}
    assert last == want


def test_status_fold_equals_batch_latest(spark, tmpdir_path):
    changes = FX.changes_from_events(S.events_stream(spark, SF001))
    q = S.start_status_fold(changes, f"{tmpdir_path}/state", f"{tmpdir_path}/ckpt2")
    q.awaitTermination(300)
    got = S.latest_status_table(spark, f"{tmpdir_path}/state")
    want = ST.latest_status(FX.status_changes(spark, SF001))
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_status_fold_across_micro_batches(spark, tmpdir_path):
    changes = FX.status_changes(spark, SF001)
    src = f"{tmpdir_path}/changes"
    # two files, later changes second: each becomes its own micro-batch
    changes.filter("change_id % 2 = 0").coalesce(1).write.parquet(f"{src}/part=a")
    changes.filter("change_id % 2 = 1").coalesce(1).write.parquet(f"{src}/part=b")
    stream = (spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = S.start_status_fold(stream, f"{tmpdir_path}/state", f"{tmpdir_path}/ckpt3")
    q.awaitTermination(300)
    assert spark.read.parquet(f"{tmpdir_path}/state").select("batch").distinct().count() >= 2
    got = S.latest_status_table(spark, f"{tmpdir_path}/state")
    want = ST.latest_status(changes)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_windows_take_late_rows_inside_the_watermark_only(spark, tmpdir_path):
    src = f"{tmpdir_path}/late"
    batches = [["2024-01-02 10:00:00", "2024-01-09 08:00:00", "2024-01-10 12:00:00"],
               ["2024-01-09 23:00:00"],  # late, inside the watermark of one day
               ["2024-01-11 00:00:00", "2024-01-02 11:00:00"]]  # the second is too late: Spark drops by the watermark of the batch before
    for i, times in enumerate(batches):
        df = spark.createDataFrame([(t,) for t in times], "t string").selectExpr("cast(t as timestamp_ntz) as created_at")
        df.coalesce(1).write.parquet(f"{src}/part={i}")
        time.sleep(1.1)  # the file source takes older files first
    stream = (spark.readStream.schema("created_at timestamp_ntz").option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = S.start_windows(S.daily_counts(stream), f"{tmpdir_path}/days", f"{tmpdir_path}/ckpt4")
    q.awaitTermination(300)
    got = {r.day.day: r.complaints for r in S.current_windows(spark, f"{tmpdir_path}/days", "complaints").collect()}
    assert got == {2: 1, 9: 2, 10: 1, 11: 1}
    before = S.current_windows(spark, f"{tmpdir_path}/days", "complaints").collect()
    S.compact(spark, f"{tmpdir_path}/days", partial(S.newest_windows, value="complaints"))
    assert sorted(S.current_windows(spark, f"{tmpdir_path}/days", "complaints").collect()) == sorted(before)


def test_compacted_deltas_keep_the_latest_status(spark, tmpdir_path):
    path = f"{tmpdir_path}/deltas"

    def write(batch, rows):
        S._write_delta(path)(spark.createDataFrame(rows, "complaint_id string, status string, changed_at string, change_id long")
                             .withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz")), batch)

    def state():
        return {r.complaint_id: r.status for r in S.latest_status_table(spark, path).collect()}

    write(0, [("A", "Open", "2024-01-01 00:00:00", 1), ("B", "Open", "2024-01-01 00:00:00", 2)])
    write(1, [("A", "Closed", "2024-01-03 00:00:00", 4), ("C", "Open", "2024-01-01 00:00:00", 3)])
    S.compact(spark, path, S.newest_status)
    assert {r.batch for r in spark.read.parquet(path).select("batch").distinct().collect()} == {0, 1}
    write(2, [("A", "Open", "2024-01-02 00:00:00", 5), ("B", "Closed", "2024-01-04 00:00:00", 6)])
    want = {"A": "Closed", "B": "Closed", "C": "Open"}
    assert state() == want
    for _ in range(2):
        S.compact(spark, path, S.newest_status)
        assert state() == want
        assert {r.batch for r in spark.read.parquet(path).select("batch").distinct().collect()} == {1, 2}
    write(2, [("B", "Open", "2024-01-04 00:00:00", 7)])  # the newest batch is written again
    assert state() == {"A": "Closed", "B": "Open", "C": "Open"}


def _parts(spark, src, batches, schema, build):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).selectExpr(*build).coalesce(1).write.parquet(f"{src}/part={i}")
        time.sleep(1.1)  # the file source takes older files first
    return (spark.readStream.schema(spark.read.parquet(f"{src}/part=0").schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(src))


TIMES = [["2024-01-02 10:00:00", "2024-01-09 08:00:00", "2024-01-10 12:00:00"],
         ["2024-01-09 23:00:00", "2024-01-08 22:00:00", "2024-01-08 21:00:00"],  # the first is in time, its day ends after the watermark
         ["2024-01-11 00:00:00", "2024-01-02 11:00:00"]]


def test_late_rows_are_counted_and_kept_aside(spark, tmpdir_path):
    stream = _parts(spark, f"{tmpdir_path}/in", [[(t,) for t in b] for b in TIMES], "t string", ["cast(t as timestamp_ntz) as created_at"])
    args = f"{tmpdir_path}/out", f"{tmpdir_path}/late", f"{tmpdir_path}/ckpt5"
    S.start_checked_daily_counts(stream, *args).awaitTermination(200)
    got = {r.day.day: r.complaints for r in S.checked_daily_counts(spark, args[0]).collect()}
    assert got == {2: 1, 9: 2, 10: 1, 11: 1}
    assert sorted((r.batch, r.n, r.late) for r in S.late_marks(spark, args[0]).collect()) == [(0, 3, 0), (1, 3, 2), (2, 2, 1)]
    late = spark.read.parquet(args[1])
    assert sorted((r.batch, str(r.created_at)) for r in late.collect()) == [
        (1, "2024-01-08 21:00:00"), (1, "2024-01-08 22:00:00"), (2, "2024-01-02 11:00:00")]


def test_chained_panes_equal_sliding_windows(spark, tmpdir_path):
    """Windows that the watermark has passed, from panes chained in the stream and from stored panes."""
    rows = [[(f"2024-01-{d:02d} {h:02d}:30:00", c) for d in days for h, c in ((1, "loan"), (20, "fraud"), (21, "loan"))]
            for days in (range(1, 9), range(9, 20), [31])]
    stream = _parts(spark, f"{tmpdir_path}/in", rows, "t string, category string", ["cast(t as timestamp_ntz) as created_at", "category"])
    chained = {tuple(r) for r in _memory(S.rolling_panes_stream(stream), "chained_t", "append").collect()}
    batch = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmpdir_path}/in")
    want = {tuple(r) for r in S.rolling_category_counts(batch).collect()}
    assert chained and chained <= want
    assert {r for r in want if r[1] <= dt.datetime(2024, 1, 19)} <= chained
    S.start_windows(S.daily_category_counts(stream), f"{tmpdir_path}/panes", f"{tmpdir_path}/ckpt6").awaitTermination(200)
    panes = S.current_windows(spark, f"{tmpdir_path}/panes", "n")
    assert {tuple(r) for r in S.rolling_from_panes(panes).collect()} == want
    assert panes.count() == 20 * 2


def test_state_of_long_closed_complaints_ends(spark, tmpdir_path):
    src, args = f"{tmpdir_path}/in", (f"{tmpdir_path}/state", f"{tmpdir_path}/ckpt7", 1500)
    build = ["c as complaint_id", "s as new_status", "cast(t as timestamp_ntz) as changed_at", "i as change_id"]
    schema = "c string, s string, t string, i long"

    def run(i, rows):
        spark.createDataFrame(rows, schema).selectExpr(*build).coalesce(1).write.parquet(f"{src}/part={i}")
        stream = (spark.readStream.schema(spark.read.parquet(f"{src}/part=0").schema).option("recursiveFileLookup", "true").parquet(src))
        q = S.start_ending_status_fold(stream, *args)
        q.awaitTermination(200)
        time.sleep(2)
        return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1]

    sizes = [run(0, [(f"C{i}", "Closed", "2024-01-01 10:00:00", i) for i in range(20)] + [("A", "Open", "2024-01-01 10:00:00", 50)])]
    sizes.append(run(1, [("A", "In Progress", "2024-01-02 10:00:00", 51), ("C1", "Open", "2024-01-05 10:00:00", 52)]))
    sizes.append(run(2, [("C2", "Open", "2023-01-01 10:00:00", 53), ("A", "Nonsense", "2024-02-02 10:00:00", 54)]))  # older than what has ended
    assert sizes[0] == 21 and sizes[-1] <= 4
    changes = spark.read.option("recursiveFileLookup", "true").parquet(src)
    assert sorted(S.latest_status_table(spark, args[0]).collect()) == sorted(ST.latest_status(changes).collect())
