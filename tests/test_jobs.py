"""The intake and report jobs end to end on the smallest fixture."""

import datetime as dt

from conftest import SF001
from plaint import jobs
from plaint.operators import store as ST
from plaint.plans import views as V
from plaint.sources import fixtures as FX


def test_intake_then_reports(spark, tmpdir_path):
    raw = FX.complaints_raw(spark, SF001)
    store, quarantine, out = f"{tmpdir_path}/store", f"{tmpdir_path}/quarantine", f"{tmpdir_path}/reports"
    written = jobs.intake(raw, store, quarantine, batch="2024-01-31")
    accepted = V.validated_raw(spark, SF001).filter("ok").count()
    assert written.count() == accepted == ST.read(spark, store).count()
    assert spark.read.parquet(quarantine).count() == raw.count() - accepted
    jobs.intake(raw, store, quarantine, batch="2024-01-31")           # a re-run replaces itself
    assert ST.read(spark, store).count() == accepted
    log = f"{tmpdir_path}/changes"
    some = ST.read(spark, store).orderBy("complaint_id").limit(3).collect()
    changes = [(i, r.complaint_id, dt.datetime(2024, 2, 1), "Closed") for i, r in enumerate(some)] + [(9, some[0].complaint_id, dt.datetime(2024, 2, 2), "Nonsense")]
    jobs.status(spark.createDataFrame(changes, ST.CHANGE_SCHEMA), log, batch="1")
    assert spark.read.parquet(f"{log}/_rejects").count() == 1
    paths = jobs.reports(spark, store, out, dt.datetime(2024, 1, 31), log)
    assert spark.read.parquet(paths["kpi_summary"]).first().closed == 3
    assert spark.read.parquet(paths["kpi_summary"]).first().total == accepted
    assert spark.read.parquet(paths["week_over_week"]).count() == 4
    assert spark.read.option("header", True).csv(paths["csv_report"]).count() == accepted
