"""Batch jobs as a user submits them: intake into the store, reports from the store.

    spark-submit -m plaint.jobs intake  --raw <path> --store <path> --quarantine <path> --batch <id> [--format json] [--index]
    spark-submit -m plaint.jobs status  --raw <parquet> --changes <path> --batch <id>
    spark-submit -m plaint.jobs reports --store <path> --out <dir> --as-of 2024-01-31T00:00:00 [--changes <path>]

Raw input columns: ``source_id, ts, customer_name, raw_text`` (a unique key, arrival time,
optional name, the complaint text), as parquet or as JSON or CSV lines; lines that do not
parse go to ``<quarantine>_lines`` with a reason.  Every step is one of the library's DataFrame plans;
outputs are parquet tables (and one formula-safe CSV report) under ``--out``.
"""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from plaint.functions.validate import validate
from plaint.operators import analytics as A
from plaint.operators import export as X
from plaint.operators import search_index as SX
from plaint.operators import store as ST
from plaint.plans.views import accepted, label_accepted, rejected
from plaint.session import materialize
from plaint.sources.fixtures import ntz
from plaint.sources.tolerant import read_complaints


def intake(raw: DataFrame, store_path: str, quarantine_path: str, batch: str, index: bool = False) -> DataFrame:
    """Validate, quarantine rejects, triage and append accepted complaints as ``batch``.

    Validation and triage run once; with ``index`` the batch joins the keyword-search index.
    """
    validated = materialize(validate(raw, "raw_text").select(
        "source_id", "ts", "customer_name", "ok", "error_code", "error", "cleaned"))
    ST.write_rejects(rejected(validated), quarantine_path, batch)
    labelled = label_accepted(accepted(validated), seeded_status=False)
    written = ST.append(labelled.drop("status"), store_path, batch=batch)
    if index:
        SX.index_batch(raw.sparkSession, store_path, batch)
    return written


def status(changes: DataFrame, changes_path: str, batch: str) -> None:
    """Append a load of status changes to the log that the reports fold in."""
    ST.append_status_changes(changes, changes_path, batch)


def reports(spark: SparkSession, store_path: str, out_dir: str, as_of: dt.datetime,
            changes_path: str | None = None) -> dict[str, str]:
    """Write every dashboard report of the stored complaints in their current status; returns name -> path."""
    df = ST.read(spark, store_path)
    if changes_path:
        df = ST.current(df, ST.read_status_changes(spark, changes_path))
    now = ntz(as_of)
    out = out_dir.rstrip("/")
    frames = {
        "kpi_summary": A.kpi_summary(df),
        "distributions": A.all_distributions(df),
        "daily_trend": A.daily_trend(df),
        "week_over_week": A.category_trend(df, now),
        "insights": A.insights(df, now),
        "stats_text": A.stats_text(df, now),
        "ageing_by_status": A.ageing_by_status(df, now),
    }
    paths = {}
    for name, frame in frames.items():
        paths[name] = f"{out}/{name}"
        frame.write.mode("overwrite").parquet(paths[name])
    console = ST.newest_first(df).select("complaint_id", "created_at", "category", "priority", "sentiment",
                                         "status", "complaint")
    paths["csv_report"] = X.write_csv_report(console, out, as_of)
    return paths


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="plaint.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    a = sub.add_parser("intake")
    a.add_argument("--raw", required=True)
    a.add_argument("--store", required=True)
    a.add_argument("--quarantine", required=True)
    a.add_argument("--batch", required=True)
    a.add_argument("--format", choices=["parquet", "json", "csv"], default="parquet")
    a.add_argument("--index", action="store_true")
    r = sub.add_parser("reports")
    r.add_argument("--store", required=True)
    r.add_argument("--out", required=True)
    r.add_argument("--as-of", required=True, type=dt.datetime.fromisoformat)
    r.add_argument("--changes")
    c = sub.add_parser("status")
    c.add_argument("--raw", required=True)
    c.add_argument("--changes", required=True)
    c.add_argument("--batch", required=True)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"plaint-{args.job}").getOrCreate()
    if args.job == "intake":
        raw = spark.read.parquet(args.raw) if args.format == "parquet" else None
        if raw is None:
            parsed = read_complaints(spark, args.raw, args.format)
            ST.write_rejects(parsed.rejects, f"{args.quarantine.rstrip('/')}_lines", args.batch)
            raw = parsed.rows
        intake(raw, args.store, args.quarantine, args.batch, args.index)
    elif args.job == "status":
        status(spark.read.parquet(args.raw), args.changes, args.batch)
    else:
        reports(spark, args.store, args.out, args.as_of, args.changes)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
