"""The complaint store as a parquet table plus an append-only status-change log.

* Layout: ``<path>`` partitioned by ``year`` (from ``created_at``) and ``batch`` (the
  load that wrote the rows); ``created_at`` is TIMESTAMP_NTZ at whole seconds.  A batch
  is written with dynamic partition overwrite, so replaying it (a retried streaming
  micro-batch, a re-run job) replaces its own rows instead of duplicating them; a row
  keeps the ID that its source key was given in the batch before.  ``read`` and ``lookup``
  prune by ``year``; inside a year rows lie in the order of IDs, with bloom filters on them,
  so that a lookup skips the row groups of other IDs.
* Every row gets an ID of its own: rows that repeat a source key are told apart by an
  occurrence number, rows without one by their content.
* One writer per table; IDs continue from the stored per-year maximum: the high-water
  marks, and the rows of batches that have none (a load that died between its two writes).
* Status changes are appended to a log and the current status is the latest valid change
  per complaint (``max_by``, partial-aggregated, so a hot complaint does not pile up in one
  task).  ``merge_status`` folds the log into the rows, rewriting only the partitions that
  hold a changed complaint.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaint import domains as D
from plaint.functions.respond import label_of
from plaint.functions.text import ustrip
from plaint.operators.ids import ID_PREFIX, assign_ids, max_seq_per_year
from plaint.operators.sequence import sequence_within
from plaint.session import materialize

COMPLAINT_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("customer_name", T.StringType(), True),
    T.StructField("complaint", T.StringType(), False),
    T.StructField("category", T.StringType(), False),
    T.StructField("priority", T.StringType(), False),
    T.StructField("sentiment", T.StringType(), False),
    T.StructField("response", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("mode", T.StringType(), False),
])
COLUMNS = [f.name for f in COMPLAINT_SCHEMA.fields]
STORED_SCHEMA = T.StructType(COMPLAINT_SCHEMA.fields + [T.StructField("source_key", T.StringType(), True),
                                                       T.StructField("occurrence", T.LongType(), True),
                                                       T.StructField("year", T.IntegerType(), True),
                                                       T.StructField("batch", T.StringType(), True)])
#: Rows are sorted by ID in a file; these let a reader skip row groups by their bloom filters.
LAYOUT = {"parquet.bloom.filter.enabled#complaint_id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
CREATED_FORMAT = "yyyy-MM-dd HH:mm:ss"


def empty(spark: SparkSession) -> DataFrame:
    """The typed empty table: every operator is total on it."""
    return spark.createDataFrame([], COMPLAINT_SCHEMA)


def read(spark: SparkSession, path: str, since: dt.datetime | None = None) -> DataFrame:
    """The stored complaints; ``since`` keeps the rows after it and prunes the years before."""
    df = read_stored(spark, path)
    if since is not None:
        df = df.where((F.col("year") >= since.year) & (F.col("created_at") > F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")))
    return df.select(*COLUMNS)


def lookup(spark: SparkSession, path: str, complaint_id: str) -> DataFrame:
    """Point lookup in the stored table: 0 or 1 row, reading only the year that the ID names."""
    wanted = complaint_id.strip(D.WHITESPACE).upper()
    year = wanted.removeprefix(ID_PREFIX).partition("-")[0]
    df = read_stored(spark, path)
    return df.where((F.col("year") == F.lit(int(year) if year.isascii() and year.isdigit() else None))
                    & (F.col("complaint_id") == wanted)).select(*COLUMNS)


def append(df: DataFrame, path: str, batch: str, key: str = "source_id") -> DataFrame:
    """Assign IDs after the stored maximum and write the rows as load ``batch``.

    ``df`` carries the complaint columns except ``complaint_id`` plus a ``key`` (arrival
    order for ties in ``created_at``).  Defaults: status Open, mode ai, name ''.  Each row
    gets one ID, also where its key is null or repeated.  Rows already stored under the same
    ``batch`` are replaced and keep their IDs, also when other batches were loaded since; new
    ones continue after every ID ever issued.  Returns the written rows.

    ``df`` is evaluated once: its rows go to the checkpoint folder before they are told
    apart, numbered and written.
    """
    spark = df.sparkSession
    staged = _occurrences(materialize(_staged(df, key)))
    issued = read_stored(spark, path).where(F.col("batch") == batch).select(
        "source_key", F.coalesce("occurrence", F.lit(1)).alias("occurrence"), "complaint_id")
    maxima = materialize(_stored_maxima(spark, path))
    fresh, kept = staged, None
    if not issued.isEmpty():
        issued = materialize(issued)
        fresh = staged.join(issued, ["source_key", "occurrence"], "left_anti")
        kept = staged.join(issued, ["source_key", "occurrence"])
    rows = assign_ids(fresh, key=["_key", "_content", "_row"], maxes=maxima)
    rows = rows if kept is None else rows.unionByName(kept)
    years = {r[0] for r in staged.select(F.year("created_at")).distinct().collect()}
    write_rows(rows.withColumn("year", F.year("created_at")).withColumn("batch", F.lit(batch)), path)
    _drop_years(spark, path, batch, years)
    written = read_stored(spark, path).where(F.col("batch") == batch)
    # High-water marks: one (year, max) row per year, never lower than any ID issued before.
    marks = max_seq_per_year(written).unionByName(maxima).groupBy("_year").agg(F.max("_max").alias("_max"))
    (marks.withColumn("batch", F.lit(batch))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch").parquet(f"{path.rstrip('/')}/_hwm"))
    return written.select(*COLUMNS)


def _staged(df: DataFrame, key: str) -> DataFrame:
    """The stored columns of new rows, and what orders them (``_key``, ``_content``)."""
    rows = df.select(
        F.col(key).alias("_key"),
        F.date_trunc("second", F.col("created_at")).cast("timestamp_ntz").alias("created_at"),
        ustrip(F.coalesce(F.col("customer_name"), F.lit(""))).alias("customer_name")
        if "customer_name" in df.columns else F.lit("").alias("customer_name"),
        "complaint", "category", "priority", "sentiment", "response",
        (F.col("status") if "status" in df.columns else F.lit("Open")).alias("status"),
        (F.col("mode") if "mode" in df.columns else F.lit("ai")).alias("mode"),
    )
    content = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != "_key"])), 256)
    rows = rows.withColumn("_content", content)
    return rows.withColumn("source_key", F.coalesce(F.col("_key").cast("string"), F.concat(F.lit("#"), "_content")))


def _occurrences(staged: DataFrame) -> DataFrame:
    """Adds ``occurrence``: 1, 2, ... for the rows of one ``source_key``, the same in a replay.

    Only repeated keys are numbered, and those over many tasks, so that one key may hold a
    large share of the rows.  Rows that are equal in all columns are interchangeable.
    """
    staged = staged.withColumn("_row", F.monotonically_increasing_id())  # over a checkpoint: fixed
    repeated = materialize(staged.groupBy("source_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("source_key"))
    if repeated.isEmpty():
        return staged.withColumn("occurrence", F.lit(1).cast("bigint"))
    once = staged.join(repeated, "source_key", "left_anti").withColumn("occurrence", F.lit(1).cast("bigint"))
    again = sequence_within(staged.join(repeated, "source_key", "left_semi"), ["source_key"],
                            ["created_at", "_content", "_row"], out_col="occurrence")
    return once.unionByName(again)


def write_rows(rows: DataFrame, path: str) -> None:
    """Replaces the (year, batch) partitions that ``rows`` (of STORED_SCHEMA) fall into."""
    (rows.select(*COLUMNS, "source_key", "occurrence", "year", "batch").sortWithinPartitions("year", "batch", "complaint_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**LAYOUT)
     .partitionBy("year", "batch").parquet(path))


def _drop_years(spark: SparkSession, path: str, batch: str, years: set[int]) -> None:
    """Removes the batch's partitions of years that its latest load has no row in."""
    jvm = spark._jvm
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
    found = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/year=*/batch={name}")
    fs = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.globStatus(found) or []:
        year = status.getPath().getParent().getName().partition("=")[2]
        if not (year.isdigit() and int(year) in years):
            fs.delete(status.getPath(), True)


def write_rejects(rejects: DataFrame, path: str, batch: str) -> None:
    """Replaces the quarantined rows of a batch, also by none."""
    name = rejects.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
    rejects.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={name}")


def _stored_maxima(spark: SparkSession, path: str) -> DataFrame:
    """(_year, _max) of every ID issued: the high-water marks, and the rows of batches without any."""
    marks, stored = _read_marks(spark, path), read_stored(spark, path)
    if marks is None:
        return max_seq_per_year(stored)
    marked = marks.select("batch").distinct()
    bare = [r[0] for r in stored.select("batch").distinct().join(marked, "batch", "left_anti").collect()]
    return (marks.select("_year", "_max").unionByName(max_seq_per_year(stored.where(F.col("batch").isin(bare))))
            .groupBy("_year").agg(F.max("_max").alias("_max")))


def _read_marks(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("_year int, _max bigint, batch string").parquet(f"{path.rstrip('/')}/_hwm")
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return None
        raise


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with source key, occurrence, year and batch; none where nothing is stored."""
    try:
        return spark.read.schema(STORED_SCHEMA).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], STORED_SCHEMA)
        raise


def clear(spark: SparkSession, path: str) -> None:
    """Replace the table with the typed empty table."""
    spark.createDataFrame([], STORED_SCHEMA).write.mode("overwrite").partitionBy("year", "batch").parquet(path)


# ------------------------------------------------------------------------------ reads
def newest_first(df: DataFrame) -> DataFrame:
    """Order: ``created_at DESC, complaint_id DESC`` (IDs compared as text)."""
    return df.orderBy(F.col("created_at").desc(), F.col("complaint_id").desc())


def _like_term(term: str) -> str:
    """``%term%`` for a LIKE with no escape character: ``%``/``_`` stay wildcards."""
    return "%" + term.replace("\\", "\\\\") + "%"


def search_predicate(search: str) -> Column | None:
    term = search.strip(D.WHITESPACE) if search else ""
    if not term:
        return None
    like = _like_term(term)
    return (F.col("complaint_id").ilike(like) | F.col("complaint").ilike(like)
            | F.col("customer_name").ilike(like))


def list_complaints(df: DataFrame, categories: Sequence[str] | None = None,
                    priorities: Sequence[str] | None = None, statuses: Sequence[str] | None = None,
                    search: str | None = None, ordered: bool = True) -> DataFrame:
    """Filtered listing: empty lists mean no filter; filters AND-ed; search ORs 3 columns."""
    wanted = {"category": categories, "priority": priorities, "status": statuses}
    out = reduce(DataFrame.where, [F.col(c).isin(list(v)) for c, v in wanted.items() if v], df)
    pred = search_predicate(search or "")
    if pred is not None:
        out = out.filter(pred)
    return newest_first(out) if ordered else out


def get(df: DataFrame, complaint_id: str) -> DataFrame:
    """Point lookup: stripped, case-insensitive (IDs are issued in upper case); 0 or 1 row."""
    return df.filter(F.col("complaint_id") == complaint_id.strip(D.WHITESPACE).upper())


def tracking_card(df: DataFrame) -> DataFrame:
    return df.select(
        "complaint_id", "status",
        label_of(F.col("category"), "category").alias("category_label"),
        F.initcap(F.col("priority")).alias("priority_title"),
        F.date_format("created_at", CREATED_FORMAT).alias("logged"))


def count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------- status log
CHANGE_SCHEMA = "change_id bigint, complaint_id string, changed_at timestamp_ntz, new_status string"


def status_change_rejects(changes: DataFrame) -> DataFrame:
    """Changes to a status outside the domain: kept aside with the error text."""
    bad = ~F.col("new_status").isin(D.STATUSES) | F.col("new_status").isNull()
    return changes.filter(bad).select(
        "change_id", "complaint_id", "new_status",
        F.concat(F.lit("Invalid status: '"), F.col("new_status"), F.lit("'")).alias("error"))


def valid_changes(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("new_status").isin(D.STATUSES))


def latest_status(changes: DataFrame) -> DataFrame:
    """(complaint_id, status, changed_at): the last valid change per complaint."""
    v = valid_changes(changes)
    last = F.max_by(F.struct("new_status", "changed_at"), F.struct("changed_at", "change_id"))
    return v.groupBy("complaint_id").agg(last.alias("_l")).select(
        "complaint_id", F.col("_l.new_status").alias("status"), F.col("_l.changed_at").alias("changed_at"))


def apply_status_updates(complaints: DataFrame, changes: DataFrame) -> DataFrame:
    """Current table state: exact-match IDs take their latest valid status."""
    latest = latest_status(changes).select("complaint_id", F.col("status").alias("_new"))
    j = complaints.join(latest, "complaint_id", "left")
    return j.select(
        *[F.col(c) for c in complaints.columns if c != "status"],
        F.coalesce(F.col("_new"), F.col("status")).alias("status"),
        F.col("status").alias("previous_status"),
        F.col("_new").isNotNull().alias("updated"))


def unmatched_changes(complaints: DataFrame, changes: DataFrame) -> DataFrame:
    """Valid changes whose ID matches no complaint ("not updated")."""
    return valid_changes(changes).join(complaints.select("complaint_id"), "complaint_id", "left_anti").select(
        "change_id", "complaint_id", "new_status")


def append_status_changes(changes: DataFrame, path: str, batch: str) -> None:
    """Adds a load of status changes to the log; changes to an unknown status go to ``<path>/_rejects``."""
    name = changes.sparkSession._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(batch)
    valid_changes(changes).select("change_id", "complaint_id", "changed_at", "new_status").write.mode("overwrite").parquet(
        f"{path.rstrip('/')}/batch={name}")
    write_rejects(status_change_rejects(changes), f"{path.rstrip('/')}/_rejects", batch)


def read_status_changes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGE_SCHEMA).parquet(path)


def current(complaints: DataFrame, changes: DataFrame) -> DataFrame:
    """The complaints with the status that the log leaves them in."""
    return apply_status_updates(complaints, changes).select(*complaints.columns)


def merge_status(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """Folds the log into the stored rows; returns (year, batch, changed) of the partitions rewritten.

    Only the partitions holding a complaint whose status the log alters are written again;
    the files of all others stay.  A changed complaint's year is part of its ID, so the search
    for them reads the IDs and statuses of those years alone.  Merging the same log again
    changes nothing, so a run that died half way is repeated as it is.
    """
    year = F.substring("complaint_id", 5, 4).try_cast("int")
    latest = materialize(latest_status(changes).select("complaint_id", year.alias("year"), F.col("status").alias("_new"))
                         .where("year is not null"))
    stored = read_stored(spark, path)
    years = [r[0] for r in latest.select("year").distinct().collect()]
    of_years = stored.where(F.col("year").isin(years))
    altered = of_years.select("complaint_id", "year", "batch", "status").join(latest, ["complaint_id", "year"]).where("status <> _new")
    touched = materialize(altered.groupBy("year", "batch").agg(F.count(F.lit(1)).alias("changed")))
    parts = touched.select("year", "batch").collect()  # folders of the store, not rows
    if parts:
        here = reduce(Column.__or__, [(F.col("year") == y) & (F.col("batch") == b) for y, b in parts])
        merged = stored.where(here).join(latest, ["complaint_id", "year"], "left")
        merged = materialize(merged.withColumn("status", F.coalesce("_new", "status")))
        write_rows(merged.repartitionByRange("year", "batch", "complaint_id"), path)
    return touched
