"""Tolerant reads of JSON and CSV lines: what does not parse goes aside with a reason.

Each line is read as text and parsed once; a bad line never ends a job and never comes back
as a row of nulls.  ``rows`` and ``rejects`` are two filters of the same parsed lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"
TIME_SHAPE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
#: A raw complaint as files carry it: the time is text until it has been checked.
RAW_COMPLAINT = T.StructType([T.StructField("source_id", T.LongType()), T.StructField("ts", T.StringType()),
                              T.StructField("customer_name", T.StringType()), T.StructField("raw_text", T.StringType())])


@dataclass
class Parsed:
    """``rows`` have the wanted columns; ``rejects`` are (file, line, reason)."""

    rows: DataFrame
    rejects: DataFrame


def wall_clock(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` as TIMESTAMP_NTZ; null where it is no such time."""
    return F.when(text.rlike(TIME_SHAPE), text.try_cast("timestamp_ntz"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], "value string, file string")
        raise


def read_lines(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json", times: tuple[str, ...] = (),
               required: tuple[str, ...] = ()) -> Parsed:
    """Parses the lines of ``path`` (JSON objects, or CSV without line breaks in fields).

    ``times`` names string columns that hold wall-clock times: they come as TIMESTAMP_NTZ.
    ``required`` names columns that may not be null.  The first fault is the reason:
    'malformed', 'bad time: <column>', 'missing: <column>'.  Blank lines are skipped; a
    missing path has no lines.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = _lines(spark, path).where(F.trim("value") != "")
    value = F.col("value")
    parsed = F.from_json(value, wide, options) if kind == "json" else F.from_csv(
        value, wide.simpleString()[len("struct<"):-1].replace(":", " "), {**options, "escape": '"'})
    staged = lines.select("file", "value", parsed.alias("_r"))
    at = {n: F.col(f"_r.{n}") for n in schema.names}
    faults = [F.when(F.col("_r").isNull() | F.col(f"_r.{CORRUPT}").isNotNull(), F.lit("malformed"))]
    faults += [F.when(at[n].isNotNull() & wall_clock(at[n]).isNull(), F.lit(f"bad time: {n}")) for n in times]
    faults += [F.when(at[n].isNull(), F.lit(f"missing: {n}")) for n in required]
    checked = staged.withColumn("reason", F.coalesce(*faults))
    columns = [(wall_clock(at[n]) if n in times else at[n]).alias(n) for n in schema.names]
    return Parsed(checked.where("reason is null").select(*columns),
                  checked.where("reason is not null").select("file", F.col("value").alias("line"), "reason"))


def read_complaints(spark: SparkSession, path: str, kind: str = "json") -> Parsed:
    """Raw complaints (source_id, ts, customer_name, raw_text) from files of lines, ready for the intake."""
    return read_lines(spark, path, RAW_COMPLAINT, kind, times=("ts",), required=("ts",))
