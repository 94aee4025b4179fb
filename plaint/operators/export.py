"""Exports: formula-safe CSV reports and JSON result files (sinks and sources)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaint.sources.tolerant import Parsed, read_lines

FORMULA_LEADS = ["=", "+", "-", "@"]


def guard(c: Column) -> Column:
    """Prefix ``'`` to text starting with ``= + - @`` (spreadsheet formula injection)."""
    return F.when(F.substring(c, 1, 1).isin(FORMULA_LEADS), F.concat(F.lit("'"), c)).otherwise(c)


def csv_safe(df: DataFrame) -> DataFrame:
    """Guard every string column; other types pass through unchanged."""
    return df.select(*[guard(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType)
                       else F.col(f.name) for f in df.schema.fields])


def report_name(as_of: dt.datetime) -> str:
    return f"complaint_report_{as_of:%Y%m%d_%H%M}.csv"


def write_csv_report(df: DataFrame, folder: str, as_of: dt.datetime) -> str:
    """UTF-8 CSV with header, formula-guarded, in a time-stamped folder; returns the path."""
    path = f"{folder.rstrip('/')}/{report_name(as_of)}"
    (csv_safe(df).write.mode("overwrite").option("header", True).option("escape", '"')
     .option("encoding", "UTF-8").csv(path))
    return path


RECORD_SCHEMA = T.StructType([
    T.StructField("complaint_id", T.LongType()), T.StructField("ok", T.BooleanType()),
    T.StructField("latency_s", T.DoubleType()), T.StructField("category", T.StringType()),
    T.StructField("priority", T.StringType()), T.StructField("sentiment", T.StringType()),
    T.StructField("response", T.StringType()), T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()), T.StructField("tokens_estimated", T.BooleanType()),
    T.StructField("format_repairs", T.IntegerType()),
    T.StructField("checks", T.MapType(T.StringType(), T.BooleanType())), T.StructField("error", T.StringType()),
])
RUN_FIELDS = [T.StructField("key", T.StringType()), T.StructField("label", T.StringType()),
              T.StructField("model", T.StringType()), T.StructField("company", T.StringType()),
              T.StructField("cold_start_s", T.DoubleType()), T.StructField("generated_at", T.StringType()),
              T.StructField("hardware", T.StringType()), T.StructField("endpoint", T.StringType())]
# One JSON line per record with its run's metadata: no run is ever nested into one row.
RESULT_LINE_SCHEMA = T.StructType(RUN_FIELDS + list(RECORD_SCHEMA.fields))
# The nested one-object-per-run layout, readable for small evaluation files.
NESTED_SCHEMA = T.StructType(RUN_FIELDS + [T.StructField("records", T.ArrayType(RECORD_SCHEMA))])


def write_results(records: DataFrame, path: str) -> None:
    """JSON Lines sink: one record per line, run metadata repeated, nested map kept."""
    records.select(*[f.name for f in RESULT_LINE_SCHEMA.fields]).write.mode("overwrite").json(path)


def read_results_checked(spark: SparkSession, path: str) -> Parsed:
    """``read_results`` of lines that may be broken: the records, and the rejected lines with a reason."""
    return read_lines(spark, path, RESULT_LINE_SCHEMA, required=("key", "complaint_id"))


def read_results(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """JSON source with an explicit schema; a missing path gives an empty result."""
    try:
        if nested:
            runs = spark.read.schema(NESTED_SCHEMA).option("multiLine", True).json(path)
            return runs.select(*[f.name for f in RUN_FIELDS], F.inline("records"))
        return spark.read.schema(RESULT_LINE_SCHEMA).json(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], RESULT_LINE_SCHEMA)
        raise
