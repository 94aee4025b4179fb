"""Readers for the driver's parquet tables and the small fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plaint import domains as D
from plaint.session import INPUT_PARTITIONS

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


DOMAIN_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("code", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
])


def domains(spark: SparkSession) -> DataFrame:
    """(domain, ord, code, label): 14 fixed rows, safe to broadcast."""
    return spark.createDataFrame(D.domain_rows(), DOMAIN_SCHEMA)


def domain(spark: SparkSession, name: str) -> DataFrame:
    rows = [r for r in D.domain_rows() if r[0] == name]
    return spark.createDataFrame(rows, DOMAIN_SCHEMA)


LEXICON_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("weight", T.DoubleType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("whole_word", T.BooleanType(), False),
])


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(r.rule, r.label, r.weight, r.keyword, r.whole_word) for r in D.lexicon()], LEXICON_SCHEMA)


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows over as many tasks as the session setting ``INPUT_PARTITIONS`` names.

    For inputs whose file splits are too few for CPU-heavy text stages (one small parquet
    file is one task).  The setting is the user's choice, made for a session; without it
    the plan is left as it is, whatever the input's size.

    Catalyst pushes deterministic filters through a round-robin repartition, so a
    selective filter on an expensive expression placed right after ``spread`` would run
    before it; keep such filters behind a join or aggregate (as the intake does).
    """
    wanted = df.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def dealt(df: DataFrame) -> DataFrame:
    """Deals short rows over all tasks of the session, for text stages that cost far more than the rows.

    A parquet file is read by at most one task for each row group, so a large file of few row
    groups would keep such a stage, and what is written from it, in few tasks that grow with
    the input.  ``INPUT_PARTITIONS`` sets the tasks; without it there are as many as after any
    other shuffle, and no fewer than the session has cores.
    """
    spark = df.sparkSession
    if spark.conf.get(INPUT_PARTITIONS, None):
        return spread(df)
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
