"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  ``run`` writes each stage's result as Parquet in the folder that the
cluster names in ``spark.checkpoint.dir`` and reads it again.  Stages work on every row they
are given: rows with null columns stay unless their text is the reason to go, rows that
repeat a doc_id are told apart by their texts, an empty table stays empty, and further
columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaint.llm import bpe, decontaminate, language, minhash, pii
from plaint.llm.catalog import tokenizer
from plaint.llm.common import bounded, table
from plaint.operators.sequence import sequence_within
from plaint.session import checkpoint_dir, materialize

#: Near-duplicates share this many percent of their shingles of this many words.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that no learned language fits."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group; rows with a null id are no duplicates.

    Rows that share an id are told apart by their texts: a group that holds one of them says
    nothing about the others, and of equal rows one stays.
    """
    named = docs.where("doc_id is not null")
    repeated = named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        groups = minhash.near_duplicates(named, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
        gone = materialize(groups.where("not kept").select("doc_id"))
        return docs.join(bounded(gone), "doc_id", "left_anti").select(docs.columns)
    # Rows numbered in the order of (id, text) take the place of the ids.
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rows = sequence_within(named.withColumn("_text", text), [], ["doc_id", "_text"], out_col="_row")
    groups = minhash.near_duplicates(rows, id_col="_row", words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    gone = materialize(groups.where("not kept").select(F.col("doc_id").alias("_row")))
    left = rows.join(bounded(gone), "_row", "left_anti").select(docs.columns)
    return left.union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a word inside a benchmark window."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind; n_chars follows."""
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each document."""
    return bpe.encode(docs, *tokenizer(), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("byte_bpe", encode),
]

#: The first stage and the fourth learn models, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``; a stage's folder goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return docs
