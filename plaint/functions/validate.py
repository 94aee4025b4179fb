"""Complaint validation: first failing rule wins, masked text only when accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions.text import collapse_blanks, letter_count, mask_cards, ustrip

ERROR_CODES = ["empty", "too_short", "too_long", "no_words"]


def _error_code(raw: Column, cleaned: Column) -> Column:
    n = F.length(cleaned)
    return (
        F.when(raw.isNull() | (cleaned == ""), F.lit("empty"))
        .when(n < D.MIN_LENGTH, F.lit("too_short"))
        .when(n > D.MAX_LENGTH, F.lit("too_long"))
        .when(letter_count(cleaned) < D.MIN_LETTERS, F.lit("no_words"))
    )


def error_message(code: Column, cleaned: Column) -> Column:
    """The user-facing message; the too-long one embeds the length."""
    return (
        F.when(code == "empty", F.lit(D.MSG_EMPTY))
        .when(code == "too_short", F.lit(D.MSG_SHORT))
        .when(code == "too_long",
              F.concat(F.lit(D.MSG_LONG_HEAD), F.length(cleaned).cast("string"), F.lit(D.MSG_LONG_TAIL)))
        .otherwise(F.lit(""))
    )


def validate(df: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Add ``ok, cleaned, error_code, error`` to ``df``.

    Two projections: the whitespace clean-up is computed once, then the CASE chain
    reads it (Catalyst keeps the regexp from being duplicated into every branch).
    ``ok`` also names the task, whose number is never negative: a filter on it then
    stays above these projections.  Pushed into the scan or the join below, it would hold
    the regexps once for each time the CASE chain names the cleaned text.
    """
    raw = F.col(text_col)
    staged = df.withColumn("_clean0", collapse_blanks(ustrip(raw)))
    code = _error_code(raw, F.col("_clean0"))
    staged = staged.withColumn("error_code", code)
    return (
        staged.withColumn("ok", F.col("error_code").isNull() & (F.spark_partition_id() >= 0))
        .withColumn("cleaned", F.when(F.col("ok"), mask_cards(F.col("_clean0"))).otherwise(F.lit("")))
        .withColumn("error", error_message(F.col("error_code"), F.col("_clean0")))
        .drop("_clean0")
    )

