"""Rule triage and model-output repair/fallback as DataFrame plans.

``rule_triage`` is one narrow stage: no shuffle, no Python.  ``triage_with_model``
joins model outputs back to the complaints by key; the model output table is as large
as the complaint table, so it carries no broadcast hint — AQE picks the strategy from
the runtime sizes (sort-merge at scale, broadcast only when a side turns out small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions import rules
from plaint.functions.respond import build_response, ensure_signature, normalize_label


def rule_triage(df: DataFrame, text_col: str = "complaint", company: str = D.DEFAULT_COMPANY) -> DataFrame:
    """Add ``category, priority, sentiment, response, mode='offline'`` from the rules."""
    staged = rules.with_rule_labels(df, text_col, prefix="_r_")
    return (
        staged.withColumn("category", F.col("_r_category"))
        .withColumn("priority", F.col("_r_priority"))
        .withColumn("sentiment", F.col("_r_sentiment"))
        .withColumn("response", build_response(F.col("category"), F.col("sentiment"), company))
        .withColumn("mode", F.lit("offline"))
        .drop("_r_category", "_r_priority", "_r_sentiment", "_r_amount")
    )


def repair_labels(df: DataFrame, text_col: str, raw_category: str = "raw_category",
                  raw_priority: str = "raw_priority", raw_sentiment: str = "raw_sentiment") -> DataFrame:
    """Per-step fallback: an unparseable label is replaced by the rule label.

    Priority's rule fallback uses the *repaired* category.  Adds ``category, priority,
    sentiment`` and ``format_repairs`` (how many of the three steps needed the rules).
    """
    staged = df.select(
        "*",
        normalize_label(F.col(raw_category), D.CATEGORIES).alias("_n_cat"),
        normalize_label(F.col(raw_priority), D.PRIORITIES).alias("_n_pri"),
        normalize_label(F.col(raw_sentiment), D.SENTIMENTS).alias("_n_sen"),
        F.lower(F.col(text_col)).alias("_lt"),
    )
    lt = F.col("_lt")
    scores = {c: rules.category_score(lt, c) for c in D.CATEGORIES}
    staged = staged.withColumn("category", F.coalesce(F.col("_n_cat"), rules.category_from_scores(scores)))
    staged = staged.withColumn(
        "priority",
        F.coalesce(F.col("_n_pri"), rules.priority(F.col("category"), lt, rules.amount(F.col(text_col)))))
    staged = staged.withColumn("sentiment", F.coalesce(F.col("_n_sen"), rules.sentiment(lt)))
    repairs = sum(F.col(c).isNull().cast("int") for c in ("_n_cat", "_n_pri", "_n_sen"))
    return staged.withColumn("format_repairs", repairs).drop("_n_cat", "_n_pri", "_n_sen", "_lt")


def triage_with_model(complaints: DataFrame, outputs: DataFrame, key: str | list[str] = "complaint_id",
                      text_col: str = "complaint", company: str = D.DEFAULT_COMPANY) -> DataFrame:
    """Join model outputs ``(key, call_ok, raw_category, raw_priority, raw_sentiment, raw_response)``.

    A missing or failed call gives the full rule result with ``mode='offline'`` and the
    warning; a successful call gives repaired labels, the signed reply, ``mode='ai'``.
    """
    joined = complaints.join(outputs, key, "left")
    called = F.coalesce(F.col("call_ok"), F.lit(False))
    # The rules run once: an unusable label takes theirs, except priority, which depends on the
    # category; its cues and amount are looked at again only where the category differs.
    ruled = rule_triage(joined, text_col, company)
    names = {"category": D.CATEGORIES, "priority": D.PRIORITIES, "sentiment": D.SENTIMENTS}
    given = ruled.select("*", *[normalize_label(F.col(f"raw_{n}"), values).alias(f"_n_{n}") for n, values in names.items()])
    lowered = F.lower(F.col(text_col))
    category = F.coalesce("_n_category", "category")
    both = given.select(
        "*", category.alias("_m_cat"), F.coalesce("_n_sentiment", "sentiment").alias("_m_sen"),
        F.coalesce("_n_priority", F.when(category == F.col("category"), F.col("priority")).otherwise(
            rules.priority(category, lowered, rules.amount(F.col(text_col))))).alias("_m_pri"),
        sum(F.col(f"_n_{n}").isNull().cast("int") for n in names).alias("format_repairs"))

    def pick(model_value, rule_value):
        return F.when(called, model_value).otherwise(rule_value)

    return both.select(
        *complaints.columns,
        pick(F.col("_m_cat"), F.col("category")).alias("category"),
        pick(F.col("_m_pri"), F.col("priority")).alias("priority"),
        pick(F.col("_m_sen"), F.col("sentiment")).alias("sentiment"),
        pick(ensure_signature(F.trim(F.col("raw_response"), F.lit(D.WHITESPACE)), company),
             F.col("response")).alias("response"),
        pick(F.lit("ai"), F.lit("offline")).alias("mode"),
        pick(F.lit(None).cast("string"), F.lit(D.FALLBACK_WARNING)).alias("warning"),
        pick(F.col("format_repairs"), F.lit(0)).alias("format_repairs"),
    )
