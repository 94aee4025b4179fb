"""The whole model path of a complaint in one narrow stage: ask, repair, ask again, assemble.

Category first, then priority (from the repaired category) and sentiment, then the reply
(from all three repaired labels).  Each step is one Arrow-batched call over a row's own
columns, so nothing is shuffled, joined or asked twice; prompts, repairs and the rule
fallback stay Columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaint import domains as D
from plaint.functions import rules
from plaint.functions.respond import ensure_signature, normalize_label
from plaint.functions.text import ustrip
from plaint.operators.prompts import step_prompt
from plaint.operators.scorer import ask
from plaint.operators.triage import rule_triage

ANSWER = "answer string, input_tokens bigint, output_tokens bigint, error string"
STEPS = ["category", "priority", "sentiment", "response"]


def _caller(answer_fn: Callable[[str, str, str], tuple[str, int, int]], step: str):
    @F.arrow_udf(ANSWER)
    def call(system: pa.Array, human: pa.Array) -> pa.Array:
        rows = [(None, 0, 0, None) if h is None else ask(answer_fn, step, s, h) for s, h in zip(system.to_pylist(), human.to_pylist())]
        kinds = {"answer": pa.string(), "input_tokens": pa.int64(), "output_tokens": pa.int64(), "error": pa.string()}
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return call.asNondeterministic()  # a model call is never repeated or moved by the optimizer


def model_triage(complaints: DataFrame, answer_fn: Callable[[str, str, str], tuple[str, int, int]],
                 text_col: str = "complaint", company: str = D.DEFAULT_COMPANY) -> DataFrame:
    """Adds category, priority, sentiment, response, mode, warning, format_repairs, tokens, calls, error.

    ``answer_fn(step, system, human) -> (answer, in_tokens, out_tokens)``.  An unusable label
    takes the rule's (priority by the repaired category).  A failed step ends the calls of its
    complaint: it gets the rule result, mode 'offline', the warning and the first error.
    ``complaints`` must not have columns of the added names.
    """
    names = ["category", "priority", "sentiment", "response"]
    ruled = rule_triage(complaints, text_col, company).select(
        *complaints.columns, *[F.col(n).alias(f"_r_{n}") for n in names])
    text = F.col(text_col)

    def step(name: str, wanted: Column, **labels: Column) -> Column:
        system, human = step_prompt(name, {"text": text, "company": company, **labels})
        return _caller(answer_fn, name)(system, F.when(wanted, human)).alias(f"_{name}")

    def fine(*steps: str) -> Column:
        return F.coalesce(*[F.col(f"_{s}.error") for s in steps], F.lit(None)).isNull()

    def label(name: str, allowed: list[str], rule: Column) -> Column:
        return F.coalesce(normalize_label(F.col(f"_{name}.answer"), allowed), rule)

    cat, pri, sen = F.col("_m_category"), F.col("_m_priority"), F.col("_m_sentiment")
    df = ruled.select("*", step("category", F.lit(True)))
    df = df.withColumn("_m_category", label("category", D.CATEGORIES, F.col("_r_category")))
    # Both in one select: Spark asks them in one pass, so a task keeps three Python workers, not four.
    df = df.select("*", step("priority", fine("category"), cat=cat), step("sentiment", fine("category")))
    by_rule = F.when(cat == F.col("_r_category"), F.col("_r_priority")).otherwise(
        rules.priority(cat, F.lower(text), rules.amount(text)))
    df = df.withColumn("_m_priority", label("priority", D.PRIORITIES, by_rule)) \
        .withColumn("_m_sentiment", label("sentiment", D.SENTIMENTS, F.col("_r_sentiment")))
    df = df.select("*", step("response", fine("category", "priority", "sentiment"), cat=cat, priority=pri, sentiment=sen))
    reply = ensure_signature(ustrip(F.coalesce(F.col("_response.answer"), F.lit(""))), company)
    df = df.withColumn("_m_response", reply).withColumn("_ok", fine(*STEPS))
    repairs = sum(normalize_label(F.col(f"_{n}.answer"), allowed).isNull().cast("int") for n, allowed in (
        ("category", D.CATEGORIES), ("priority", D.PRIORITIES), ("sentiment", D.SENTIMENTS)))
    calls = (F.lit(1) + F.when(fine("category"), 2).otherwise(0)
             + F.when(fine("category", "priority", "sentiment"), 1).otherwise(0))
    ok = F.col("_ok")
    return df.select(
        *complaints.columns,
        *[F.when(ok, F.col(f"_m_{n}")).otherwise(F.col(f"_r_{n}")).alias(n) for n in names],
        F.when(ok, "ai").otherwise("offline").alias("mode"),
        F.when(~ok, F.lit(D.FALLBACK_WARNING)).alias("warning"),
        F.when(ok, repairs).otherwise(0).alias("format_repairs"),
        *[sum(F.col(f"_{s}.{c}") for s in STEPS).alias(c) for c in ("input_tokens", "output_tokens")],
        calls.cast("bigint").alias("calls"),
        F.coalesce(*[F.col(f"_{s}.error") for s in STEPS]).alias("error"))
