"""Evaluation goldens (cost, break-even, rubric, quality score) and the scorer hook."""

import math

import pytest
from pyspark.sql import functions as F

from plaint.functions import rules
from plaint.operators import evaluate as EV
from plaint.operators.scorer import score_prompts
from plaint.sources import fixtures as FX

BAD = "Dear Customer, we guarantee your refund within 2 days. Please share your OTP."


def _checks(spark, text, gold="loan"):
    df = spark.createDataFrame([(text, gold)], "r string, g string")
    q = EV.quality_checks(F.col("r"), "XYZ Finance", F.col("g"))
    return df.select(*[v.alias(k) for k, v in q.items()]).first().asDict()


def test_rubric_pass_and_fail(spark):
    good = _checks(spark, FX.REPLY_OK)
    assert all(v for k, v in good.items() if k != "fraud_team") and good["fraud_team"] is None
    assert _checks(spark, FX.REPLY_OK, "fraud")["fraud_team"] is False
    bad = _checks(spark, BAD, "billing")
    assert not bad["no_promise"] and not bad["safe"] and not bad["signature"] and not bad["length_50_60"]
    assert not _checks(spark, "Card 4111 1111 1111 1234 noted. XYZ Finance")["safe"]


def test_cost_math(spark):
    df = spark.createDataFrame([(1000.0, 500.0)], "i double, o double")
    cost = df.select(EV.cost_per_1000(F.col("i"), F.col("o"), 0.10, 0.50).alias("c")).first().c
    assert cost == pytest.approx(0.35)
    c = spark.createDataFrame([(0.25,), (0.0,)], "c double").select(EV.breakeven(500.0, F.col("c")).alias("b"))
    b = [r.b for r in c.collect()]
    assert b[0] == pytest.approx(2_000_000) and math.isinf(b[1])


def _gold_runs(spark, provider="hosted", ok=True, reply=FX.REPLY_OK, latency=1.0):
    g = rules.with_rule_labels(FX.gold_set(spark), "text", prefix="r_")
    return g.select(
        F.col("complaint_id").alias("source_id"), F.lit(provider).alias("provider"), F.lit(ok).alias("ok"), "text",
        F.col("category").alias("g_category"), F.col("priority").alias("g_priority"),
        F.col("sentiment").alias("g_sentiment"), F.col("r_category").alias("raw_category"),
        F.col("r_priority").alias("raw_priority"), F.col("r_sentiment").alias("raw_sentiment"),
        F.lit(latency).alias("latency_s"), F.lit(400).cast("bigint").alias("input_tokens"),
        F.lit(40).cast("bigint").alias("output_tokens"), F.lit(reply).alias("raw_response"),
        F.lit("TimeoutError").alias("error_type"), F.lit("no answer " + "x" * 200).alias("error_message"))


def test_run_metrics_with_rule_answering_model(spark):
    rec = EV.model_run_records(_gold_runs(spark))
    s = EV.provider_metrics(rec).first()
    assert s.n == 10 and s.failed == 0 and s.clean_outputs == 10
    assert s.category_correct >= 8
    assert s.quality_score == pytest.approx(100 * (7 + 3 * 6 / 7) / 10)
    assert s.avg_input_tokens == 400 and s.median_latency == 1.0
    assert s.triage_accuracy == pytest.approx(90.0)


def test_failures_count_as_wrong(spark):
    rec = EV.model_run_records(_gold_runs(spark, ok=False))
    s = EV.provider_metrics(rec).first()
    assert s.failed == 10 and s.triage_accuracy == 0 and s.quality_score == 0.0 and s.median_latency == 0.0
    assert rec.first().error.startswith("TimeoutError: ")
    assert rec.first().error == "TimeoutError: " + ("no answer " + "x" * 200)[:160]


def test_unsigned_reply_is_scored_raw(spark):
    rec = EV.model_run_records(_gold_runs(spark, reply="Dear Customer, we are investigating with our support team."))
    assert not any(r.checks["signature"] for r in rec.collect())


def test_repairs_are_counted(spark):
    raw = _gold_runs(spark).withColumn("raw_category", F.lit("I am not sure"))
    s = EV.provider_metrics(EV.model_run_records(raw)).first()
    assert s.clean_outputs == 0
    assert {r.format_repairs for r in EV.model_run_records(raw).collect()} == {1}


def test_verdict_and_speed(spark):
    both = EV.model_run_records(_gold_runs(spark, "hosted", latency=1.0).unionByName(
        _gold_runs(spark, "local", latency=6.0)))
    v = EV.provider_verdict(both).first()
    assert v.accuracy_band == "matched" and v.speed_band == "slower" and v.faster == "hosted"
    assert v.speed_factor == pytest.approx(6.0) and v.tail == "gpu_hardware"
    swapped = EV.model_run_records(_gold_runs(spark, "hosted", latency=6.0).unionByName(
        _gold_runs(spark, "local", latency=1.0)))
    v2 = EV.provider_verdict(swapped).first()
    assert v2.faster == "local" and v2.speed_band == "faster" and v2.speed_factor == pytest.approx(6.0)
    failed_local = EV.model_run_records(_gold_runs(spark, "hosted").unionByName(_gold_runs(spark, "local", ok=False)))
    assert EV.provider_verdict(failed_local).first().accuracy_band == "trailed"


def test_injection_probe(spark):
    rec = EV.model_run_records(_gold_runs(spark))
    assert [r.category for r in EV.injection_probe(rec, 9).collect()] == ["fraud"]


def test_scorer_isolates_row_failures(spark):
    prompts = spark.createDataFrame([(1, "category", "s", "Complaint:\nx"), (2, "category", "s", "boom")],
                                    "complaint_id bigint, step string, system string, human string")

    def answer(step, system, human):
        if human == "boom":
            raise RuntimeError("model unavailable")
        return "Loan.", 100, 10

    out = {r.complaint_id: r for r in score_prompts(prompts, answer).collect()}
    assert out[1].answer == "Loan." and out[1].error is None
    assert out[2].answer is None and out[2].error.startswith("RuntimeError")


def test_scorer_takes_text_ids_and_missing_usage(spark):
    prompts = spark.createDataFrame([("CMP-2024-001", "category", "s", "x"), ("CMP-2024-002", "category", "s", "bad")],
                                    "complaint_id string, step string, system string, human string")
    out = {r.complaint_id: r for r in score_prompts(prompts, lambda step, system, human: ("Loan", None, None if human == "x" else "many")).collect()}
    assert (out["CMP-2024-001"].answer, out["CMP-2024-001"].input_tokens) == ("Loan", 0)
    assert out["CMP-2024-002"].answer is None and out["CMP-2024-002"].error.startswith("ValueError")


def test_usage_summed_over_the_four_calls(spark):
    from plaint.operators import prompts as PR
    df = spark.createDataFrame([(1, "My EMI payment was deducted twice.", "loan", "medium", "neutral")],
                               "complaint_id bigint, complaint string, category string, priority string, "
                               "sentiment string")
    calls = score_prompts(PR.prompts(df, PR.STAGE1 + PR.STAGE2), lambda step, system, human: ("x", 100, 10))
    u = EV.usage_per_complaint(calls).first()
    assert (u.input_tokens, u.output_tokens, u.calls) == (400, 40, 4)
