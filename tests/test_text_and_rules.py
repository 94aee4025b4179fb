"""Validation, masking, rule engine and label repair (goldens from the reference tests)."""

import pytest
from pyspark.sql import functions as F

from conftest import one
from plaint import domains as D
from plaint.functions import rules
from plaint.functions.respond import build_response, ensure_signature, normalize_label
from plaint.functions.text import mask_cards, preview, ustrip, word_count
from plaint.functions.validate import validate
from plaint.sources import fixtures as FX


def _validate(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_text string")
    return {r["i"]: r for r in validate(df).collect()}


def test_validation_rejects_empty_null_short_long(spark):
    out = _validate(spark, ["", None, "help", "x" * 1001, "   \t ", "1234567890 99"])
    assert [out[i]["error_code"] for i in range(6)] == ["empty", "empty", "too_short", "too_long", "empty",
                                                        "no_words"]
    assert all(not out[i]["ok"] and out[i]["cleaned"] == "" for i in range(6))
    assert out[3]["error"] == "Your complaint is too long (1001 characters). Please keep it under 1000."


def test_validation_accepts_and_masks_cards(spark):
    out = _validate(spark, ["My card 4111 1111 1111 1234 was charged twice yesterday"])[0]
    assert out["ok"] and "4111 1111" not in out["cleaned"] and out["cleaned"].count("1234") == 1
    assert one(spark, mask_cards(F.col("t")), "call 9876543210 amount 50000") == "call 9876543210 amount 50000"


@pytest.mark.parametrize("text,expected", [
    ("card 4111-1111-1111-123 x", "card XXXX-XXXX-XXXX-1123 x"),
    ("n 4111111111111111 end", "n XXXX-XXXX-XXXX-1111 end"),
    ("a 4111 1111 1111 1234567 b", "a XXXX-XXXX-XXXX-4567 b"),
    ("id x4111111111111111", "id x4111111111111111"),
    ("4111 1111 1111 12345678", "4111 1111 1111 12345678"),
])
def test_mask_edges(spark, text, expected):
    assert one(spark, mask_cards(F.col("t")), text) == expected


def test_mask_is_idempotent(spark):
    t = "pay 4111 1111 1111 1234 and 5500000000000004"
    once = one(spark, mask_cards(F.col("t")), t)
    assert one(spark, mask_cards(F.col("t")), once) == once


def test_strip_and_words_follow_python(spark):
    s = "   hello\tworld 　\n"
    assert one(spark, ustrip(F.col("t")), s) == s.strip()
    assert one(spark, word_count(F.col("t")), s) == len(s.split())
    assert one(spark, word_count(F.col("t")), "") == 0


def _labels(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    r = rules.with_rule_labels(df, "t", prefix="r_").first()
    return r["r_category"], r["r_priority"], r["r_sentiment"], r["r_amount"]


@pytest.mark.parametrize("text,expected", [
    ("My EMI payment was deducted twice.", "loan"),
    ("My credit card was charged twice.", "billing"),
    ("Unauthorized transaction of ₹50,000 on my account", "fraud"),
    ("The app crashes when I try to login", "app_issue"),
    ("Happen to know your branch hours?", "app_issue"),
])
def test_rule_category(spark, text, expected):
    assert _labels(spark, text)[0] == expected


def test_rule_priority_sentiment_amount(spark):
    assert _labels(spark, "Unauthorized transaction of ₹50,000")[1] == "high"
    assert _labels(spark, "Refund not received")[1] == "medium"
    assert _labels(spark, "App looks different")[1] == "low"
    assert _labels(spark, "Nobody is helping me and money is missing.")[2] == "angry"
    assert _labels(spark, "Thank you for the quick help")[2] == "positive"
    assert _labels(spark, "charged Rs. 1,200 and ₹5,000")[3] == 5000
    assert _labels(spark, "offers 500")[3] == 500
    assert _labels(spark, "rs , then")[3] == 0
    assert _labels(spark, "INR 1,20,000.50")[3] == 120000.5


def test_overlapping_keywords_each_count(spark):
    df = spark.createDataFrame([("overcharged",)], "t string")
    assert rules.with_rule_scores(df, "t").first()["score_billing"] == 3.0


def test_templates_reproduce_their_labels(spark):
    df = FX.templates(spark)
    out = rules.with_rule_labels(df, "txt", prefix="r_").collect()
    assert all((r.r_category, r.r_priority, r.r_sentiment) == (r.g_category, r.g_priority, r.g_sentiment)
               for r in out)


def test_gold_set_rule_accuracy_is_90_percent(spark):
    out = rules.with_rule_labels(FX.gold_set(spark), "text", prefix="r_").collect()
    hits = sum((r.r_category == r.category) + (r.r_priority == r.priority) + (r.r_sentiment == r.sentiment)
               for r in out)
    assert hits == 27 and sum(r.r_category == r.category for r in out) >= 8


@pytest.mark.parametrize("raw,expected", [
    (" Loan. ", "loan"), ("App Issue", "app_issue"), ("category: fraud", "fraud"), ("gibberish", None),
])
def test_normalize_label(spark, raw, expected):
    assert one(spark, normalize_label(F.col("t"), D.CATEGORIES), raw) == expected


def test_response_and_signature(spark):
    df = spark.createDataFrame([("fraud", "angry"), ("kyc", "neutral")], "c string, s string")
    r = df.select(build_response(F.col("c"), F.col("s")).alias("r")).collect()
    assert r[0].r.startswith("Dear Customer,\n\nWe sincerely apologise") and "fraud investigation team" in r[0].r
    assert "regarding your account." in r[1].r and r[1].r.endswith("Regards,\nXYZ Finance")
    signed = one(spark, ensure_signature(F.col("t")), "Dear Customer,\n\nWe are investigating.")
    assert signed.rstrip().endswith("XYZ Finance")
    assert one(spark, ensure_signature(F.col("t")), "thanks, xyz finance") == "thanks, xyz finance"


def test_preview(spark):
    assert one(spark, preview(F.col("t")), "a" * 71) == "a" * 70 + "..."
    assert one(spark, preview(F.col("t")), "short") == "short"


def test_lexicon_and_domain_tables(spark):
    from plaint.sources import tables
    lex = tables.lexicon(spark)
    counts = {(r.rule, r.label): r["count"] for r in lex.groupBy("rule", "label").count().collect()}
    assert counts == {("category", "fraud"): 16, ("category", "loan"): 10, ("category", "billing"): 15,
                      ("category", "app_issue"): 17, ("high", "high"): 10, ("angry", "angry"): 16,
                      ("frustrated", "frustrated"): 12, ("positive", "positive"): 5}
    whole = {r.keyword for r in lex.filter("whole_word").collect()}
    assert whole == {"hack", "scam", "emi", "loan", "fee", "fees", "bill", "app", "hang"}
    assert tables.domains(spark).count() == 14
