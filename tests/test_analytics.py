"""Analytics on the reference's four-row shape, on empty input, and properties at sf0.01."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import SF01
from plaint.sources import fixtures as FX
from plaint.operators import analytics as A
from plaint.operators import store as ST
from plaint.plans import views as V

NOW = dt.datetime(2024, 3, 10, 12, 0, 0)


def _four(spark):
    rows = [(f"CMP-2024-00{i + 1}", NOW - dt.timedelta(days=d), "", "sample complaint text", c, p, "angry", "ok",
             "Open", "ai") for i, (d, c, p) in enumerate([(1, "fraud", "high"), (2, "fraud", "high"),
                                                          (9, "fraud", "high"), (3, "loan", "medium")])]
    return spark.createDataFrame(rows, ST.COMPLAINT_SCHEMA)


def test_metrics_and_insights(spark):
    df = _four(spark)
    m = A.kpi_summary(df).first()
    assert (m.total, m.fraud, m.open) == (4, 3, 4)
    cats = {r.label: r.n for r in A.category_counts(df).collect()}
    assert cats == {"Billing": 0, "Loan": 1, "Fraud": 3, "App Issue": 0}
    text = " ".join(r.insight for r in A.insights(df, NOW).orderBy("ord").collect())
    assert "Fraud" in text and "increased by 100%" in text
    assert "Loan: 1 new complaint(s) this week" in text
    assert "Fraud=3" in A.stats_text(df, NOW).first().stats
    assert A.daily_trend(df).count() == 9


def test_empty_input(spark):
    e = ST.empty(spark)
    m = A.kpi_summary(e).first()
    assert m.asDict() == {"total": 0, "fraud": 0, "loan": 0, "billing": 0, "app_issue": 0, "open": 0, "closed": 0}
    assert [r.n for r in A.status_counts(e).orderBy("ord").collect()] == [0, 0, 0]
    assert A.daily_trend(e).count() == 0
    assert [r.insight for r in A.insights(e, NOW).collect()] == [
        "No complaints recorded yet. Insights will appear once customers submit complaints."]
    assert "last 7 days" not in A.stats_text(e, NOW).first().stats
    assert A.top_category(e).count() == 0
    assert A.week_over_week_counts(e, NOW).count() == 4


def test_percent_text_is_half_even(spark):
    df = spark.createDataFrame([(0.005,), (0.125,), (0.375,)], "x double")
    assert [r.p for r in df.select(A._pct(F.col("x")).alias("p")).collect()] == ["0%", "12%", "38%"]


def test_properties_on_fixture(spark):
    t = V.complaints_triaged(spark, SF01).cache()
    k = A.kpi_summary(t).first()
    assert k.open + k.closed == k.total == 9000
    d = A.all_distributions(t).collect()
    for dom in ("category", "priority", "sentiment", "status"):
        assert sum(r.n for r in d if r.domain == dom) == k.total
    trend = A.daily_trend(t).orderBy("day").collect()
    assert all((b.day - a.day).days == 1 for a, b in zip(trend, trend[1:]))
    wow = {r.category: (r.last_7, r.prev_7) for r in A.week_over_week_counts(t, FX.as_of()).collect()}
    assert wow == {"billing": (543, 521), "app_issue": (604, 632), "loan": (532, 532), "fraud": (422, 429)}
    t.unpersist()


def test_distributions_show_labels_outside_their_domain(spark):
    rows = [("fraud", "high", "angry", "Open"), ("fraud", "urgent", "angry", None), ("crypto", "high", "calm", "Closed"), ("crypto", "low", None, "Open")]
    df = spark.createDataFrame(rows, "category string, priority string, sentiment string, status string")
    got = {(r.domain, r.code): (r.ord, r.label, r.n) for r in A.all_distributions(df).collect()}
    assert got["category", "fraud"][1:] == ("Fraud", 2)
    assert got["category", "crypto"] == (None, "crypto", 2) and got["category", "billing"][2] == 0
    assert got["priority", "urgent"] == (None, "urgent", 1) and got["status", None] == (None, None, 1) and got["sentiment", "calm"][2] == 1
    totals = {}
    for (domain, _), (_, _, n) in got.items():
        totals[domain] = totals.get(domain, 0) + n
    assert totals == dict.fromkeys(("category", "priority", "sentiment", "status"), 4)
    empty = A.all_distributions(df.limit(0)).collect()
    assert len(empty) == 14 and {r.n for r in empty} == {0}


def test_daily_trend_fills_gaps(spark):
    rows = [("2024-01-01 10:00:00",), ("2024-01-01 11:00:00",), ("2024-01-05 00:00:00",), ("2024-03-01 00:00:00",), (None,)]
    df = spark.createDataFrame(rows, "t string").selectExpr("cast(t as timestamp_ntz) as created_at")
    got = {str(r.day): r.complaints for r in A.daily_trend(df).collect()}
    assert len(got) == 61 and got["2024-01-01"] == 2 and got["2024-01-02"] == 0 and got["2024-01-05"] == 1 and got["2024-03-01"] == 1
    assert A.daily_trend(df.limit(0)).count() == 0
