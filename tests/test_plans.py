"""Physical-plan checks: no Python in core plans, pushdown, top-k, single scans."""

from plaint.sources import fixtures as FX
from plaint.operators import analytics as A
from plaint.operators import store as ST
from plaint.plans import views as V
from plaint.plans.catalog import REGISTRY
from conftest import SF001

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas", "FlatMapGroupsInPandas")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_core_plans_have_no_python(spark):
    for name in ["rule_triage", "validate_complaints", "kpi_summary", "insights", "model_run_records",
                 "triage_with_model", "side_by_side"]:
        plan = _plan(REGISTRY[name][0](spark, SF001))
        assert not any(node in plan for node in PYTHON_NODES), name


def test_filters_reach_the_parquet_scan(spark, tmpdir_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    path = f"{tmpdir_path}/store"
    ST.append(V.complaints_triaged(spark, SF001).drop("status"), path, batch="b0")
    df = ST.list_complaints(ST.read(spark, path), categories=["fraud", "loan"], statuses=["Open"])
    plan = _plan(df)
    assert "PushedFilters: [" in plan and "In(category" in plan and "EqualTo(status,Open)" in plan
    wow = _plan(A.week_over_week_counts(ST.read(spark, path), FX.as_of()))
    assert "GreaterThan(created_at" in wow and "ReadSchema: struct<created_at:timestamp_ntz,category:string>" in wow


def test_latest_10_is_top_k(spark):
    plan = _plan(REGISTRY["latest_10"][0](spark, SF001))
    assert "TakeOrderedAndProject" in plan


def test_one_scan_for_all_distributions_and_week_windows(spark):
    for name in ("all_distributions", "week_over_week_counts", "stats_text", "insights"):
        plan = _plan(REGISTRY[name][0](spark, SF001))
        assert plan.count("FileScan parquet") == 1, name


def test_gold_join_is_a_semi_join(spark):
    from plaint.operators import evaluate as EV
    runs = spark.createDataFrame([("a", 1, True, "high"), ("a", 2, True, "low"), ("a", 3, False, "high"), ("b", 9, True, "high")],
                                 "provider string, complaint_id long, ok boolean, priority string")
    gold = spark.createDataFrame([(1, "fraud"), (1, "fraud"), (2, "fraud"), (3, "fraud"), (9, "loan"), (None, "fraud")], "complaint_id long, g_category string")
    out = EV.fraud_marked_high(runs, gold)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 3), ("b", 0, 0)]
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
