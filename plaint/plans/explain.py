"""Write the physical plans of the headline queries to PLANS.md.

Usage: ``python -m plaint.plans.explain [sf_dir] [out.md]``.  For each query: a one-line
summary (shuffles, broadcasts, sort-merge joins, whole-stage codegen subtrees, file scans,
pushed filters, Python nodes) and the final physical plan tree after execution (the plan
AQE actually ran).
"""

from __future__ import annotations

import re
import sys

HEADLINE = ["rule_triage", "validate_complaints", "kpi_summary", "all_distributions", "week_over_week_counts",
            "insights", "daily_trend", "assign_ids", "search_combined", "latest_10", "apply_status_updates",
            "triage_with_model", "model_run_records", "eval_provider_summary", "side_by_side"]
PYTHON = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")


def summarize(plan: str) -> str:
    """Counts over a final physical plan tree (one line per operator)."""
    def n(pat: str) -> int:
        return len(re.findall(pat, plan, flags=re.M))
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)) - {""})
    shuffles = n(r"[+:\- ]Exchange (hash|range|RoundRobin|Single|SinglePartition)") + n(r"^Exchange ")
    return (f"shuffle_exchanges={shuffles}, broadcast_exchanges={n(r'BroadcastExchange ')}, "
            f"broadcast_joins={n(r'BroadcastHashJoin ')}, sort_merge_joins={n(r'SortMergeJoin ')}, "
            f"codegen_stages={len(set(re.findall(r'\*\((\d+)\)', plan)))}, file_scans={n(r'FileScan ')}, "
            f"rdd_scans={n(r'Scan ExistingRDD')}, python_nodes={sum(plan.count(p) for p in PYTHON)}, "
            f"pushed_filters={pushed or 'none'}")


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    out = argv[2] if len(argv) > 2 else "PLANS.md"
    sys.path.insert(0, ".")
    from plaint.plans.catalog import REGISTRY
    from plaint.session import local_session
    spark = local_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "400")
    parts = [f"# Physical plans ({sf_dir}, local session, AQE final plans)\n",
             "Generated by `python -m plaint.plans.explain`. Reports read the materialised stores "
             "(`views.complaints_store`, `views.model_runs_store`); their build plans are those of "
             "`assign_ids` + triage and `model_run_records`.\n"]
    for name in HEADLINE:
        df = REGISTRY[name][0](spark, sf_dir)
        qe = df._jdf.queryExecution()
        qe.toRdd().count()   # run this plan itself so AQE finalises it (rows stay on executors)
        exec_plan = qe.executedPlan()
        final = exec_plan.executedPlan() if exec_plan.nodeName().startswith("AdaptiveSparkPlan") else exec_plan
        plan = final.treeString()
        parts.append(f"## {name}\n\n{summarize(plan)}\n\n```\n{plan.strip()}\n```\n")
    with open(out, "w") as fh:
        fh.write("\n".join(parts))
    print(f"wrote {out}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
