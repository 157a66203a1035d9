"""Summarise the final (adaptive) physical plan of every registered query into PLANS.md.

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from assaykit import session  # noqa: E402
from assaykit.session import get_spark  # noqa: E402

# How the headline plans behave when the inputs are 100 TB instead of megabytes.
SCALE_NOTES = {
    "training_set_labels": "Activity is scanned with pruned columns; the IQR bounds come from one "
                           "scalar subquery (values counted map-side, distinct ones range-partitioned, "
                           "written once). The assay join becomes a sort-merge join (AQE skew split on hot "
                           "assays); the per-molecule aggregate keeps fixed-size partial sketches; "
                           "structures join one row per molecule.",
    "train_val_split": "Pure filters on an md5 bucket: no shuffle is added by the split itself.",
    "annotate_targets": "Three left joins to dimension-sized target tables; they broadcast when AQE "
                        "measures them small, else sort-merge. Output fan-out is the operator's contract.",
    "activity_distributions": "Target components are pre-aggregated to (target, type) weights before "
                              "meeting measurements; rows are counted per type, dimensions and value, and "
                              "GROUPING SETS expand these counts, not rows; group ranges are a written "
                              "table, broadcast only where Spark finds its files small.",
    "to_nanomolar": "Narrow projection, no shuffle.",
    "regression_metrics": "One rollup with partial aggregation; output size is epochs x batches.",
    "early_stopping": "Three distributed prefix scans (numbered, blocked, carried across blocks) and a "
                      "per-run min; a run with a third of all epochs is spread over many tasks.",
    "assign_batches": "Range partition + per-partition offsets; no single-partition window over rows.",
    "assemble_graphs": "Nodes and edges meet in one shuffle by graph id; places by binary search in the "
                       "sorted ids; each output row is one graph by definition.",
    "robust_pooled_regression": "One pass and one aggregate of (width + 1)^2 sums per regularisation and step, "
                                "over a written table; the driver solves a system of the model's width.",
    "early_stopping_delta": "Numbered once; strict minima become one step function per block, folded over "
                            "the steps near each block's start; counters are prefix scans.",
    "daily_profile": "A new day is one aggregate of partial sketches; older days are not read.",
    "propagate": "One join + one aggregate per round over a materialized link table; hub nodes are "
                 "handled by partial aggregation and AQE skew joins.",
    "circular_fingerprint": "Same round shape as propagate; per-graph bit sets are capped at n_bits.",
    "render_context": "Resolution is a narrow projection; transcripts keep n rows per conversation "
                      "with a group limit before the shuffle.",
}


def final_only(plan: str) -> str:
    """Drop every '== Initial Plan ==' subtree; adaptive plans print both versions."""
    out, skip_at = [], None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" "))
        if skip_at is not None:
            if indent > skip_at:
                continue
            skip_at = None
        if "== Initial Plan ==" in line:
            skip_at = indent
            continue
        out.append(line)
    return "\n".join(out)


def summarize(plan: str) -> dict[str, object]:
    return {
        "hash shuffles": len(re.findall(r"Exchange hashpartitioning", plan)),
        "range shuffles": len(re.findall(r"Exchange rangepartitioning", plan)),
        "single-partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcast joins": plan.count("BroadcastHashJoin"),
        "sort-merge joins": plan.count("SortMergeJoin"),
        "subqueries": len(re.findall(r"Subquery subquery", plan)),
        "python": sum(plan.count(k) for k in ("MapInArrow", "ArrowEvalPython", "BatchEvalPython",
                                              "PythonMapInArrow", "MapInPandas")),
        "group limit": plan.count("WindowGroupLimit"),
        "cartesian": plan.count("CartesianProduct") + plan.count("BroadcastNestedLoopJoin"),
        "pushed filters": len([m for m in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if m]),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from assaykit.plans import catalog

    spark = get_spark()
    catalog.load_all()
    qs, oracle = catalog.QUERIES, catalog.ORACLE
    print("# PLANS\n")
    print(f"Final adaptive physical plans of the registered queries at `{sf_dir}`, summarised by "
          "`tools/plan_report.py`, together with the plans (before adaptive changes) of the tables that a "
          "query writes to the shared folder on its way. Counts include scalar subqueries. Small inputs make AQE choose "
          "broadcast joins that become sort-merge joins at scale. Single-partition exchanges here "
          "only carry partial results of global aggregates (one row per partition) or the "
          "per-partition offset table of `global_index`, never data rows.\n")
    cols = ["hash shuffles", "range shuffles", "single-partition", "broadcast joins", "sort-merge joins",
            "subqueries", "python", "group limit", "cartesian", "pushed filters"]
    print("| query | oracle | " + " | ".join(cols) + " |")
    print("|---|---|" + "---|" * len(cols))
    for name, fn in qs.items():
        session.STORED_PLANS = stored = []
        df = fn(spark, sf_dir)
        df.collect()
        plan = "\n".join([*stored, final_only(df._jdf.queryExecution().executedPlan().toString())])
        s = summarize(plan)
        print(f"| {name} | {'yes' if name in oracle else 'rows'} | " + " | ".join(str(s[c]) for c in cols) + " |")
    print("\n## At 100 TB\n")
    for name, note in SCALE_NOTES.items():
        print(f"* **{name}**: {note}")
    spark.stop()


if __name__ == "__main__":
    main()
