"""Summarise the physical plan of every catalogue query into PLANS.md.

Usage: python scripts/plan_report.py [sf_dir]
For each query: exchanges (shuffles), file scans, whether filters reached the
scan, Python nodes, join strategies, WindowGroupLimit, subqueries, and whether
whole-stage codegen covers the plan.  Sink and streaming queries run their
writes while being planned, so they are listed separately.
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SINKS = {
    "q_scan_csv", "q_scan_first", "q_result_append", "q_json_append", "q_run_log", "q_verify_sample",
    "q_error_rows", "q_report_json", "q_report_sections", "q_report_queue", "q_report_from_files", "q_reset_append",
    "q_stream_append", "q_stream_distribution",
}


def summarise(plan: str) -> dict[str, str]:
    def n(pat: str) -> int:
        return len(re.findall(pat, plan))

    pushed = re.findall(r"PushedFilters: \[([^\]]*)\]", plan)
    return {
        "exchanges": str(n(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)")),
        "scans": str(n(r"FileScan ")),
        "pushed filters": "yes" if any(p.strip() for p in pushed) else "-",
        "python": str(n(r"MapInPandas|PythonMapInArrow|BatchEvalPython|ArrowEvalPython")),
        "joins": ",".join(sorted({m for m in re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)", plan)})) or "-",
        "group limit": "yes" if "WindowGroupLimit" in plan else "-",
        "subqueries": str(len(set(re.findall(r"(?:scalar-)?subquery#(\d+)", plan)))),
        "codegen": "yes" if "WholeStageCodegen" in plan or "*(" in plan else "-",
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from docvet.plans.catalog import QUERIES
    from docvet.session import local_session

    spark = local_session()
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan Catalyst chose
    rows = []
    for name, fn in QUERIES.items():
        if name in SINKS:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        rows.append((name, summarise(plan)))
    cols = list(rows[0][1])
    out = [
        "# PLANS",
        "",
        f"Physical plans of the catalogue queries at `{sf}`, AQE off so the static",
        "choice is visible (AQE then coalesces partitions and may switch joins to",
        "broadcast by runtime size).  Reports and the research run write their",
        "counts or answers first; shown is the plan that reads these.",
        "Generated by `python scripts/plan_report.py`.",
        "",
        "| query | " + " | ".join(cols) + " |",
        "| --- | " + " | ".join("---" for _ in cols) + " |",
    ]
    out += [f"| `{name}` | " + " | ".join(s[c] for c in cols) + " |" for name, s in rows]
    out += ["", "Not listed (they write while planning): " + ", ".join(f"`{s}`" for s in sorted(SINKS)) + "."]
    Path(__file__).resolve().parents[1].joinpath("PLANS.md").write_text("\n".join(out) + "\n")
    print("\n".join(out))


if __name__ == "__main__":
    main()
