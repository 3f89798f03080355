"""Headline-query benchmark.

Runs the headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is materialised with a full scan of its result (``noop`` write
sink), so every stage runs but nothing is collected to the driver.  Before
timing, every headline query runs once on the smallest fixture directory
(sf0.001) so that JIT and whole-stage code generation warm-up are not
counted; the timed runs then process the whole tables at the target scale.

The fixture tables are single files of one row group, which one task reads; a
cluster's tables are many files.  So the bench first copies each table into
files of a scratch folder (not timed) and runs the queries over those.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from findrift.session import get_spark  # noqa: E402
from findrift.plans import catalog  # noqa: E402

HEADLINE = [
    "a1_merge_findings_by_file",
    "a1_hot_file_merge",
    "o4_union_tools",
    "a3_file_severity_rollup",
    "t8_build_contexts",
    "j6_findings_to_nodes",
    "n1_ast_nodes",
    "t6_unified_diff",
    "t6b_diff_stats",
    "t9a_report_lines",
    "t9b_pr_body_lines",
    "l2_repo_log_rows",
    "l6_pr_requests",
    "t2b_sections_relaxed",
    "r1_stream_findings",
]


def spread(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in ``files`` files each."""
    out = tempfile.mkdtemp(prefix="bench-tables-")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").repartition(files).write.parquet(f"{out}/{name}")
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus))
    names = [n for n in HEADLINE if n in catalog.REGISTRY]
    times: dict[str, float] = {}
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names:
        catalog.REGISTRY[name](spark, warm_dir if os.path.isdir(warm_dir) else sf_dir) \
            .write.format("noop").mode("overwrite").save()
    tables = spread(spark, sf_dir, 2 * int(cpus))
    for name in names:
        t0 = time.time()
        catalog.REGISTRY[name](spark, tables).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "warmed_on": "sf0.001", "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
