"""Summarise the physical plans of the headline queries into PLANS.md.

For each query: exchanges (hash / round-robin / broadcast), join strategies,
aggregate operators, Python operators, and the ReadSchema of every parquet
scan (column pruning).  Plans are the final adaptive plans after one run at
the given scale.  Usage: python scripts/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from findrift.plans import catalog  # noqa: E402
from findrift.session import get_spark  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange RoundRobinPartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "Generate", "MapInPandas", "ArrowEvalPython",
       "BatchEvalPython", "ReusedExchange", "AQEShuffleRead"]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8)
    out = ["# Physical plans of the headline queries", "",
           f"Final adaptive plans after one run at `{sf_dir}` (local[8]).  Counts are operator occurrences;",
           "ReadSchema lists the columns each parquet scan reads (column pruning).",
           "SinglePartition exchanges belong to one-row aggregates (document counts, sizes).", ""]
    for name in HEADLINE:
        if name not in catalog.REGISTRY or name.startswith("r1"):
            continue
        df = catalog.REGISTRY[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = Counter()
        for op in OPS:
            counts[op] = plan.count(op)
        scans = sorted(set(re.findall(r"Location: InMemoryFileIndex\(\d+ paths\)\[file:[^\]]*/([a-z_]+)\.parquet\]"
                                      r"[^\n]*ReadSchema: (struct<[^\n]*>)", plan)))
        out.append(f"## {name}")
        out.append("")
        out.append(", ".join(f"{k}: {v}" for k, v in counts.items() if v) or "(no shuffles)")
        out.append("")
        for table, schema in scans:
            out.append(f"* `{table}` reads `{schema}`")
        out.append("")
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join(out) + "\n")
    print(path)


if __name__ == "__main__":
    main()
