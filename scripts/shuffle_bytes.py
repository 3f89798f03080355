"""Shuffle bytes written per headline query, read from Spark's event log.

Runs each headline query once (noop sink) under its own job group with the
event log written to a fresh scratch folder, then sums "Shuffle Bytes
Written" of all tasks of the jobs in that group.
Usage: python scripts/shuffle_bytes.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from bench import HEADLINE  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="findrift-eventlog-")
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false")
             .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from findrift.plans import catalog
    for name in HEADLINE:
        spark.sparkContext.setJobGroup(name, name)
        catalog.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()
    stage_group, written = {}, defaultdict(int)
    for path in sorted(p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)):
        with open(path, encoding="utf-8") as fh:
            for line in fh:
                try:
                    ev = json.loads(line)
                except ValueError:
                    continue
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif kind == "SparkListenerTaskEnd":
                    m = (ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}
                    written[ev.get("Stage ID")] += int(m.get("Shuffle Bytes Written", 0))
    per_query = defaultdict(int)
    for sid, b in written.items():
        per_query[stage_group.get(sid)] += b
    print(json.dumps({q: round(per_query.get(q, 0) / 2**20, 1) for q in HEADLINE}))


if __name__ == "__main__":
    main()
