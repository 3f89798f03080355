"""Plan guards: no registered query may plan a nested-loop join, a cartesian
product or a row-at-a-time Python UDF."""

import pytest

from findrift.plans import catalog

SMOKE = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.REGISTRY))
def test_no_pathological_operators(spark, name):
    plan = plan_of(catalog.REGISTRY[name](spark, SMOKE))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
        assert bad not in plan, f"{name}: {bad}"


def test_pr_body_shuffles_findings_once(spark):
    plan = plan_of(catalog.t9b_pr_body_lines(spark, SMOKE))
    assert plan.count("Exchange hashpartitioning") <= 8


@pytest.mark.parametrize("name", ["o4_union_tools", "t6b_diff_stats", "j4_unpaired"])
def test_stored_sources_are_joined_where_they_are(spark, name):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are not small
    try:
        plan = plan_of(catalog.REGISTRY[name](spark, SMOKE)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "sources_" in line]
    assert scans
    for i in scans:
        depth = len(plan[i]) - len(plan[i].lstrip(" :+-"))
        # upwards from the scan to the join: the lines that lie above it
        for line in reversed(plan[:i]):
            here = len(line) - len(line.lstrip(" :+-"))
            if here < depth:
                depth = here
                assert "Exchange" not in line, f"{name}: sources are shuffled"
                if "Join" in line:
                    break


def test_scanner_documents_are_parsed_once(spark):
    for name in ("s2_semgrep_findings", "s3_codeql_findings", "s3_snyk_findings"):
        plan = plan_of(catalog.REGISTRY[name](spark, SMOKE))
        assert plan.count("from_json(") == 1, name
