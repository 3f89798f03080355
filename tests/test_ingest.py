"""Adapters: the line-slicing policy table per tool, SARIF levels and rule maps."""

import json

from pyspark.sql import functions as F

from findrift.operators import ingest


def _files(spark, files):
    from findrift.functions.columns import split_lines
    df = spark.createDataFrame([("r", p, c) for p, c in files.items()], "repo string, path string, content string")
    return df.select("repo", "path", "content", split_lines("content").alias("lines"),
                     F.size(split_lines("content")).alias("n_lines"))


def _raw(spark, tool, docs):
    return spark.createDataFrame([("s1", "r", tool, i, json.dumps(d)) for i, d in enumerate(docs)],
                                 "scan_id string, repo string, tool string, part long, text string")


def test_semgrep_policy(spark):
    files = _files(spark, {"a.py": "l1\nl2\n\nl4\n"})
    res = [
        {"path": "a.py", "start": {"line": 2}, "end": {"line": 3}, "extra": {"message": "m", "severity": "ERROR",
                                                                           "metadata": {"cwe": "CWE-1"}}},
        {"path": "a.py", "extra": {"metadata": {"cwe": ["CWE-2", "CWE-3"]}}},
        {"path": "a.py", "start": {"line": 5}, "end": {"line": 5}},
        {"path": "a.py", "start": {"line": 3}, "end": {"line": 2}},
        {"path": "missing.py", "start": {"line": 1}, "end": {"line": 1}},
        {"path": "a.py", "start_line": 4, "end_line": 4, "extra": {"severity": "info"}},
    ]
    out, rej = ingest.semgrep_findings(_raw(spark, "semgrep", [{"results": res}]), files)
    rows = {r["idx"]: r for r in out.collect()}
    assert sorted(rows) == [0, 1, 2, 3, 5]
    assert rows[0]["snippet"] == "l2\n" and rows[0]["cwe"] == ["CWE-1"] and rows[0]["severity"] == "ERROR"
    assert rows[1]["snippet"] == "" and (rows[1]["start_line"], rows[1]["end_line"]) == (0, 0)
    assert rows[1]["cwe"] == ["CWE-2", "CWE-3"] and rows[1]["vulnerability_class"] == []
    assert rows[2]["snippet"] == "" and rows[3]["snippet"] == ""
    assert rows[5]["snippet"] == "l4" and rows[5]["severity"] == "info"
    assert [r["code"] for r in rej.collect()] == ["FILE_NOT_FOUND"]
    # a bare list is accepted as well
    out2, _ = ingest.semgrep_findings(_raw(spark, "semgrep", [res[:1]]), files)
    assert out2.count() == 1


def _sarif(rules_by_run, results_by_run):
    return {"runs": [{"tool": {"driver": {"rules": rules}}, "results": results}
                     for rules, results in zip(rules_by_run, results_by_run)]}


def _loc(uri, start=None, end=None):
    region = {}
    if start is not None:
        region["startLine"] = start
    if end is not None:
        region["endLine"] = end
    return [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": region}}]


RULES0 = [{"id": "py/a", "helpUri": "u0", "defaultConfiguration": {"level": "note"},
           "properties": {"tags": ["external/cwe/cwe-079", "CWE-89"]}},
          {"id": "py/b", "properties": {"problem.severity": "recommendation", "tags": []}}]
RULES1 = [{"id": "py/a", "helpUri": "u1", "defaultConfiguration": {"level": "note"},
           "properties": {"tags": ["external/cwe/cwe-079"]}}]


def test_codeql_policy(spark):
    files = _files(spark, {"a.py": "x = 1\n   \ny = 2\n"})
    run0 = [
        {"ruleId": "py/a", "level": "error", "message": {"text": "m0"}, "locations": _loc("a.py", 1, 3)},
        {"ruleId": "py/a", "locations": _loc("a.py", 2)},                     # blank line -> dropped
        {"ruleId": "py/a", "locations": _loc("a.py", 4)},                     # beyond file -> dropped
        {"ruleId": "py/a", "locations": _loc("a.py", 0)},                     # start 0 -> dropped
        {"ruleId": "py/a", "level": ["warning", "x"], "locations": _loc("a.py", 3, 9)},
    ]
    run1 = [
        {"ruleId": "py/a", "level": [], "locations": _loc("nope.py", 2, 2)},  # missing file kept
        {"ruleId": "py/b", "locations": _loc("a.py", 3, 1)},                  # e <= s -> start line only
        {"ruleId": "py/zzz", "locations": _loc("a.py", 1, 1)},                # unknown rule
    ]
    doc = _sarif([RULES0, RULES1], [run0, run1])
    out, rej = ingest.codeql_findings(_raw(spark, "codeql", [doc]), files)
    rows = sorted(out.collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in rows] == [0, 1, 2, 3, 4]
    assert rows[0]["snippet"] == "x = 1\n   \ny = 2" and rows[0]["severity"] == "ERROR"
    assert rows[1]["snippet"] == "y = 2" and rows[1]["severity"] == "WARNING"
    assert rows[2]["path"] == "nope.py" and rows[2]["snippet"] == "" and rows[2]["severity"] == "NOTE"
    assert rows[3]["snippet"] == "y = 2" and rows[3]["severity"] == "RECOMMENDATION" and rows[3]["end_line"] == 1
    assert rows[4]["severity"] == "UNKNOWN" and rows[4]["cwe"] == [] and rows[4]["vulnerability_class"] == ["zzz"]
    # CodeQL: one rule map over all runs, later run wins; only lower-case 'cwe-' tags
    assert rows[0]["references"] == ["u1"] and rows[0]["cwe"] == ["CWE-079"]
    assert rej.count() == 3


def test_snyk_policy(spark):
    files = _files(spark, {"a.py": "  one  \ntwo\nthree\n"})
    run0 = [
        {"ruleId": "py/a", "level": "warning", "message": {"text": "m"}, "locations": _loc("a.py", 1, 2)},
        {"ruleId": "py/a", "locations": _loc("missing.py", 1, 1)},            # dropped, still counted in idx
        {"ruleId": "py/a", "locations": _loc("a.py", 0, 1)},                  # start 0 -> '' (documented)
        {"ruleId": "py/a", "locations": _loc("a.py", 3, 7)},                  # clipped
    ]
    run1 = [{"ruleId": "py/a", "level": "note", "locations": _loc("a.py", 2)}]
    doc = _sarif([RULES0, RULES1], [run0, run1])
    out, rej = ingest.snyk_findings(_raw(spark, "snykcode", [doc]), files)
    rows = sorted(out.collect(), key=lambda r: r["ordinal"])
    assert [r["idx"] for r in rows] == [0, 2, 3, 0]
    assert rows[0]["snippet"] == "one  \ntwo" and rows[0]["severity"] == "WARNING"
    assert rows[1]["snippet"] == "" and rows[1]["severity"] == ""
    assert rows[2]["snippet"] == "three"
    # Snyk: rule map per run; any-case 'cwe' tags kept
    assert rows[0]["references"] == ["u0"] and rows[0]["cwe"] == ["CWE-079", "CWE-89"]
    assert rows[3]["references"] == ["u1"] and rows[3]["severity"] == "NOTE" and rows[3]["snippet"] == "two"
    assert [r["code"] for r in rej.collect()] == ["SOURCE_MISSING"]


def test_union_and_agreement(spark):
    files = _files(spark, {"a.py": "l1\nl2\n"})
    sg = _raw(spark, "semgrep", [{"results": [{"path": "a.py", "start": {"line": 1}, "end": {"line": 1},
                                               "extra": {"metadata": {"vulnerability_class": "a"}}}]}])
    cq = _raw(spark, "codeql", [_sarif([RULES0], [[{"ruleId": "py/a", "locations": _loc("a.py", 1, 1)}]])])
    f, _ = ingest.union_tools({"semgrep": sg, "codeql": cq}, files)
    assert f.count() == 2
    ag = ingest.tool_agreement(f).collect()
    assert [(r["cls"], r["n_tools"]) for r in ag] == [("a", 2)]
