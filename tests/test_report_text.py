"""The PR body (T9b) on a two-finding scan, compared with the expected markdown."""

from findrift.operators import context as ctxop
from findrift.operators import merge
from findrift.operators import report_text as RT

SCHEMA = ("repo string, scan_id string, ordinal long, tool string, idx int, path string, start_line int, "
          "end_line int, snippet string, message string, vulnerability_class array<string>, cwe array<string>, "
          "severity string, references array<string>")


def test_pr_body_small(spark):
    f = spark.createDataFrame([
        ("r", "s", 0, "semgrep", 0, "a.py", 1, 1, "x", "m1", ["x"], ["CWE-1: desc"], "error", ["u1"]),
        ("r", "s", 1, "semgrep", 1, "a.py", 3, 4, "y", "m2", [], [], "", []),
    ], SCHEMA)
    attached = ctxop.attach_context(f, ctxop.build_contexts(merge.merge_findings_by_file(f)))
    scans = spark.createDataFrame([("r", "s", "semgrep"), ("r", "empty", "codeql")], "repo string, scan_id string, tool string")
    body = {r["scan_id"]: r["text"] for r in RT.assemble(RT.pr_body_lines(attached, None, scans)).collect()}
    err = RT.SEVERITY_LABELS["ERROR"]
    expected = RT.PR_HEADER + [
        "### Overview\n", "> Detected by: **SEMGREP**\n",
        "| File | Total Issues | Levels | Top CWE(s) |", "|------|---------------|--------|-------------|",
        "| `a.py` | **2** | E:1 | CWE-1 |",
        "### 1. `a.py`", *RT.BIT_SUMMARY,
        f"| 1 | {err} | m1 | Review lines 1-4 in a.py |",
        "| 3 |  | m2 | Review lines 3-4 in a.py |",
        RT.SAST_SUMMARY, "| Line | Type | Level | BIT Level | CWE(s) | Ref |", "|----|----|-----|---------|------|---|",
        f"| 1 | x | {err} | {err} | CWE-1 | {RT.REF_LINK}(u1) |",
        "| 3~4 | N/A | N/A |  | N/A |  |",
        RT.HIGHLIGHTS,
        "- Line 1: Trigger: m1; Steps: Review lines 1-4 in a.py; Repro: " + ctxop.REPRODUCTION,
        RT.FURTHER, "- References:", "  - [link](u1)", "- Preconditions:", "  - " + ctxop.PRECONDITION,
        *RT.PR_FOOTER,
    ]
    assert body["s"] == "\n".join(expected)
    assert body["empty"] == "\n".join(RT.PR_HEADER + [RT.PR_NO_FINDINGS])


def test_repo_log_small(spark):
    f = spark.createDataFrame([
        ("r", "s", 0, "codeql", 0, "a.py", 2, 2, "x", "m1", ["x"], ["CWE-7: t"], "warning", []),
        ("r", "s", 1, "codeql", 1, "b.py", 1, 3, "y", "m2", ["y"], [], "note", ["u"]),
        ("r", "s", 2, "codeql", 2, "a.py", 5, 6, "z", "m3", [], [], "", []),
    ], SCHEMA)
    text = RT.assemble(RT.repo_log_lines(f)).first()["text"]
    warn, note = RT.SEVERITY_LABELS["WARNING"], RT.SEVERITY_LABELS["NOTE"]
    expected = [
        RT.LOG_HEADER, "- SAST Tool: Codeql", "- Total vulnerabilities Detected: 2\n",
        "| Type | Count |", "|------|-------|", "| x | 1 |", "| y | 1 |", RT.LOG_FILES,
        "\n### 1. `a.py`", RT.LOG_SAST, "| Line | Type | Level | CWE |", "|----|----|-----|---|",
        f"| 2 | x | {warn} | CWE-7 |", "| 5~6 | N/A | N/A | N/A |", RT.LOG_LLM,
        "\n### 2. `b.py`", RT.LOG_SAST, "| Line | Type | Level | Ref |", "|----|----|-----|---|",
        f"| 1~3 | y | {note} | {RT.REF_LINK}(u) |", RT.LOG_LLM,
    ]
    assert text == "\n".join(expected)
