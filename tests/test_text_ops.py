"""Contexts, validation, prompts, code blocks, sections, annotation, diffs, patches."""

import difflib
import os

from pyspark.sql import functions as F

from findrift.functions.columns import split_lines
from findrift.operators import context as ctxop
from findrift.operators import patches as PT
from findrift.operators import prompts as P

MERGED = ("repo string, scan_id string, path string, first_ordinal long, n_findings long, start_line int, end_line int, "
          "snippet string, message string, vulnerability_class array<string>, cwe array<string>, severity string, "
          "references array<string>")


def _merged(spark, rows):
    return spark.createDataFrame(rows, MERGED)


def test_contexts_and_validation(spark):
    m = _merged(spark, [("r", "s", "a.py", 1, 2, 3, 5, "x", "m1 | m2", ["c"], ["CWE-1"], "warning", ["u"]),
                        ("r", "s", "b.py", 2, 1, 0, 0, "", "", [], [], "", [])])
    ctx = {r["path"]: r["vuln"] for r in ctxop.build_contexts(m).collect()}
    a = ctx["a.py"]
    assert a["id"] == "a.py:3-5" and a["severity_overall"] == "WARNING" and a["message_items"] == ["m1", "m2"]
    assert a["message_text"] is None and a["bit"]["steps"] == ["Review lines 3-5 in a.py"]
    b = ctx["b.py"]
    assert b["bit"]["trigger"] == ctxop.DEFAULT_TRIGGER and b["classes"] is None and b["severity_bit"] == "UNKNOWN"
    v = {r["path"]: r for r in ctxop.validate_contexts(ctxop.build_contexts(m)).collect()}
    assert v["a.py"]["is_valid"] and not v["b.py"]["is_valid"]
    assert "RANGE@start must be a positive integer" in v["b.py"]["errors"]
    mini = ctxop.validate_contexts(ctxop.build_contexts_minimal(m)).collect()
    assert all(not r["is_valid"] and "BIT is required" in r["errors"] for r in mini)


def test_choose_cwes(spark):
    df = spark.createDataFrame([(["CWE-22: Path", "CWE-79"], ["CWE-79", "CWE-22"]), (["CWE-1"], ["CWE-2"]),
                                ([], ["CWE-3"]), (["CWE-4"], None)], "c array<string>, x array<string>")
    out = [r[0] for r in df.select(ctxop.choose_cwes(F.col("c"), F.col("x"))).collect()]
    assert out == [["CWE-22", "CWE-79"], ["CWE-1"], ["CWE-3"], ["CWE-4"]]


def test_prompt_render_and_reject(spark):
    m = _merged(spark, [("r", "s", "a.py", 1, 1, 2, 2, "x", "", [], [], "", []),
                        ("r", "s", "b.py", 2, 1, 1, 1, "x", "msg", ["k"], ["CWE-1"], "ERROR", [])])
    files = spark.createDataFrame([("r", "a.py", "print(1)\n"), ("r", "b.py", "  \n")], "repo string, path string, content string") \
        .withColumn("lines", split_lines("content"))
    out, rej = P.render_prompts(m, files)
    p = out.first()["prompt"]
    assert "```python\nprint(1)\n\n```" in p and "Type: Unknown\nCWE: N/A\nDescription: None\nSeverity: Unknown" in p
    assert "Location: 2 ~ 2 (Only modify this code range)\n\n" in p
    assert [r["code"] for r in rej.collect()] == ["EMPTY_SNIPPET"]
    req = P.chat_requests(out).first()["request"]
    assert '"temperature":0.3' in req and '"role":"system"' in req


def test_code_blocks(spark):
    texts = ["a\n```py\n x = 1 \n```\nb\n```PYTHON\ny\n```", "```javascript\nz\n```", "```python\nunterminated"]
    r = spark.createDataFrame([("r", "s", f"p{i}", t) for i, t in enumerate(texts)], "repo string, scan_id string, path string, content string")
    out, rej = P.extract_code_blocks(r)
    rows = out.collect()
    assert len(rows) == 1 and rows[0]["code"] == "x = 1\n\ny" and rows[0]["n_blocks"] == 2
    assert sorted(x["key"] for x in rej.collect()) == ["p1", "p2"]


def test_sections_tiers(spark):
    texts = {
        "strict": "1. Vulnerability Description: v\n2. Potential Risk: r\n3. Recommended Fix: f\n4. Final Modified Code:\n```python\nx\n```\n5. Additional Notes: n",
        "fullwidth": "1. Vulnerability Description： v\n2. Potential Risks：r\n3. Recommended Fix： f\n5. References： n",
        "plain": "Vulnerability Description: v\nPotential Risks: r\nRecommended Fix: f\nAdditional Notes: n",
        "headings": "## Vulnerability\nv\n## Fix\nf\n## Risks\nr",
        "empty": "1. Vulnerability Description:\n2. Potential Risk: r\n3. Recommended Fix: f\n5. Additional Notes: n",
    }
    r = spark.createDataFrame([("r", "s", k, t) for k, t in texts.items()], "repo string, scan_id string, path string, content string")
    rel = {x["path"]: x for x in P.sections_relaxed(r).collect()}
    assert (rel["strict"]["tier"], rel["strict"]["vulnerability"], rel["strict"]["references"]) == (1, "v", "n")
    assert (rel["fullwidth"]["tier"], rel["fullwidth"]["risks"]) == (1, "r")
    assert (rel["plain"]["tier"], rel["plain"]["risks"], rel["plain"]["recommended_fix"]) == (2, "r", "f")
    assert (rel["headings"]["tier"], rel["headings"]["vulnerability"], rel["headings"]["recommended_fix"],
            rel["headings"]["risks"], rel["headings"]["references"]) == (3, "v", "f", "r", "")
    assert (rel["empty"]["tier"], rel["empty"]["vulnerability"]) == (1, "")
    st = {x["path"]: x for x in P.sections_strict(r).collect()}
    assert st["strict"]["recommended_fix"] == "f" and st["plain"]["vulnerability"] == ""


def test_annotate(spark):
    files = spark.createDataFrame([("r", "a.py", "l1\nl2\nl3")], "repo string, path string, content string") \
        .withColumn("lines", split_lines("content")).withColumn("n_lines", F.size("lines"))
    f = spark.createDataFrame([("r", "s", "a.py", 1, 1, 1), ("r", "s", "a.py", 2, 1, 3), ("r", "s", "a.py", 3, 9, 9),
                               ("r", "s", "a.py", 4, 2, 7)],
                              "repo string, scan_id string, path string, ordinal long, start_line int, end_line int")
    out = PT.annotate_source(f, files).first()["annotated"]
    assert out == "l1  # @BUG_HERE  # @BUG_HERE_START\nl2  # @BUG_HERE\nl3  # @BUG_HERE_END\n"


def test_diff_and_patches(spark):
    orig = "a\nb  \nc\n"
    new = "a\nb\nC\n"
    pairs = spark.createDataFrame([("r", "s", "x/y.py", orig, new), ("r", "s", "z.py", "q\n", "q   ")],
                                  "repo string, scan_id string, path string, original string, code string")
    d = {r["path"]: r for r in PT.unified_diff(pairs).collect()}
    exp = "".join(difflib.unified_diff([x.rstrip() + "\n" for x in orig.splitlines()], [x.rstrip() + "\n" for x in new.splitlines()],
                                       fromfile="a/x/y.py", tofile="b/x/y.py", lineterm="\n"))
    assert d["x/y.py"]["diff"] == exp and d["z.py"]["status"] == "no_changes"
    st = {r["path"]: r for r in PT.diff_stats(pairs).collect()}
    assert (st["x/y.py"]["n_added"], st["x/y.py"]["n_removed"]) == (1, 1)
    files = spark.createDataFrame([("r", "x/y.py", orig), ("r", "z.py", "q\n"), ("r", "w.py", "w")], "repo string, path string, content string")
    parsed = pairs.select("repo", "scan_id", "path", "code").unionByName(
        spark.createDataFrame([("r", "s", "new.py", "n")], "repo string, scan_id string, path string, code string"))
    res = {r["path"]: r for r in PT.apply_patches(parsed, files).collect()}
    assert res["x/y.py"]["status"] == "patched" and res["x/y.py"]["content"] == new
    assert res["z.py"]["status"] == "unchanged" and res["w.py"]["status"] == "unchanged"
    assert res["new.py"]["status"] == "no_original"
    cs = spark.createDataFrame([(p,) for p in ["src/a.py", ".github/w.yml", ".snyk", "node_modules", "x/.github/y"]], "path string")
    assert sorted(r[0] for r in PT.exclude_paths(cs).collect()) == ["src/a.py", "x/.github/y"]


def test_read_responses(spark, tmp_path):
    d = tmp_path / "repoA" / "scan1"
    os.makedirs(d)
    (d / "response_src‣pkg‣m.py.md").write_text("```python\nx\n```", encoding="utf-8")
    (d / "notes.md").write_text("no", encoding="utf-8")
    rows = {r["file_name"]: r for r in P.read_responses(spark, str(tmp_path)).collect()}
    assert rows["response_src‣pkg‣m.py.md"]["path"] == "src/pkg/m.py" and rows["notes.md"]["path"] is None
    assert rows["notes.md"]["repo"] == "repoA" and rows["notes.md"]["scan_id"] == "scan1"


def test_context_options_and_strict_validation(spark):
    import pytest
    m = _merged(spark, [("r", "s", "a.py", 1, 1, 0, 0, "", "", [], [], "", [])])
    ctx = ctxop.build_contexts(m, include_env=False, include_mitigations=False, context_before=3,
                               extras=F.create_map(F.lit("k"), F.lit("v"))).first()["vuln"]
    assert ctx["env"] is None and ctx["mitigation"] is None
    assert (ctx["context"]["before"], ctx["context"]["after"]) == (3, 0) and ctx["extras"] == {"k": "v"}
    with pytest.raises(Exception):
        ctxop.validate_contexts(ctxop.build_contexts(m), strict=True).collect()


def test_strict_validation_passes_valid_contexts(spark):
    m = _merged(spark, [("r", "s", "a.py", 1, 1, 2, 3, "x", "m", ["c"], ["CWE-1"], "error", ["u"])])
    rows = ctxop.validate_contexts(ctxop.build_contexts(m), strict=True).collect()
    assert [r["is_valid"] for r in rows] == [True]
