"""K2 -> S5: context XML keeps snippet indentation, escapes markup, reads back by schema."""

import os

from findrift.operators import context as ctxop

MERGED = ("repo string, scan_id string, path string, first_ordinal long, n_findings long, start_line int, end_line int, "
          "snippet string, message string, vulnerability_class array<string>, cwe array<string>, severity string, "
          "references array<string>")


def test_context_xml_roundtrip(spark, tmp_path):
    snippet = "    if a < b and c > d:\n        return \"x\" & 'y'"
    m = spark.createDataFrame([("r", "s", "pkg/a.py", 1, 2, 3, 4, snippet, "m1 | m2", ["c"], ["CWE-1"], "error", ["http://u?a=1&b=2"])],
                              MERGED)
    out = str(tmp_path / "xml")
    ctxop.write_context_xml(ctxop.build_contexts(m), out)
    files = [os.path.join(dp, f) for dp, _, fs in os.walk(out) for f in fs if f.endswith(".xml")]
    text = open(files[0], encoding="utf-8").read()
    assert 'xmlns="urn:' in text and "VULNERABILITY" in text and "&lt;" in text
    back = ctxop.read_context_xml(spark, out).first()
    assert back["SNIPPET"] == snippet
    assert back["FILE"]["_path"] == "pkg/a.py" and back["RANGE"]["_start"] == 3
    assert back["REFERENCES"]["REF"][0]["_href"] == "http://u?a=1&b=2"
    assert back["BIT"]["STEPS"]["STEP"] == ["Review lines 3-4 in pkg/a.py"]
