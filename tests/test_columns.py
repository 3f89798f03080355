"""Scalar functions: line builder, lists, CWE tags, severities, keys, paths, cells."""

from pyspark.sql import functions as F

from findrift.functions import columns as C


def _one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_split_lines_matches_python(spark):
    cases = ["", "a", "a\n", "a\n\n", "a\r\nb", "x\x0cy", "\n", "a\rb\n", "p q"]
    df = spark.createDataFrame([(c,) for c in cases], "v string").select("v", C.split_lines("v").alias("l"))
    for row in df.collect():
        assert row["l"] == row["v"].splitlines(), row["v"]


def test_pystrip_matches_python(spark):
    for v in ["  a  ", "\n\ta b \n", "", "　x　"]:
        assert _one(spark, C.pystrip("v"), v) == v.strip()


def test_ensure_list(spark):
    docs = ['{"m":{"cwe":"CWE-1"}}', '{"m":{"cwe":["a","b"]}}', '{"m":{}}', '{"m":{"cwe":null}}', '{"m":{"cwe":[]}}']
    df = spark.createDataFrame([(d,) for d in docs], "t string").select(C.ensure_list(F.parse_json("t"), "$.m.cwe").alias("l"))
    assert [r["l"] for r in df.collect()] == [["CWE-1"], ["a", "b"], [], [], []]


def test_cwe_from_tags_policies(spark):
    tags = ["security", "external/cwe/cwe-079", "CWE-89"]
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(C.cwe_from_tags(F.col("t"), "codeql")).first()[0] == ["CWE-079"]
    assert df.select(C.cwe_from_tags(F.col("t"), "snykcode")).first()[0] == ["CWE-079", "CWE-89"]


def test_class_from_rule(spark):
    df = spark.createDataFrame([("py/sql-injection",), ("plain",), ("",), (None,)], "r string")
    assert [x[0] for x in df.select(C.class_from_rule("r")).collect()] == [["sql-injection"], ["plain"], [], []]


def test_severity_pair_and_label(spark):
    df = spark.createDataFrame([("error",), ("",), (None,), ("note",), ("foo",)], "s string")
    assert [x[0] for x in df.select(C.severity_pair("s")).collect()] == ["ERROR", "UNKNOWN", "UNKNOWN", "NOTE", "FOO"]
    labels = [x[0] for x in df.select(C.severity_label("s")).collect()]
    assert labels[0].endswith("ERROR") and labels[1] == "N/A" and labels[4] == "FOO"


def test_message_items_and_trigger(spark):
    df = spark.createDataFrame([("a | b |  | c", None), ("single. more", None), (" | ", "m1|m2")], "m string, t string")
    items = [x[0] for x in df.select(C.message_items("m")).collect()]
    assert items == [["a", "b", "c"], ["single. more"], []]
    trig = [x[0] for x in df.select(C.trigger_text("m", "t")).collect()]
    # trigger text first piece; a blank-pieces trigger falls back to its stripped form
    assert trig == ["a", "single. more", "|"]
    df2 = spark.createDataFrame([(None, "  First sentence. Second | x")], "t string, m string")
    assert df2.select(C.trigger_text("t", "m")).first()[0] == "First sentence"


def test_key_roundtrip(spark):
    paths = ["src/a/b.py", "artifacts/downloaded_repo/x_y.py", "a_b/c.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    out = df.select(C.encode_key("p").alias("k")).select("k", C.decode_key("k").alias("d")).collect()
    assert out[0]["k"] == "response_src‣a‣b.py.md" and out[0]["d"] == "src/a/b.py"
    assert out[1]["d"] == "x_y.py"
    assert out[2]["d"] == "a_b/c.py"
    assert spark.createDataFrame([("other.md",)], "k string").select(C.decode_key("k")).first()[0] is None


def test_normalize_path_requires_boundary(spark):
    df = spark.createDataFrame([("/a/repo/x.py",), ("/a/repo2/x.py",), (" \\a\\repo\\y.py ",)], "p string")
    out = [x[0] for x in df.select(C.normalize_path("p", "/a/repo")).collect()]
    assert out == ["x.py", "a/repo2/x.py", "y.py"]


def test_md_cell_and_line_label(spark):
    df = spark.createDataFrame([("a|b\nc", 3, 3), ("x" * 130, 1, 4)], "s string, a int, b int")
    rows = df.select(C.md_cell("s", 120).alias("c"), C.line_label("a", "b").alias("l")).collect()
    assert rows[0]["c"] == "a\\|b c" and rows[0]["l"] == "3"
    assert rows[1]["c"] == "x" * 120 + "…" and rows[1]["l"] == "1~4"


def test_repo_from_url(spark):
    urls = ["https://github.com/owner/name.git", "https://github.com/owner/name/", "https://github.com/only", "https://x.org/a//b"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(C.repo_from_url("u").alias("r"))
    rows = [r["r"] for r in df.collect()]
    assert (rows[0]["owner"], rows[0]["name"]) == ("owner", "name")
    assert (rows[1]["owner"], rows[1]["name"]) == ("owner", "name")
    assert rows[2]["error"] is not None and rows[2]["owner"] is None
    assert (rows[3]["owner"], rows[3]["name"]) == ("a", "")


def test_contains_all(spark):
    df = spark.createDataFrame([("alpha beta",), ("alpha",)], "t string")
    assert [x[0] for x in df.select(C.contains_all("t", ["alpha", "beta"])).collect()] == [True, False]


def test_repo_url_variants(spark):
    urls = ["https://github.com/own/name", "https://github.com/own/name/extra", "https://github.com/only",
            "https://gitlab.example.com/a/b", "https://github.com/own/name.git/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    last = [r[0] for r in df.select(C.repo_name_from_url("u")).collect()]
    assert last == ["name", "extra", "only", "b", "name.git"]
    up = [r[0] for r in df.select(C.upstream_from_url("u")).collect()]
    assert (up[0]["owner"], up[0]["name"]) == ("own", "name")
    assert (up[1]["owner"], up[1]["name"]) == ("own", "name")
    assert up[2]["error"] == "invalid repository URL"
    assert up[3]["error"] == "not a repository host URL"
    assert up[4]["name"] == "name.git"
