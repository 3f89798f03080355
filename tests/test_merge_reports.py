"""A1 tie/rank rules and partition independence; rollups and numbering."""

from pyspark.sql import functions as F

from findrift.operators import merge, reports

SCHEMA = ("repo string, scan_id string, ordinal long, tool string, idx int, path string, start_line int, "
          "end_line int, snippet string, message string, vulnerability_class array<string>, cwe array<string>, "
          "severity string, references array<string>")


def _f(spark, rows):
    full = [("r", "s", o, "semgrep", None, p, s, e, snip, m, cls, cwe, sev, refs)
            for (o, p, s, e, snip, m, cls, cwe, sev, refs) in rows]
    return spark.createDataFrame(full, SCHEMA)


def test_merge_rules(spark):
    rows = [
        (1, "a", 5, 6, "b\na", "m2", ["x"], ["CWE-2"], "note", ["r1"]),
        (2, "a", 2, 3, "a\nc\n", "m1", ["y", "x"], ["CWE-1"], "FOO", []),
        (3, "a", 9, 9, None, "", [], [], "", ["r0"]),
        (4, "b", 1, 1, "", "", [], [], "", []),
        (5, "c", 1, 2, "z", "q", [], [], "warning", []),
        (6, "c", 3, 4, "z", "q", [], [], "ERROR", []),
        (7, "c", 5, 5, "y", "p", [], [], "error", []),
    ]
    out = {r["path"]: r for r in merge.merge_findings_by_file(_f(spark, rows)).collect()}
    a = out["a"]
    assert (a["start_line"], a["end_line"], a["n_findings"], a["first_ordinal"]) == (2, 9, 3, 1)
    assert a["snippet"] == "a\nb\nc"
    assert a["message"] == "m1 | m2"
    assert a["vulnerability_class"] == ["x", "y"] and a["cwe"] == ["CWE-1", "CWE-2"] and a["references"] == ["r0", "r1"]
    # NOTE and FOO both rank -1: the earlier one wins, upper-cased
    assert a["severity"] == "NOTE"
    assert out["b"]["severity"] == "" and out["b"]["snippet"] == "" and out["b"]["message"] == ""
    # ERROR beats WARNING; among equal ranks the earliest ordinal wins
    assert out["c"]["severity"] == "ERROR" and out["c"]["snippet"] == "y\nz"


def test_merge_partition_independent(spark):
    rows = [(i, f"p{i % 7}", i % 5 + 1, i % 5 + 2, f"l{i % 3}\nl{i % 4}", f"m{i % 2}", [f"c{i % 3}"], [f"CWE-{i % 4}"],
             ["INFO", "WARNING", "ERROR", "NOTE", ""][i % 5], []) for i in range(200)]
    df = _f(spark, rows)
    a = sorted(map(tuple, merge.merge_findings_by_file(df.repartition(1)).collect()))
    b = sorted(map(tuple, merge.merge_findings_by_file(df.repartition(8)).collect()))
    assert a == b
    # idempotent on severity / classes / CWEs when merged twice
    m1 = merge.merge_findings_by_file(df).withColumnRenamed("first_ordinal", "ordinal") \
        .withColumn("tool", F.lit("semgrep")).withColumn("idx", F.lit(None).cast("int"))
    m2 = {r["path"]: r for r in merge.merge_findings_by_file(m1).collect()}
    for r in m1.collect():
        assert m2[r["path"]]["severity"] == r["severity"] and m2[r["path"]]["cwe"] == r["cwe"]


def test_class_counts_and_numbers(spark):
    rows = [(1, "a", 1, 1, "", "", ["x"], [], "", []), (2, "b", 1, 1, "", "", ["y"], [], "", []),
            (3, "a", 1, 1, "", "", ["x", "z"], [], "", []), (4, "c", 1, 1, "", "", [], [], "", [])]
    df = _f(spark, rows)
    cc = {r["type"]: r for r in reports.class_counts(df).collect()}
    assert (cc["x"]["count"], cc["x"]["class_pos"], cc["x"]["vulnerabilities"]) == (2, 1, 3)
    assert (cc["y"]["count"], cc["y"]["class_pos"]) == (1, 2)
    nums = {r["path"]: r["file_no"] for r in reports.file_numbers(df).collect()}
    assert nums == {"a": 1, "b": 2, "c": 3}


def test_ranked_matches_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 100003).alias("o"))
    got = reports.ranked(df, ["g"], "o", "rn", bucket_bits=6)
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    assert got.exceptAll(exp.select(*got.columns)).count() == 0


def test_top_cwes_stable_ties(spark):
    rows = [(1, "a", 1, 1, "", "", [], ["CWE-9"], "", []), (2, "a", 1, 1, "", "", [], ["CWE-1"], "", []),
            (3, "a", 1, 1, "", "", [], ["CWE-1"], "", []), (4, "a", 1, 1, "", "", [], ["CWE-9"], "", []),
            (5, "a", 1, 1, "", "", [], ["CWE-5"], "", [])]
    df = _f(spark, rows).withColumn("chosen_cwes", F.col("cwe"))
    top = [r["cwe"] for r in reports.top_cwes(df).orderBy("rank").collect()]
    assert top == ["CWE-9", "CWE-1"]
    roll = reports.file_severity_rollup(df.withColumn("severity", F.lit("error"))).first()
    assert roll["levels"] == "E:5" and roll["top_cwes"] == "CWE-9, CWE-1"


def _py_merge(rows):
    """Brute-force per-file merge over Python lists (the semantics of A1)."""
    rank = {"INFO": 0, "WARNING": 1, "ERROR": 2}
    groups = {}
    for r in sorted(rows, key=lambda r: r[0]):
        groups.setdefault(r[1], []).append(r)
    out = {}
    for path, g in groups.items():
        lines = set()
        for r in g:
            if r[4]:
                lines.update(r[4].splitlines())
        sevs = [str(r[8]).upper() for r in g if r[8]]
        best = max(sevs, key=lambda x: rank.get(x, -1), default="")
        out[path] = (min(r[2] for r in g), max(r[3] for r in g), "\n".join(sorted(lines)),
                     " | ".join(sorted({r[5] for r in g if r[5]})), best)
    return out


def test_merge_hot_file_matches_brute_force(spark):
    import random
    rnd = random.Random(3)
    sev = ["INFO", "warning", "ERROR", "NOTE", "", "foo", "Info"]
    rows = []
    for i in range(3000):
        path = "hot.py" if rnd.random() < 0.7 else f"f{rnd.randint(0, 40)}.py"   # one file holds most rows
        s = rnd.randint(1, 50)
        snip = "\n".join(f"line{(s + k) % 23}" for k in range(rnd.randint(0, 3)))
        rows.append((i, path, s, s + rnd.randint(0, 4), snip, rnd.choice(["", "a", "b", "c d"]), [], [],
                     rnd.choice(sev), []))
    exp = _py_merge(rows)
    got = {r["path"]: (r["start_line"], r["end_line"], r["snippet"], r["message"], r["severity"])
           for r in merge.merge_findings_by_file(_f(spark, rows).repartition(8)).collect()}
    assert got == exp
