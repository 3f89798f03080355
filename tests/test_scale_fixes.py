"""Work done once and texts moved once: R1's join, T3's joins, stored reports, META counts."""

from pyspark.sql import functions as F

from findrift.functions.columns import split_lines
from findrift.operators import context as ctxop
from findrift.operators import ingest
from findrift.operators import prompts as P
from findrift.operators import report_text as RT
from findrift.plans import catalog
from findrift.streaming import streams as ST


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stream_join_gives_the_rows_of_join_sources(spark):
    text = ('{"results":[{"path":"a.py","start":{"line":1},"end":{"line":2}},{"path":"gone.py","start":{"line":1},"end":{"line":1}},'
            '{"path":"none.py","start":{"line":1},"end":{"line":1}},{"path":"odd.py","start":{"line":1},"end":{"line":1}}]}')
    raw = spark.createDataFrame([("s", "r", "semgrep", 0, text), ("s", "r", "semgrep", 1, '{"results":[')],
                                "scan_id string, repo string, tool string, part long, text string")
    files = spark.createDataFrame([("r", "a.py", "x\ny\n"), ("r", "none.py", None), ("r", "odd.py", "p q\n")], "repo string, path string, content string")
    files = files.withColumn("lines", split_lines("content")).withColumn("n_lines", F.size("lines"))
    mine = ST._joined(raw, files, "semgrep")
    theirs = ingest.join_sources(ingest.semgrep_base(raw), files).select(*mine.columns)
    key = lambda r: (r["part"], str(r["pos"]))
    assert sorted(mine.collect(), key=key) == sorted(theirs.collect(), key=key)
    assert "split" not in _plan(mine)[_plan(mine).index("Join"):]  # lines are cut above the join


def test_prompts_meet_contexts_before_texts(spark):
    merged = spark.createDataFrame([("r", "s", "a.py", 1, 2, "m", "ERROR", ["c"], ["CWE-1"], "semgrep"), ("r", "s", "b.py", 1, 2, "m", "ERROR", ["c"], ["CWE-1"], "semgrep")],
                                   "repo string, scan_id string, path string, start_line int, end_line int, message string, severity string, "
                                   "vulnerability_class array<string>, cwe array<string>, tool string")
    files = spark.createDataFrame([("r", "a.py", "x\n"), ("r", "b.py", "y\n")], "repo string, path string, content string").withColumn("lines", split_lines("content"))
    xml = spark.createDataFrame([("r", "s", "a.py", 1, "<V/>")], "repo string, scan_id string, path string, start_line int, xml string")
    out, _ = P.render_prompts(merged, files, xml)
    assert {(r["path"], "<V/>" in r["prompt"], "x\n" in r["prompt"]) for r in out.collect()} == {("a.py", True, True), ("b.py", False, False)}
    joins = [x for x in _plan(out).splitlines() if "Join " in x]
    assert "scan_id" not in joins[0] and "scan_id" in joins[1]


def test_stored_reports_make_each_line_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(t):
        made.add(1)
        return t

    lines = spark.range(0, 200, 1, 4).select(
        F.lit("r").alias("repo"), F.lit("s").alias("scan_id"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("file_no"), F.lit(0).alias("part"),
        F.col("id").alias("seq"), F.udf(count, "string")(F.concat(F.lit("l"), F.col("id").cast("string"))).alias("text"))
    RT.write_reports(lines, str(tmp_path / "out"), lines_per_part=30)
    assert made.value == 200
    back = RT.read_reports(spark, str(tmp_path / "out")).orderBy("line_no").collect()
    assert [r["text"] for r in back] == [f"l{i}" for i in range(200)]


def test_meta_counts_read_no_text(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(0, "a\nb", "en", "src0"), (1, "c", "de", "src1")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 3, "error", '{"k": 1}') for i in range(6)], "event_id long, user_id long, event_type string, props string").withColumn(
        "ts", F.lit("2026-01-01").cast("timestamp_ntz")).write.parquet(f"{d}/events.parquet")
    meta = ctxop.scan_meta(catalog._counted(spark, d), F.lit("t"))
    read = [x for x in meta._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in x]
    assert read and not any("text:" in x for x in read)
    key = lambda r: r["scan_id"]
    assert sorted(meta.collect(), key=key) == sorted(ctxop.scan_meta(catalog._contexts(spark, d), F.lit("t")).collect(), key=key)


def test_body_lines_make_each_finding_once(spark, tmp_path, monkeypatch):
    d = str(tmp_path)
    spark.createDataFrame([(0, "a\nb", "en", "src0"), (1, "c", "de", "src1")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 3, "error", '{"k": 1}') for i in range(6)], "event_id long, user_id long, event_type string, props string").withColumn(
        "ts", F.lit("2026-01-01").cast("timestamp_ntz")).write.parquet(f"{d}/events.parquet")
    made, found = spark.sparkContext.accumulator(0), catalog.fx.findings

    def count(t):
        made.add(1)
        return t

    counting = F.udf(count, "string").asNondeterministic()
    monkeypatch.setattr(catalog.fx, "findings", lambda *a, **k: found(*a, **k).withColumn("message", counting("message")))
    lines = catalog.t9b_pr_body_lines(spark, d)
    assert lines.where("block = 2 and part = 3").count() == 6
    assert made.value == 6
