"""Scan-file reader, stream ingest equals the batch merge, oracle agreement at sf0.001."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from findrift import session
from findrift.functions.columns import split_lines
from findrift.operators import ingest, merge, prompts, report_text
from findrift.sources import files, json_chunks, scans
from findrift.streaming import streams

SMOKE = "/root/testdata/sf0.001"


def _files(spark):
    return spark.createDataFrame([("r1", "a.py", "x\ny\nz\n")], "repo string, path string, content string") \
        .withColumn("lines", split_lines("content")).withColumn("n_lines", F.size("lines"))


def test_read_scan_files(spark, tmp_path):
    d = tmp_path / "r1" / "scanA"
    os.makedirs(d)
    for i, line in enumerate([1, 2]):
        (d / f"out{i}.json").write_text(json.dumps({"results": [{"path": "a.py", "start": {"line": line}, "end": {"line": line}}]}))
    raw = scans.read_scan_files(spark, str(tmp_path), "semgrep")
    parts = sorted((r["scan_id"], r["repo"], r["part"]) for r in raw.collect())
    assert parts == [("scanA", "r1", 0), ("scanA", "r1", 1)]
    out, _ = ingest.semgrep_findings(raw, _files(spark))
    assert sorted(r["snippet"] for r in out.collect()) == ["x", "y"]


def test_files_of_several_lines_are_one_document_each(spark, tmp_path):
    d = tmp_path / "r1" / "scanA"
    os.makedirs(d)
    doc = {"results": [{"path": "a.py", "start": {"line": 1}, "end": {"line": 2}}]}
    (d / "out.json").write_text(json.dumps(doc, indent=2))
    for raw in (scans.read_scan_files(spark, str(tmp_path), "semgrep"), json_chunks.read_scan_chunks(spark, str(tmp_path), "semgrep", size=20)):
        out, rejects = ingest.semgrep_findings(raw, _files(spark))
        assert [r["snippet"] for r in out.collect()] == ["x\ny"] and rejects.count() == 0
    answer = "1. Vulnerability Description: v\n\n2. Potential Risk: r\n"
    (d / "response_src‣a.py.md").write_text(answer, encoding="utf-8")
    (d / "notes.md").write_text(answer, encoding="utf-8")
    got = sorted((r["repo"], r["scan_id"], r["path"] or "", r["content"]) for r in prompts.read_responses(spark, str(tmp_path)).collect())
    assert got == [("r1", "scanA", "", answer), ("r1", "scanA", "src/a.py", answer)]


def test_stored_sources_and_their_table(spark):
    stored = files.store_sources(_files(spark), bucket_bytes=10)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, _files(spark).collect()))
    tables = len(spark.catalog.listTables())
    session.drop_scratch(spark)
    assert len(spark.catalog.listTables()) < tables
    assert files.store_sources(_files(spark).where("false")).count() == 0


def test_reports_are_stored_in_ordered_parts(spark, tmp_path):
    rows = [("r", s, b, f, 0, q, t) for s in ("s1", "s2") for b in (0, 1) for f in range(30) for q, t in ((0, f"a{b}.{f}\nmore"), (1, ""), (2, "end"))]
    lines = spark.createDataFrame(rows, "repo string, scan_id string, block int, file_no long, part int, seq long, text string").repartition(5)
    report_text.write_reports(lines, str(tmp_path / "reports"), lines_per_part=7)
    got = report_text.read_reports(spark, str(tmp_path / "reports")).collect()
    for s in ("s1", "s2"):
        text = "\n".join(t for _, s_, *_, t in rows if s_ == s)
        assert [r["text"] for r in sorted((r for r in got if r["scan_id"] == s), key=lambda r: r["line_no"])] == text.split("\n")
    assert sum(len(f) for _, _, f in os.walk(tmp_path / "reports")) > 20


def _land_scans(landing, parts):
    docs = []
    for part in parts:
        res = [{"path": "a.py", "start": {"line": 1 + (part + k) % 3}, "end": {"line": 1 + (part + k) % 3},
                "extra": {"message": f"m{part}{k}", "severity": ["INFO", "ERROR"][k % 2]}} for k in range(3)]
        d = landing / "repo=r1" / "scan_id=s1" / f"part={part}"
        os.makedirs(d)
        (d / "f.json").write_text(json.dumps({"results": res}))
        docs.append(("s1", "r1", "semgrep", part, json.dumps({"results": res})))
    return docs


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    landing, out = tmp_path / "landing", str(tmp_path / "out")
    docs = []
    for parts in (range(5), range(5, 8)):  # the second run goes on from the checkpoints
        docs += _land_scans(landing, parts)
        for stream in (streams.stream_findings, streams.stream_file_findings):
            q = stream(spark, str(landing), _files(spark), out, max_files_per_trigger=2)
            q.awaitTermination()
            assert q.exception() is None
    got = sorted(map(tuple, streams.latest_file_findings(spark, out).select(*merge.MERGED_COLUMNS).collect()))
    raw = spark.createDataFrame(docs, "scan_id string, repo string, tool string, part long, text string")
    found, _ = ingest.semgrep_findings(raw, _files(spark))
    exp = sorted(map(tuple, merge.merge_findings_by_file(found).collect()))
    assert got == exp and got[0][merge.MERGED_COLUMNS.index("n_findings")] == 24
    assert spark.read.parquet(f"{out}/findings").count() == 24
    assert not {"state", "snapshot"} & set(os.listdir(out))


def test_merge_stream_holds_its_state_in_the_engine(spark, tmp_path):
    for tool in ("semgrep", "codeql", "snykcode"):
        (tmp_path / tool).mkdir()
        raw = streams._landed(spark, str(tmp_path / tool), tool, None)
        found, _ = ingest.apply_policies(ingest.join_sources(ingest.BASES[tool](raw), _files(spark)), set())
        state = merge.merge_state(found)
        plan = state._jdf.queryExecution().analyzed().toString()
        assert state.isStreaming and "Window" not in plan and "/out/" not in plan


def test_oracles_at_smoke_scale(spark):
    """A few registered queries against their DuckDB oracle on sf0.001."""
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ("documents", "events", "conversations", "orders", "lineitem", "pages", "benchmark", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    for name in ("a1_merge_findings_by_file", "s3_codeql_findings", "t2b_sections_relaxed", "j6_findings_to_nodes"):
        sdf = E.queries()[name](spark, SMOKE)
        cols = sorted(sdf.columns)
        srows = sorted(tuple(str(r[c]) for c in cols) for r in sdf.collect())
        res = con.execute(E.oracle_sql()[name])
        names = [d[0] for d in res.description]
        orows = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in res.fetchall())
        assert srows == orows, name


def test_default_layout_and_bytes_that_are_no_utf8(spark, tmp_path):
    root = tmp_path / "c++ (x)"
    for name, data in (("r1/pkg/sub/a.py", b"x\n"), ("r1/b.py", "é".encode()), ("r2/bad.py", b"ok\n\xff\xfe"), ("r2/c.txt", b"no")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = sorted((r["repo"], r["path"], r["n_lines"]) for r in files.read_source_files(spark, str(root)).collect())
    assert got == [("r1", "b.py", 1), ("r1", "pkg/sub/a.py", 1)]
    assert [(r["repo"], r["key"], r["code"]) for r in files.source_rejects(spark, str(root)).collect()] == [("r2", "bad.py", "NOT_UTF8")]


def test_broken_documents_become_rejects_and_shared_scan_ids_stay_apart(spark):
    ok = {"runs": [{"tool": {"driver": {"rules": []}}, "results": [{"ruleId": "x", "locations": [{"physicalLocation": {
        "artifactLocation": {"uri": "a.py"}, "region": {"startLine": n}}}]} for n in (1, 2)]}]}
    rows = [("s", r, "codeql", 0, json.dumps(ok)) for r in ("r1", "r2")] + [("s", "r1", "codeql", i, t) for i, t in enumerate(("{", "", None, "[]"), 1)]
    src = _files(spark).unionByName(_files(spark).withColumn("repo", F.lit("r2")))
    found, rejects = ingest.codeql_findings(spark.createDataFrame(rows, "scan_id string, repo string, tool string, part long, text string"), src)
    assert sorted((r["repo"], r["idx"]) for r in found.collect()) == [("r1", 0), ("r1", 1), ("r2", 0), ("r2", 1)]
    assert sorted((r["key"], r["code"]) for r in rejects.collect()) == [(f"codeql part {i}", "MALFORMED_DOCUMENT") for i in range(1, 5)]


def test_ordinals_fail_rather_than_collide(spark):
    df = spark.range(1).select(scans.ordinal(F.lit(0), F.lit(0), F.lit(1 << 24)).alias("o"))
    with pytest.raises(Exception, match="beyond the range"):
        df.collect()


def _update(pr, ts, seq):
    return {"pr_number": pr, "repo_url": "u", "approved": seq > 1, "opened": True, "ts": ts, "seq": seq}


def _land_updates(spark, tmp_path, name, *rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
    streams.stream_pr_status(spark, str(tmp_path / "in"), str(tmp_path / "out")).awaitTermination()
    out = str(tmp_path / "out")
    found = [sorted(((r["pr_number"], r["seq"]) for r in df.collect()), key=str) for df in
             (spark.read.schema(streams.STATUS_SCHEMA).parquet(f"{out}/updates"), streams.late_pr_updates(spark, out))]
    return found, sorted((r["pr_number"], r["approved"]) for r in streams.current_pr_status(spark, out).collect())


def test_late_status_updates_are_kept_apart_and_count(spark, tmp_path):
    first, again = _update(1, "2026-01-20T00:00:00Z", 2), _update(1, "2026-01-19T12:00:00Z", 3)
    old, older = _update(2, "2026-01-01T00:00:00Z", 1), _update(1, "2026-01-02T00:00:00Z", 1)
    (updates, late), now = _land_updates(spark, tmp_path, "a.json", first, first, again)
    assert (updates, late, now) == ([(1, 2), (1, 3)], [], [(1, True)])
    # a redelivery in a later batch adds no row; rows behind the watermark go to the late table
    (updates, late), now = _land_updates(spark, tmp_path, "b.json", old, older, first, again, old)
    assert (updates, late, now) == ([(1, 2), (1, 3)], [(1, 1), (2, 1)], [(1, True), (2, False)])
    # neither do redeliveries of late rows, or of rows that the watermark has passed since
    _land_updates(spark, tmp_path, "c.json", _update(3, "2026-03-01T00:00:00Z", 5))
    (updates, late), now = _land_updates(spark, tmp_path, "d.json", old, first, _update(2, "2026-01-03T00:00:00Z", 2), _update(None, "2026-01-03T00:00:00Z", 9))
    assert updates == [(1, 2), (1, 3), (3, 5)]
    assert sorted(late, key=str) == [(1, 1), (2, 1), (2, 2), (None, 9)]
    assert now == [(1, True), (2, True), (3, True)]


def test_scratch_tables_can_be_dropped(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    assert session.drop_scratch(spark) >= 1 and not os.path.exists(path.removeprefix("file:"))


def test_clusters_must_name_the_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
