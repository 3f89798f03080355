"""Scanner documents in chunks against the same documents in one piece."""

import json
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from findrift.sources import json_chunks as jc
from findrift.sources import scans

KEYS = ["scan_id", "repo", "tool", "part"]

NASTY = 'br{ace} ]"quote\\ back\\\\ é日🙂 \t,'
RESULTS = [{"path": NASTY, "extra": {"message": '"\\"', "n": [[], {}, [{}]]}}, {"path": "b"}, {}, {"check_id": "x" * 50, "start": {"line": 3}}]
RULES = [{"id": "a", "helpUri": "u{1}", "properties": {"tags": ["t]", "external/cwe/cwe-01"]}}, {"id": "a", "defaultConfiguration": {"level": "error"}},
         {"id": "", "helpUri": "no"}, {"helpUri": "no id"}, {"id": "b", "properties": {}}]
SARIF_RESULT = {"ruleId": "a", "level": "note", "message": {"text": NASTY}, "locations": [
    {"physicalLocation": {"artifactLocation": {"uri": "f{}.py"}, "region": {"startLine": 2, "endLine": 4}}}]}


def native_documents():
    yield json.dumps({"version": "1", "results": RESULTS, "errors": [{"a": [1]}]}, ensure_ascii=False)
    yield json.dumps({"results": RESULTS}, indent=1)
    yield " \n" + json.dumps(RESULTS)
    yield from ("", "   ", "{}", "[]", "null", "5", '{"results":[]}', '{"results":null}', '{"results":5}', '{"results":{"a":{"b":1}}}',
                '{"results":[1,"s",null,{"path":"p"},[{"path":"q"}],true]}', '[1,{"path":"p"},"s"]')
    whole = json.dumps({"results": RESULTS})
    yield from (whole[:-1], whole[:-2], whole[:40], whole[1:], whole.replace("},", "}", 1), whole.replace('"b"', '"b'), whole + "}",
                '{"results":[{"path":"p",}]}', '{"results":[{"path":"p"}],}', '{"results":[{"path":"p"},,{"path":"q"}]}', '{"results":[{"path":"p"} {"path":"q"}]}',
                '{"results":[{"a":[1}]}', "}{", '{"a":{"results":[{"path":"deep"}]},"results":[{"path":"p"}]}')


def sarif_documents():
    run = lambda *r, **k: {"tool": {"driver": {"name": "n}", "rules": RULES, **k}}, "results": list(r)}
    yield json.dumps({"version": "2.1.0", "runs": [run(SARIF_RESULT, {"ruleId": "b"}), run(), run({"ruleId": "zz"}, SARIF_RESULT, {"level": ["error"]})]})
    yield json.dumps({"runs": [run(SARIF_RESULT, rules=[{"id": "a", "helpUri": "last"}]), run(SARIF_RESULT, rules=[{"id": "a", "helpUri": "later"}])]}, indent=2)
    yield json.dumps({"runs": [{"results": [SARIF_RESULT, 5, None, [SARIF_RESULT]]}, {"tool": {"driver": []}, "results": [SARIF_RESULT]}, {"tool": 3}]})
    yield from ("", "{}", '{"runs":[]}', '{"runs":5}', '{"runs":[{"results":{}}]}', '{"runs":[[{"results":[{}]}]]}')
    whole = json.dumps({"runs": [run(SARIF_RESULT)]})
    yield from (whole[:-3], whole[:60], whole.replace('"level"', '"level', 1), whole.replace("[{", "[", 1))


def documents(spark, texts, tool):
    rows = [(f"s{i % 3}", "r", tool, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "scan_id string, repo string, tool string, part long, text string")


def rows(df):
    as_text = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("variant", "struct", "array") else F.col(f.name) for f in df.schema.fields]
    return sorted(tuple(map(repr, r)) for r in df.select(*as_text).select(sorted(df.columns)).collect())


@pytest.mark.parametrize("size", [1, 3, 17, 400, 10**6])
def test_native_results_equal_those_of_whole_documents(spark, size):
    raw = documents(spark, native_documents(), "semgrep")
    assert rows(scans.native_results(jc.chunked(raw, size))) == rows(scans.native_results(raw))


@pytest.mark.parametrize("size", [2, 31, 10**6])
@pytest.mark.parametrize("scope", ["file", "run"])
def test_sarif_results_and_rules_equal_those_of_whole_documents(spark, size, scope):
    raw = documents(spark, sarif_documents(), "codeql")
    # the run in which a broken document breaks off is not told by its chunks
    run = F.when(F.col("doc_error").isNull(), F.col("run_pos"))
    found, want = (scans.sarif_results(x, scope).withColumn("run_pos", run) for x in (jc.chunked(raw, size), raw))
    assert rows(found) == rows(want)
    if scope == "file":
        assert rows(scans.sarif_rules(jc.chunked(raw, size))) == rows(scans.sarif_rules(raw))


def test_no_documents(spark):
    raw = documents(spark, ["{}"], "semgrep").where("false")
    assert scans.native_results(jc.chunked(raw)).count() == scans.sarif_results(jc.chunked(raw)).count() == 0


def _cut(text: bytes, cuts: list[int], outline: int):
    """The steps of ``cut`` in plain Python: records by (seq, run, k), outline."""
    edges = sorted({0, *(c % (len(text) + 1) for c in cuts)})
    chunks = [text[a:z] for a, z in zip(edges, [*edges[1:], len(text)])]
    inside = esc = depth = 0
    owner, records, pieces, outline_text = None, {}, {}, b""
    top = outline
    for seq, raw in enumerate(chunks):
        for kind, run, k, own, t in jc.cut_chunk(raw, seq, inside, esc, depth, top, owner):
            if kind == jc.WHOLE:
                records[seq, run, k] = t
            elif kind == jc.PIECE:
                pieces.setdefault(own, []).append((run, k, t))
            else:
                outline_text += t
        ends, escs, deltas, opens = jc.summary(raw)
        start = inside + 2 * esc
        if top - depth in opens[start]:
            owner = seq
        inside, esc, depth = ends[start], escs[start], depth + deltas[start]
    for own, p in pieces.items():
        records[own, p[0][0], p[0][1]] = b"".join(t for _, _, t in p)
    return records, json.loads(outline_text)


strings = st.text(alphabet='"\\{}[],:ab é\n', max_size=8)
values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | strings,
                      lambda v: st.lists(v, max_size=4) | st.dictionaries(strings, v, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(values, max_size=6), st.dictionaries(strings.filter(lambda k: k != "results"), values, max_size=2), st.lists(st.integers(0, 10**6), max_size=12),
       st.booleans())
def test_any_cut_gives_the_same_records(results, other, cuts, ascii_):
    doc = {**other, "results": results}
    records, outline = _cut(json.dumps(doc, ensure_ascii=ascii_).encode(), cuts, jc.NATIVE)
    got = []
    for e in outline["results"]:
        if isinstance(e, dict):
            got += [json.loads(records[e["@"], e["run"], k]) for k in range(e["n"])]
        else:
            got.append(e)
    assert got == results


def test_outline_is_small():
    doc = json.dumps({"results": RESULTS * 5000}).encode()
    records, _ = _cut(doc, list(range(0, len(doc), 50_000)), jc.NATIVE)
    assert len(records) == 20_000
    outline = [t for kind, *_, t in jc.cut_chunk(doc, 0, 0, 0, 0, 2, None) if kind == jc.OUTLINE][0]
    assert len(outline) < 100


def test_files_are_read_in_ranges(spark, tmp_path):
    texts = {"a b%20.json": json.dumps({"results": RESULTS * 40}), "b+.json": json.dumps(RESULTS * 3), "c.json": json.dumps({"results": RESULTS}) + "\n\n",
             "e.json": '{"results":[{"path":"p"}', "f.json": '{"results":[]}'}
    folder = tmp_path / "repo1" / "scan1"
    os.makedirs(folder)
    for name, t in texts.items():
        (folder / name).write_text(t, encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        chunks = jc.read_scan_chunks(spark, str(tmp_path), "semgrep", size=700)
        got = {}
        for r in sorted(chunks.collect(), key=lambda r: (r["part"], r["seq"])):
            assert (r["scan_id"], r["repo"], r["tool"]) == ("scan1", "repo1", "semgrep")
            got.setdefault(r["part"], []).append(r["text"])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert ["".join(got[k]) for k in sorted(got)] == [texts[n] for n in sorted(texts)]
    assert len(got[0]) > 5


def test_chunks_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(t):
        made.add(1)
        return t

    texts = ['{"results":[{"a":1},{"a"', ':2},{"a":3}', ']}']
    chunks = spark.createDataFrame([("s", "r", "semgrep", 0, i, t) for i, t in enumerate(texts)], "scan_id string, repo string, tool string, part long, seq long, text string")
    records, outlines = jc.cut(chunks.withColumn("text", F.udf(count, "string").asNondeterministic()("text")), jc.NATIVE)
    assert sorted(r["text"] for r in records.collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']
    assert outlines.count() == 1 and made.value == 3
