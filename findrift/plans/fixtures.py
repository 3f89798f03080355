"""Deterministic recipes that derive the engine's inputs from the driver tables.

Every recipe is a Spark job over the given parquet tables, so its work grows
with them.  The DuckDB oracles in ``findrift.plans.oracle`` recompute the
expected answers from the same base tables by a different route.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.functions.columns import split_lines

# Fixed recipe parameters (mirrored in the oracle SQL).
TOOLS = ("semgrep", "codeql", "snykcode")
PART_EVENTS = 8192     # event-id span of one scanner output file
BROKEN_PARTS = 1_000_000  # first part number of the broken documents
RUN_EVENTS = 512       # event-id span of one SARIF run inside a file
SEVERITY_OF_EVENT = {"error": "ERROR", "purchase": "WARNING", "signup": "NOTE", "view": "INFO", "click": ""}
# One SARIF rule per event type: (event_type, cwe tags, helpUri, defaultConfiguration.level, problem.severity)
SARIF_RULES = [
    ("signup", ["security", "external/cwe/cwe-01"], "https://rules.example.org/signup", "note", None),
    ("purchase", ["security", "external/cwe/cwe-02", "CWE-89"], "https://rules.example.org/purchase", "warning", None),
    ("error", ["security", "external/cwe/cwe-03"], "https://rules.example.org/error", None, "error"),
    ("view", ["security", "external/cwe/cwe-04"], "", None, "recommendation"),
    ("click", ["security", "external/cwe/cwe-05"], None, None, None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-shaped table: one Python source file per document."""
    d = table(spark, sf_dir, "documents")
    lines = split_lines(F.col("text"))
    return d.select(
        F.col("doc_id"),
        F.col("source").alias("repo"),
        F.concat(F.lit("src/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"),
        lines.alias("lines"),
        F.size(lines).alias("n_lines"),
    )


def _severity_of(event_type):
    out = F.lit("")
    for ev, sev in SEVERITY_OF_EVENT.items():
        out = F.when(event_type == ev, F.lit(sev)).otherwise(out)
    return out


def scan_events(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """One scanner result per event, with the file it points to (before any parsing).

    doc_id = event_id mod count(documents) uses a scalar subquery, not a join.
    ``hot``: every third event points at document 0, so one (repo, scan, path)
    key holds a third of all rows (the skew case).
    """
    # count from the raw scan (answered from parquet metadata; no spreading)
    n_docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select(F.count(F.lit(1))).scalar()
    ev = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "ts",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        (F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % n_docs) if hot
         else F.col("event_id") % n_docs).cast("bigint").alias("doc_id"))
    sf = source_files(spark, sf_dir).select("doc_id", "repo", "path", "n_lines", "lines")
    j = ev.join(sf, "doc_id")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.col("event_id") % 3 + 1).cast("int"))
    start = (F.lit(1) + F.col("user_id") % F.col("n_lines")).cast("int")
    end = F.least(F.col("n_lines"), start + (F.col("event_id") % 3).cast("int")).cast("int")
    return j.select(
        "repo", "event_id", "doc_id", "path", "n_lines", "lines", "ts", "user_id", "event_type", "k",
        tool.alias("tool"),
        start.alias("start_line"), end.alias("end_line"),
        _severity_of(F.col("event_type")).alias("severity"),
        F.concat(F.lit("Possible "), F.col("event_type"), F.lit(" issue k="), F.col("k").cast("string")).alias("message"),
    ).withColumn("scan_id", F.concat_ws("-", "repo", "tool"))


def findings(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """The normalised ``findings`` table of the M0 recipe (Semgrep slicing, all events)."""
    e = scan_events(spark, sf_dir, hot)
    return e.select(
        "repo", "scan_id", F.col("event_id").alias("ordinal"), "tool",
        F.lit(None).cast("int").alias("idx"), "path", "start_line", "end_line",
        F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n").alias("snippet"),
        "message",
        F.array(F.col("event_type")).alias("vulnerability_class"),
        F.array(F.concat(F.lit("CWE-"), (F.col("k") % 7).cast("string"))).alias("cwe"),
        "severity",
        F.array(F.concat(F.lit("https://refs.example.org/"), (F.col("k") % 5).cast("string"))).alias("references"),
    )


def broken_contexts(ctx: DataFrame) -> DataFrame:
    """Contexts with one field spoilt: the (start line mod 19)-th of these, from 1; 0 leaves all as they are."""
    none, blank = F.array().cast("array<string>"), F.array(F.lit(""))
    spoilt = [("id", F.lit("")), ("file_path", F.lit(None)), ("range_start", F.lit(0)), ("range_end", F.lit(None)), ("severity_overall", F.lit(None)),
              ("severity_bit", F.lit(None)), ("message", F.lit(None)), ("message_items", none), ("snippet", F.lit(None)), ("bit", F.lit(None)),
              ("bit.trigger", F.lit(None)), ("bit.steps", none), ("bit.reproduction", F.lit(None)), ("bit.bit_severity", F.lit(None)),
              ("classes", none), ("weaknesses", blank), ("references", blank), ("preconditions", none)]
    which, v = F.col("start_line") % (len(spoilt) + 1), F.col("vuln")
    at = {name: (n, value) for n, (name, value) in enumerate(spoilt, 1)}
    at["message_text"] = at["message"]

    def field(name: str, now):
        if name in at:
            now = F.when(which == at[name][0], at[name][1]).otherwise(now)
        if name == "message_items":  # goes with the text as well
            now = F.when(which == at["message"][0], F.lit(None)).otherwise(now)
        return now

    kinds = {f.name: f.dataType for f in ctx.schema["vuln"].dataType.fields}
    bit = F.struct(*[field(f"bit.{n}", v["bit"][n]).alias(n) for n in kinds["bit"].names])
    return ctx.withColumn("vuln", F.struct(*[field(n, bit if n == "bit" else v[n]).alias(n) for n in kinds]))


# --------------------------------------------------------------------------- scanner output text
def _jstr(c):
    """JSON string literal of a string column (escaped by to_json)."""
    j = F.to_json(F.array(c))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _scanner_view(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """Scanner-side view of the events of one tool, with the two reject paths."""
    e = scan_events(spark, sf_dir).where(F.col("tool") == tool)
    # two repositories share one CodeQL scan id, so scan-level keys must hold the repository
    shared = (F.lit(tool) == "codeql") & F.col("repo").isin("src0", "src1")
    return e.select(
        "repo", F.when(shared, F.lit("shared-codeql")).otherwise(F.col("scan_id")).alias("scan_id"),
        "event_id", "event_type", "k", "message", "severity",
        F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("missing/"), F.col("path"))).otherwise(F.col("path")).alias("raw_path"),
        F.when(F.col("event_id") % 50 == 1, F.col("n_lines") + 1).otherwise(F.col("start_line")).cast("int").alias("raw_start"),
        F.col("end_line").alias("raw_end"),
        (F.col("event_id").cast("long") / PART_EVENTS).cast("long").alias("part"),
        ((F.col("event_id").cast("long") / RUN_EVENTS).cast("long") % 2).alias("run_pos"),
    )


def _with_broken(docs: DataFrame, spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """Plus one broken document (cut off after some results) per benchmark item."""
    b = table(spark, sf_dir, "benchmark")
    repo = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    head = '{"results":[{"path":' if tool == "semgrep" else '{"version":"2.1.0","runs":[{"results":[{"message":'
    return docs.unionByName(b.select(
        F.concat(repo, F.lit(f"-{tool}")).alias("scan_id"), repo.alias("repo"), F.lit(tool).alias("tool"),
        (F.lit(BROKEN_PARTS) + F.col("item_id")).alias("part"), F.concat(F.lit(head), _jstr(F.col("text")), F.lit("},")).alias("text")))


def semgrep_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native scanner JSON text, one document per (scan_id, part).

    cwe is a scalar when k is even, a list when odd, absent when k % 11 = 0;
    results with event_id % 7 = 0 use flat start_line/end_line keys;
    odd parts are written as a bare list instead of {"results": [...]}.
    """
    v = _scanner_view(spark, sf_dir, "semgrep")
    cwe_txt = F.concat(F.lit("CWE-"), (F.col("k") % 7).cast("string"))
    cwe_json = (F.when(F.col("k") % 11 == 0, F.lit(""))
                .when(F.col("k") % 2 == 0, F.concat(F.lit(',"cwe":'), _jstr(cwe_txt)))
                .otherwise(F.concat(F.lit(',"cwe":'), F.to_json(F.array(cwe_txt)))))
    meta = F.concat(F.lit('{"vulnerability_class":'), _jstr(F.col("event_type")), cwe_json,
                    F.lit(',"references":'),
                    F.to_json(F.array(F.concat(F.lit("https://refs.example.org/"), (F.col("k") % 5).cast("string")))),
                    F.lit("}"))
    pos = F.when(F.col("event_id") % 7 == 0,
                 F.format_string('"start_line":%d,"end_line":%d', F.col("raw_start"), F.col("raw_end"))
                 ).otherwise(F.format_string('"start":{"line":%d},"end":{"line":%d}', F.col("raw_start"), F.col("raw_end")))
    item = F.concat(F.lit('{"path":'), _jstr(F.col("raw_path")), F.lit(","), pos,
                    F.lit(',"extra":{"message":'), _jstr(F.col("message")),
                    F.lit(',"severity":'), _jstr(F.col("severity")),
                    F.lit(',"metadata":'), meta, F.lit("}}"))
    docs = (v.groupBy("repo", "scan_id", "part")
            .agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("j")))).alias("items")))
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]"))
    text = F.when(F.col("part") % 2 == 1, body).otherwise(F.concat(F.lit('{"results":'), body, F.lit("}")))
    out = docs.select("scan_id", "repo", F.lit("semgrep").alias("tool"), "part", text.alias("text"))
    return _with_broken(out, spark, sf_dir, "semgrep")


def sarif_rules_json() -> str:
    """JSON array of the fixed rules; '{RUN}' is replaced by the run number."""
    out = []
    for ev, tags, help_uri, lvl, psev in SARIF_RULES:
        r = {"id": f"py/{ev}"}
        if help_uri is not None:
            r["helpUri"] = help_uri + "/run{RUN}" if ev == "error" else help_uri
        if lvl is not None:
            r["defaultConfiguration"] = {"level": lvl}
        props = {"tags": tags}
        if psev is not None:
            props["problem.severity"] = psev
        r["properties"] = props
        out.append(r)
    return json.dumps(out)


def sarif_output(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """SARIF text, one document per (scan_id, part), two runs per document.

    result.level = lower(severity) for ERROR/WARNING/NOTE unless event_id % 4 = 0
    (then absent, so CodeQL falls back to the rule).  The 'error' rule's helpUri
    names its run, so CodeQL's "last run wins" rule map is observable.
    """
    v = _scanner_view(spark, sf_dir, tool)
    level = F.when(F.col("severity").isin("ERROR", "WARNING", "NOTE") & (F.col("event_id") % 4 != 0),
                   F.lower(F.col("severity")))
    region = F.format_string('{"startLine":%d,"endLine":%d}', F.col("raw_start"), F.col("raw_end"))
    region = F.when(F.col("event_id") % 9 == 0, F.format_string('{"startLine":%d}', F.col("raw_start"))).otherwise(region)
    result = F.concat(
        F.lit('{"ruleId":'), _jstr(F.concat(F.lit("py/"), F.col("event_type"))),
        F.when(level.isNotNull(), F.concat(F.lit(',"level":'), _jstr(level))).otherwise(F.lit("")),
        F.lit(',"message":{"text":'), _jstr(F.col("message")),
        F.lit('},"locations":[{"physicalLocation":{"artifactLocation":{"uri":'), _jstr(F.col("raw_path")),
        F.lit('},"region":'), region, F.lit("}}]}"))
    runs = (v.groupBy("repo", "scan_id", "part", "run_pos")
            .agg(F.array_sort(F.collect_list(F.struct("event_id", result.alias("j")))).alias("items")))
    # Rules section: the fixed five-rule list rendered once on the driver (a
    # constant string, no join); the 'error' rule's helpUri carries the global
    # run number through a placeholder.
    rules_txt = F.replace(F.lit(sarif_rules_json()), F.lit("{RUN}"),
                          (F.col("part") * 2 + F.col("run_pos")).cast("string"))
    run_json = F.concat(
        F.lit('{"tool":{"driver":{"name":"'), F.lit(tool), F.lit('","rules":'),
        rules_txt, F.lit('}},"results":['),
        F.array_join(F.transform("items", lambda x: x["j"]), ","), F.lit("]}"))
    docs = (runs.groupBy("repo", "scan_id", "part")
            .agg(F.array_sort(F.collect_list(F.struct("run_pos", run_json.alias("r")))).alias("runs")))
    text = F.concat(F.lit('{"version":"2.1.0","runs":['), F.array_join(F.transform("runs", lambda x: x["r"]), ","), F.lit("]}"))
    out = docs.select("scan_id", "repo", F.lit(tool).alias("tool"), "part", text.alias("text"))
    return _with_broken(out, spark, sf_dir, tool)


# --------------------------------------------------------------------------- model responses
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One markdown response per conversation turn.

    Numbered sections by default; un-numbered headings when conv_id % 7 = 0;
    '#' headings only when conv_id % 11 = 0 (and not % 7); no python fence
    when conv_id % 5 = 0.  Usage: prompt = length(text), completion = 10 * turn.
    """
    c = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    fence = F.when(F.col("conv_id") % 5 == 0, F.lit("")).otherwise(
        F.concat(F.lit("```python\nx = "), cid, F.lit("\n```\n")))
    numbered = F.concat(F.lit("1. Vulnerability Description: "), F.col("text"),
                        F.lit("\n2. Potential Risk: r"), turn, F.lit("\n3. Recommended Fix: fix "), cid,
                        F.lit("\n4. Final Modified Code:\n"), fence, F.lit("5. Additional Notes: n"), turn)
    plain = F.concat(F.lit("Vulnerability Description: "), F.col("text"),
                     F.lit("\nPotential Risks: r"), turn, F.lit("\nRecommended Fix: fix "), cid,
                     F.lit("\nFinal Modified Code:\n"), fence, F.lit("Additional Notes: n"), turn)
    headings = F.concat(F.lit("## Vulnerability\n"), F.col("text"), F.lit("\n## Fix\nfix "), cid,
                        F.lit("\n## Risks\nr"), turn, F.lit("\n## Notes\n"), fence)
    content = (F.when(F.col("conv_id") % 7 == 0, plain).when(F.col("conv_id") % 11 == 0, headings)
               .otherwise(numbered))
    repo = F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string"))
    return c.select(
        repo.alias("repo"), F.concat(repo, F.lit("-semgrep")).alias("scan_id"),
        F.concat(F.lit("src/conv_"), cid, F.lit("/turn_"), turn, F.lit(".py")).alias("path"),
        content.alias("content"),
        F.length("text").cast("bigint").alias("prompt_tokens"),
        (F.col("turn") * 10).cast("bigint").alias("completion_tokens"),
        (F.length("text") + F.col("turn") * 10).cast("bigint").alias("total_tokens"),
    )


def file_responses(spark: SparkSession, sf_dir: str, merged: DataFrame, some_missing: bool = False) -> DataFrame:
    """Responses for all merged files, in the numbered form, for report and patch
    stages; ``some_missing`` leaves out files whose first ordinal % 4 = 3."""
    m = merged.where(F.col("first_ordinal") % 4 != 3) if some_missing else merged
    content = F.concat(
        F.lit("1. Vulnerability Description: "), F.col("message"),
        F.lit("\n2. Potential Risk: r"), F.col("n_findings").cast("string"),
        F.lit("\n3. Recommended Fix: fix "), F.col("path"),
        F.lit("\n4. Final Modified Code:\n```python\nx = "), F.col("first_ordinal").cast("string"),
        F.lit("\n```\n5. Additional Notes: n"), F.col("start_line").cast("string"))
    return m.select("repo", "scan_id", "path", content.alias("content"))


# --------------------------------------------------------------------------- parsed (patched) code
def parsed_code(spark: SparkSession, sf_dir: str, some_missing: bool = False) -> DataFrame:
    """Parsed model output per file: doc_id % 3 = 0 -> line 1 + doc_id % n_lines
    replaced by 'fixed_<doc_id>', else identical text (``some_missing``: absent
    where doc_id % 3 = 2); plus one file without an original per benchmark row."""
    sf = source_files(spark, sf_dir)
    if some_missing:
        sf = sf.where(F.col("doc_id") % 3 != 2)
    target = F.lit(1) + F.col("doc_id") % F.col("n_lines")
    fixed = F.concat(F.lit("fixed_"), F.col("doc_id").cast("string"))
    changed = F.array_join(F.transform("lines", lambda l, i: F.when(i + 1 == target, fixed).otherwise(l)), "\n")
    docs = sf.select("repo", F.concat("repo", F.lit("-semgrep")).alias("scan_id"), "path",
                     F.when(F.col("doc_id") % 3 == 0, changed).otherwise(F.col("content")).alias("code"))
    b = table(spark, sf_dir, "benchmark")
    repo = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    bench = b.select(repo.alias("repo"), F.concat(repo, F.lit("-semgrep")).alias("scan_id"),
                     F.concat(F.lit("bench/item_"), F.col("item_id").cast("string"), F.lit(".py")).alias("path"),
                     F.col("text").alias("code"))
    return docs.unionByName(bench)


def change_set(spark: SparkSession, sf_dir: str, patched_paths: DataFrame) -> DataFrame:
    """Paths of a change set: patched files plus tool artefacts per benchmark row."""
    b = table(spark, sf_dir, "benchmark")
    repo = F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))
    iid = F.col("item_id").cast("string")
    arts = b.select(repo.alias("repo"), F.explode(F.array(
        F.concat(F.lit(".github/workflows/ci_"), iid, F.lit(".yml")),
        F.concat(F.lit("node_modules/m"), iid, F.lit("/index.js")),
        F.concat(F.lit("docs/.snyk_notes_"), iid, F.lit(".md")),
        F.lit(".snyk"), F.lit(".DS_Store"))).alias("path"))
    return patched_paths.select("repo", "path").unionByName(arts)


# --------------------------------------------------------------------------- python sources
def python_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic Python text per document, same (repo, path): for each document
    line i one ``def f<i>(a):`` / ``    return len("<i>")`` pair; documents with
    doc_id % 97 = 0 end in ``def (`` (a syntax error)."""
    sf = source_files(spark, sf_dir)
    defs = F.transform(F.sequence(F.lit(1), F.col("n_lines")),
                       lambda i: F.concat(F.lit("def f"), i.cast("string"), F.lit('(a):\n    return len("'),
                                          i.cast("string"), F.lit('")')))
    text = F.concat(F.array_join(defs, "\n"), F.lit("\n"),
                    F.when(F.col("doc_id") % 97 == 0, F.lit("def (\n")).otherwise(F.lit("")))
    return sf.select("doc_id", "repo", "path", text.alias("content"))


NEST, BODY = 20, 10_000


def nested_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax nodes of a large file per document: NEST functions, one inside the
    other, around a body of BODY lines, and a statement of 40 lines per document line."""
    sf = source_files(spark, sf_dir)
    shape = lambda *c: F.struct(*[x.cast("int").alias(n) for x, n in zip(c, ("bfs_id", "parent_id", "line", "col", "end_line", "end_col"))])
    inner = F.transform(F.sequence(F.lit(1), F.lit(NEST)), lambda i: F.struct(
        F.lit("FunctionDef").alias("node_type"), shape(i, i - 1, i, (i - 1) * 4, F.lit(2 * NEST + BODY) - i, i * 4 + 10).alias("at")))
    body = F.transform(F.sequence(F.lit(0), F.col("n_lines") - 1), lambda t: F.struct(
        F.lit("If").alias("node_type"), shape(F.lit(NEST + 1) + t, F.lit(NEST), F.lit(NEST + 1) + (t % 200) * 50, F.lit(4 * NEST),
                                              F.lit(NEST + 40) + (t % 200) * 50, F.lit(4 * NEST + 10)).alias("at")))
    return sf.select("repo", "path", F.explode(F.concat(inner, body)).alias("n")).select("repo", "path", "n.node_type", "n.at.*")


def nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings spread over the lines of those files, up to 60 lines long."""
    start = 1 + (F.col("ordinal") * 131 + F.col("start_line")) % (BODY + 2 * NEST - 1)
    return findings(spark, sf_dir).select("repo", "scan_id", "ordinal", "path", start.cast("int").alias("start_line"),
                                          (start + F.col("ordinal") % 60).cast("int").alias("end_line"))


# --------------------------------------------------------------------------- publish-log inputs
def _repo_url(user_id):
    return F.concat(F.lit("https://github.com/o"), (user_id % 5).cast("string"), F.lit("/r"), (user_id % 20).cast("string"))


def pr_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged PR per user: number = user_id, date = first event time."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"))
    u = F.col("user_id")
    return e.select(
        F.date_format("first_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("date"),
        F.concat(F.lit("o"), (u % 5).cast("string")).alias("owner"),
        F.concat(F.lit("r"), (u % 20).cast("string")).alias("repo"),
        F.concat(F.lit("u"), (u % 7).cast("string")).alias("user_name"),
        _repo_url(u).alias("repo_url"), F.sha2(_repo_url(u), 256).alias("repo_hash"),
        u.cast("int").alias("pr_number"))


def status_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a status update: approved = purchase, opened = signup or view.
    event_id % 97 = 0 carries no PR number; event_id % 50 = 0 names an unknown repo."""
    e = table(spark, sf_dir, "events")
    url = F.when(F.col("event_id") % 50 == 0, F.concat(_repo_url(F.col("user_id")), F.lit("-gone"))).otherwise(_repo_url(F.col("user_id")))
    return e.select(
        F.when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(F.col("user_id")).cast("int").alias("pr_number"),
        url.alias("repo_url"),
        (F.col("event_type") == "purchase").alias("approved"),
        F.col("event_type").isin("signup", "view").alias("opened"),
        F.col("ts"), F.col("event_id").alias("seq"))


def fork_prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRs on forks: one per customer with orders; every fourth is closed."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
    c = F.col("o_custkey")
    return o.select(F.concat(F.lit("r"), (c % 20).cast("string")).alias("repo"), c.alias("number"),
                    F.when(c % 4 == 0, F.lit("closed")).otherwise(F.lit("open")).alias("state"),
                    F.concat(F.lit("fix-"), c.cast("string")).alias("head_ref"),
                    F.col("created_at"))


def workflow_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CI runs: one per order; F -> completed/success, P -> completed/failure,
    O -> in_progress; linked to PRs o_custkey and o_custkey + 20 (same repo)."""
    o = table(spark, sf_dir, "orders")
    s = F.col("o_orderstatus")
    return o.select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 20).cast("string")).alias("repo"),
        F.col("o_orderkey").alias("id"),
        F.when(s.isin("F", "P"), F.lit("completed")).otherwise(F.lit("in_progress")).alias("status"),
        F.when(s == "F", F.lit("success")).when(s == "P", F.lit("failure")).alias("conclusion"),
        F.array(F.struct(F.col("o_custkey").alias("number")),
                F.struct((F.col("o_custkey") + 20).alias("number"))).alias("pull_requests"))


def repo_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repo-log entries from lineitem; repo_url is null for status 'F' rows so
    that null-safe equality matters.  part = 'existing' for even order keys."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_returnflag").alias("owner"),
        F.when(F.col("l_linestatus") == "F", F.lit(None)).otherwise(
            F.concat(F.lit("https://github.com/"), F.col("l_linestatus"))).alias("repo_url"),
        F.col("l_linenumber").cast("bigint").alias("vulnerabilities"),
        F.array(F.struct(F.col("l_returnflag").alias("type"), F.col("l_linenumber").cast("bigint").alias("count"))).alias("byClass"),
        F.lit("semgrep").alias("sastTool"),
        (F.col("l_linenumber") % 2 == 0).alias("rerun"),
        F.lit("").alias("analysis"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_orderkey") % 2 == 0, F.lit("existing")).otherwise(F.lit("new")).alias("batch"))


def repo_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories in a fleet run: src0 .. src24 (src20+ have no findings)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("src"), (F.col("c_custkey") % 25).cast("string")).alias("repo")).distinct()
