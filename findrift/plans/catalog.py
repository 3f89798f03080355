"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query derives its inputs from the driver tables with the recipes of
``fixtures`` and runs the library operators over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findrift.operators import merge
from findrift.plans import fixtures as fx

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def flat(df: DataFrame, sep: str = ";") -> DataFrame:
    """Arrays of strings -> joined strings, so results compare by value."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            cols.append(F.array_join(F.col(f.name), sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


@register("a1_merge_findings_by_file")
def a1_merge_findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(merge.merge_findings_by_file(fx.findings(spark, sf_dir)))


@register("a1_hot_file_merge")
def a1_hot_file_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 with one file holding a third of all findings (skew case)."""
    return flat(merge.merge_findings_by_file(fx.findings(spark, sf_dir, hot=True)))


# --------------------------------------------------------------------------- M1 ingest
from findrift.operators import ingest  # noqa: E402
from findrift.sources import files as SRC  # noqa: E402
from findrift.sources import json_chunks, scans  # noqa: E402


def _ingest(spark: SparkSession, sf_dir: str, tool: str):
    files = fx.source_files(spark, sf_dir)
    raw = fx.semgrep_output(spark, sf_dir) if tool == "semgrep" else fx.sarif_output(spark, sf_dir, tool)
    return ingest.ADAPTERS[tool](raw, files)


@register("s2_semgrep_findings")
def s2_semgrep_findings(spark, sf_dir):
    return flat(_ingest(spark, sf_dir, "semgrep")[0])


@register("s3_codeql_findings")
def s3_codeql_findings(spark, sf_dir):
    return flat(_ingest(spark, sf_dir, "codeql")[0])


@register("s3_snyk_findings")
def s3_snyk_findings(spark, sf_dir):
    return flat(_ingest(spark, sf_dir, "snykcode")[0])


#: Small chunks, so that results, strings and escapes lie across their ends.
_CHUNK_CHARS = 4096


def _ingest_chunks(spark, sf_dir, tool):
    raw = fx.semgrep_output(spark, sf_dir) if tool == "semgrep" else fx.sarif_output(spark, sf_dir, tool)
    return ingest.ADAPTERS[tool](json_chunks.chunked(raw, _CHUNK_CHARS), fx.source_files(spark, sf_dir))


@register("s2_semgrep_chunks")
def s2_semgrep_chunks(spark, sf_dir):
    """S2 over documents cut into chunks of 4 KB."""
    return flat(_ingest_chunks(spark, sf_dir, "semgrep")[0])


@register("s3_codeql_chunks")
def s3_codeql_chunks(spark, sf_dir):
    """S3 with the CodeQL policy over documents cut into chunks of 4 KB."""
    return flat(_ingest_chunks(spark, sf_dir, "codeql")[0])


@register("s3_snyk_chunks")
def s3_snyk_chunks(spark, sf_dir):
    """S3 with the Snyk policy over documents cut into chunks of 4 KB."""
    return flat(_ingest_chunks(spark, sf_dir, "snykcode")[0])


@register("f2_chunk_rejects")
def f2_chunk_rejects(spark, sf_dir):
    """F2 over documents of all tools cut into chunks of 4 KB: broken ones give one reject each."""
    raws = {"semgrep": fx.semgrep_output(spark, sf_dir), "codeql": fx.sarif_output(spark, sf_dir, "codeql"),
            "snykcode": fx.sarif_output(spark, sf_dir, "snykcode")}
    return ingest.union_tools({t: json_chunks.chunked(r, _CHUNK_CHARS) for t, r in raws.items()}, fx.source_files(spark, sf_dir))[1]


@register("j2_attach_rules")
def j2_attach_rules(spark, sf_dir):
    return flat(ingest.codeql_rule_map(fx.sarif_output(spark, sf_dir, "codeql")))


def stored_files(spark, sf_dir):
    """The source files as a bucketed table."""
    return SRC.store_sources(fx.source_files(spark, sf_dir))


def all_tools(spark, sf_dir):
    files = stored_files(spark, sf_dir)
    raws = {"semgrep": fx.semgrep_output(spark, sf_dir),
            "codeql": fx.sarif_output(spark, sf_dir, "codeql"),
            "snykcode": fx.sarif_output(spark, sf_dir, "snykcode")}
    return ingest.union_tools(raws, files)


@register("f2_rejects")
def f2_rejects(spark, sf_dir):
    return all_tools(spark, sf_dir)[1]


@register("o4_union_tools")
def o4_union_tools(spark, sf_dir):
    return flat(all_tools(spark, sf_dir)[0])


@register("o5_tool_agreement")
def o5_tool_agreement(spark, sf_dir):
    return flat(ingest.tool_agreement(all_tools(spark, sf_dir)[0]))


# --------------------------------------------------------------------------- M2 / M3 rollups and contexts
from findrift.operators import context as ctxop  # noqa: E402
from findrift.operators import reports  # noqa: E402
from findrift.session import many_folders, scratch_path  # noqa: E402


def _contexts(spark, sf_dir):
    merged = merge.merge_findings_by_file(fx.findings(spark, sf_dir))
    return ctxop.build_contexts(merged)


def _counted(spark, sf_dir):
    """The merged files for their number: no line of text is read or moved again."""
    return merge.merge_findings_by_file(fx.findings(spark, sf_dir), snippet=False)


def _attached(spark, sf_dir):
    # the context lookup never reads the merged snippet, so the line set is skipped
    merged = merge.merge_findings_by_file(fx.findings(spark, sf_dir), snippet=False)
    return ctxop.attach_context(fx.findings(spark, sf_dir), ctxop.build_contexts(merged))


def _chosen(spark, sf_dir):
    a = _attached(spark, sf_dir)
    return a.withColumn("chosen_cwes", ctxop.choose_cwes(F.col("cwe"), F.col("xml_cwes")))


def flat_context(ctx: DataFrame) -> DataFrame:
    v = F.col("vuln")
    return ctx.select(
        "repo", "scan_id", "path", "start_line",
        v["id"].alias("id"), v["range_end"].alias("end_line"),
        v["severity_overall"].alias("severity_overall"), v["severity_bit"].alias("severity_bit"),
        v["message_text"].alias("message_text"), F.array_join(v["message_items"], ";").alias("message_items"),
        v["snippet"].alias("snippet"), v["bit"]["trigger"].alias("trigger"),
        F.array_join(v["bit"]["steps"], ";").alias("steps"), v["bit"]["reproduction"].alias("reproduction"),
        v["bit"]["bit_severity"].alias("bit_severity"),
        F.array_join(v["classes"], ";").alias("classes"), F.array_join(v["weaknesses"], ";").alias("weaknesses"),
        F.array_join(v["references"], ";").alias("references"),
        F.array_join(v["preconditions"], ";").alias("preconditions"),
        v["env"]["node"].alias("env_node"), v["mitigation"].alias("mitigation"), v["tracking"].alias("tracking"))


@register("a2_class_counts")
def a2_class_counts(spark, sf_dir):
    return reports.class_counts(fx.findings(spark, sf_dir))


@register("w2_file_number")
def w2_file_number(spark, sf_dir):
    return reports.file_numbers(fx.findings(spark, sf_dir))


@register("t8_build_contexts")
def t8_build_contexts(spark, sf_dir):
    return flat_context(_contexts(spark, sf_dir))


@register("a4_scan_meta")
def a4_scan_meta(spark, sf_dir):
    merged = merge.merge_findings_by_file(fx.findings(spark, sf_dir))
    return ctxop.scan_meta(merged, F.lit("1970-01-01T00:00:00+00:00"))


@register("f5_validate_context")
def f5_validate_context(spark, sf_dir):
    merged = merge.merge_findings_by_file(fx.findings(spark, sf_dir))
    full = ctxop.validate_contexts(ctxop.build_contexts(merged)).withColumn("flavor", F.lit("v1.1"))
    mini = ctxop.validate_contexts(ctxop.build_contexts_minimal(merged)).withColumn("flavor", F.lit("v1.0"))
    return flat(full.unionByName(mini))


@register("f5_broken_contexts")
def f5_broken_contexts(spark, sf_dir):
    """F5 over contexts of which each breaks one rule of the schema, told by its start line (every 19th none)."""
    return flat(ctxop.validate_contexts(fx.broken_contexts(_contexts(spark, sf_dir))))


@register("j3_attach_context")
def j3_attach_context(spark, sf_dir):
    a = _attached(spark, sf_dir)
    return flat(a.select("repo", "scan_id", "ordinal", "path", "start_line",
                         F.col("xml_bit_severity").isNotNull().alias("matched"),
                         "xml_cwes", "xml_bit_severity", "xml_trigger", "xml_steps", "xml_references"))


@register("a7_choose_cwes")
def a7_choose_cwes(spark, sf_dir):
    c = _chosen(spark, sf_dir)
    return c.select("repo", "scan_id", "ordinal", F.array_join("chosen_cwes", ", ").alias("chosen_cwes"))


@register("w3_top_cwes")
def w3_top_cwes(spark, sf_dir):
    return reports.top_cwes(_chosen(spark, sf_dir))


@register("a3_file_severity_rollup")
def a3_file_severity_rollup(spark, sf_dir):
    return reports.file_severity_rollup(_chosen(spark, sf_dir))


@register("a6_flags")
def a6_flags(spark, sf_dir):
    return reports.presence_flags(_attached(spark, sf_dir))


@register("a8_context_rollup")
def a8_context_rollup(spark, sf_dir):
    return flat(ctxop.file_context_rollup(_attached(spark, sf_dir)))


@register("a11_fleet_rollup")
def a11_fleet_rollup(spark, sf_dir):
    return reports.fleet_rollup(fx.findings(spark, sf_dir))


@register("s5_context_roundtrip")
def s5_context_roundtrip(spark, sf_dir):
    """K2 then S5: contexts written as XML documents and read back."""
    out = scratch_path(spark, "contexts-xml")
    merged = merge.merge_findings_by_file(fx.findings(spark, sf_dir))
    ctxop.write_context_xml(ctxop.build_contexts(merged, context_before=2, context_after=3), out, ctxop.scan_meta(_counted(spark, sf_dir)))
    x = ctxop.read_context_xml(spark, out)
    return x.select("repo", "scan_id", F.col("FILE._path").alias("path"),
                    F.col("RANGE._start").alias("start_line"), F.col("RANGE._end").alias("end_line"),
                    F.col("_id").alias("id"), F.col("SEVERITY._overall").alias("severity_overall"),
                    F.col("SEVERITY._bit").alias("severity_bit"),
                    F.col("MESSAGE._VALUE").alias("message"), F.array_join("MESSAGE.MESSAGES.ITEM", ";").alias("message_items"),
                    F.col("SNIPPET").alias("snippet"), F.col("BIT.REPRODUCTION").alias("reproduction"),
                    F.col("BIT.BIT_SEVERITY").alias("bit_severity"), F.array_join("PRECONDITIONS.ITEM", ";").alias("preconditions"),
                    F.col("ENV.RUNTIME._node").alias("env_node"), F.col("ENV.RUNTIME._os").alias("env_os"),
                    F.col("MITIGATION.SUMMARY").alias("mitigation"), F.col("TRACKING").isNotNull().alias("tracking"),
                    F.col("CONTEXT._before").alias("context_before"), F.col("CONTEXT._after").alias("context_after"),
                    F.col("BIT.TRIGGER").alias("trigger"), F.array_join("BIT.STEPS.STEP", ";").alias("steps"),
                    F.array_join("CLASSES.CLASS", ";").alias("classes"),
                    F.array_join(F.transform("WEAKNESSES.CWE", lambda x: x["_id"]), ";").alias("weaknesses"),
                    F.array_join(F.transform("REFERENCES.REF", lambda x: x["_href"]), ";").alias("references"))


@register("s5_context_meta")
def s5_context_meta(spark, sf_dir):
    """A4's META rows written beside the contexts, read back and validated."""
    out = scratch_path(spark, "contexts-meta")
    ctx = _contexts(spark, sf_dir)
    ctxop.write_context_xml(ctx, out, ctxop.scan_meta(_counted(spark, sf_dir), F.lit("1970-01-01T00:00:00+00:00")))
    meta = ctxop.read_context_meta(spark, out).select(
        "repo", "scan_id", F.col("_generatedAt").alias("generatedAt"), F.col("_tool").alias("tool"), F.col("_count").alias("count"))
    return flat(meta.join(ctxop.validate_meta(meta), ["repo", "scan_id"]))


@register("t8b_contexts_minimal")
def t8b_contexts_minimal(spark, sf_dir):
    v = F.col("vuln")
    return ctxop.build_contexts_minimal(_merged(spark, sf_dir)).select(
        "repo", "scan_id", "path", "start_line", v["id"].alias("id"), v["range_end"].alias("end_line"),
        v["severity_overall"].alias("severity_overall"), v["message_text"].alias("message"), v["snippet"].alias("snippet"),
        v["severity_bit"].isNull().alias("no_bit"))


# --------------------------------------------------------------------------- M4 prompts and responses
from findrift.functions import columns as C  # noqa: E402
from findrift.operators import prompts as P  # noqa: E402


def _merged(spark, sf_dir):
    return merge.merge_findings_by_file(fx.findings(spark, sf_dir))


@register("t3_render_prompts")
def t3_render_prompts(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    out, _ = P.render_prompts(merged, fx.source_files(spark, sf_dir))
    return out


@register("t3_prompts_with_context")
def t3_prompts_with_context(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    xml = P.context_xml(ctxop.build_contexts(merged))
    out, _ = P.render_prompts(merged, fx.source_files(spark, sf_dir), xml)
    return out.select("repo", "scan_id", "path", F.length("prompt").alias("prompt_chars"),
                      F.sha2("prompt", 256).alias("prompt_sha"),
                      F.col("prompt").contains("<VULNERABILITY ").alias("has_context"))


@register("f4_empty_input_rejects")
def f4_empty_input_rejects(spark, sf_dir):
    """Prompts over files whose text is blanked when doc_id % 13 = 0 -> rejects."""
    files = fx.source_files(spark, sf_dir).withColumn(
        "content", F.when(F.col("doc_id") % 13 == 0, F.lit("  \n")).otherwise(F.col("content"))
    ).withColumn("lines", C.split_lines("content"))
    _, rej = P.render_prompts(_merged(spark, sf_dir), files)
    return rej


@register("t3b_retry_prompts")
def t3b_retry_prompts(spark, sf_dir):
    code, _ = P.extract_code_blocks(fx.responses(spark, sf_dir))
    return P.render_retry_prompts(code)


@register("t3c_chat_requests")
def t3c_chat_requests(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    out, _ = P.render_prompts(merged, fx.source_files(spark, sf_dir))
    req = P.chat_requests(out)
    return req.select("repo", "scan_id", "path", "kind",
                      F.get_json_object("request", "$.model").alias("model"),
                      F.get_json_object("request", "$.messages[0].content").alias("system"),
                      F.sha2(F.get_json_object("request", "$.messages[1].content"), 256).alias("user_sha"),
                      F.get_json_object("request", "$.temperature").alias("temperature"))


@register("t1_code_blocks")
def t1_code_blocks(spark, sf_dir):
    return P.extract_code_blocks(fx.responses(spark, sf_dir))[0]


@register("t1_parse_rejects")
def t1_parse_rejects(spark, sf_dir):
    return P.extract_code_blocks(fx.responses(spark, sf_dir))[1]


@register("t2a_sections_strict")
def t2a_sections_strict(spark, sf_dir):
    return P.sections_strict(fx.responses(spark, sf_dir))


@register("t2b_sections_relaxed")
def t2b_sections_relaxed(spark, sf_dir):
    return P.sections_relaxed(fx.responses(spark, sf_dir))


@register("p14_key_roundtrip")
def p14_key_roundtrip(spark, sf_dir):
    r = fx.responses(spark, sf_dir)
    paths = r.select("path").union(r.select(F.concat(F.lit("artifacts/downloaded_repo/"), "path").alias("path")))
    key = C.encode_key("path")
    return paths.select("path", key.alias("file_name"), C.decode_key(key).alias("decoded"))


@register("a9_token_usage")
def a9_token_usage(spark, sf_dir):
    return P.token_usage(fx.responses(spark, sf_dir))


@register("j5_attach_sections")
def j5_attach_sections(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    sections = P.sections_strict(fx.file_responses(spark, sf_dir, merged, some_missing=True))
    files = merged.select("repo", "scan_id", "path")
    return P.attach_sections(files, sections)


# --------------------------------------------------------------------------- M5 patches
from findrift.operators import patches as PT  # noqa: E402


def _pairs(spark, sf_dir):
    return PT.pair_files(fx.parsed_code(spark, sf_dir), stored_files(spark, sf_dir))


@register("t5_annotate_source")
def t5_annotate_source(spark, sf_dir):
    """Merged form, as the pipeline runs it: one marker set per file."""
    merged = _merged(spark, sf_dir).withColumnRenamed("first_ordinal", "ordinal")
    return PT.annotate_source(merged, fx.source_files(spark, sf_dir))


@register("t5_annotate_findings")
def t5_annotate_findings(spark, sf_dir):
    """General form: every finding of a file, markers in finding order."""
    return PT.annotate_source(fx.findings(spark, sf_dir), fx.source_files(spark, sf_dir))


@register("j4_unpaired")
def j4_unpaired(spark, sf_dir):
    return _pairs(spark, sf_dir)[1]


@register("t6_unified_diff")
def t6_unified_diff(spark, sf_dir):
    return PT.unified_diff(_pairs(spark, sf_dir)[0])


@register("t6b_diff_stats")
def t6b_diff_stats(spark, sf_dir):
    return PT.diff_stats(_pairs(spark, sf_dir)[0])


@register("t7_apply_patches")
def t7_apply_patches(spark, sf_dir):
    return PT.apply_patches(fx.parsed_code(spark, sf_dir, some_missing=True), fx.source_files(spark, sf_dir))


@register("f3_exclude_paths")
def f3_exclude_paths(spark, sf_dir):
    patched = PT.apply_patches(fx.parsed_code(spark, sf_dir), fx.source_files(spark, sf_dir))
    cs = fx.change_set(spark, sf_dir, patched.where(F.col("status") == "patched"))
    return PT.exclude_paths(cs)


# --------------------------------------------------------------------------- M6 syntax nodes
from findrift.operators import syntax as SX  # noqa: E402

_NODE_OUT = ["repo", "path", "bfs_id", "parent_id", "node_type", "line", "col", "end_line", "end_col"]


@register("n1_ast_nodes")
def n1_ast_nodes(spark, sf_dir):
    nodes, _ = SX.extract_ast_nodes(fx.python_sources(spark, sf_dir))
    return nodes.select(*_NODE_OUT)


@register("n1_parse_status")
def n1_parse_status(spark, sf_dir):
    return SX.parse_status(fx.python_sources(spark, sf_dir))


@register("n2_node_type_counts")
def n2_node_type_counts(spark, sf_dir):
    nodes, _ = SX.extract_ast_nodes(fx.python_sources(spark, sf_dir))
    return SX.node_type_counts(nodes)


@register("n3_find_node_at")
def n3_find_node_at(spark, sf_dir):
    nodes, _ = SX.extract_ast_nodes(fx.python_sources(spark, sf_dir))
    pts = fx.findings(spark, sf_dir).select("repo", "scan_id", "ordinal", "path",
                                            F.col("start_line").alias("line"), (F.col("ordinal") % 40).cast("int").alias("col"))
    return SX.find_node_at(pts, nodes)


@register("j6_findings_to_nodes")
def j6_findings_to_nodes(spark, sf_dir):
    return SX.map_findings_to_nodes(fx.findings(spark, sf_dir), SX.extract_ast_nodes(fx.python_sources(spark, sf_dir))[0])


@register("j6_nested_nodes")
def j6_nested_nodes(spark, sf_dir):
    """J6 and W4 over functions nested 20 deep around bodies of 10,000 lines."""
    return SX.map_findings_to_nodes(fx.nested_findings(spark, sf_dir), fx.nested_nodes(spark, sf_dir))


@register("n3_nested_nodes")
def n3_nested_nodes(spark, sf_dir):
    """N3 over the same files; columns up to 95."""
    points = fx.nested_findings(spark, sf_dir).select("repo", "scan_id", "ordinal", "path", F.col("start_line").alias("line"),
                                                      (F.col("ordinal") % 96).cast("int").alias("col"))
    return SX.find_node_at(points, fx.nested_nodes(spark, sf_dir))


# --------------------------------------------------------------------------- M7 publish
from findrift.operators import publish as PB  # noqa: E402


@register("l1_pr_log_rows")
def l1_pr_log_rows(spark, sf_dir):
    prs = fx.pr_log(spark, sf_dir)
    return PB.pr_log_rows(prs, F.col("date"))


@register("w6_latest_status")
def w6_latest_status(spark, sf_dir):
    return PB.latest_status(fx.status_updates(spark, sf_dir))


@register("j9_update_pr_status")
def j9_update_pr_status(spark, sf_dir):
    log = PB.pr_log_rows(fx.pr_log(spark, sf_dir), F.col("date"))
    return PB.update_pr_status(log, fx.status_updates(spark, sf_dir))[0]


@register("j9_status_errors")
def j9_status_errors(spark, sf_dir):
    log = PB.pr_log_rows(fx.pr_log(spark, sf_dir), F.col("date"))
    return PB.update_pr_status(log, fx.status_updates(spark, sf_dir))[1]


@register("j8_replace_equal_rows")
def j8_replace_equal_rows(spark, sf_dir):
    rows = fx.repo_log_rows(spark, sf_dir)
    existing = rows.where(F.col("batch") == "existing").drop("batch")
    new = rows.where(F.col("batch") == "new").drop("batch")
    out = PB.replace_equal_rows(existing, new)
    return out.select(*[c for c in out.columns if c != "byClass"],
                      F.to_json("byClass").alias("byClass"))


@register("p17_repo_hash")
def p17_repo_hash(spark, sf_dir):
    rows = fx.repo_log_rows(spark, sf_dir)
    h = C.repo_hash({k: F.col(k) for k in PB.REPO_HASH_KEYS})
    return rows.select("seq", h.alias("repo_hash"))


@register("w5_latest_open_pr")
def w5_latest_open_pr(spark, sf_dir):
    return PB.latest_open_pr(fx.fork_prs(spark, sf_dir))


@register("j7_prs_to_runs")
def j7_prs_to_runs(spark, sf_dir):
    return PB.prs_to_runs(fx.fork_prs(spark, sf_dir), fx.workflow_runs(spark, sf_dir))


@register("l5_publishable_prs")
def l5_publishable_prs(spark, sf_dir):
    return PB.publishable_prs(fx.fork_prs(spark, sf_dir), fx.workflow_runs(spark, sf_dir))


@register("f6_has_findings")
def f6_has_findings(spark, sf_dir):
    return PB.has_findings(fx.repo_universe(spark, sf_dir), _merged(spark, sf_dir))


@register("p16_repo_from_url")
def p16_repo_from_url(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    urls = pages.select("page_id", F.lit("raw").alias("variant"), "url").unionByName(
        pages.select("page_id", F.lit("git").alias("variant"),
                     F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit(".git")).alias("url")))
    r = C.repo_from_url("url")
    return urls.select("page_id", "variant", "url", r["owner"].alias("owner"), r["name"].alias("name"),
                       r["error"].alias("error"), C.repo_name_from_url("url").alias("last_segment"))


@register("p18_contains_all")
def p18_contains_all(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages")
    return pages.select("page_id", C.contains_all(F.col("html"), ["<!DOCTYPE html>", "<title>", "</html>"]).alias("has_all"))


# --------------------------------------------------------------------------- M8 reports
from findrift.operators import report_text as RT  # noqa: E402


def _file_sections(spark, sf_dir, relaxed: bool):
    # the response recipe reads message / counts / lines of a file, never its snippet
    resp = fx.file_responses(spark, sf_dir, merge.merge_findings_by_file(fx.findings(spark, sf_dir), snippet=False))
    return P.sections_relaxed(resp).drop("tier") if relaxed else P.sections_strict(resp)


def _body_lines(spark, sf_dir, used=None):
    """PR body lines (of the scans that ``used`` keeps).  Findings and merged files are stored
    once: contexts, attached findings and responses are all made of these copies."""
    found = fx.findings(spark, sf_dir).drop("snippet")  # neither the merge nor the body reads it
    found = RT.stored(found if used is None else found.where(used))
    merged = RT.stored(merge.merge_findings_by_file(found, snippet=False))
    attached = ctxop.attach_context(found, ctxop.build_contexts(merged))
    return RT.pr_body_lines(attached, P.sections_relaxed(fx.file_responses(spark, sf_dir, merged)).drop("tier"))


@register("t9b_pr_body_lines")
def t9b_pr_body_lines(spark, sf_dir):
    return _body_lines(spark, sf_dir)


@register("t9b_stored_report")
def t9b_stored_report(spark, sf_dir):
    """T9b written as ordered parts of text, read back line by line."""
    base = scratch_path(spark, "reports")
    RT.write_reports(_body_lines(spark, sf_dir), base, lines_per_part=2000)
    return RT.read_reports(spark, base)


@register("s6_read_responses")
def s6_read_responses(spark, sf_dir):
    """Answers written under names made of their paths, read back by the S6 reader."""
    base = scratch_path(spark, "s6")
    r = fx.responses(spark, sf_dir).select("repo", "scan_id", C.encode_key("path").alias("file"), "content")
    SNK.write_text_per_key(r, ["repo", "scan_id", "file"], "content", base)
    found = P.read_responses(spark, base, r"repo=([^/]+)/scan_id=([^/]+)/file=([^/]+)/[^/]+$", "*.txt")
    content = F.expr("substring(content, 1, length(content) - 1)")  # the writer ends a text with a line break
    return found.select("repo", "scan_id", "path", "file_name", F.sha2(content, 256).alias("content_sha"))


@register("t9a_report_lines")
def t9a_report_lines(spark, sf_dir):
    return RT.repo_log_lines(fx.findings(spark, sf_dir), _file_sections(spark, sf_dir, False))


def _log_scans(spark, sf_dir):
    s = fx.findings(spark, sf_dir).select("repo", "scan_id").distinct()
    return s.select("repo", "scan_id", F.col("repo").alias("name"), F.lit("upstream").alias("owner"),
                    F.when(F.col("scan_id").endswith("codeql"), F.lit("upstream")).otherwise(F.lit("forker")).alias("user_name"),
                    F.concat(F.lit("https://github.com/upstream/"), F.col("repo")).alias("repo_url"),
                    F.when(F.col("repo") == "src3", F.lit(None)).otherwise(F.length("scan_id")).alias("pr_number"),
                    F.lit(False).alias("rerun"))


@register("l2_repo_log_rows")
def l2_repo_log_rows(spark, sf_dir):
    e = RT.repo_log_entries(fx.findings(spark, sf_dir), _file_sections(spark, sf_dir, False), _log_scans(spark, sf_dir))
    return e.select("repo", "scan_id", "name", "owner", "repo_url", "vulnerabilities",
                    F.to_json("byClass").alias("byClass"), F.sha2("analysis", 256).alias("analysis_sha"),
                    F.length("analysis").alias("analysis_chars"), "sastTool", "rerun", "repo_hash")


@register("a10_run_summary")
def a10_run_summary(spark, sf_dir):
    merged = _merged(spark, sf_dir)
    return reports.run_summary(merged, fx.file_responses(spark, sf_dir, merged))


@register("l6_pr_requests")
def l6_pr_requests(spark, sf_dir):
    # only the scans whose text is used
    used = F.col("scan_id").endswith("-semgrep")
    body = RT.assemble(_body_lines(spark, sf_dir, used))
    body = (body
            .select(F.regexp_replace("repo", "^src", "r").alias("repo"), F.col("text").alias("body")))
    pub = PB.publishable_prs(fx.fork_prs(spark, sf_dir), fx.workflow_runs(spark, sf_dir))
    req = PB.pr_requests(pub, body, F.lit("forker"), F.lit("main"), F.lit("2026-01-01"))
    return req.select("repo", "number", "title", "head", "base", F.sha2("body", 256).alias("body_sha"))


# --------------------------------------------------------------------------- M9 streams
from findrift.streaming import streams as ST  # noqa: E402


@register("r1_stream_findings")
def r1_stream_findings(spark, sf_dir):
    """Semgrep output files land in a folder; an availableNow stream ingests them
    in several micro-batches and keeps the per-file merge current."""
    base = scratch_path(spark, "r1")
    raw = fx.semgrep_output(spark, sf_dir)
    n_files = SNK.write_text_per_key(raw, ["repo", "scan_id", "part"], "text", f"{base}/landing")
    # the static side of the stream-static join is stored in buckets; each batch reads it
    # whole, so batches of more than 128 files are taken where there would be over 8
    files = stored_files(spark, sf_dir)
    per_batch = max(128, -(-n_files // 8))
    with many_folders(spark):
        both = [stream(spark, f"{base}/landing", files, f"{base}/out", "semgrep", max_files_per_trigger=per_batch)
                for stream in (ST.stream_findings, ST.stream_file_findings)]
        for q in both:
            q.awaitTermination()
    return flat(ST.latest_file_findings(spark, f"{base}/out").select(*merge.MERGED_COLUMNS))


@register("r2_stream_pr_status")
def r2_stream_pr_status(spark, sf_dir):
    """Three runs of the status stream: the second has updates days older than the
    first's, every tenth one is delivered twice in its run, and the third run
    delivers every seventh again; W6 over the sink is the current status."""
    return ST.current_pr_status(spark, _status_streamed(spark, sf_dir))


@register("r2_late_updates")
def r2_late_updates(spark, sf_dir):
    """The updates of the second run that are over a day older than the latest of the first."""
    return ST.late_pr_updates(spark, _status_streamed(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("r2_stored_updates")
def r2_stored_updates(spark, sf_dir):
    """How many rows the sink has: each update once, whatever was delivered again."""
    base = _status_streamed(spark, sf_dir)
    updates = spark.read.parquet(f"{base}/updates").select("seq")
    return updates.union(ST.late_pr_updates(spark, base).select("seq")).agg(F.count("*").alias("n_rows"))


def _status_streamed(spark, sf_dir):
    base = scratch_path(spark, "r2")
    upd = fx.status_updates(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    upd = upd.unionByName(upd.where(F.col("seq") % 10 == 0))
    mid = upd.agg(F.timestamp_seconds((F.unix_seconds(F.min("ts")) + F.unix_seconds(F.max("ts"))) / 2).alias("t")).first()["t"]
    # PRs of every fourth user are heard of in the second run only
    later = (F.col("ts") < F.lit(mid)) | (F.coalesce(F.col("pr_number"), F.lit(0)) % 4 == 0)
    for delivered in (upd.where(~later), upd.where(later), upd.where(F.col("seq") % 7 == 0)):
        delivered.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{base}/landing")
        ST.stream_pr_status(spark, f"{base}/landing", f"{base}/out").awaitTermination()
    return f"{base}/out"


# --------------------------------------------------------------------------- sources and sinks
from findrift.sources import sinks as SNK  # noqa: E402


@register("s1_read_source_files")
def s1_read_source_files(spark, sf_dir):
    """Documents written as files (repo=/lang=/doc= folders), read back by the S1 reader."""
    base = scratch_path(spark, "s1")
    d = fx.table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("doc"), "text")
    SNK.write_text_per_key(d, ["repo", "lang", "doc"], "text", base)
    sf = SRC.read_source_files(spark, base, exts=("txt",), layout=r"repo=([^/]+)/(lang=[^/]+/doc=[^/]+)/")
    path = F.concat(F.lit("src/"), F.regexp_extract("path", r"lang=([^/]+)/", 1), F.lit("/"),
                    F.regexp_extract("path", r"doc=([^/]+)", 1), F.lit(".py"))
    return sf.select("repo", path.alias("path"), "n_lines", F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha"))


@register("s1_default_layout")
def s1_default_layout(spark, sf_dir):
    """Files below nested folders, read with the default <repo>/<path> layout."""
    base = scratch_path(spark, "s1")
    d = fx.table(spark, sf_dir, "documents").select("source", "lang", F.col("doc_id").cast("string").alias("doc"), "text")
    SNK.write_text_per_key(d, ["source", "lang", "doc"], "text", base)
    sf = SRC.read_source_files(spark, base, exts=("txt",))
    return sf.select("repo", F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), "n_lines")


@register("s4_findings_roundtrip")
def s4_findings_roundtrip(spark, sf_dir):
    """K1 writes findings as JSON lines partitioned by repo; S4 reads them back."""
    base = scratch_path(spark, "s4")
    f = fx.findings(spark, sf_dir).withColumn("input", F.lit(None).cast("string"))
    SNK.write_findings(f.select("repo", "input", "idx", "start_line", "end_line", "snippet", "message",
                                "vulnerability_class", "cwe", "severity", "references", "path"), base)
    back = SRC.read_findings(spark, base, multiline=False)
    return flat(back.select("repo", "path", "start_line", "end_line", "snippet", "message", "vulnerability_class",
                            "cwe", "severity", "references"))


@register("s7_read_logs")
def s7_read_logs(spark, sf_dir):
    """Legacy log documents ({prs, repos}, ten PRs each) read by S7."""
    base = scratch_path(spark, "s7")
    prs = PB.pr_log_rows(fx.pr_log(spark, sf_dir), F.col("date"))
    # a document holds up to ten PRs, however long the log is
    docs = (prs.groupBy(F.floor(F.col("pr_number") / 10).alias("shard"))
            .agg(F.collect_list(F.struct(*prs.columns)).alias("prs"))
            .select(F.to_json(F.struct("prs", F.array().cast("array<string>").alias("repos"))).alias("value")))
    docs.write.text(base)
    pr_rows, _ = SRC.read_logs(spark, base, multiline=False)
    return pr_rows


@register("k4_append_log")
def k4_append_log(spark, sf_dir):
    """K4: PR rows appended in two batches to a reset store, read back."""
    base = scratch_path(spark, "k4")
    prs = PB.pr_log_rows(fx.pr_log(spark, sf_dir), F.col("date"))
    SNK.reset_log(spark, base, prs.schema)
    SNK.append_log(prs.where(F.col("pr_number") % 2 == 0), base)
    SNK.append_log(prs.where(F.col("pr_number") % 2 == 1), base)
    return spark.read.parquet(base)


@register("k3_text_per_file")
def k3_text_per_file(spark, sf_dir):
    """K3: parsed code and diffs stored as one (path, text) table per kind."""
    base = scratch_path(spark, "k3")
    code, _ = P.extract_code_blocks(fx.responses(spark, sf_dir))
    SNK.write_text_per_file(code, "code", base, "parsed")
    SNK.write_text_per_file(PT.unified_diff(_pairs(spark, sf_dir)[0]).where(F.col("status") == "diff"), "diff", base, "diff")
    t = spark.read.parquet(base)
    return t.select("repo", "scan_id", "path", "kind", F.sha2("text", 256).alias("text_sha"))


@register("a5_distinct_paths")
def a5_distinct_paths(spark, sf_dir):
    """A5/O2: distinct paths per scan (prompt inputs)."""
    return reports.distinct_paths(fx.findings(spark, sf_dir))


def _written_scans(spark, sf_dir):
    base = scratch_path(spark, "s2")
    raw = fx.semgrep_output(spark, sf_dir)
    (raw.where(F.col("part") < fx.BROKEN_PARTS).select("repo", "scan_id", "text").repartition("repo", "scan_id")
     .write.option("maxRecordsPerFile", 1).partitionBy("repo", "scan_id").text(base))
    return base


def _read_findings(spark, sf_dir, files):
    for c in ("repo", "scan_id"):
        files = files.withColumn(c, F.regexp_replace(c, "^[a-z_]+=", ""))
    found, _ = ingest.semgrep_findings(files, fx.source_files(spark, sf_dir))
    return flat(found.drop("ordinal", "idx"))


@register("s2_read_scan_files")
def s2_read_scan_files(spark, sf_dir):
    """Scanner output written as one file per document, read by the file reader."""
    return _read_findings(spark, sf_dir, scans.read_scan_files(spark, _written_scans(spark, sf_dir), "semgrep"))


@register("s2_read_scan_chunks")
def s2_read_scan_chunks(spark, sf_dir):
    """The same files read in chunks of 4 KB, ranges of a file in parallel."""
    return _read_findings(spark, sf_dir, json_chunks.read_scan_chunks(spark, _written_scans(spark, sf_dir), "semgrep", size=_CHUNK_CHARS))


@register("s7_read_repo_logs")
def s7_read_repo_logs(spark, sf_dir):
    """The repos half of legacy log documents, one document per order."""
    base = scratch_path(spark, "s7r")
    rows = fx.repo_log_rows(spark, sf_dir)
    entry = F.struct("name", "owner", "repo_url", "vulnerabilities", "byClass", "analysis", "sastTool", "rerun")
    (rows.groupBy(F.floor(F.col("seq") / 10).alias("order")).agg(F.collect_list(entry).alias("repos"))
     .select(F.to_json(F.struct(F.array().cast("array<string>").alias("prs"), "repos")).alias("value")).write.text(base))
    _, repos = SRC.read_logs(spark, base, multiline=False)
    return repos.select("name", "owner", "repo_url", "vulnerabilities", F.to_json("byClass").alias("byClass"), "analysis", "sastTool", "rerun")


@register("l4_updates_from_pulls")
def l4_updates_from_pulls(spark, sf_dir):
    """Status updates from the code host's pull-request records (one per order)."""
    o = fx.table(spark, sf_dir, "orders")
    pulls = o.select(F.col("o_orderkey").alias("pr_number"), F.concat(F.lit("https://github.com/o/r"), (F.col("o_custkey") % 20).cast("string")).alias("repo_url"),
                     F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("merged"),
                     F.when(F.col("o_orderstatus") == "O", F.lit("open")).when(F.col("o_orderstatus") == "F", F.lit("closed")).alias("state"),
                     F.col("o_orderdate").alias("ts"))
    return PB.updates_from_pulls(pulls).select("pr_number", "repo_url", "approved", "opened", "seq")


@register("p16_upstream_from_url")
def p16_upstream_from_url(spark, sf_dir):
    """P16, publish variant: owner and name after the host prefix."""
    pages = fx.table(spark, sf_dir, "pages")
    urls = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(
        F.concat(F.lit("https://github.com/"), F.regexp_replace("url", r"^[a-z]+://", ""))).alias("url"))
    u = C.upstream_from_url("url")
    return urls.select("page_id", u["owner"].alias("owner"), u["name"].alias("name"), u["error"].alias("error"))
