"""Scanner adapters: raw scan documents + source_files -> findings + rejects.

Each adapter is a narrow projection over exploded results followed by one
equi-join to ``source_files`` on (repo, path).  The join carries each file's
line array once per file partition; snippets are sliced right after the join
so only the needed lines travel further.  Hot files (one file holding a large
share of findings) are split by AQE's skew-join handling: the skewed side is
the findings side and the replicated side is one row per file.

Policies per tool (missing source, line guard, slicing, idx) follow the
reference; see the module docstrings of each function.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findrift.functions.columns import (class_from_rule, cwe_from_tags, ensure_list, normalize_path,
                                        pystrip, references_from_help)
from findrift.sources import scans as S

FINDING_COLUMNS = ("repo", "scan_id", "ordinal", "tool", "idx", "path", "start_line", "end_line",
                   "snippet", "message", "vulnerability_class", "cwe", "severity", "references")
REJECT_COLUMNS = ("repo", "scan_id", "stage", "key", "code", "message")

_ODD_BREAKS = "[\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"


def _rejects(df: DataFrame, stage: str, key: Column, code: str, message: Column) -> DataFrame:
    return df.select("repo", "scan_id", F.lit(stage).alias("stage"), key.alias("key"),
                     F.lit(code).alias("code"), message.alias("message"))


def _files(source_files: DataFrame) -> DataFrame:
    """Join side: line array per file; the raw text travels only for the rare
    files with extra line-break characters (flag computed once per file)."""
    return source_files.select("repo", "path", "lines", "n_lines", odd_content().alias("odd_content"))


def odd_content() -> Column:
    return F.when(F.col("content").rlike(_ODD_BREAKS), F.col("content"))


# --------------------------------------------------------------------------- shared finishing step
BASE_COLUMNS = ("repo", "scan_id", "tool", "part", "run_pos", "pos", "path", "start_line", "end_line", "message",
                "severity", "vulnerability_class", "cwe", "references", "doc_error")


def join_sources(base: DataFrame, source_files: DataFrame) -> DataFrame:
    """Results of any mix of tools with their source files: one join for all."""
    return base.join(_files(source_files), ["repo", "path"], "left")


def _finish(base: DataFrame, source_files: DataFrame, tools: set[str]) -> tuple[DataFrame, DataFrame]:
    return apply_policies(join_sources(base, source_files), tools)


def apply_policies(fj: DataFrame, tools: set[str]) -> tuple[DataFrame, DataFrame]:
    """Findings and rejects of joined results, each tool's policy as conditional
    expressions:

    semgrep   missing file -> reject; 0 < s <= e <= n else ''; idx = position
    codeql    missing file kept ('' snippet); start outside 1..n or blank region
              dropped; e <= s -> start line only; stripped; idx counts kept rows
              of the file in (run, position) order
    snykcode  missing file dropped; s < 1 or e < s -> ''; stripped; idx = position in run
    broken document (any tool) -> reject
    """
    tool, broken = F.col("tool"), F.col("doc_error").isNotNull()
    s, e, n = F.col("start_line"), F.col("end_line"), F.col("n_lines")
    exists = n.isNotNull()
    is_cq, is_sn = tool == "codeql", tool == "snykcode"
    # readlines() keeps only '\n' as a break; re-split the few files that contain
    # other splitlines() separators, reuse the prepared array for all others.
    nl_lines = F.when(F.col("odd_content").isNotNull(),
                      F.split(F.regexp_replace(F.regexp_replace("odd_content", "\r\n?", "\n"), r"\n\z", ""), "\n", -1)
                      ).otherwise(F.col("lines"))
    region = F.when(e > s, F.slice(nl_lines, s, e - s + 1)).otherwise(F.slice(nl_lines, s, 1))
    cq_ok = (s >= 1) & (s <= n) & F.exists(region, lambda x: pystrip(x) != "")
    keep = F.when(is_cq, ~exists | cq_ok).otherwise(exists)
    snippet = (F.when(is_cq, F.when(exists, pystrip(F.array_join(region, "\n"))).otherwise(F.lit("")))
               .when(is_sn, F.when((s >= 1) & (e >= s), pystrip(F.array_join(F.slice("lines", s, e - s + 1), "\n")))
                     .otherwise(F.lit("")))
               .otherwise(F.when((s > 0) & (s <= e) & (e <= n), F.array_join(F.slice("lines", s, e - s + 1), "\n"))
                          .otherwise(F.lit(""))))
    kept = fj.where(keep & ~broken)
    if "codeql" in tools:
        # only CodeQL numbers kept rows; the window is planned only when CodeQL rows exist
        w = Window.partitionBy("repo", "scan_id", "part", "tool").orderBy("run_pos", "pos")
        idx = F.when(is_cq, F.row_number().over(w) - 1).otherwise(F.col("pos"))
    else:
        idx = F.col("pos")
    out = kept.select(
        *[c for c in BASE_COLUMNS if c not in ("run_pos", "pos", "doc_error")],
        S.ordinal("part", "run_pos", "pos").alias("ordinal"),
        snippet.alias("snippet"), idx.cast("int").alias("idx"),
    ).select(*FINDING_COLUMNS)
    missing = ~exists & ~is_cq
    rej = fj.where(broken | missing | (is_cq & exists & ~cq_ok)).select(
        "repo", "scan_id", F.lit("ingest").alias("stage"),
        F.when(broken, F.format_string("%s part %d", tool, F.col("part")))
         .when(missing, F.col("path")).otherwise(F.format_string("%s:%d", F.col("path"), s)).alias("key"),
        F.when(broken, F.col("doc_error"))
         .when(missing & is_sn, F.lit("SOURCE_MISSING")).when(missing, F.lit("FILE_NOT_FOUND"))
         .otherwise(F.lit("INVALID_REGION")).alias("code"),
        F.when(broken, F.lit(S.MALFORMED_DOCUMENT[1]))
         .when(missing & is_sn, F.lit("source file missing; dropped"))
         .when(missing, F.concat(F.lit("File not found: "), F.col("path")))
         .otherwise(F.lit("start line outside file or blank region; dropped")).alias("message"))
    return out, rej


# --------------------------------------------------------------------------- Semgrep
def semgrep_base(raw: DataFrame, base_dir: str | None = None) -> DataFrame:
    """Native JSON results before the source join (``{"results": [...]}`` or a bare list)."""
    ex = S.native_results(raw)
    has_start = S.vget("r", "$.start.line", "variant").isNotNull()
    return ex.select(
        "repo", "scan_id", "tool", "part", F.lit(0).cast("int").alias("run_pos"), "pos",
        normalize_path(F.coalesce(S.vget("r", "$.path"), F.lit("")), base_dir).alias("path"),
        F.when(has_start, S.vget("r", "$.start.line", "int"))
         .otherwise(F.coalesce(S.vget("r", "$.start_line", "int"), F.lit(0))).alias("start_line"),
        F.when(has_start, S.vget("r", "$.end.line", "int"))
         .otherwise(F.coalesce(S.vget("r", "$.end_line", "int"), F.lit(0))).alias("end_line"),
        F.coalesce(S.vget("r", "$.extra.message"), F.lit("")).alias("message"),
        F.coalesce(S.vget("r", "$.extra.severity"), F.lit("")).alias("severity"),
        ensure_list("r", "$.extra.metadata.vulnerability_class").alias("vulnerability_class"),
        ensure_list("r", "$.extra.metadata.cwe").alias("cwe"),
        ensure_list("r", "$.extra.metadata.references").alias("references"), "doc_error",
    )


def semgrep_findings(raw: DataFrame, source_files: DataFrame, base_dir: str | None = None,
                     strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Native JSON.  Missing source file: the reference aborts the run; here the
    row goes to ``rejects`` (``strict=True`` raises instead).  Region guard
    0 < s <= e <= n else empty snippet (row kept).  idx = position in the file's results."""
    out, rej = _finish(semgrep_base(raw, base_dir), source_files, {"semgrep"})
    if strict and rej.limit(1).count():
        raise FileNotFoundError("semgrep output is broken or points at missing source files")
    return out, rej


# --------------------------------------------------------------------------- SARIF rule maps
def _rule_fields(rule: Column, tool: str) -> list[Column]:
    """cwe / references / level of a rule struct (null rule -> empty lists, null level)."""
    return [
        F.when(rule.isNotNull(), cwe_from_tags(rule["tags"], tool)).otherwise(F.array().cast("array<string>")).alias("cwe"),
        F.when(rule.isNotNull(), references_from_help(rule["help_uri"])).otherwise(F.array().cast("array<string>")).alias("references"),
        F.when(rule.isNotNull(), F.coalesce(F.nullif(rule["default_level"], F.lit("")), rule["problem_severity"],
                                            F.lit("UNKNOWN"))).alias("level"),
    ]


def _rule_meta(rules: DataFrame, tool: str, keys: list[str], order: list[str]) -> DataFrame:
    """Deduplicate rules on ``keys``, last one (by ``order``) wins, and derive cwe/references/level."""
    rule = F.struct("tags", "help_uri", "default_level", "problem_severity")
    meta = rules.where(F.col("rule_id").isNotNull() & (F.col("rule_id") != "")).select(
        *keys, *[c for c in order if c not in keys], *_rule_fields(rule, tool))
    last = F.max_by(F.struct("cwe", "references", "level"), F.struct(*order)).alias("m")
    return meta.groupBy(*keys).agg(last).select(*keys, "m.cwe", "m.references", "m.level")


def codeql_rule_map(raw: DataFrame) -> DataFrame:
    """J2 (CodeQL) as a table: one entry per (repo, scan_id, part, rule_id) -- all runs
    of one file, later runs win.  The adapter itself applies the same rule
    inside each document row (``sources.scans.sarif_results``)."""
    rules = S.sarif_rules(raw)
    return _rule_meta(rules, "codeql", ["repo", "scan_id", "part", "rule_id"], ["run_pos", "rule_pos"])


def snyk_rule_map(raw: DataFrame) -> DataFrame:
    """J2 (Snyk) as a table: rule entries are scoped to their run."""
    rules = S.sarif_rules(raw)
    return _rule_meta(rules, "snykcode", ["repo", "scan_id", "part", "run_pos", "rule_id"], ["rule_pos"])


# --------------------------------------------------------------------------- CodeQL (S3)
def codeql_base(raw: DataFrame) -> DataFrame:
    """SARIF results with CodeQL rule metadata (all runs of the file, later runs
    win) and severity (result level, a list's first entry, else the rule's
    level, UNKNOWN for unknown rules), before the source join."""
    j = S.sarif_results(raw, rule_scope="file")
    cwe, refs, rule_level = _rule_fields(F.col("rule"), "codeql")
    res_level = F.coalesce(F.nullif(F.col("level_str"), F.lit("")),
                           F.when(F.size("level_arr") > 0, F.get("level_arr", 0)))
    level = F.coalesce(res_level, F.when(F.col("rule").isNotNull(), rule_level), F.lit("UNKNOWN"))
    start = F.coalesce(F.col("start_line"), F.lit(0))
    return j.select(
        "repo", "scan_id", "tool", "part", "run_pos", "pos",
        F.coalesce(F.col("uri"), F.lit("Unknown")).alias("path"),
        start.alias("start_line"), F.coalesce(F.nullif(F.col("end_line"), F.lit(0)), start).alias("end_line"),
        F.coalesce(F.col("message"), F.lit("")).alias("message"),
        F.upper(F.coalesce(level, F.lit(""))).alias("severity"),
        class_from_rule("rule_id").alias("vulnerability_class"), cwe, refs, "doc_error")


def codeql_findings(raw: DataFrame, source_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SARIF with the CodeQL policy (see ``apply_policies``)."""
    return _finish(codeql_base(raw), source_files, {"codeql"})


# --------------------------------------------------------------------------- Snyk Code (S3)
def snyk_base(raw: DataFrame) -> DataFrame:
    """SARIF results with Snyk rule metadata (the result's own run) and
    severity = upper(result level), no fallback, before the source join."""
    j = S.sarif_results(raw, rule_scope="run")
    cwe, refs, _ = _rule_fields(F.col("rule"), "snykcode")
    start = F.coalesce(F.col("start_line"), F.lit(0))
    return j.select(
        "repo", "scan_id", "tool", "part", "run_pos", "pos",
        F.coalesce(F.col("uri"), F.lit("")).alias("path"),
        start.alias("start_line"), F.coalesce(F.col("end_line"), start).alias("end_line"),
        F.coalesce(F.col("message"), F.lit("")).alias("message"),
        F.upper(F.coalesce(F.col("level_str"), F.lit(""))).alias("severity"),
        class_from_rule("rule_id").alias("vulnerability_class"), cwe, refs, "doc_error")


def snyk_findings(raw: DataFrame, source_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SARIF with the Snyk policy (see ``apply_policies``); s < 1 gives an empty snippet,
    a documented divergence from Python's negative index."""
    return _finish(snyk_base(raw), source_files, {"snykcode"})


# --------------------------------------------------------------------------- registry + O4
ADAPTERS: dict[str, Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]] = {
    "semgrep": semgrep_findings,
    "codeql": codeql_findings,
    "snykcode": snyk_findings,
}


_BUILTIN = dict(ADAPTERS)


def register_adapter(tool: str, fn: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> None:
    """Extension point: a new scanner is a function (raw docs, source_files) -> (findings, rejects)."""
    ADAPTERS[tool] = fn


BASES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "semgrep": semgrep_base,
    "codeql": codeql_base,
    "snykcode": snyk_base,
}


def is_builtin(tool: str) -> bool:
    return tool in BASES and ADAPTERS.get(tool) is _BUILTIN[tool]


def union_tools(raw_by_tool: dict[str, DataFrame], source_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All scanners into one findings table (and one rejects table).

    The built-in tools are unioned *before* the source join, so the source text
    is joined (and shuffled) once for all of them; registered extra adapters
    run on their own and are unioned after."""
    builtin = [t for t in raw_by_tool if is_builtin(t)]
    outs, rejs = [], []
    if builtin:
        base = None
        for t in builtin:
            b = BASES[t](raw_by_tool[t]).select(*BASE_COLUMNS)
            base = b if base is None else base.unionByName(b)
        o, r = _finish(base, source_files, set(builtin))
        outs.append(o)
        rejs.append(r)
    for t, raw in raw_by_tool.items():
        if t not in builtin:
            o, r = ADAPTERS[t](raw, source_files)
            outs.append(o)
            rejs.append(r)
    f, r = outs[0], rejs[0]
    for o in outs[1:]:
        f = f.unionByName(o)
    for x in rejs[1:]:
        r = r.unionByName(x)
    return f, r


def tool_agreement(findings: DataFrame) -> DataFrame:
    """(repo, path, class) flagged by every scanner present vs. by one only."""
    pc = findings.select("repo", "tool", "path", F.explode("vulnerability_class").alias("cls")).distinct()
    n_tools = pc.groupBy("repo", "path", "cls").agg(F.count_distinct("tool").alias("n_tools"),
                                                   F.array_sort(F.collect_set("tool")).alias("tools"))
    return n_tools
