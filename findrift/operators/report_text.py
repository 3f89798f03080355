"""T9a repo-log analysis and T9b PR body as ordered line tables; L2, L6, A10.

A report is never built by growing one string: every section is a small
DataFrame of lines keyed by (repo, scan_id, block, file_no, part, seq), the
sections are unioned, and text is assembled only at the sink
(``assemble``), where the sort keys give the reference's line order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findrift.functions import branding as B
from findrift.functions.columns import (SEVERITY_LABELS, cwe_short, line_label, md_cell, pystrip,
                                        repo_hash, row_parts, severity_label, step_text, trigger_text)
from findrift.operators import context as ctxop
from findrift.session import scratch_path
from findrift.operators import reports

LINE_COLUMNS = ("repo", "scan_id", "block", "file_no", "part", "seq", "text")

# Fixed texts of the PR body (must equal the reference).
PR_HEADER = [
    "## \U0001f527 About This Pull Request",
    f"This patch was automatically created by **[ {B.NAME} ]({B.SITE})**,\n"
    "an open-source framework that combines **static analysis tools** with **AI-driven remediation**.",
    f"\nUsing **Semgrep**, **CodeQL**, and **Snyk Code**, {B.NAME} detected potential **security flaws** "
    "and applied **verified fixes**.",
    "Each patch includes **contextual explanations** powered by a **large language model** to support "
    "**review and decision-making**.",
    "",
    "## \U0001f510 Summary of Security Fixes",
]
PR_NO_FINDINGS = "No vulnerabilities detected. No changes made.\n"
PR_FOOTER = [
    "\n## \U0001f6e0 Fix Summary\n",
    "All identified **vulnerabilities** have been **remediated** following **security best practices** "
    "such as **parameterized queries** and **proper input validation**. "
    "Please refer to the **diff tab** for detailed **code changes**.\n",
    "If you have **questions** or **feedback** regarding this **automated patch**, feel free to reach out via "
    f"**[{B.NAME} source]({B.SOURCE})**.\n",
]
BIT_SUMMARY = ["#### \U0001f9f7 BIT Summary (per line)", "| Line | BIT Level | Trigger | Step |",
               "|------|-----------|---------|------|"]
SAST_SUMMARY = "#### \U0001f9e9 SAST Analysis Summary"
HIGHLIGHTS = "\n#### \U0001f9e0 BIT Highlights\n"
LLM_ANALYSIS = "\n#### \U0001f4dd LLM Analysis\n"
LLM_PARTS = [("vulnerability", "**\U0001f538 Vulnerability Description**\n"),
             ("recommended_fix", "**\U0001f538 Recommended Fix**\n"),
             ("references", "**\U0001f538 Additional Notes**\n")]
FURTHER = "\n#### \U0001f4ce Further Context\n"
REF_LINK = "[\U0001f517]"
# Repo-log analysis texts.
LOG_HEADER = "\U0001f527 Security Patch Summary\n"
LOG_FILES = "\U0001f4c1 File-by-File Summary\n"
LOG_SAST = "\U0001f50f SAST Analysis Summary"
LOG_LLM = "\n \U0001f916 LLM Analysis Summary"
LOG_LLM_PARTS = [("vulnerability", "#### \U0001f538 Vulnerability Description"),
                 ("recommended_fix", "#### \U0001f538 Recommended Fix"),
                 ("references", "#### \U0001f538 Additional Notes")]


def emoji(level: Column) -> Column:
    """Severity label: icon for ERROR/WARNING/NOTE, otherwise the upper-cased level."""
    s = F.upper(level)
    out = s
    for name, label in SEVERITY_LABELS.items():
        out = F.when(s == name, F.lit(label)).otherwise(out)
    return out


def _lines(df: DataFrame, block: int, file_no: Column, part: int, rows: list[tuple[int, Column | str]],
           cond: Column | None = None) -> DataFrame:
    """Fixed or computed lines for each input row: rows = [(seq, text)]."""
    arr = F.array(*[F.struct(F.lit(seq).cast("bigint").alias("seq"),
                             (t if isinstance(t, Column) else F.lit(t)).alias("text")) for seq, t in rows])
    src = df if cond is None else df.where(cond)
    return src.select("repo", "scan_id", F.lit(block).alias("block"), file_no.cast("bigint").alias("file_no"),
                      F.lit(part).alias("part"), F.inline(arr)).select(*LINE_COLUMNS)


def _row_lines(df: DataFrame, block: int, part: int, seq: Column, text: Column, file_no: Column) -> DataFrame:
    return df.select("repo", "scan_id", F.lit(block).alias("block"), file_no.cast("bigint").alias("file_no"),
                     F.lit(part).alias("part"), seq.cast("bigint").alias("seq"), text.alias("text"))


def assemble(lines: DataFrame, sep: str = "\n") -> DataFrame:
    """Sink-side text: one string per (repo, scan_id) in line order."""
    return (lines.groupBy("repo", "scan_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "file_no", "part", "seq", "text"))),
                                          lambda x: x["text"]), sep).alias("text")))


def write_reports(lines: DataFrame, path: str, lines_per_part: int = 100_000) -> None:
    """Reports as text under ``path``/repo=/scan_id=, in parts of at most
    ``lines_per_part`` rows whose names are in the order of the report: no row,
    file or task holds a whole one.  The rows are stored first: the ranges are
    found on them, which would make every line twice otherwise."""
    lines = stored(lines)
    order = ["repo", "scan_id", "block", "file_no", "part", "seq"]
    (lines.repartitionByRange(*order).sortWithinPartitions(*order).select("repo", "scan_id", "text")
     .write.option("maxRecordsPerFile", lines_per_part).partitionBy("repo", "scan_id").text(path))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """repo, scan_id, line_no, text: the lines of stored reports, numbered from 1
    (a text of several lines gives several)."""
    parts = (spark.read.text(path, wholetext=True)
             .select(F.col("repo").cast("string").alias("repo"), F.col("scan_id").cast("string").alias("scan_id"), "value",
                     F.regexp_extract("_metadata.file_name", r"^part-(\d+)-.*?(\d+)\.txt$", 1).cast("long").alias("task"),
                     F.regexp_extract("_metadata.file_name", r"^part-(\d+)-.*?(\d+)\.txt$", 2).cast("long").alias("piece")))
    # each part ends in a line break
    lines = parts.select("repo", "scan_id", "task", "piece", F.posexplode(F.split(F.expr("substring(value, 1, length(value) - 1)"), "\n", -1)).alias("at", "text"))
    order = F.shiftleft(F.col("task"), 44) + F.shiftleft(F.col("piece"), 28) + F.col("at")
    return (reports.ranked(lines.withColumn("_o", order), ["repo", "scan_id"], "_o", "line_no")
            .select("repo", "scan_id", "line_no", "text"))


def _md_row(cells: list[Column]) -> Column:
    """Bar-separated row; null cells are optional columns left out."""
    return row_parts(cells)


# --------------------------------------------------------------------------- T9b
def _L(block: int, part: int, seq: Column | int, text: Column | str, file_no: Column | int = 0,
       cond: Column | None = None) -> Column:
    """One line as a struct (null when ``cond`` is false)."""
    c = lambda v: v if isinstance(v, Column) else F.lit(v)
    s = F.struct(F.lit(block).alias("block"), c(file_no).cast("bigint").alias("file_no"), F.lit(part).alias("part"),
                 c(seq).cast("bigint").alias("seq"), c(text).alias("text"))
    return s if cond is None else F.when(cond, s)


def _emit(df: DataFrame, *arrays: Column) -> DataFrame:
    """All lines of each row: concatenated line arrays, nulls dropped, inlined."""
    arr = F.filter(F.concat(*arrays), lambda x: x.isNotNull())
    return df.select("repo", "scan_id", F.inline(arr)).select(*LINE_COLUMNS)


def _trim(c: Column, n: int = 180) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


FILE = ["repo", "scan_id", "path"]
SECTIONS = ("vulnerability", "risks", "recommended_fix", "references")


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as Parquet and read back, so each consumer
    reads only its columns."""
    path = scratch_path(df.sparkSession, "report")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _file_dimension(per_file: DataFrame, scan_flags: list[str], sections: DataFrame | None,
                    *more: DataFrame) -> DataFrame:
    """One stored row per file: its columns, ``file_no`` (W2), ``scan_flags``
    turned into those of the whole scan, its sections (null without) and the
    columns of ``more``.

    Files are numbered in ordinal buckets; one small table per (scan, bucket)
    gives the offsets and the scan's flags."""
    x = per_file.withColumn("_b", F.shiftright("first_ordinal", 16))
    whole = Window.partitionBy("repo", "scan_id")
    before = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (x.groupBy("repo", "scan_id", "_b").agg(F.count(F.lit(1)).alias("_n"), *[F.bool_or(c).alias(c) for c in scan_flags])
               .select("repo", "scan_id", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                       *[F.bool_or(c).over(whole).alias(c) for c in scan_flags]))
    files = (x.drop(*scan_flags).join(buckets, ["repo", "scan_id", "_b"])
             .withColumn("file_no", F.col("_off") + F.row_number().over(
                 Window.partitionBy("repo", "scan_id", "_b").orderBy("first_ordinal")))
             .drop("_b", "_off"))
    for m in more:
        files = files.join(m, FILE, "left")
    if sections is not None:
        files = files.join(sections.select(*FILE, *SECTIONS, F.lit(True).alias("has_sections")), FILE, "left")
    else:
        files = files.select("*", *[F.lit(None).cast("string").alias(n) for n in SECTIONS], F.lit(None).cast("boolean").alias("has_sections"))
    return stored(files)


def pr_body_lines(attached: DataFrame, sections: DataFrame | None = None, scans: DataFrame | None = None) -> DataFrame:
    """PR body lines per scan.

    ``attached``: findings with the J3 context columns (xml_*) of their scan;
    ``sections``: (repo, scan_id, path, vulnerability, risks, recommended_fix,
    references), the relaxed parse of each file's response; ``scans`` (repo,
    scan_id, tool) adds the "no vulnerabilities" body for scans without findings.

    Three grains emit all their lines from one projection each (scan, file,
    finding), so the upstream plan is shared instead of re-run per section."""
    # only what the body reads: the snippet and other wide columns are pruned
    # before the checkpoint below (Catalyst pushes this down to the source join)
    need = ["repo", "scan_id", "path", "ordinal", "tool", "start_line", "end_line", "message", "severity",
            "vulnerability_class", "cwe", "references", "xml_cwes", "xml_bit_severity", "xml_trigger", "xml_steps",
            "xml_reproduction", "xml_references", "xml_preconditions"]
    # stored once, as columns: the file dimension and the finding rows read this copy
    a = stored(attached.select(*need).withColumn("chosen_cwes", ctxop.choose_cwes(F.col("cwe"), F.col("xml_cwes"))))
    fno = F.col("file_no")
    # ---- finding grain: BIT row, SAST row, highlight row
    has_xml_sev = F.coalesce(F.col("xml_bit_severity"), F.lit("")) != ""
    bit_level = F.when(has_xml_sev, emoji(F.col("xml_bit_severity"))).when(
        F.coalesce(F.col("severity"), F.lit("")) != "", emoji(F.col("severity"))).otherwise(F.lit(""))
    trig = trigger_text(F.col("xml_trigger"), F.col("message"))
    step = F.coalesce(F.get(F.col("xml_steps"), 0), step_text("path", "start_line", "end_line"))
    bit_row = _md_row([F.col("start_line").cast("string"), bit_level, md_cell(trig, 120), md_cell(step, 120)])
    ref0 = F.coalesce(F.get(F.col("references"), 0), F.lit(""))
    sast_row = _md_row([
        line_label("start_line", "end_line"), reports.first_or("vulnerability_class"),
        severity_label("severity"),
        F.when(F.col("has_bit"), F.when(has_xml_sev, emoji(F.col("xml_bit_severity"))).otherwise(F.lit(""))),
        F.when(F.col("has_cwe"), F.coalesce(F.nullif(F.array_join("chosen_cwes", ", "), F.lit("")), F.lit("N/A"))),
        F.when(F.col("has_ref"), F.when(ref0 != "", F.concat(F.lit(REF_LINK + "("), ref0, F.lit(")"))).otherwise(F.lit("")))])
    tr = F.coalesce(F.col("xml_trigger"), F.lit(""))
    trig_first = F.when(tr.contains("|"), F.coalesce(
        F.get(F.filter(F.transform(F.split(tr, r"\|", -1), pystrip), lambda x: x != ""), 0), pystrip(tr))).otherwise(pystrip(tr))
    repro = pystrip(F.coalesce(F.col("xml_reproduction"), F.lit("")))
    hl_parts = F.array_compact(F.array(
        F.when(trig_first != "", F.concat(F.lit("Trigger: "), _trim(trig_first))),
        F.when(step != "", F.concat(F.lit("Steps: "), _trim(step))),
        F.when(repro != "", F.concat(F.lit("Repro: "), _trim(repro)))))
    has_hl = ((tr != "") | (F.size(F.coalesce("xml_steps", F.array().cast("array<string>"))) > 0) | (repro != "")) \
        & (F.size(hl_parts) > 0)
    hl_row = F.concat(F.lit("- Line "), F.col("start_line").cast("string"), F.lit(": "), F.array_join(hl_parts, "; "))

    # ---- file dimension: counts, flags, rollups, number, top CWEs, sections
    per_file = a.groupBy(*FILE).agg(
        F.min("ordinal").alias("first_ordinal"), F.min("tool").alias("tool"), F.count(F.lit(1)).alias("n_issues"),
        *[F.count_if(F.upper(F.coalesce("severity", F.lit(""))) == lvl).alias(f"n_{lvl.lower()}")
          for lvl in reports.COUNTED_LEVELS],
        F.bool_or(has_hl).alias("any_hl"),
        F.bool_or((F.size("cwe") > 0) | (F.size(F.coalesce("xml_cwes", F.array().cast("array<string>"))) > 0)).alias("has_cwe"),
        F.bool_or(F.size("references") > 0).alias("has_ref"), F.bool_or(has_xml_sev).alias("has_bit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("xml_references", F.array().cast("array<string>")))))).alias("refs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("xml_preconditions", F.array().cast("array<string>")))))).alias("pre"))
    top = (reports.top_cwes(a).groupBy(*FILE)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cwe"))), lambda x: x["cwe"]), ", ")
                .alias("top_cwes")))
    files = _file_dimension(per_file, ["has_cwe", "has_ref", "has_bit"], sections, top)
    # findings meet their file once; nothing is shuffled by scan
    items = a.join(files.select(*FILE, "file_no", "has_cwe", "has_ref", "has_bit"), FILE)
    item_lines = _emit(items, F.array(_L(2, 1, F.col("ordinal"), bit_row, fno),
                                      _L(2, 3, F.col("ordinal"), sast_row, fno),
                                      _L(2, 5, F.col("ordinal"), hl_row, fno, has_hl)))

    # ---- file grain: overview row, titles, table headers, highlights header, LLM, further context
    lv = [F.when(F.col(f"n_{lvl.lower()}") > 0, F.concat(F.lit(lvl[:1] + ":"), F.col(f"n_{lvl.lower()}").cast("string")))
          for lvl in reports.COUNTED_LEVELS]
    levels = F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*lv)), ", "), F.lit("")), F.lit("-"))
    overview = _md_row([F.concat(F.lit("`"), F.col("path"), F.lit("`")),
                        F.concat(F.lit("**"), F.col("n_issues").cast("string"), F.lit("**")), levels,
                        F.coalesce(F.nullif(F.col("top_cwes"), F.lit("")), F.lit("-"))])
    hdr = _md_row([F.lit("Line"), F.lit("Type"), F.lit("Level"), F.when(F.col("has_bit"), F.lit("BIT Level")),
                   F.when(F.col("has_cwe"), F.lit("CWE(s)")), F.when(F.col("has_ref"), F.lit("Ref"))])
    sep = F.concat(F.lit("|"), F.concat_ws("|", F.lit("----"), F.lit("----"), F.lit("-----"),
                                           F.when(F.col("has_bit"), F.lit("-" * 9)), F.when(F.col("has_cwe"), F.lit("-" * 6)),
                                           F.when(F.col("has_ref"), F.lit("---"))), F.lit("|"))
    any_sec = F.lit(False)
    for n in ("vulnerability", "risks", "recommended_fix", "references"):
        any_sec = any_sec | (F.coalesce(F.col(n), F.lit("")) != "")
    llm = [_L(2, 6, 0, LLM_ANALYSIS, fno, any_sec)]
    for k, (n, title) in enumerate(LLM_PARTS):
        present = any_sec & (F.coalesce(F.col(n), F.lit("")) != "")
        llm += [_L(2, 6, 2 * k + 1, title, fno, present),
                _L(2, 6, 2 * k + 2, F.concat(pystrip(F.col(n)), F.lit("\n")), fno, present)]
    has_refs, has_pre = F.size("refs") > 0, F.size("pre") > 0
    file_lines = _emit(files, F.array(
        _L(1, 1, fno, overview, 0),
        _L(2, 0, 0, F.concat(F.lit("### "), fno.cast("string"), F.lit(". `"), F.col("path"), F.lit("`")), fno),
        *[_L(2, 0, i + 1, t, fno) for i, t in enumerate(BIT_SUMMARY)],
        _L(2, 2, 0, SAST_SUMMARY, fno), _L(2, 2, 1, hdr, fno), _L(2, 2, 2, sep, fno),
        _L(2, 4, 0, HIGHLIGHTS, fno, F.col("any_hl")),
        *llm,
        _L(2, 7, 0, FURTHER, fno, has_refs | has_pre),
        _L(2, 8, 0, "- References:", fno, has_refs),
        _L(2, 9, 0, "- Preconditions:", fno, has_pre)),
        F.transform("refs", lambda r, i: _L(2, 8, i + 1, F.concat(F.lit("  - [link]("), r, F.lit(")")), fno)),
        F.transform("pre", lambda x, i: _L(2, 9, i + 1, F.concat(F.lit("  - "), x), fno)))

    # ---- scan grain: header, overview table head, footer; the no-findings body
    scan_rows = files.select("repo", "scan_id", "tool").distinct()
    scan_lines = _emit(scan_rows, F.array(
        *[_L(0, 0, i, t) for i, t in enumerate(PR_HEADER)],
        _L(1, 0, 0, "### Overview\n"),
        _L(1, 0, 1, F.concat(F.lit("> Detected by: **"), F.upper("tool"), F.lit("**\n"))),
        _L(1, 0, 2, "| File | Total Issues | Levels | Top CWE(s) |"),
        _L(1, 0, 3, "|------|---------------|--------|-------------|"),
        *[_L(3, 0, i, t) for i, t in enumerate(PR_FOOTER)]))
    out = scan_lines.unionByName(file_lines).unionByName(item_lines)
    if scans is not None:
        empty = scans.select("repo", "scan_id").join(scan_rows.select("repo", "scan_id"), ["repo", "scan_id"], "left_anti")
        out = out.unionByName(_emit(empty, F.array(*[_L(0, 0, i, t) for i, t in enumerate(PR_HEADER + [PR_NO_FINDINGS])])))
    return out


# --------------------------------------------------------------------------- T9a
def repo_log_lines(findings: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Repo-log analysis lines per scan (class table, per-file finding
    tables with file-level CWE/Ref columns, strict LLM sections)."""
    findings = stored(findings.select("repo", "scan_id", "path", "ordinal", "tool", "start_line", "end_line",
                                       "severity", "vulnerability_class", "cwe", "references"))
    per_file = findings.groupBy(*FILE).agg(
        F.min("ordinal").alias("first_ordinal"), F.min("tool").alias("tool"),
        F.bool_or(F.size("cwe") > 0).alias("f_cwe"), F.bool_or(F.size("references") > 0).alias("f_ref"))
    files = _file_dimension(per_file, [], sections)
    cc = reports.class_counts(findings)
    totals = cc.groupBy("repo", "scan_id").agg(F.sum("count").alias("vulns"))
    sr = (files.select("repo", "scan_id", "tool").distinct().join(totals, ["repo", "scan_id"], "left")
          .withColumn("vulns", F.coalesce("vulns", F.lit(0))))
    zero = F.lit(0)
    tool_cap = F.concat(F.upper(F.substring("tool", 1, 1)), F.lower(F.substr("tool", F.lit(2))))
    parts = [
        _lines(sr, 0, zero, 0, [(0, LOG_HEADER), (1, F.concat(F.lit("- SAST Tool: "), tool_cap)),
                                (2, F.concat(F.lit("- Total vulnerabilities Detected: "), F.col("vulns").cast("string"), F.lit("\n")))]),
        _lines(sr, 0, zero, 1, [(0, "| Type | Count |"), (1, "|------|-------|")], F.col("vulns") > 0),
        _row_lines(cc, 0, 2, F.col("class_pos"), F.concat(F.lit("| "), F.col("type"), F.lit(" | "),
                                                           F.col("count").cast("string"), F.lit(" |")), zero),
        _lines(sr, 0, zero, 3, [(0, LOG_FILES)]),
    ]
    items = findings.join(files.select(*FILE, "file_no", "f_cwe", "f_ref"), FILE)
    fno = F.col("file_no")
    hdr = [F.lit("Line"), F.lit("Type"), F.lit("Level"), F.when(F.col("f_cwe"), F.lit("CWE")), F.when(F.col("f_ref"), F.lit("Ref"))]
    sep = [F.lit("----"), F.lit("----"), F.lit("-----"), F.when(F.col("f_cwe"), F.lit("---")), F.when(F.col("f_ref"), F.lit("---"))]
    parts.append(_lines(files, 1, fno, 0, [
        (0, F.concat(F.lit("\n### "), fno.cast("string"), F.lit(". `"), F.col("path"), F.lit("`"))),
        (1, LOG_SAST), (2, _md_row(hdr)), (3, F.concat(F.lit("|"), F.concat_ws("|", *sep), F.lit("|")))]))
    ref0 = F.coalesce(F.get(F.col("references"), 0), F.lit(""))
    cells = [line_label("start_line", "end_line"), reports.first_or("vulnerability_class"),
             severity_label("severity"),
             F.when(F.col("f_cwe"), F.coalesce(cwe_short(F.get(F.col("cwe"), 0)), F.lit("N/A"))),
             F.when(F.col("f_ref"), F.when(ref0 != "", F.concat(F.lit(REF_LINK + "("), ref0, F.lit(")"))).otherwise(F.lit("")))]
    parts.append(_row_lines(items, 1, 1, F.col("ordinal"), _md_row(cells), fno))
    parts.append(_lines(files, 1, fno, 2, [(0, LOG_LLM)]))
    # section lines come from the stored files: one projection for all
    text = lambda n: F.coalesce(F.col(n), F.lit("")) != ""
    parts.append(_emit(files.where("has_sections"), F.array(
        _L(1, 3, 0, F.concat(F.lit("\n### \U0001f4c4 `"), F.col("path"), F.lit("`")), fno),
        *[_L(1, 3, 2 * k + 1, title, fno, text(n)) for k, (n, title) in enumerate(LOG_LLM_PARTS)],
        *[_L(1, 3, 2 * k + 2, F.col(n), fno, text(n)) for k, (n, _) in enumerate(LOG_LLM_PARTS)])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------- L2 / A10
def repo_log_entries(findings: DataFrame, sections: DataFrame | None, scans: DataFrame) -> DataFrame:
    """L2: repo-log row per scan with a created PR whose fork owner differs from
    the upstream owner: class counts (A2), analysis text (T9a), hash (P17).

    ``scans``: (repo, scan_id, name, owner, user_name, repo_url, pr_number, rerun)."""
    eligible = scans.where(F.col("pr_number").isNotNull() & (F.col("user_name") != F.col("owner")))
    # rows of other scans go before any text is built
    wanted = eligible.select("repo", "scan_id").distinct()
    findings = findings.join(wanted, ["repo", "scan_id"], "left_semi")
    if sections is not None:
        sections = sections.join(wanted, ["repo", "scan_id"], "left_semi")
    cc = reports.class_counts(findings)
    by_class = (cc.groupBy("repo", "scan_id")
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("class_pos", "type", "count"))),
                                 lambda x: F.struct(x["type"].alias("type"), x["count"].alias("count"))).alias("byClass"),
                     F.sum("count").alias("vulnerabilities")))
    text = assemble(repo_log_lines(findings, sections)).withColumnRenamed("text", "analysis")
    tools = findings.select("repo", "scan_id", F.lower("tool").alias("sastTool")).distinct()
    j = (eligible.join(tools, ["repo", "scan_id"]).join(by_class, ["repo", "scan_id"], "left")
         .join(text, ["repo", "scan_id"], "left"))
    j = j.select("repo", "scan_id", "name", "owner", "repo_url",
                 F.coalesce("vulnerabilities", F.lit(0)).cast("bigint").alias("vulnerabilities"),
                 F.coalesce("byClass", F.array().cast("array<struct<type:string,count:bigint>>")).alias("byClass"),
                 "analysis", "sastTool", "rerun")
    return j.withColumn("repo_hash", repo_hash({k: F.col(k) for k in
                                                ("repo_url", "sastTool", "rerun", "vulnerabilities", "byClass", "analysis")}))
