"""T8/T8b context records, F5 validation, J3 attach, A7/A8 context-driven choices.

A context is one struct per merged finding (one per file of a scan).  The
XML document of the reference is only a sink/source format here (K2/S5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.functions import branding as B
from findrift.functions.columns import cwe_short, message_items, severity_pair, step_text

# Fixed texts of the v1.1 context (must equal the reference's output).
DEFAULT_TRIGGER = "Vulnerability detected."
REPRODUCTION = "Inspect the indicated code region and verify unsafe data flow or pattern."
PRECONDITION = "Authenticated user may be required depending on route."
MITIGATION = "Apply minimal changes: sanitize inputs, use parameterized APIs, and enforce allowlists."
TOOL_NAME = B.NAME
XML_NS = B.XML_NS


def _empty() -> Column:
    return F.array().cast("array<string>")


def _opt_list(c: Column) -> Column:
    """Optional list element: null when empty (the element is omitted)."""
    s = F.array_sort(F.array_distinct(F.coalesce(c, _empty())))
    return F.when(F.size(s) > 0, s)


def build_contexts(merged: DataFrame, include_env: bool = True, include_tracking: bool = True,
                   include_mitigations: bool = True, context_before: int = 0, context_after: int = 0,
                   runtime_node: str = "unknown", runtime_os: str = "posix",
                   extras: Column | None = None) -> DataFrame:
    """(repo, scan_id, path, start_line, vuln struct) from ``file_findings``.

    A pure projection: no shuffle, stays in whole-stage codegen.  ``extras`` is
    an optional map<string,string> column for additional elements (the open
    extension slot of the context schema); it is carried as ``vuln.extras``."""
    s, e, p = F.col("start_line"), F.col("end_line"), F.col("path")
    msg = F.coalesce(F.col("message"), F.lit(""))
    sev = severity_pair("severity")
    multi = msg.contains(" | ")
    vuln = F.struct(
        F.concat(p, F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string")).alias("id"),
        p.alias("file_path"),
        s.alias("range_start"), e.alias("range_end"),
        sev.alias("severity_overall"), sev.alias("severity_bit"),
        F.when(~multi, msg).alias("message_text"),
        F.when(multi, message_items(msg)).alias("message_items"),
        F.coalesce(F.col("snippet"), F.lit("")).alias("snippet"),
        F.struct(
            F.when(msg != "", msg).otherwise(F.lit(DEFAULT_TRIGGER)).alias("trigger"),
            F.array(step_text(p, s, e)).alias("steps"),
            F.lit(REPRODUCTION).alias("reproduction"),
            sev.alias("bit_severity"),
        ).alias("bit"),
        _opt_list(F.col("vulnerability_class")).alias("classes"),
        _opt_list(F.col("cwe")).alias("weaknesses"),
        _opt_list(F.col("references")).alias("references"),
        F.array(F.lit(PRECONDITION)).alias("preconditions"),
        (F.struct(F.lit(runtime_node).alias("node"), F.lit(runtime_os).alias("os")) if include_env
         else F.lit(None).cast("struct<node:string,os:string>")).alias("env"),
        (F.lit(MITIGATION) if include_mitigations else F.lit(None).cast("string")).alias("mitigation"),
        F.lit(include_tracking).alias("tracking"),
        (F.struct(F.lit(context_before).alias("before"), F.lit(context_after).alias("after"))
         if (context_before or context_after) else F.lit(None).cast("struct<before:int,after:int>")).alias("context"),
        (extras if extras is not None else F.lit(None).cast("map<string,string>")).alias("extras"),
    )
    return merged.select("repo", "scan_id", "path", "start_line", vuln.alias("vuln"))


def build_contexts_minimal(merged: DataFrame) -> DataFrame:
    """T8b (v1.0): id, file, range, severity as given (not upper-cased), message, snippet."""
    s, e, p = F.col("start_line"), F.col("end_line"), F.col("path")
    vuln = F.struct(
        F.concat(p, F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string")).alias("id"),
        p.alias("file_path"), s.alias("range_start"), e.alias("range_end"),
        F.col("severity").alias("severity_overall"), F.lit(None).cast("string").alias("severity_bit"),
        F.coalesce(F.col("message"), F.lit("")).alias("message_text"),
        F.lit(None).cast("array<string>").alias("message_items"),
        F.coalesce(F.col("snippet"), F.lit("")).alias("snippet"),
        F.lit(None).cast("struct<trigger:string,steps:array<string>,reproduction:string,bit_severity:string>").alias("bit"),
        F.lit(None).cast("array<string>").alias("classes"),
        F.lit(None).cast("array<string>").alias("weaknesses"),
        F.lit(None).cast("array<string>").alias("references"),
        F.lit(None).cast("array<string>").alias("preconditions"),
        F.lit(None).cast("struct<node:string,os:string>").alias("env"),
        F.lit(None).cast("string").alias("mitigation"),
        F.lit(False).alias("tracking"),
        F.lit(None).cast("struct<before:int,after:int>").alias("context"),
        F.lit(None).cast("map<string,string>").alias("extras"),
    )
    return merged.select("repo", "scan_id", "path", "start_line", vuln.alias("vuln"))


def scan_meta(findings_or_merged: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """A4: one META row per scan: tool name, vulnerability count, generation time."""
    ts = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return (findings_or_merged.groupBy("repo", "scan_id").agg(F.count(F.lit(1)).alias("count"))
            .select("repo", "scan_id", F.lit(TOOL_NAME).alias("tool"), "count", ts.alias("generatedAt")))


# --------------------------------------------------------------------------- F5
def _nonempty(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def validate_contexts(ctx: DataFrame, strict: bool = False) -> DataFrame:
    """schema rules of the v1.1 context as row checks -> (is_valid, errors[]).

    With ``strict`` the returned frame raises on the first invalid row when
    evaluated (``assert_true``), instead of reporting it."""
    v = F.col("vuln")
    b = v["bit"]
    rules = [
        (~_nonempty(v["id"]), "VULNERABILITY@id is required"),
        (~_nonempty(v["file_path"]), "FILE@path is required"),
        (v["range_start"].isNull() | (v["range_start"] < 1), "RANGE@start must be a positive integer"),
        (v["range_end"].isNull() | (v["range_end"] < 1), "RANGE@end must be a positive integer"),
        (v["severity_overall"].isNull(), "SEVERITY@overall is required"),
        (v["severity_bit"].isNull(), "SEVERITY@bit is required"),
        (v["message_text"].isNull() & v["message_items"].isNull(), "MESSAGE is required"),
        (v["message_items"].isNotNull() & (F.size(v["message_items"]) < 1), "MESSAGES needs at least one ITEM"),
        (v["snippet"].isNull(), "SNIPPET is required"),
        (b.isNull(), "BIT is required"),
        (b.isNotNull() & b["trigger"].isNull(), "BIT/TRIGGER is required"),
        (b.isNotNull() & (F.coalesce(F.size(b["steps"]), F.lit(0)) < 1), "BIT/STEPS needs at least one STEP"),
        (b.isNotNull() & b["reproduction"].isNull(), "BIT/REPRODUCTION is required"),
        (b.isNotNull() & b["bit_severity"].isNull(), "BIT/BIT_SEVERITY is required"),
        (v["classes"].isNotNull() & (F.size(v["classes"]) < 1), "CLASSES needs at least one CLASS"),
        (v["weaknesses"].isNotNull() & ((F.size(v["weaknesses"]) < 1)
                                         | F.exists(v["weaknesses"], lambda x: ~_nonempty(x))), "CWE@id is required"),
        (v["references"].isNotNull() & ((F.size(v["references"]) < 1)
                                         | F.exists(v["references"], lambda x: ~_nonempty(x))), "REF@href is required"),
        (v["preconditions"].isNotNull() & (F.size(v["preconditions"]) < 1), "PRECONDITIONS needs at least one ITEM"),
    ]
    errors = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]))
    out = ctx.select("repo", "scan_id", "path", errors.alias("errors")).withColumn("is_valid", F.size("errors") == 0)
    if strict:
        # the check is folded into an output column so column pruning cannot drop it
        out = out.withColumn("is_valid", F.coalesce(
            F.assert_true(F.col("is_valid"), F.lit("context failed validation")).cast("boolean"), F.col("is_valid")))
    return out.select("repo", "scan_id", "path", "is_valid", "errors")


# --------------------------------------------------------------------------- J3, A7, A8
def xml_info(ctx: DataFrame) -> DataFrame:
    """What the report stage reads back from a context (per (repo, scan_id, path, start_line))."""
    v = F.col("vuln")
    b = v["bit"]
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return ctx.select(
        "repo", "scan_id", "path", F.col("vuln.range_start").alias("start_line"),
        F.coalesce(F.filter(v["weaknesses"], lambda x: _nonempty(x)), _empty()).alias("xml_cwes"),
        F.when(_nonempty(b["bit_severity"]), strip(b["bit_severity"])).alias("xml_bit_severity"),
        F.when(_nonempty(b["trigger"]), strip(b["trigger"])).alias("xml_trigger"),
        F.coalesce(F.filter(F.transform(b["steps"], strip), lambda x: x != ""), _empty()).alias("xml_steps"),
        F.when(_nonempty(b["reproduction"]), strip(b["reproduction"])).alias("xml_reproduction"),
        F.coalesce(F.filter(v["references"], lambda x: _nonempty(x)), _empty()).alias("xml_references"),
        F.coalesce(F.filter(F.transform(v["preconditions"], strip), lambda x: x != ""), _empty()).alias("xml_preconditions"),
    )


def attach_context(findings: DataFrame, ctx: DataFrame) -> DataFrame:
    """Findings left-join context info on (repo, scan_id, path, start_line).

    Contexts are per merged file, so only findings starting at the file's
    minimum line match.  One equi-join replaces the reference's per-item scan."""
    return findings.join(xml_info(ctx), ["repo", "scan_id", "path", "start_line"], "left")


def choose_cwes(snippet_cwe: Column, xml_cwes: Column) -> Column:
    """Short snippet CWEs intersected with XML CWEs (sorted); else snippet; else XML."""
    sn = F.transform(F.filter(F.coalesce(snippet_cwe, _empty()), lambda c: c != ""), cwe_short)
    xc = F.coalesce(xml_cwes, _empty())
    inter = F.array_sort(F.array_intersect(sn, xc))
    return (F.when((F.size(sn) > 0) & (F.size(xc) > 0), F.when(F.size(inter) > 0, inter).otherwise(sn))
            .when(F.size(sn) > 0, sn).otherwise(xc))


def file_context_rollup(attached: DataFrame) -> DataFrame:
    """Per file, sorted distinct XML references and preconditions of its findings."""
    return (attached.groupBy("repo", "scan_id", "path")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("xml_references", _empty()))))).alias("references"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("xml_preconditions", _empty()))))).alias("preconditions")))


# --------------------------------------------------------------------------- K2 / S5
CONTEXT_XML_SCHEMA = (
    "_id STRING, FILE STRUCT<_path: STRING>, RANGE STRUCT<_start: INT, _end: INT>, "
    "SEVERITY STRUCT<_overall: STRING, _bit: STRING>, "
    "MESSAGE STRUCT<_VALUE: STRING, MESSAGES: STRUCT<ITEM: ARRAY<STRING>>>, SNIPPET STRING, "
    "BIT STRUCT<TRIGGER: STRING, STEPS: STRUCT<STEP: ARRAY<STRING>>, REPRODUCTION: STRING, BIT_SEVERITY: STRING>, "
    "CLASSES STRUCT<CLASS: ARRAY<STRING>>, WEAKNESSES STRUCT<CWE: ARRAY<STRUCT<_id: STRING>>>, "
    "REFERENCES STRUCT<REF: ARRAY<STRUCT<_href: STRING>>>, PRECONDITIONS STRUCT<ITEM: ARRAY<STRING>>, "
    "ENV STRUCT<RUNTIME: STRUCT<_node: STRING, _os: STRING>>, MITIGATION STRUCT<SUMMARY: STRING>, TRACKING STRING, "
    "CONTEXT STRUCT<_before: INT, _after: INT>"
)
META_XML_SCHEMA = "_generatedAt STRING, _tool STRING, _count BIGINT"


def to_xml_rows(ctx: DataFrame) -> DataFrame:
    """Context struct -> the element layout of the XML document (attributes as
    _name, a null element left out)."""
    v = F.col("vuln")
    some = lambda c, *fields: F.when(c.isNotNull(), F.struct(*fields))
    return ctx.select(
        "repo", "scan_id",
        v["id"].alias("_id"),
        F.struct(v["file_path"].alias("_path")).alias("FILE"),
        F.struct(v["range_start"].alias("_start"), v["range_end"].alias("_end")).alias("RANGE"),
        F.struct(v["severity_overall"].alias("_overall"), v["severity_bit"].alias("_bit")).alias("SEVERITY"),
        F.struct(v["message_text"].alias("_VALUE"), some(v["message_items"], v["message_items"].alias("ITEM")).alias("MESSAGES")).alias("MESSAGE"),
        v["snippet"].alias("SNIPPET"),
        some(v["bit"], v["bit"]["trigger"].alias("TRIGGER"), F.struct(v["bit"]["steps"].alias("STEP")).alias("STEPS"),
             v["bit"]["reproduction"].alias("REPRODUCTION"), v["bit"]["bit_severity"].alias("BIT_SEVERITY")).alias("BIT"),
        some(v["classes"], v["classes"].alias("CLASS")).alias("CLASSES"),
        some(v["weaknesses"], F.transform(v["weaknesses"], lambda x: F.struct(x.alias("_id"))).alias("CWE")).alias("WEAKNESSES"),
        some(v["references"], F.transform(v["references"], lambda x: F.struct(x.alias("_href"))).alias("REF")).alias("REFERENCES"),
        some(v["preconditions"], v["preconditions"].alias("ITEM")).alias("PRECONDITIONS"),
        some(v["env"], F.struct(v["env"]["node"].alias("_node"), v["env"]["os"].alias("_os")).alias("RUNTIME")).alias("ENV"),
        some(v["mitigation"], v["mitigation"].alias("SUMMARY")).alias("MITIGATION"),
        F.when(v["tracking"], F.lit("")).alias("TRACKING"),
        some(v["context"], v["context"]["before"].alias("_before"), v["context"]["after"].alias("_after")).alias("CONTEXT"),
    )


def write_context_xml(ctx: DataFrame, path: str, meta: DataFrame | None = None) -> None:
    """K2: VULNERABILITY documents per (repo, scan_id) folder, under a namespaced
    CUSTOM_CONTEXT root, and the scan's META document (A4) beside them."""
    def save(rows, kind):
        (rows.write.mode("overwrite").partitionBy("repo", "scan_id").format("xml")
         .option("rootTag", f'CUSTOM_CONTEXT xmlns="{XML_NS}" version="1.1"')
         .option("rowTag", kind).save(f"{path}/element={kind}"))
    save(to_xml_rows(ctx), "VULNERABILITY")
    meta = scan_meta(ctx) if meta is None else meta
    save(meta.select("repo", "scan_id", F.col("generatedAt").alias("_generatedAt"), F.col("tool").alias("_tool"),
                     F.col("count").alias("_count")), "META")


def _read_xml(spark, path: str, kind: str, schema: str) -> DataFrame:
    # explicit schema (no inference); surrounding spaces kept so snippet indentation survives
    return (spark.read.format("xml").schema(schema + ", repo STRING, scan_id STRING")
            .option("rowTag", kind).option("ignoreSurroundingSpaces", False)
            .option("ignoreNamespace", True).load(f"{path}/element={kind}"))


def read_context_xml(spark, path: str) -> DataFrame:
    """All VULNERABILITY elements back."""
    return _read_xml(spark, path, "VULNERABILITY", CONTEXT_XML_SCHEMA)


def read_context_meta(spark, path: str) -> DataFrame:
    """The META element of each scan."""
    return _read_xml(spark, path, "META", META_XML_SCHEMA)


def validate_meta(meta: DataFrame) -> DataFrame:
    """F5 for META: generatedAt and tool present, count a whole number from 0."""
    rules = [(F.col("generatedAt").isNull(), "META@generatedAt is required"),
             (F.col("tool").isNull(), "META@tool is required"),
             (F.col("count").isNull() | (F.col("count") < 0), "META@count must be a non-negative integer")]
    errors = F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules]))
    return meta.select("repo", "scan_id", (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"))
