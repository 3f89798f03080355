"""A1 merge_findings_by_file and O1 sorted-distinct arrays.

Group key (repo, scan_id, path).  Per group:
  start_line = min, end_line = max
  snippet    = sorted distinct lines of all non-empty snippets, '\\n'-joined
  message    = sorted distinct non-empty messages joined by ' | '
  classes, cwe, references = sorted distinct union
  severity   = upper-cased max by INFO 0 < WARNING 1 < ERROR 2 (others -1),
               empty skipped, '' if none, ties -> earliest ordinal

Plan shape: one pass, one shuffle.  Each finding is exploded into its snippet
lines (``explode_outer`` keeps findings without a snippet); per-finding
aggregates read only the first row of each finding, the line set collects
every row.  Map-side partial aggregation collapses a hot file to one partial
row per map task before the shuffle, and the final line set of a file is
bounded by the file's size, never by its number of findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.functions.columns import severity_rank, split_lines

KEYS = ["repo", "scan_id", "path"]
MERGED_COLUMNS = ("repo", "scan_id", "path", "tool", "first_ordinal", "n_findings", "start_line", "end_line",
                  "snippet", "message", "vulnerability_class", "cwe", "severity", "references")
STATE_COLUMNS = ("first_ordinal", "n_findings", "start_line", "end_line", "tool", "lines", "messages", "classes",
                 "cwes", "refs", "sev")


def sorted_distinct(c) -> F.Column:
    """O1: array_sort(array_distinct(...))."""
    return F.array_sort(F.array_distinct(c))


def merge_state(findings: DataFrame, keys: list[str] | None = None, snippet: bool = True) -> DataFrame:
    """The state of A1 per key: minima, maxima, counts and sets, which
    :func:`add_states` can add up and :func:`finish_state` turns into the merged row."""
    keys = keys or KEYS
    tool = F.col("tool") if "tool" in findings.columns else F.lit(None).cast("string")
    base = [*keys, tool.alias("tool"), "ordinal", "start_line", "end_line", "message", "vulnerability_class", "cwe",
            "severity", "references"]
    if snippet:
        snip = F.col("snippet")
        lines = F.when(snip.isNotNull() & (snip != ""), split_lines(snip))
        x = findings.select(*base, F.posexplode_outer(lines).alias("_pos", "_line"))
    else:
        x = findings.select(*base, F.lit(None).cast("int").alias("_pos"), F.lit(None).cast("string").alias("_line"))
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    one = lambda c: F.when(first, c)  # noqa: E731  per-finding value on the finding's first row only
    sev = F.upper(F.col("severity"))
    ranked = first & (sev != "")
    rank = F.struct(severity_rank(sev).alias("rank"), (-F.col("ordinal")).alias("late"), sev.alias("sev"))
    return x.groupBy(*keys).agg(
        F.min(one(F.col("ordinal"))).alias("first_ordinal"),
        F.count_if(first).alias("n_findings"),
        F.min(one(F.col("start_line"))).alias("start_line"),
        F.max(one(F.col("end_line"))).alias("end_line"),
        F.min("tool").alias("tool"),
        F.collect_set("_line").alias("lines"),
        F.collect_set(F.when(first & (F.col("message") != ""), F.col("message"))).alias("messages"),
        F.array_distinct(F.flatten(F.collect_set(one(F.col("vulnerability_class"))))).alias("classes"),
        F.array_distinct(F.flatten(F.collect_set(one(F.col("cwe"))))).alias("cwes"),
        F.array_distinct(F.flatten(F.collect_set(one(F.col("references"))))).alias("refs"),
        F.max(F.when(ranked, rank)).alias("sev"),
    )


def add_states(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """States of the same keys added up (each finding in one of them only)."""
    keys = keys or KEYS
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c))).alias(c)  # noqa: E731  one entry a state
    return states.groupBy(*keys).agg(
        F.min("first_ordinal").alias("first_ordinal"), F.sum("n_findings").alias("n_findings"),
        F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.min("tool").alias("tool"),
        union("lines"), union("messages"), union("classes"), union("cwes"), union("refs"), F.max("sev").alias("sev"))


def finish_state(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return states.select(
        *(keys or KEYS), "tool", "first_ordinal", "n_findings", "start_line", "end_line",
        F.array_join(F.array_sort("lines"), "\n").alias("snippet"),
        F.array_join(F.array_sort("messages"), " | ").alias("message"),
        F.array_sort("classes").alias("vulnerability_class"), F.array_sort("cwes").alias("cwe"),
        F.coalesce("sev.sev", F.lit("")).alias("severity"), F.array_sort("refs").alias("references"),
    ).select(*MERGED_COLUMNS)


def merge_findings_by_file(findings: DataFrame, keys: list[str] | None = None, snippet: bool = True) -> DataFrame:
    """A1.  ``snippet=False`` skips the line set (snippet = '') for consumers that
    only read the other merged fields (e.g. context lookups)."""
    return finish_state(merge_state(findings, keys, snippet), keys)
