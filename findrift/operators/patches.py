"""Annotation, pairing, diffs and patch application: T5, J4, T6, T6b, T7, F3.

Source texts live once in ``source_files``; markers and diffs are computed
per file after one equi-join on (repo, path).  The only Python in this
module is T6 (difflib's unified diff), an Arrow-batched pandas UDF over
already-paired rows: one call per batch of files, no per-row JVM round trip.
"""

from __future__ import annotations

import sys

import difflib

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findrift.functions.columns import split_lines

# Worker-side code ships with the task (pickled by value), so Python workers
# need not import this package from their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKER = "@BUG_HERE"
# Paths left out of a change set (fixed values of the reference).
IGNORED_PATHS = (".codeql-db", ".codeql-results", "node_modules", ".github", ".snyk",
                 "snyk_result.sarif.json", ".eslintcache", "eslint_tmp_env", ".DS_Store")
ORIGINAL_FILE_NOT_FOUND = "ORIGINAL_FILE_NOT_FOUND"


def rstrip_lines(text: Column) -> Column:
    """Lines of a text with trailing whitespace removed (Python ``line.rstrip()``)."""
    return F.transform(split_lines(text), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))


# --------------------------------------------------------------------------- T5
def annotate_source(findings: DataFrame, source_files: DataFrame, marker: str = MARKER,
                    keys: tuple[str, ...] = ("repo", "scan_id", "path")) -> DataFrame:
    """T5: append '  # @BUG_HERE' (single line) or '_START'/'_END' (range ends) to
    the flagged lines, in finding order; start outside the file -> skipped,
    end outside -> treated as single-line.  Every output line ends in '\\n'.

    Markers are grouped per (file, line) first, then per file into an array in
    line order that cuts the line array into stretches -- the file text is
    joined once per file, never per finding."""
    files = source_files.select("repo", "path", "n_lines")
    f = findings.select(*keys, "ordinal", "start_line", "end_line").join(files, ["repo", "path"])
    s, e, n = F.col("start_line"), F.col("end_line"), F.col("n_lines")
    e_eff = F.when((e >= 1) & (e <= n), e).otherwise(s)
    single = F.array(F.struct(s.alias("line"), F.lit(0).alias("k"), F.lit(f"  # {marker}").alias("m")))
    ranged = F.array(F.struct(s.alias("line"), F.lit(0).alias("k"), F.lit(f"  # {marker}_START").alias("m")),
                     F.struct(e_eff.alias("line"), F.lit(1).alias("k"), F.lit(f"  # {marker}_END").alias("m")))
    marks = (f.where((s >= 1) & (s <= n))
             .select(*keys, "ordinal", F.explode(F.when(s == e_eff, single).otherwise(ranged)).alias("x"))
             .select(*keys, "ordinal", "x.*"))
    per_line = (marks.groupBy(*keys, "line")
                .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "k", "m"))),
                                              lambda x: x["m"]), "").alias("suffix")))
    per_file = per_line.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "suffix"))).alias("marks"))
    j = per_file.join(source_files.select("repo", "path", "lines", "n_lines"), ["repo", "path"])
    # the stretch of lines up to each marked line, then the rest: every line is taken once
    before = lambda i: F.when(i > 0, F.get("marks", i - 1)["line"]).otherwise(F.lit(0))
    up_to = F.transform("marks", lambda m, i: F.concat(
        F.array_join(F.slice("lines", before(i) + 1, m["line"] - before(i)), "\n"), m["suffix"]))
    last = F.element_at("marks", -1)["line"]
    rest = F.when(last < F.col("n_lines"), F.array(F.array_join(F.slice("lines", last + 1, F.col("n_lines") - last), "\n")))
    text = F.array_join(F.concat(up_to, F.coalesce(rest, F.array().cast("array<string>"))), "\n")
    annotated = F.when(F.col("n_lines") > 0, F.concat(text, F.lit("\n"))).otherwise(F.lit(""))
    return j.select(*keys, annotated.alias("annotated"))


# --------------------------------------------------------------------------- J4
def pair_files(parsed: DataFrame, source_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed code paired with its original by (repo, path); parsed files without
    an original go to a warnings table."""
    orig = source_files.select("repo", "path", F.col("content").alias("original"))
    pairs = parsed.join(orig, ["repo", "path"])
    unpaired = parsed.join(orig, ["repo", "path"], "left_anti").select(
        "repo", "scan_id", "path", F.lit(ORIGINAL_FILE_NOT_FOUND).alias("code"))
    return pairs, unpaired


# --------------------------------------------------------------------------- T6
def _unified(path: str, a: str | None, b: str | None) -> str:
    left = [x.rstrip() + "\n" for x in (a or "").splitlines()]
    right = [x.rstrip() + "\n" for x in (b or "").splitlines()]
    return "".join(difflib.unified_diff(left, right, fromfile=f"a/{path}", tofile=f"b/{path}", lineterm="\n"))


@F.pandas_udf(T.StringType())
def unified_diff_udf(path: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_unified(p, x, y) for p, x, y in zip(path, a, b)])


def unified_diff(pairs: DataFrame) -> DataFrame:
    """Unified diff per paired file (right-stripped lines, 3 context lines,
    a/ b/ headers); an empty diff gives status 'no_changes'.  The text form is a
    per-file helper for sinks (T6b is the relational form); files whose
    right-stripped lines are equal are told apart before it and never reach
    Python."""
    same = rstrip_lines(F.col("original")) == rstrip_lines(F.col("code"))
    x = pairs.withColumn("_same", F.coalesce(same, F.lit(False)))
    changed = x.where(~F.col("_same")).select(
        "repo", "scan_id", "path", unified_diff_udf(F.col("path"), F.col("original"), F.col("code")).alias("diff"))
    equal = x.where("_same").select("repo", "scan_id", "path", F.lit("").alias("diff"))
    return changed.unionAll(equal).withColumn(
        "status", F.when(F.col("diff") == "", F.lit("no_changes")).otherwise(F.lit("diff")))


# --------------------------------------------------------------------------- T6b
def diff_stats(pairs: DataFrame) -> DataFrame:
    """added/removed line counts per file as a multiset difference of the
    right-stripped lines (one signed count per distinct line, then per file)."""
    keys = ["repo", "path", "scan_id"]
    # one explode of both sides per pair row; both aggregations group on keys
    # that contain (repo, path), the key the pairs are already partitioned on
    # by the pairing join, so the lines are not shuffled again
    both = F.concat(F.transform(rstrip_lines(F.col("original")), lambda x: F.struct(x.alias("line"), F.lit(-1).alias("sign"))),
                    F.transform(rstrip_lines(F.col("code")), lambda x: F.struct(x.alias("line"), F.lit(1).alias("sign"))))
    # inline_outer keeps files without any line (one null row) so no join back is needed
    per_line = (pairs.select(*keys, F.inline_outer(both)).groupBy(*keys, "line").agg(F.sum("sign").alias("d")))
    per_file = per_line.groupBy(*keys).agg(
        F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0))), F.lit(0)).cast("bigint").alias("n_added"),
        F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).cast("bigint").alias("n_removed"))
    return per_file.select("repo", "scan_id", "path", "n_added", "n_removed")


# --------------------------------------------------------------------------- T7
def apply_patches(parsed: DataFrame, source_files: DataFrame) -> DataFrame:
    """Final content per file.  Parsed code wins where it differs from the
    original (status 'patched'); equal or absent parsed code keeps the
    original ('unchanged'); parsed code without an original -> 'no_original'."""
    orig = source_files.select("repo", "path", F.col("content").alias("original"))
    j = orig.join(parsed.select("repo", "path", "scan_id", "code"), ["repo", "path"], "full")
    differs = rstrip_lines(F.col("original")) != rstrip_lines(F.col("code"))
    status = (F.when(F.col("original").isNull(), F.lit("no_original"))
              .when(F.col("code").isNotNull() & differs, F.lit("patched"))
              .otherwise(F.lit("unchanged")))
    content = F.when(status == "patched", F.col("code")).otherwise(F.col("original"))
    return j.select("repo", "path", "scan_id", content.alias("content"), status.alias("status"))


# --------------------------------------------------------------------------- F3
def exclude_paths(df: DataFrame, path_col: str = "path", names: tuple[str, ...] = IGNORED_PATHS) -> DataFrame:
    """drop tool artefacts from a change set (the name itself or anything below it)."""
    p = F.col(path_col)
    below = F.lit(False)
    for n in names:
        below = below | p.startswith(n + "/")
    return df.where(~(p.isin(*names) | below))
