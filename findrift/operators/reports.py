"""Rollups and rankings: A2, A3, A6, A10, A11, W2, W3.

Order-dependent semantics (first seen, stable ties) use the scan ordinal.
Group-wide numbering (W2) never sorts a whole scan in one task: rows are
bucketed by ordinal range, bucket sizes are prefix-summed up and down a tree,
and each bucket is numbered on its own (``ranked``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED_LEVELS = ("ERROR", "WARNING", "NOTE")


def _empty() -> Column:
    return F.array().cast("array<string>")


def ranked(df: DataFrame, group: list[str], order: str, name: str = "rn", bucket_bits: int = 16) -> DataFrame:
    """1-based position of each row inside ``group`` by the unique bigint ``order`` (0 or more).

    Equivalent to row_number() over (partition by group order by order), but no
    task gets a whole group: rows are numbered within buckets of 2^bucket_bits orders.
    Bucket sizes are summed up a tree whose nodes have at most 2^bucket_bits children,
    so what lies before a bucket is a sum of one number per level, and no window
    has more than 2^bucket_bits rows, however many buckets a group has."""
    x = df.withColumn("_0", F.shiftright(F.col(order), bucket_bits))
    shifts = range(2 * bucket_bits, 64, bucket_bits)  # of the tree's levels above the buckets
    # sizes of nodes, from the buckets up
    sizes = [x.groupBy(*group, "_0").agg(F.count(F.lit(1)).alias("_n"))]
    for k, _ in enumerate(shifts, 1):
        below = sizes[-1].withColumn(f"_{k}", F.shiftright(F.col(f"_{k - 1}"), bucket_bits))
        sizes[-1] = below
        sizes.append(below.groupBy(*group, f"_{k}").agg(F.sum("_n").alias("_n")))
    # what lies before each node, from the root (all of a group) down
    before = None
    for k in reversed(range(len(sizes))):
        parent = [*group, *([f"_{k + 1}"] if k + 1 < len(sizes) else [])]
        siblings = Window.partitionBy(*parent).orderBy(f"_{k}").rowsBetween(Window.unboundedPreceding, -1)
        here = sizes[k].withColumn("_off", F.coalesce(F.sum("_n").over(siblings), F.lit(0)))
        if before is not None:
            here = here.join(before.withColumnRenamed("_off", "_up"), parent).withColumn("_off", F.col("_off") + F.col("_up"))
        before = here.select(*group, f"_{k}", "_off")
    inside = Window.partitionBy(*group, "_0").orderBy(order)
    return (x.join(before, [*group, "_0"])
            .withColumn(name, F.col("_off") + F.row_number().over(inside))
            .drop("_0", "_off"))


# --------------------------------------------------------------------------- A2
def class_counts(findings: DataFrame) -> DataFrame:
    """A2: count by *first* class per scan; unclassed rows excluded from the total;
    ``class_pos`` = first-seen order."""
    f = findings.where(F.size("vulnerability_class") > 0).select(
        "repo", "scan_id", F.get("vulnerability_class", 0).alias("type"), "ordinal")
    agg = f.groupBy("repo", "scan_id", "type").agg(F.count(F.lit(1)).alias("count"),
                                                  F.min("ordinal").alias("first_seen"))
    w = Window.partitionBy("repo", "scan_id")
    return agg.select(
        "repo", "scan_id", "type", "count",
        F.row_number().over(w.orderBy("first_seen")).alias("class_pos"),
        F.sum("count").over(w).alias("vulnerabilities"),
    )


# --------------------------------------------------------------------------- W2
def file_numbers(findings: DataFrame) -> DataFrame:
    """1-based file number per scan by first appearance."""
    files = findings.groupBy("repo", "scan_id", "path").agg(F.min("ordinal").alias("first_ordinal"))
    return ranked(files, ["repo", "scan_id"], "first_ordinal", "file_no")


# --------------------------------------------------------------------------- W3 / A3
def top_cwes(chosen: DataFrame, n: int = 2) -> DataFrame:
    """Per file, CWE counts over the chosen CWEs of its findings; top ``n`` by
    count desc, ties by first appearance (stable sort of insertion order)."""
    ex = chosen.select("repo", "scan_id", "path", "ordinal", F.posexplode("chosen_cwes").alias("k", "cwe"))
    cnt = ex.groupBy("repo", "scan_id", "path", "cwe").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct("ordinal", "k")).alias("first_seen"))
    w = Window.partitionBy("repo", "scan_id", "path").orderBy(F.desc("cnt"), "first_seen")
    return (cnt.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("repo", "scan_id", "path", "cwe", "cnt", "rank"))


def file_severity_rollup(chosen: DataFrame, n_top: int = 2) -> DataFrame:
    """A3: per file issue count, 'E:1, W:2' level string (zeros skipped, '-' if none)
    and the top-2 CWEs (W3) joined by ', ' ('-' if none)."""
    sev = F.upper(F.coalesce(F.col("severity"), F.lit("")))
    per_file = chosen.groupBy("repo", "scan_id", "path").agg(
        F.count(F.lit(1)).alias("n_issues"),
        *[F.count_if(sev == lvl).alias(f"n_{lvl.lower()}") for lvl in COUNTED_LEVELS])
    parts = [F.when(F.col(f"n_{lvl.lower()}") > 0, F.concat(F.lit(lvl[:1] + ":"), F.col(f"n_{lvl.lower()}").cast("string")))
             for lvl in COUNTED_LEVELS]
    levels = F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("")), F.lit("-"))
    top = (top_cwes(chosen, n_top).groupBy("repo", "scan_id", "path")
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cwe"))), lambda x: x["cwe"]), ", ")
                .alias("top_cwes")))
    return (per_file.join(top, ["repo", "scan_id", "path"], "left")
            .select("repo", "scan_id", "path", "n_issues",
                    *[f"n_{lvl.lower()}" for lvl in COUNTED_LEVELS],
                    levels.alias("levels"),
                    F.coalesce(F.nullif(F.col("top_cwes"), F.lit("")), F.lit("-")).alias("top_cwes")))


# --------------------------------------------------------------------------- A6
def presence_flags(attached: DataFrame) -> DataFrame:
    """has_cwe / has_ref per file (repo log) and has_cwe / has_ref / has_bit over
    all files of a scan (PR body), the scan grain broadcast back by a join on a
    per-scan aggregate -- never a collect()."""
    has_cwe = F.size(F.coalesce("cwe", _empty())) > 0
    has_ref = F.size(F.coalesce("references", _empty())) > 0
    xml_cwe = F.size(F.coalesce("xml_cwes", _empty())) > 0
    has_bit = F.coalesce(F.col("xml_bit_severity"), F.lit("")) != ""
    files = attached.groupBy("repo", "scan_id", "path").agg(
        F.bool_or(has_cwe).alias("file_has_cwe"), F.bool_or(has_ref).alias("file_has_ref"),
        F.bool_or(has_cwe | xml_cwe).alias("_c"), F.bool_or(has_bit).alias("_b"))
    scans = files.groupBy("repo", "scan_id").agg(
        F.bool_or("_c").alias("scan_has_cwe"), F.bool_or("file_has_ref").alias("scan_has_ref"),
        F.bool_or("_b").alias("scan_has_bit"))
    return files.drop("_c", "_b").join(scans, ["repo", "scan_id"])


# --------------------------------------------------------------------------- A10 / A11
def run_summary(file_findings: DataFrame, responses: DataFrame) -> DataFrame:
    """A10: per repo, files with findings and number of responses."""
    f = file_findings.groupBy("repo").agg(F.count(F.lit(1)).alias("files_with_findings"))
    r = responses.groupBy("repo").agg(F.count(F.lit(1)).alias("n_responses"))
    return f.join(r, "repo", "full").select(
        "repo", F.coalesce("files_with_findings", F.lit(0)).alias("files_with_findings"),
        F.coalesce("n_responses", F.lit(0)).alias("n_responses"))


def fleet_rollup(findings: DataFrame) -> DataFrame:
    """Findings, files and errors per (repo, tool, first class) with rollup
    subtotals, and the status of each line: failed (errors found) or passed.

    Findings are counted by file, tool and class first.  A file's few counts then
    lie in one row, which adds itself once to each line that it belongs to, so
    files are counted exactly without a second copy of any finding."""
    f = findings.select("repo", "tool", F.coalesce(F.get("vulnerability_class", 0), F.lit("N/A")).alias("cls"), "path", "severity")
    counted = f.groupBy("repo", "path", "tool", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.upper("severity") == "ERROR").alias("e"))
    files = counted.groupBy("repo", "path").agg(F.collect_list(F.struct("tool", "cls", "n", "e")).alias("xs"))
    none = F.lit(None).cast("string")

    def line(tool, cls, level, xs):
        total = lambda c: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x[c]).alias(c)
        return F.struct(tool.alias("tool"), cls.alias("cls"), F.lit(level).alias("level"), total("n"), total("e"))

    xs = F.col("xs")
    by_class = F.transform(xs, lambda x: line(x["tool"], x["cls"], 0, F.array(x)))
    by_tool = F.transform(F.array_distinct(F.transform(xs, lambda x: x["tool"])),
                          lambda t: line(t, none, 1, F.filter(xs, lambda x: x["tool"].eqNullSafe(t))))
    lines = files.select("repo", F.explode(F.concat(by_class, by_tool, F.array(line(none, none, 3, xs), line(none, none, 7, xs)))).alias("x"))
    return (lines.groupBy(F.when(F.col("x.level") < 7, F.col("repo")).alias("repo"), "x.tool", "x.cls",
                          F.col("x.level").cast("long").alias("level"))
            .agg(F.sum("x.n").alias("n_findings"), F.count(F.lit(1)).alias("n_files"), F.sum("x.e").alias("n_error"))
            .select("repo", "tool", "cls", "n_findings", "n_files", "n_error", "level",
                    F.when(F.col("n_error") > 0, "failed").otherwise("passed").alias("status")))


def distinct_paths(findings: DataFrame) -> DataFrame:
    """A5 / O2: the paths of each scan, one row each (a scan's list is never one row)."""
    return findings.select("repo", "scan_id", "path").distinct()


def first_or(c: Column | str, default: str = "N/A") -> Column:
    """O3: first element or a default."""
    return F.coalesce(F.get(F.col(c) if isinstance(c, str) else c, 0), F.lit(default))
