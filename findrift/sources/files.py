"""File sources: S1 source files, S4 findings JSON, S6 responses, S7 legacy logs.

All readers take an explicit schema or derive columns from file metadata;
nothing infers a schema across many files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.functions.columns import split_lines
from findrift.operators.prompts import read_responses  # noqa: F401  (S6 lives with the response operators)
from findrift.session import scratch_path, scratch_table
from findrift.sources.tree import read_small_files

#: Bytes of source texts in a bucket.
BUCKET_BYTES = 128_000_000

FINDING_SCHEMA = ("input string, idx int, start_line int, end_line int, snippet string, message string, "
                  "vulnerability_class array<string>, cwe array<string>, severity string, "
                  "references array<string>, path string")
PR_LOG_SCHEMA = ("date string, owner string, repo string, user_name string, repo_url string, repo_hash string, "
                 "pr_number int, opened boolean, approved boolean")
REPO_LOG_SCHEMA = ("name string, owner string, repo_url string, vulnerabilities bigint, "
                   "byClass array<struct<type:string,count:bigint>>, analysis string, sastTool string, "
                   "rerun boolean, repo_hash string")


def _scan_sources(spark: SparkSession, root: str, exts: Sequence[str], layout: str) -> DataFrame:
    glob = "*." + (exts[0] if len(exts) == 1 else "{" + ",".join(exts) + "}")
    rel = F.col("rel")
    return read_small_files(spark, root, glob).select(
        F.regexp_extract(rel, layout, 1).alias("repo"), F.regexp_extract(rel, layout, 2).alias("path"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def read_source_files(spark: SparkSession, root: str, exts: Sequence[str] = ("py", "pyi"),
                      layout: str = r"^([^/]+)/(.+)$") -> DataFrame:
    """Recursive read of UTF-8 source files under ``root`` (listed and read by
    tasks, extension glob applied in the listing).  ``layout`` maps the path below
    ``root`` to (repo, path) with two regex groups; default <repo>/<path>.
    Files that are not UTF-8 are left out here and listed by
    :func:`source_rejects`."""
    lines = split_lines("content")
    return (_scan_sources(spark, root, exts, layout).where(F.col("content").isNotNull())
            .select("repo", "path", "content", lines.alias("lines"), F.size(lines).alias("n_lines")))


def store_sources(source_files: DataFrame, table: str | None = None, path: str | None = None,
                  bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Source files stored once, in buckets by (repo, path) and sorted, so that every
    join on that key leaves the texts where they are and moves the other side only.

    Without ``table`` and ``path`` the table is an intermediate one.  A bucket is one
    task of every join: where a single file has a large share of all findings,
    pass the files unstored, whose joins split such a key."""
    spark = source_files.sparkSession
    files = source_files.select("repo", "path", "content")
    size = files.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
    # not fewer than a shuffle has, or a join would rather shuffle both sides
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    table = table or scratch_table("sources")
    (files.repartition(n, "repo", "path").sortWithinPartitions("repo", "path").write
     .option("path", path or scratch_path(spark, "sources")).bucketBy(n, "repo", "path").sortBy("repo", "path").saveAsTable(table))
    return stored_sources(spark, table)


def stored_sources(spark: SparkSession, table: str) -> DataFrame:
    """The stored files, lines cut as they are read."""
    lines = split_lines("content")
    return spark.table(table).select("repo", "path", "content", lines.alias("lines"), F.size(lines).alias("n_lines"))


def source_rejects(spark: SparkSession, root: str, exts: Sequence[str] = ("py", "pyi"),
                   layout: str = r"^([^/]+)/(.+)$") -> DataFrame:
    """Files under ``root`` that S1 can't read, as reject rows."""
    return _scan_sources(spark, root, exts, layout).where(F.col("content").isNull()).select(
        "repo", F.lit(None).cast("string").alias("scan_id"), F.lit("source").alias("stage"), F.col("path").alias("key"),
        F.lit("NOT_UTF8").alias("code"), F.lit("file is not valid UTF-8; dropped").alias("message"))


def read_findings(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """merged/raw finding records (a JSON array per file, or JSON lines with
    ``multiline=False``) with the fixed 11-field schema."""
    return spark.read.schema(FINDING_SCHEMA).option("multiLine", multiline).json(path)


def read_logs(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """Legacy ``{"prs": [...], "repos": [...]}`` log documents -> (pr_log, repo_log).

    ``multiline`` for pretty-printed files (one document each); False for
    files holding one compact document per line."""
    doc = spark.read.schema(f"prs array<struct<{_ddl(PR_LOG_SCHEMA)}>>, repos array<struct<{_ddl(REPO_LOG_SCHEMA)}>>") \
        .option("multiLine", multiline).json(path)
    return doc.select(F.inline_outer("prs")).where(F.col("pr_number").isNotNull() | F.col("repo_url").isNotNull()), \
        doc.select(F.inline_outer("repos")).where(F.col("name").isNotNull() | F.col("repo_url").isNotNull())


def _ddl(schema: str) -> str:
    """'a int, b string' -> 'a:int,b:string' for nesting inside struct<...>."""
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    out.append(cur.strip())
    return ",".join(f"{p.split(' ', 1)[0]}:{p.split(' ', 1)[1]}" for p in out)
