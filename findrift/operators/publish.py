"""Publish log and PR state: L1-L6, J7-J9, W5, W6, F6.

The reference keeps one JSON file rewritten on every change.  Here the logs
are append-only tables; the current state is a view computed with joins and
``max_by`` (no read-modify-write, so no lost updates), and replacing rows is
an anti-join on null-safe equality followed by a union.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.functions import branding as B
from findrift.session import scratch_path

#: Digests (8 bytes each) that may be broadcast.
FEW = 500_000
# Columns whose equality makes two repo-log entries "the same" (fixed by the reference).
REPO_LOG_EQUALITY = ("name", "owner", "repo_url", "vulnerabilities", "byClass", "sastTool", "rerun", "analysis")
# Hashed fields, title prefix; also the 400 / 404 texts below.
REPO_HASH_KEYS = ("repo_url", "sastTool", "rerun", "vulnerabilities", "byClass", "analysis")
PR_TITLE_PREFIX = f"[ {B.NAME} ] Security Patch "


# --------------------------------------------------------------------------- L1
def pr_log_rows(prs: DataFrame, date: Column | None = None) -> DataFrame:
    """L1: a new PR log row per created PR: opened = true, approved = false."""
    d = date if date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return prs.select(d.alias("date"), "owner", "repo", "user_name", "repo_url", "repo_hash",
                      F.col("pr_number").cast("int").alias("pr_number"),
                      F.lit(True).alias("opened"), F.lit(False).alias("approved"))


# --------------------------------------------------------------------------- W6 / J9 / L4
def latest_status(updates: DataFrame, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """The last status update per (pr_number, repo_url) wins."""
    u = updates.where(F.col("pr_number").isNotNull())
    return (u.groupBy("pr_number", "repo_url")
            .agg(F.max_by(F.struct("approved", "opened"), F.struct(*order)).alias("s"))
            .select("pr_number", "repo_url", "s.approved", "s.opened"))


def update_pr_status(pr_log: DataFrame, updates: DataFrame,
                     order: Sequence[str] = ("ts", "seq")) -> tuple[DataFrame, DataFrame]:
    """Apply the latest update to every log row with the same
    (pr_number, repo_url); updates matching no row -> 404 rows, updates
    without a PR number -> 400 rows."""
    last = latest_status(updates, order)
    keys = ["pr_number", "repo_url"]
    j = pr_log.join(last.withColumnRenamed("approved", "u_approved").withColumnRenamed("opened", "u_opened"),
                    keys, "left")
    matched = F.col("u_approved").isNotNull() | F.col("u_opened").isNotNull()
    out = j.select(*[c for c in pr_log.columns if c not in ("approved", "opened")],
                   F.when(matched, F.col("u_approved")).otherwise(F.col("approved")).alias("approved"),
                   F.when(matched, F.col("u_opened")).otherwise(F.col("opened")).alias("opened"))
    missing = (updates.where(F.col("pr_number").isNotNull())
               .join(pr_log.select(*keys).distinct(), keys, "left_anti")
               .select("pr_number", "repo_url", F.lit(404).alias("status_code"), F.lit("PR not found").alias("error")))
    bad = updates.where(F.col("pr_number").isNull()).select(
        "pr_number", "repo_url", F.lit(400).alias("status_code"), F.lit("pr_number is required").alias("error"))
    return out, missing.unionByName(bad)


def updates_from_pulls(pulls: DataFrame) -> DataFrame:
    """L4: status updates from pull-request records of the code host
    (pr_number, repo_url, merged, state, ts[, seq]): approved = merged,
    opened = (state == 'open'); a missing record reads as neither."""
    seq = F.col("seq") if "seq" in pulls.columns else F.lit(0).cast("bigint")
    return pulls.select(F.col("pr_number").cast("int").alias("pr_number"), "repo_url",
                        F.coalesce(F.col("merged"), F.lit(False)).alias("approved"),
                        F.coalesce(F.col("state") == "open", F.lit(False)).alias("opened"),
                        "ts", seq.alias("seq"))


# --------------------------------------------------------------------------- J8 / L3
def replace_equal_rows(existing: DataFrame, new: DataFrame, keys: Sequence[str] = REPO_LOG_EQUALITY,
                       order: str = "seq") -> DataFrame:
    """Drop existing rows equal (null-safe, on ``keys``) to any new row,
    then append the new rows; among equal new rows the last (by ``order``) stays,
    as sequential single-row upserts would leave it.

    Rows carry whole reports, so a 64-bit digest of the columns is what is
    shuffled to find equal rows; only rows whose digest occurs again move
    themselves, for the exact comparison."""
    keys = list(keys)
    existing, new = (df.withColumn("_d", F.xxhash64(*keys)) for df in (existing, new))
    both = _few(existing.select("_d").distinct().join(new.select("_d").distinct(), "_d", "left_semi"))
    many = _few(new.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_d"))
    # digests that one side only has tell enough; rows that share one are compared column by column
    asked = new.join(both, "_d", "left_semi").select("_d", *[F.col(k).alias(f"_n_{k}") for k in keys])
    hit = existing.join(both, "_d", "left_semi")
    same = hit["_d"] == asked["_d"]
    for k in keys:
        same = same & hit[k].eqNullSafe(asked[f"_n_{k}"])
    kept = existing.join(both, "_d", "left_anti").unionByName(hit.join(asked, same, "left_anti"))
    rest = [c for c in new.columns if c not in keys]
    last = (new.join(many, "_d", "left_semi").groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r"))
            .select(*keys, "r.*"))
    added = new.join(many, "_d", "left_anti").unionByName(last)
    return kept.unionByName(added).drop("_d")


def _few(digests: DataFrame) -> DataFrame:
    """Stored digests (8 bytes each), broadcast while there are at most FEW of them."""
    spark = digests.sparkSession
    path = scratch_path(spark, "digests")
    digests.write.parquet(path)
    stored = spark.read.parquet(path)
    return F.broadcast(stored) if stored.count() <= FEW else stored


# --------------------------------------------------------------------------- W5 / J7 / L5
def latest_open_pr(prs: DataFrame) -> DataFrame:
    """Newest open PR per repo (created_at, then number)."""
    return (prs.where(F.col("state") == "open").groupBy("repo")
            .agg(F.max_by(F.struct("number", "head_ref", "created_at"), F.struct("created_at", "number")).alias("p"))
            .select("repo", "p.number", "p.head_ref", "p.created_at"))


def prs_to_runs(prs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each PR with the first listed workflow run (newest id) whose
    pull_requests contain its number."""
    ex = runs.select("repo", "id", "status", "conclusion", F.explode("pull_requests").alias("pr"))
    first = (ex.select("repo", F.col("pr.number").alias("number"), "id", "status", "conclusion")
             .groupBy("repo", "number")
             .agg(F.max_by(F.struct("id", "status", "conclusion"), F.col("id")).alias("r"))
             .select("repo", "number", F.col("r.id").alias("run_id"), F.col("r.status").alias("run_status"),
                     F.col("r.conclusion").alias("run_conclusion")))
    return prs.join(first, ["repo", "number"], "left")


def publishable_prs(prs: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest open PR per repo and whether it may go upstream: its first
    run must be completed with conclusion success (reason otherwise)."""
    j = prs_to_runs(latest_open_pr(prs), runs)
    reason = (F.when(F.col("run_id").isNull(), F.lit("no_run"))
              .when(F.col("run_status") != "completed", F.lit("running"))
              .when(F.col("run_conclusion") != "success", F.lit("failed"))
              .otherwise(F.lit("ok")))
    return j.select("repo", "number", "head_ref", "run_id", (reason == "ok").alias("publishable"), reason.alias("reason"))


# --------------------------------------------------------------------------- L6
def pr_requests(publishable: DataFrame, bodies: DataFrame, user_name: Column, base_branch: Column,
                date: Column | None = None) -> DataFrame:
    """Pull-request request rows: dated title, head 'user:branch', base, body."""
    d = date if date is not None else F.date_format(F.current_date(), "yyyy-MM-dd")
    j = publishable.where("publishable").join(bodies, "repo", "left")
    return j.select("repo", "number", F.concat(F.lit(PR_TITLE_PREFIX), d).alias("title"),
                    F.concat(user_name, F.lit(":"), F.col("head_ref")).alias("head"),
                    base_branch.alias("base"), F.col("body"))


# --------------------------------------------------------------------------- F6
def has_findings(repos: DataFrame, file_findings: DataFrame) -> DataFrame:
    """repos with at least one merged finding go on; the rest stop here."""
    with_f = file_findings.select("repo").distinct().withColumn("has_findings", F.lit(True))
    return repos.select("repo").distinct().join(with_f, "repo", "left").select(
        "repo", F.coalesce("has_findings", F.lit(False)).alias("has_findings"))
