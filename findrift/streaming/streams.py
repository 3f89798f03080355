"""Structured Streaming forms of ingest and status updates: R1, R2.

R1  scanner output files land in a folder laid out as
    ``repo=<repo>/scan_id=<scan>/part=<n>/<file>``; file-source streams read
    each file whole and join its results to ``source_files``.
    ``stream_findings`` appends findings and rejects per batch.
    ``stream_file_findings`` keeps the per-file merge (A1) current: a streaming
    aggregation in update mode whose state (minima, maxima, counts and sets per
    file) the engine holds in its state store, so a batch reads its own files
    and nothing that was written before; what changed is written per batch.
    ``latest_file_findings`` is the current view.  The two streams share no
    output, so each can be restarted by itself.
R2  status updates stream in as JSON lines.  Repeats are dropped within a
    watermark, so the state is bounded by its delay; updates older than that
    are kept in a table of their own, unless they were delivered before.  W6
    over both tables is the current PR status.

Every sink folder is keyed by batch id and written with ``overwrite``, so a
re-run micro-batch (executor loss, restart from the checkpoint) replaces its
own output instead of duplicating it.  Checkpoints and outputs live under the
shared folder (``spark.checkpoint.dir``), never on a machine-local disk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from findrift.functions.columns import split_lines
from findrift.operators import ingest
from findrift.operators.merge import KEYS, STATE_COLUMNS, finish_state, merge_state
from findrift.operators.publish import latest_status
from findrift.session import many_folders

STATUS_SCHEMA = "pr_number int, repo_url string, approved boolean, opened boolean, ts timestamp, seq bigint"
#: What makes two status updates the same delivery, and how long a repeat is expected.
UPDATE_KEYS, REPEAT_DELAY = ("pr_number", "repo_url", "ts", "seq"), "1 day"
_LAYOUT = r"repo=([^/]+)/scan_id=([^/]+)/part=(\d+)/"


def _raw_from_files(df: DataFrame, tool: str) -> DataFrame:
    p = F.col("_path")
    return df.select(F.regexp_extract(p, _LAYOUT, 2).alias("scan_id"), F.regexp_extract(p, _LAYOUT, 1).alias("repo"),
                     F.lit(tool).alias("tool"), F.regexp_extract(p, _LAYOUT, 3).cast("long").alias("part"),
                     F.col("value").alias("text"))


def _landed(spark: SparkSession, landing: str, tool: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    with many_folders(spark):
        files = reader.load(landing)
    return _raw_from_files(files.select("value", F.col("_metadata.file_path").alias("_path")), tool)


def _joined(raw: DataFrame, source_files: DataFrame, tool: str) -> DataFrame:
    """``ingest.join_sources`` for a batch, which names few of the files: the batch is the
    side that is hashed, so that the sources are read past it, neither sorted nor (where
    stored in buckets) moved, and lines are cut of the files that it names only."""
    files = source_files.select("repo", "path", "content", F.lit(True).alias("_is"))
    j = ingest.BASES[tool](raw).hint("shuffle_hash").join(files, ["repo", "path"], "left")
    # a generator of one row: what is computed above it can't repeat the cutting
    cut = F.inline(F.array(F.struct(split_lines("content").alias("lines"), ingest.odd_content().alias("odd_content"))))
    return j.select(*ingest.BASE_COLUMNS, "_is", cut).withColumn("n_lines", F.when(F.col("_is"), F.size("lines"))).drop("_is")


def _start(stream: DataFrame, per_batch: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool,
           mode: str = "append") -> StreamingQuery:
    w = stream.writeStream.foreachBatch(per_batch).outputMode(mode).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def stream_findings(spark: SparkSession, landing: str, source_files: DataFrame, out_dir: str, tool: str = "semgrep",
                    checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                    available_now: bool = True) -> StreamingQuery:
    """R1, rows: start the ingest stream (``available_now`` drains what is there and stops)."""
    def per_batch(raw: DataFrame, batch_id: int) -> None:
        joined = None
        if ingest.is_builtin(tool):  # one join feeds both outputs
            joined = _joined(raw, source_files, tool).persist()
            found, rejects = ingest.apply_policies(joined, {tool})
        else:
            found, rejects = ingest.ADAPTERS[tool](raw, source_files)
        found.write.mode("overwrite").parquet(f"{out_dir}/findings/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{out_dir}/rejects/batch_id={batch_id}")
        if joined is not None:
            joined.unpersist()

    return _start(_landed(spark, landing, tool, max_files_per_trigger), per_batch, checkpoint or f"{out_dir}/_checkpoint", available_now)


def stream_file_findings(spark: SparkSession, landing: str, source_files: DataFrame, out_dir: str, tool: str = "semgrep",
                         checkpoint: str | None = None, max_files_per_trigger: int | None = None,
                         available_now: bool = True) -> StreamingQuery:
    """R1, merge: start the stream that keeps the per-file merge current.

    Any tool's results are numbered within their file only for the ``idx``
    column, which the merge doesn't read, so the plan has no window; an adapter
    registered by a user must be a plan that streams."""
    raw = _landed(spark, landing, tool, max_files_per_trigger)
    if ingest.is_builtin(tool):
        found, _ = ingest.apply_policies(_joined(raw, source_files, tool), set())
    else:
        found, _ = ingest.ADAPTERS[tool](raw, source_files)

    def per_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_dir}/merged/batch_id={batch_id}")

    return _start(merge_state(found), per_batch, checkpoint or f"{out_dir}/_merge_checkpoint", available_now, "update")


def latest_file_findings(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current per-file merge: what the latest batch that changed a file wrote of it."""
    rows = spark.read.parquet(f"{out_dir}/merged")
    return finish_state(rows.groupBy(*KEYS).agg(F.max_by(F.struct(*STATE_COLUMNS), "batch_id").alias("r")).select(*KEYS, "r.*"))


def _missing(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose update is not among ``stored`` (nulls are equal)."""
    stored = stored.select(*[F.col(k).alias(f"_{k}") for k in UPDATE_KEYS])
    same = F.lit(True)
    for k in UPDATE_KEYS:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(stored, same, "left_anti")


def stream_pr_status(spark: SparkSession, landing: str, out_dir: str, checkpoint: str | None = None,
                     available_now: bool = True, delay: str = REPEAT_DELAY) -> StreamingQuery:
    """R2: each status update once in ``updates``, whichever batches it is delivered
    in; one older than the watermark (``delay`` behind the latest update before
    its batch) goes to ``late``, if neither table has it.

    Each batch gets its rows twice, as they came and as the engine passed them.
    Those that it held back are repeats or late; the few are looked up in what
    is stored of their time."""
    s = spark.readStream.schema(STATUS_SCHEMA).json(landing)
    passed = s.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(UPDATE_KEYS))
    both = passed.withColumn("passed", F.lit(True)).unionByName(s.withColumn("passed", F.lit(False)))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # once: running the plan again would run its state again
        staged = f"{out_dir}/_staged/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(staged)
        batch = spark.read.schema(f"{STATUS_SCHEMA}, passed boolean").parquet(staged)
        new = batch.where("passed").drop("passed")
        new.write.mode("overwrite").parquet(f"{out_dir}/updates/batch_id={batch_id}")
        held = _missing(batch.where(~F.col("passed")).drop("passed").dropDuplicates(list(UPDATE_KEYS)), new)
        span = held.agg(F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n")).first()
        if span["n"]:
            for table in ("updates", "late"):
                stored = _stored(spark, out_dir, table, before=batch_id)
                if stored is not None:
                    near = F.col("ts").between(F.lit(span["a"]), F.lit(span["z"])) | F.col("ts").isNull()
                    held = _missing(held, stored.where(near))
            held.write.mode("overwrite").parquet(f"{out_dir}/late/batch_id={batch_id}")

    return _start(both, per_batch, checkpoint or f"{out_dir}/_checkpoint", available_now)


def _stored(spark: SparkSession, out_dir: str, table: str, before: int | None = None) -> DataFrame | None:
    """Rows of the batches stored so far, or None where there are none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{table}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(STATUS_SCHEMA + ", batch_id bigint").parquet(f"{out_dir}/{table}")
    return rows if before is None else rows.where(F.col("batch_id") < before)


def late_pr_updates(spark: SparkSession, out_dir: str) -> DataFrame:
    """Updates that came after the watermark had passed them, each once."""
    rows = _stored(spark, out_dir, "late")
    return spark.createDataFrame([], STATUS_SCHEMA) if rows is None else rows.drop("batch_id")


def current_pr_status(spark: SparkSession, out_dir: str) -> DataFrame:
    """W6 over all updates so far, late ones too."""
    return latest_status(_stored(spark, out_dir, "updates").drop("batch_id").unionByName(late_pr_updates(spark, out_dir)))
