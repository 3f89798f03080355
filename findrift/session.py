"""Session construction and shared-storage helpers.

Everything here reads configuration from the running session first; the
defaults only apply where a setting is unset (local tests and the bench).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a cluster deployment is expected to provide itself; applied only
# when absent so that a submitted job keeps the cluster's values.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "findrift") -> SparkSession:
    """Return the active session, or build a local one for tests and the bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("FINDRIFT_DRIVER_MEM", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set (HDFS/S3/ABFS path): a folder made here would
    be on one machine's disk, which the others don't see.  Only a session that
    runs in this one process (tests, bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="findrift-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


@contextmanager
def many_folders(spark: SparkSession) -> Iterator[None]:
    """Lists files below many folders in a few tasks for each core, instead of one
    task for each folder; wrap what lists them (``load`` and the like)."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared folder, for written intermediate tables
    and streaming checkpoints (never a machine-local folder on a cluster)."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


_SCRATCH_TABLES: list[str] = []


def scratch_table(name: str) -> str:
    """A unique name for an intermediate table that is stored at a scratch path
    (bucketed ones must be tables)."""
    _SCRATCH_TABLES.append(f"{name}_{uuid.uuid4().hex[:12]}")
    return _SCRATCH_TABLES[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables made so far; call it when the frames that
    read them have been written.  Returns how many were deleted."""
    while _SCRATCH_TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_SCRATCH_TABLES.pop()}")
    jvm, conf, n = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def materialize(df):
    """Cut lineage for a frame that several consumers read: a reliable
    checkpoint into the shared folder (never ``localCheckpoint``, which would
    not survive executor loss)."""
    from pyspark.sql import SparkSession as _S
    shared_dir(_S.getActiveSession() or df.sparkSession)
    return df.checkpoint(eager=True)
