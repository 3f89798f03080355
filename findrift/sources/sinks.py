"""Sinks: K1 findings, K2 context XML (see operators.context), K3 per-file texts, K4 logs.

The reference writes one file per finding path and rewrites one log file per
change; here every sink is a partitioned table written by Spark, appends are
plain appends, and "replace" is an overwrite of the affected partitions only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.operators.context import write_context_xml  # noqa: F401  (K2)
from findrift.sources.tree import arrow_uri

# Worker-side code ships with the task, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters that Spark escapes in the names of partition folders, and its name for null or ''.
_ESCAPED, _NO_VALUE = {*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"}, "__HIVE_DEFAULT_PARTITION__"


def folder_of(keys: Sequence[str], values: Sequence[str | None]) -> str:
    """The folder ``k=v/k=v`` of a partition, named as Spark's writers name it."""
    name = lambda v: "".join(f"%{ord(c):02X}" if c in _ESCAPED else c for c in v) if v else _NO_VALUE
    return "/".join(f"{name(k)}={name(v)}" for k, v in zip(keys, values, strict=True))


def write_text_per_key(df: DataFrame, keys: Sequence[str], text_col: str, path: str) -> int:
    """How many files it wrote: one text file for each value of ``keys``, in folders k=v/ as ``partitionBy(keys).text``
    lays them out (rows of a key in one file, a line break after each).

    Made for very many small files: tasks write them directly to their places
    (complete files only, so that a task run again replaces its own), and nothing
    is left to rename or set for each file at the end.  A store that Arrow does
    not know is written to by Spark's writer."""
    spark, keys = df.sparkSession, list(keys)
    # '' has the folder of null
    rows = df.select(*[F.nullif(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], F.col(text_col).cast("string").alias("_text"))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)
    uri = arrow_uri(spark, path)
    try:
        store, root = pafs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        rows.write.partitionBy(*keys).text(path)
        return rows.select(*keys).distinct().count()

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(uri)
        folder, key, out, n = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{folder}/.part-00000.txt", f"{folder}/part-00000.txt")

        for b in batches:
            for *now, text in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                if out is None or now != key:
                    close()
                    folder, key, n = f"{root}/{folder_of(keys, now)}", now, n + 1
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/.part-00000.txt", buffer_size=1 << 16)
                out.write((text or "").encode() + b"\n")
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    return rows.sortWithinPartitions(*keys).mapInArrow(save, "n long").agg(F.sum("n")).first()[0] or 0


def write_findings(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """K1: findings partitioned by repo (JSON lines or Parquet); one row per
    finding or per merged file replaces the reference's file per path."""
    df.write.mode(mode).partitionBy("repo").format(fmt).save(path)


def write_text_per_file(df: DataFrame, text_col: str, path: str, kind: str) -> None:
    """K3: responses, parsed code, diffs or annotated sources as a (repo, scan_id,
    path, kind, text) table partitioned by repo and kind."""
    (df.select("repo", "scan_id", "path", F.lit(kind).alias("kind"), F.col(text_col).alias("text"))
     .write.mode("append").partitionBy("repo", "kind").parquet(path))


def append_log(df: DataFrame, path: str) -> None:
    """K4: append log rows (PR or repo log); never rewrites existing rows."""
    df.write.mode("append").parquet(path)


def replace_log(df: DataFrame, path: str) -> None:
    """K4: replace the whole store (the reference's PUT of the log file)."""
    df.write.mode("overwrite").parquet(path)


def reset_log(spark, path: str, schema: str) -> None:
    """K4: empty store with the given schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
