"""Very many small files below a folder, read without a list of them in the driver.

Spark's file sources keep the status of every file in the driver, whose memory
then grows with the number of files.  Here tasks list the folders, one level of
the tree after the other, into a stored table of names, and tasks read the files
that it names.  The entries of a single folder are listed by one task.
"""

from __future__ import annotations

import fnmatch
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.session import many_folders, scratch_path

# Worker-side code ships with the task, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of files that one task reads, and that one batch of rows holds.
TASK_BYTES, BATCH_BYTES = 64_000_000, 8_000_000
_LISTED = "rel string, length long"


def arrow_uri(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme, as Arrow's file systems take it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toUri().toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    odd = name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)
    return odd and not name.startswith(("_common_metadata", "_metadata"))


def _matcher(glob: str) -> re.Pattern:
    """A file name pattern with ``*``, ``?``, ``[...]`` and one ``{a,b}``, as the readers' pathGlobFilter."""
    head, brace, rest = glob.partition("{")
    inner, _, tail = rest.partition("}")
    every = [head + x + tail for x in inner.split(",")] if brace else [glob]
    return re.compile("|".join(f"(?:{fnmatch.translate(x.replace('[^', '[!'))})" for x in every))


def _quoted(rel: str) -> str:
    """A path as it stands in a URI: as ``_metadata.file_path`` has it."""
    plain = lambda c: (c.isalnum() or c in "_-!.~'()*,;:$&+=@/") if c < "\x80" else unicodedata.category(c) not in ("Zs", "Zl", "Zp", "Cc")
    return "".join(c if plain(c) else "".join(f"%{b:02X}" for b in c.encode()) for c in rel)


def _list_folders(uri: str, glob: str):
    """Folders (paths below ``uri``) -> their files with a length, their folders with none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(uri)
        wanted = _matcher(glob)
        for b in batches:
            for rel in b.column(0).to_pylist():
                rows = []
                for x in store.get_file_info(pafs.FileSelector(f"{top}/{rel}".rstrip("/"))):
                    at = f"{rel}/{x.base_name}".lstrip("/")
                    if _hidden(x.base_name):
                        continue
                    if x.type == pafs.FileType.Directory:
                        rows.append((at, None))
                    elif x.type == pafs.FileType.File and x.size and wanted.match(x.base_name):  # Spark reads no empty files
                        rows.append((at, x.size))
                for i in range(0, len(rows), 10_000):
                    names, lengths = zip(*rows[i:i + 10_000], strict=True)
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array(lengths, pa.int64())], names=["rel", "length"])
    return run


def _read_files(uri: str, shown: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(uri)

        def rows(held):
            return pa.record_batch([pa.array([x[0] for x in held], pa.string()), pa.array([f"{shown}/{_quoted(x[0])}" for x in held], pa.string()),
                                    pa.array([x[1] for x in held], pa.binary())], names=["rel", "file_path", "content"])

        held, n = [], 0
        for b in batches:
            for rel in b.column(0).to_pylist():
                with store.open_input_file(f"{top}/{rel}") as f:
                    held.append((rel, f.read()))
                n += len(held[-1][1])
                if n >= BATCH_BYTES or len(held) >= 1_000:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)
    return run


def _listing(spark: SparkSession, uri: str, glob: str) -> DataFrame:
    """rel, length of the files below ``uri``: a round of tasks for each level of folders."""
    base, level = scratch_path(spark, "listing"), 0
    folders = spark.range(1).select(F.lit("").alias("rel"))
    stored = lambda at: spark.read.schema(_LISTED).option("recursiveFileLookup", True).parquet(at)
    while level == 0 or not folders.isEmpty():
        (folders.repartition(4 * spark.sparkContext.defaultParallelism, "rel").mapInArrow(_list_folders(uri, glob), _LISTED)
         .write.parquet(f"{base}/level={level}"))
        folders = stored(f"{base}/level={level}").where(F.col("length").isNull()).select("rel")
        level += 1
    return stored(base).where(F.col("length").isNotNull())


def read_small_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """rel (path below ``root``), file_path (as ``_metadata.file_path``), content (binary) of the files below
    ``root`` whose names fit ``glob``.  The listing runs at once, the files are read when the rows are.

    A store that Arrow does not know, a root that is no folder, and one with a
    pattern in it are left to Spark's reader."""
    uri = arrow_uri(spark, root)
    try:
        store, top = pafs.FileSystem.from_uri(uri)
        known = not set("*?[{") & set(root) and store.get_file_info(top).type == pafs.FileType.Directory
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        known = False
    if not known:
        with many_folders(spark):
            df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
                  .select("path", F.col("_metadata.file_path").alias("file_path"), "content"))
        below = "^.*?" + "".join(c if c.isalnum() or c in "/_-" else f"\\x{{{ord(c):x}}}" for c in root.rstrip("/").split("://")[-1]) + "/"
        return df.select(F.regexp_replace("path", below, "").alias("rel"), "file_path", "content")
    files = _listing(spark, uri, glob)
    size = files.agg(F.sum("length")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    shown = re.sub("^file:/+", "file:/", uri).rstrip("/")  # as Spark's listing has it
    return files.select("rel").repartition(n, "rel").mapInArrow(_read_files(uri, shown), "rel string, file_path string, content binary")
