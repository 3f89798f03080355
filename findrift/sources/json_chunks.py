"""Scanner documents of any size: results cut out of chunks of JSON text.

A document comes as rows (document keys, ``seq``, ``text``) whose texts, one
after the other, are the document; chunks may end anywhere, inside a string or
an escape as well.

1. Each chunk is summarised for each state it may start in (inside a string or
   not, after a backslash or not): the state and the change of depth at its
   end, and the depths at which it opens objects or lists.
2. The summaries of a document are composed from left to right (narrow rows, in
   one stream), which gives every chunk the state and depth it starts with, and
   the chunk in which a value that is still open was begun.
3. Each chunk is cut on its own: values below the depth of the document's
   outline (results, rule lists) become records, runs of neighbouring records
   become one placeholder in the outline.  Only the value that lies across the
   end of a chunk is put together from several.
4. The outline (small: a placeholder or two a chunk) is parsed as the document
   would be, and tells each record's run and position.

No row or task ever holds a document, only its chunks and records.  A document
whose outline or any of whose records is no JSON is broken as a whole, as it is
when it is parsed in one piece.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findrift.session import scratch_path

# Worker-side code ships with the task, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("scan_id", "repo", "tool", "part")
#: Characters of a chunk, when documents or files are cut here.
CHUNK_CHARS = 1_000_000
#: Rows of a listing (some 200 bytes each) that may be broadcast.
FEW_FILES = 50_000
#: Objects and lists of the outline: {"results": [...]} has 2, a bare list 1, {"runs": [{"results": [...]}]} 4.
NATIVE, SARIF = 2, 4

_QUOTE, _BACK, _COMMA = b'"\\,'


# --------------------------------------------------------------------------- chunks of texts and files
def chunked(raw: DataFrame, size: int = CHUNK_CHARS) -> DataFrame:
    """Whole documents (``text``) as chunks of ``size`` characters."""
    text = F.coalesce("text", F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length("_t") - 1, F.lit(0)), F.lit(size))
    return (raw.select(*KEYS, text.alias("_t")).select(*KEYS, "_t", F.posexplode(starts).alias("_i", "_s"))
            .select(*KEYS, F.col("_i").cast("long").alias("seq"), F.substring("_t", F.col("_s") + 1, F.lit(size)).alias("text")))


def listed_files(spark: SparkSession, path: str, repo: str | None = None) -> DataFrame:
    """file_path, length, scan_id, repo, part of the files under ``path``, whose contents aren't read."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
              .select(F.col("_metadata.file_path").alias("file_path"), "length"))
    names = F.split("file_path", "/")
    order = Window.partitionBy("repo", "scan_id").orderBy("file_path")
    return (listed.withColumn("scan_id", F.element_at(names, -2)).withColumn("repo", F.lit(repo) if repo else F.element_at(names, -3))
            .withColumn("part", (F.row_number().over(order) - 1).cast("long")))


def read_scan_chunks(spark: SparkSession, path: str, tool: str, repo: str | None = None, size: int = CHUNK_CHARS) -> DataFrame:
    """Scanner files laid out as <repo>/<scan_id>/<file> under ``path``, in chunks.

    Spark splits a file at any ``}``, so tasks read ranges of one file in
    parallel; rows of a range are put together to about ``size`` characters.
    ``part`` is the file's position among the scan's files by name; Spark lists
    no empty files.
    """
    files = listed_files(spark, path, repo)
    rows = (spark.read.options(lineSep="}", recursiveFileLookup=True).text(path)
            .select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("at"),
                    F.col("value").cast("binary").alias("value")))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n, made = None, [], 0, 0

        def row():
            text = b"".join(held)
            return pa.record_batch([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([made], pa.int64()),
                                    pa.array([len(text)], pa.int64()), pa.array([text.decode("utf-8", "replace")])],
                                   names=["file_path", "at", "made", "n_bytes", "text"])

        for b in batches:
            for f, at, value in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (f, at) != key or n >= size:
                    if held:
                        yield row()
                    made = made + 1 if (f, at) == key else 0
                    key, held, n = (f, at), [], 0
                held.append(value + b"}")
                n += len(value) + 1
        if held:
            yield row()

    pieces = rows.mapInArrow(build, "file_path string, at long, made long, n_bytes long, text string")
    stored = scratch_path(spark, "scan-chunks")
    pieces.write.parquet(stored)
    pieces = spark.read.parquet(stored)
    # the reader does not tell whether a file ends in the separator: its length does
    ends = pieces.groupBy("file_path").agg(F.sum("n_bytes").alias("read"), F.max(F.struct("at", "made")).alias("last"))
    got = pieces.join(files.join(ends, "file_path"), "file_path")
    extra = (F.col("read") > F.col("length")) & (F.struct("at", "made") == F.col("last"))
    return got.select("scan_id", "repo", F.lit(tool).alias("tool"), "part",
                      # a block has fewer chunks than bytes, so this is the order in the file
                      (F.col("at") + F.col("made")).alias("seq"),
                      F.when(extra, F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text")).alias("text"))


# --------------------------------------------------------------------------- structure of a chunk
class Structure:
    """Brackets of a chunk outside strings, for a start inside a string or not, after a backslash or not."""

    def __init__(self, raw: bytes):
        self.raw = raw
        data = np.frombuffer(raw, np.uint8)
        n = len(data)
        back = data == _BACK
        # length of the run of backslashes before each place
        at = np.arange(n + 1)
        reset = np.where(np.append(True, ~back), at, 0)
        run = at - np.maximum.accumulate(reset)
        self.lead = int(run[np.flatnonzero(~back)[0]]) if n and not back.all() else n  # backslashes at the start
        self.tail = int(run[n]) if n else 0
        self.quotes = np.flatnonzero((data == _QUOTE) & (run[:n] % 2 == 0))
        first = self.lead < n and data[self.lead] == _QUOTE
        self.flips = bool(first)  # whether that first character is a quote, which an escape before the chunk turns
        opens, closes = (data == ord("{")) | (data == ord("[")), (data == ord("}")) | (data == ord("]"))
        self.brackets = np.flatnonzero(opens | closes)
        self.steps = np.where(opens[self.brackets], 1, -1)

    def quoted(self, esc: int) -> np.ndarray:
        if not (esc and self.flips):
            return self.quotes
        return np.setxor1d(self.quotes, [self.lead])

    def outside(self, inside: int, esc: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and steps of the brackets outside strings; whether the end is inside one."""
        quotes = self.quoted(esc)
        mask = (np.searchsorted(quotes, self.brackets) + inside) % 2 == 0
        return self.brackets[mask], self.steps[mask], (len(quotes) + inside) % 2

    def end_esc(self, esc: int) -> int:
        return (self.tail + (esc if self.tail == len(self.raw) else 0)) % 2


def summary(raw: bytes) -> tuple[list[int], list[int], list[int], list[list[int]]]:
    """For each start (inside + 2 * esc): inside and escape at the end, change of depth, relative depths of openings."""
    s = Structure(raw)
    ends, escs, deltas, opens = [], [], [], []
    for start in range(4):
        _, steps, end = s.outside(start % 2, start // 2)
        depth = np.cumsum(steps)
        ends.append(int(end))
        escs.append(s.end_esc(start // 2))
        deltas.append(int(depth[-1]) if len(depth) else 0)
        opens.append(np.unique(depth[steps > 0] - 1).tolist())
    return ends, escs, deltas, opens


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [summary(t or b"") for t in b.column("text").to_pylist()]
        first = [(t or b"").lstrip(b" \t\r\n")[:1].decode("latin-1") for t in b.column("text").to_pylist()]
        yield pa.record_batch([*(b.column(k) for k in (*KEYS, "seq")), pa.array(first, pa.string()),
                               *(pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)),
                               pa.array([r[3] for r in rows], pa.list_(pa.list_(pa.int32())))],
                              names=[*KEYS, "seq", "first", "ends", "escs", "deltas", "opens"])


_KEY_TYPES = "scan_id string, repo string, tool string, part long"
_SUMMARY = f"{_KEY_TYPES}, seq long, first string, ends array<int>, escs array<int>, deltas array<int>, opens array<array<int>>"
_STATE = f"{_KEY_TYPES}, seq long, inside int, esc int, depth int, top int, bare boolean, owner long"


def _compose(outline: int):
    """Summaries sorted by document and seq -> the state each chunk starts with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, top, bare, inside, esc, depth, owner = None, outline, False, 0, 0, 0, None
        for b in batches:
            out = []
            cols = [b.column(k).to_pylist() for k in range(b.num_columns)]
            for *key, seq, first, ends, escs, deltas, opens in zip(*cols, strict=True):
                if key != doc:
                    doc, top, bare, inside, esc, depth, owner = key, None, False, 0, 0, 0, None
                if top is None and first:  # the first character tells the kind of document
                    bare = outline == NATIVE and first == "["
                    top = 1 if bare else outline
                out.append((*key, seq, inside, esc, depth, outline if top is None else top, bare, owner))
                start = inside + 2 * esc
                if top is not None and top - depth in opens[start]:
                    owner = seq
                inside, esc, depth = ends[start], escs[start], depth + deltas[start]
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else
                                  [pa.array([], t) for t in types],
                                  names=[*KEYS, "seq", "inside", "esc", "depth", "top", "bare", "owner"])
    return run


# --------------------------------------------------------------------------- cutting
WHOLE, PIECE, OUTLINE = 0, 1, 2


def cut_chunk(raw: bytes, seq: int, inside: int, esc: int, depth: int, top: int, owner: int | None) -> Iterator[tuple]:
    """(kind, run, k, owner, text) of a chunk: whole records, pieces of records that go
    beyond it, and its piece of the outline with placeholders {"@": seq, "run": run, "n": records}."""
    place, steps, _ = Structure(raw).outside(inside, esc)
    after = depth + np.cumsum(steps)
    starts = place[(steps > 0) & (after == top + 1)].tolist()
    ends = (place[(steps < 0) & (after == top)] + 1).tolist()
    text: list[bytes] = []
    at = 0
    if depth > top:  # goes on with a value begun in an earlier chunk
        at = ends.pop(0) if ends else len(raw)
        yield PIECE, None, None, owner, raw[:at]
    runs = n = 0
    for a, z in zip(starts, [*ends, None][:len(starts)], strict=True):
        between = raw[at:a]
        if n and between.strip(b" \t\r\n") == b",":
            n += 1
        else:
            if n:
                text.append(b'{"@":%d,"run":%d,"n":%d}' % (seq, runs, n))
                runs += 1
            text.append(between)
            n = 1
        at = len(raw) if z is None else z
        yield (PIECE, runs, n - 1, seq, raw[a:]) if z is None else (WHOLE, runs, n - 1, None, raw[a:z])
    if n:
        text.append(b'{"@":%d,"run":%d,"n":%d}' % (seq, runs, n))
    text.append(raw[at:])
    yield OUTLINE, None, None, None, b"".join(text)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [*(pa.string(),) * 3, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
    names = [*KEYS, "seq", "kind", "run", "k", "owner", "bare", "text"]
    for b in batches:
        for r in b.to_pylist():
            key = [r[k] for k in KEYS]
            rows = [(*key, r["seq"], kind, run, k, owner, r["bare"], text) for kind, run, k, owner, text in cut_chunk(
                r["text"] or b"", r["seq"], r["inside"], r["esc"], r["depth"], r["top"], r["owner"])]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _joined(rows: DataFrame, keys: list[str], *firsts: Column) -> DataFrame:
    """Pieces put together in the order of their chunks."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return rows.groupBy(*keys).agg(*firsts, F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def cut(chunks: DataFrame, outline: int) -> tuple[DataFrame, DataFrame]:
    """(records: keys, seq, run, k, text), (outlines: keys, bare, text), read from a stored table."""
    spark = chunks.sparkSession
    # stored, as they are read twice: for their summaries and to be cut
    kept = scratch_path(spark, "chunks")
    chunks.select(*KEYS, "seq", F.col("text").cast("binary").alias("text")).write.parquet(kept)
    binary = spark.read.parquet(kept)
    states = (binary.mapInArrow(_summaries, _SUMMARY).repartition(*KEYS).sortWithinPartitions(*KEYS, "seq")
              .mapInArrow(_compose(outline), _STATE))
    path = scratch_path(spark, "records")
    (binary.join(states, [*KEYS, "seq"])
     .mapInArrow(_cut, f"{_KEY_TYPES}, seq long, kind int, run int, k int, owner long, bare boolean, text binary")
     .withColumn("text", F.col("text").cast("string")).write.parquet(path))
    rows = spark.read.parquet(path)
    whole = rows.where(F.col("kind") == WHOLE).select(*KEYS, "seq", "run", "k", "text")
    across = _joined(rows.where(F.col("kind") == PIECE), [*KEYS, "owner"], F.max("run").alias("run"), F.max("k").alias("k"))
    outlines = _joined(rows.where(F.col("kind") == OUTLINE), list(KEYS), F.max("bare").alias("bare"))
    return whole.unionByName(across.select(*KEYS, F.col("owner").alias("seq"), "run", "k", "text")), outlines


# --------------------------------------------------------------------------- results
def _parsed_outline(records: DataFrame, outlines: DataFrame, schema: str) -> DataFrame:
    """Outlines as ``doc``, with ``broken`` for those that are no JSON or have a record that is none."""
    text = F.when(F.col("bare"), F.concat(F.lit('{"results":'), "text", F.lit("}"))).otherwise(F.col("text"))
    doc = F.from_json(text, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = records.where(F.try_parse_json("text").isNull()).select(*KEYS).distinct().withColumn("_no", F.lit(True))
    parsed = outlines.select(*KEYS, F.explode(F.array(doc)).alias("doc")).join(bad, list(KEYS), "left")
    return parsed.withColumn("broken", F.col("doc").isNull() | F.col("doc._bad").isNotNull() | F.col("_no").isNotNull()).drop("_no")


def _get(v: str, path: str, typ: str) -> Column:
    return F.try_variant_get(F.col(v), path, typ)


def _positions(elements: DataFrame, group: list[str]) -> DataFrame:
    """Elements of a list in the outline (``i``, ``e``) with the position ``base`` of the first
    record each stands for; a placeholder stands for ``n`` records of ``run``, others for themselves."""
    e = elements.withColumns({"seq": _get("e", "$['@']", "long"), "run": _get("e", "$.run", "int")})
    e = e.withColumn("n", F.when(F.col("run").isNotNull(), _get("e", "$.n", "long")).otherwise(F.lit(1)))
    before = Window.partitionBy(*group).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))


def _with_records(elements: DataFrame, records: DataFrame, value: Column, extra: list[str]) -> DataFrame:
    """One row a result: keys, extra columns, pos, and ``value`` of its record ``r``."""
    plain = elements.where(F.col("run").isNull()).withColumnRenamed("e", "r").select(
        *KEYS, *extra, F.col("base").cast("int").alias("pos"), value.alias("v"))
    told = (records.select(*KEYS, "seq", "run", "k", F.try_parse_json("text").alias("r")).select(*KEYS, "seq", "run", "k", value.alias("v"))
            .join(elements.where(F.col("run").isNotNull()).select(*KEYS, *extra, "seq", "run", "base"), [*KEYS, "seq", "run"])
            .select(*KEYS, *extra, (F.col("base") + F.col("k")).cast("int").alias("pos"), "v"))
    return plain.unionByName(told)


def native_results(chunks: DataFrame, error: str) -> DataFrame:
    """As ``scans.native_results``: keys, doc_error, pos, r."""
    records, outlines = cut(chunks, NATIVE)
    docs = _parsed_outline(records, outlines, "results array<variant>")
    good = docs.where(~F.col("broken")).select(*KEYS, F.posexplode("doc.results").alias("i", "e"))
    results = _with_records(_positions(good, list(KEYS)), records, F.col("r"), [])
    broken = docs.where("broken").select(*KEYS, F.lit(error).alias("doc_error"), F.lit(None).cast("int").alias("pos"))
    return (results.select(*KEYS, F.lit(None).cast("string").alias("doc_error"), "pos", F.col("v").alias("r"))
            .unionByName(broken, allowMissingColumns=True))


def sarif(chunks: DataFrame, result: Column, rule: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results: keys, run_pos, pos, v), (rules: keys, run_pos, rule_pos, rule), (broken documents: keys).

    ``result`` is evaluated on each result ``r``, ``rule`` on each rule ``x``; texts of records move no further.
    """
    records, outlines = cut(chunks, SARIF)
    docs = _parsed_outline(records, outlines, "runs array<struct<tool: variant, results: array<variant>>>")
    runs = docs.where(~F.col("broken")).select(*KEYS, F.posexplode("doc.runs").alias("run_pos", "run_"))
    elements = runs.select(*KEYS, "run_pos", F.posexplode("run_.results").alias("i", "e"))
    results = _with_records(_positions(elements, [*KEYS, "run_pos"]), records, result, ["run_pos"])
    drivers = runs.select(*KEYS, "run_pos", F.try_variant_get("run_.tool", "$.driver['@']", "long").alias("seq"),
                          F.try_variant_get("run_.tool", "$.driver.run", "int").alias("run")).where(F.col("run").isNotNull())
    told = records.where(F.col("k") == 0).join(drivers, [*KEYS, "seq", "run"])
    lists = told.select(*KEYS, "run_pos", F.try_variant_get(F.try_parse_json("text"), "$.rules", "array<variant>").alias("rules"))
    rules = lists.select(*KEYS, "run_pos", F.posexplode("rules").alias("rule_pos", "x")).select(*KEYS, "run_pos", "rule_pos", rule.alias("rule"))
    return results, rules, docs.where("broken").select(*KEYS)
