"""Syntax-node job and range mapping: N1, N2, N3, J6, W4.

N1 parses each source file with Python's ``ast`` inside ``mapInPandas``
(files are independent, so the job scales by file; a parse error becomes a
``parse_status`` row, never a failed task).  Nodes come out flat, one row per
node in ``ast.walk`` (BFS) order with its parent's BFS id.

J6 is a range-containment join turned into an equi-join over pages of 1, 256 and
65,536 lines.  A node is filed under the pages of one size that its lines touch: of
1 line up to 16 lines, of 256 up to 4,096, of 65,536 beyond, so under at most 17
(a page for every 65,536 lines beyond that).  A page's nodes are one array (up to
2^16 BFS ids each); a finding asks three pages and takes the best node of each
array that spans its line and passes the lexicographic (line, col) tests, so at most
one row for each array leaves the join, however many nodes lie around a line.
"""

from __future__ import annotations

import sys

import ast
import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Worker-side code ships with the task (pickled by value), so Python workers
# need not import this package from their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE_SCHEMA = ("repo string, path string, bfs_id int, parent_id int, node_type string, "
               "line int, col int, end_line int, end_col int, fields string, "
               "success boolean, error_message string")
_NODE_COLS = ["repo", "path", "bfs_id", "parent_id", "node_type", "line", "col", "end_line", "end_col",
              "fields", "success", "error_message"]


def _scalar_fields(node: ast.AST) -> str | None:
    """Scalar field values of a node (names, identifiers, constants) as JSON."""
    out = {k: v for k, v in ast.iter_fields(node) if isinstance(v, (str, int, float, bool))}
    return json.dumps(out, ensure_ascii=False, default=str) if out else None


def _walk_rows(repo: str, path: str, source: str) -> list[tuple]:
    """One row per node in ast.walk order, or one failure row."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(repo, path, None, None, None, None, None, None, None, None, False, str(e))]
    rows = []
    todo: deque[tuple[ast.AST, int | None]] = deque([(tree, None)])
    i = 0
    while todo:
        node, parent = todo.popleft()
        for child in ast.iter_child_nodes(node):
            todo.append((child, i))
        rows.append((repo, path, i, parent, type(node).__name__,
                     getattr(node, "lineno", None), getattr(node, "col_offset", None),
                     getattr(node, "end_lineno", None), getattr(node, "end_col_offset", None),
                     _scalar_fields(node), True, None))
        i += 1
    return rows


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple] = []
        for repo, path, content in zip(pdf["repo"], pdf["path"], pdf["content"]):
            rows.extend(_walk_rows(repo, path, content or ""))
            if len(rows) >= 50_000:   # keep Arrow batches bounded for large files
                yield pd.DataFrame(rows, columns=_NODE_COLS).astype(
                    {c: "Int32" for c in ("bfs_id", "parent_id", "line", "col", "end_line", "end_col")})
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=_NODE_COLS).astype(
                {c: "Int32" for c in ("bfs_id", "parent_id", "line", "col", "end_line", "end_col")})


def parse_files(source_files: DataFrame) -> DataFrame:
    """Raw N1 output: node rows plus one failure row per unparsable file."""
    return source_files.select("repo", "path", "content").mapInPandas(_parse_batches, NODE_SCHEMA)


def extract_ast_nodes(source_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ast_nodes, parse_status).  Write ``parse_files`` output once (e.g. to
    the shared folder) when both tables are used, so files are parsed once."""
    nodes = parse_files(source_files).where(F.col("success")).drop("success", "error_message")
    return nodes, parse_status(source_files)


def _status_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        errors = []
        for content in pdf["content"]:
            try:
                ast.parse(content or "")
                errors.append(None)
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                errors.append(str(e))
        yield pd.DataFrame({"repo": pdf["repo"], "path": pdf["path"], "success": [e is None for e in errors],
                            "error_message": errors})


def parse_status(source_files: DataFrame) -> DataFrame:
    """One row per file, without its nodes."""
    return source_files.select("repo", "path", "content").mapInPandas(
        _status_batches, "repo string, path string, success boolean, error_message string")


def node_type_counts(nodes: DataFrame) -> DataFrame:
    """Inventory of node types per repo."""
    return nodes.groupBy("repo", "node_type").agg(F.count(F.lit(1)).alias("n_nodes"))


def _positioned(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("line").isNotNull() & F.col("col").isNotNull()).select(
        "repo", "path", "bfs_id", "node_type", "line", "col",
        F.coalesce("end_line", "line").alias("end_line"), F.coalesce("end_col", "col").alias("end_col"))


def _log2(x: Column) -> Column:
    """floor(log2(x)) of a whole number of 1 or more, exactly."""
    return (F.length(F.bin(x)) - 1).cast("int")


def line_blocks(first: Column, last: Column) -> Column:
    """The dyadic blocks that make up lines first..last (0 <= first <= last), as an
    array of (level, number); lines count from 1 here, so line 0 is place 1."""
    a, z = first.cast("long") + 1, last.cast("long") + 2

    def at_level(level):
        low = F.call_function("shiftright", a + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        high = F.call_function("shiftright", z, level)
        block = lambda n: F.struct(level.alias("level"), n.alias("number"))
        return F.concat(F.when((low < high) & (low % 2 == 1), F.array(block(low))).otherwise(F.array().cast("array<struct<level:int,number:bigint>>")),
                        F.when((low < high) & (high % 2 == 1), F.array(block(high - 1))).otherwise(F.array().cast("array<struct<level:int,number:bigint>>")))

    return F.flatten(F.transform(F.sequence(F.lit(0), _log2(z - a)), at_level))


def blocks_of_line(line: Column) -> Column:
    """The dyadic blocks that hold a line (0 or more), as an array of (level, number)."""
    at = line.cast("long") + 1
    return F.transform(F.sequence(F.lit(0), _log2(at)),
                       lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at, level).alias("number")))


# The plain form of the join, one row for each node and dyadic block; tests hold the pages against it.
def _by_block(nodes: DataFrame) -> DataFrame:
    """Positioned nodes, one row for each block of lines that they are filed under."""
    p = _positioned(nodes).where(F.col("line") >= 0)
    return p.withColumn("block", F.explode(line_blocks(F.col("line"), F.greatest("end_line", "line"))))


def _asking(points: DataFrame, line: str) -> DataFrame:
    """Points, one row for each block that holds their line (one with no block for lines below 0)."""
    return points.withColumn("asked", F.explode_outer(F.when(F.col(line) >= 0, blocks_of_line(F.col(line)))))


#: Pages of 2^bits lines: (bits, longest node in lines that is filed under them).
PAGES = ((0, 16), (8, 4096), (16, None))


def _page(line: Column, bits: int) -> Column:
    """The page of 2^bits lines that holds a line, as one number."""
    return F.shiftleft(F.shiftright(line.cast("long"), bits), 5) + bits


def _pages(nodes: DataFrame) -> DataFrame:
    """repo, path, page, nodes: the positioned nodes that touch a page, as arrays of at most 2^16 BFS ids."""
    p = _positioned(nodes).where(F.col("line") >= 0).withColumn("last", F.greatest("end_line", "line"))
    span = F.col("last").cast("long") - F.col("line") + 1
    filed = F.lit(None).cast("array<bigint>")
    for bits, longest in reversed(PAGES):
        touched = F.sequence(_page(F.col("line"), bits), _page(F.col("last"), bits), F.lit(32).cast("long"))
        filed = touched if longest is None else F.when(span <= longest, touched).otherwise(filed)
    node = F.struct("line", "last", "col", "end_line", "end_col", "bfs_id", "node_type", _place("line", F.col("col")).alias("from"), _place("end_line", F.col("end_col")).alias("to"))
    return (p.select("repo", "path", F.explode(filed).alias("page"), F.shiftright("bfs_id", 16).alias("_part"), node.alias("n"))
            .groupBy("repo", "path", "page", "_part").agg(F.collect_list("n").alias("nodes")).drop("_part"))


def _place(line: Column | str, col: Column) -> Column:
    """(line, col) as one number in the same order; columns are ints, or one beyond them at either end."""
    line = F.col(line) if isinstance(line, str) else line
    return F.shiftleft(line.cast("long"), 32) + col


def _best_nodes(points: DataFrame, line: str, nodes: DataFrame, tier, rank) -> DataFrame:
    """Points with ``best``, the least ``rank(tier, node)`` of the nodes on a page that span ``line``
    and have a ``tier(node)``.  Each point has a row for its page of one line and one for every other
    page where there is a best; ``best`` may be null in the first."""
    at, none = F.col(line), F.lit(None).cast("array<bigint>")
    asked = points.withColumn("_page", F.explode_outer(F.when(at >= 0, F.array(*[_page(at, bits) for bits, _ in PAGES])).otherwise(none)))
    # a hash of the whole key comes first, so that sorting seldom compares texts
    key = lambda page: F.xxhash64("repo", "path", page)
    j = asked.withColumn("_key", key("_page")).join(
        _pages(nodes).select(key("page").alias("_key"), "repo", "path", F.col("page").alias("_page"), "nodes"), ["_key", "repo", "path", "_page"], "left")
    spans = lambda n: (n["line"] <= at) & (at <= n["last"])
    tiers = F.transform("nodes", lambda n: F.struct(F.when(spans(n), tier(n)).alias("t"), n.alias("n")))
    best = F.array_min(F.transform(F.filter(tiers, lambda x: x["t"].isNotNull()), lambda x: rank(x["t"], x["n"])))
    first = F.col("_page").isNull() | (F.col("_page") % 32 == PAGES[0][0])
    # exploded, so that the filter below reads the best node instead of finding it again
    return j.select(*points.columns, "_page", F.explode(F.array(best)).alias("best")).where(first | F.col("best").isNotNull()).drop("_page")


def map_findings_to_nodes(findings: DataFrame, nodes: DataFrame,
                          keys: tuple[str, ...] = ("repo", "scan_id", "ordinal")) -> DataFrame:
    """J6 + W4: for each finding the minimal covering node.

    Finding range: (start_line, start_col) - (end_line, end_col); columns absent
    -> col 0, end col defaults to the start col.  Tiers: 1 nodes covering the
    whole range, 2 nodes covering its start, both by min (line_span, col_span)
    then BFS order; 3 first BFS node whose line range and, independently,
    column range contain the start; else no node (nulls)."""
    sc = F.col("start_col") if "start_col" in findings.columns else F.lit(0)
    ec_raw = F.col("end_col") if "end_col" in findings.columns else F.lit(0)
    f = findings.select(*keys, "path", "start_line",
                        F.coalesce("end_line", "start_line").alias("f_end_line"),
                        sc.alias("f_col"))
    f = f.withColumn("f_end_col", F.when(ec_raw == 0, F.greatest(F.col("f_col"), F.lit(0))).otherwise(ec_raw))
    # a null column lies before and after all others of its line, so only lines that differ decide
    low, high = F.lit(-2**31 - 1), F.lit(2**31)
    f = f.withColumns({"_after": _place("start_line", F.coalesce("f_col", low)), "_before": _place("start_line", F.coalesce("f_col", high)),
                       "_end": _place("f_end_line", F.coalesce("f_end_col", high))})

    def tier(n):
        starts = n["from"] <= F.col("_after")
        return (F.when(starts & (F.col("_end") <= n["to"]), F.lit(1)).when(starts & (F.col("_before") <= n["to"]), F.lit(2))
                .when((n["col"] <= F.col("f_col")) & (F.col("f_col") <= n["end_col"]), F.lit(3)))

    def rank(t, n):
        span = lambda a, z: F.when(t < 3, n[z] - n[a]).otherwise(F.lit(0))
        return F.struct(t.alias("tier"), span("line", "end_line").alias("ls"), span("col", "end_col").alias("cs"), n["bfs_id"].alias("bfs_id"), n.alias("n"))

    j = _best_nodes(f, "start_line", nodes, tier, rank)
    agg = (j.groupBy("repo", "path", "start_line", *[k for k in keys if k != "repo"])
           .agg(F.min("best").alias("m")))
    return agg.select(*keys, "path", "start_line", "m.tier", "m.bfs_id", "m.n.node_type",
                      F.col("m.n.line").alias("node_line"), F.col("m.n.col").alias("node_col"),
                      F.col("m.n.end_line").alias("node_end_line"), F.col("m.n.end_col").alias("node_end_col"))


def find_node_at(points: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ("repo", "scan_id", "ordinal")) -> DataFrame:
    """First BFS node whose line range and column range contain (line, col)."""
    p = points.select(*keys, "path", F.col("line").alias("p_line"), F.col("col").alias("p_col"))
    j = _best_nodes(p, "p_line", nodes,
                    lambda n: F.when((n["col"] <= F.col("p_col")) & (F.col("p_col") <= n["end_col"]), n["bfs_id"]),
                    lambda bfs_id, n: F.struct(bfs_id.alias("bfs_id"), n["node_type"].alias("node_type")))
    return (j.groupBy("repo", "path", "p_line", *[k for k in keys if k != "repo"])
            .agg(F.min("best").alias("m"))
            .select(*keys, "path", F.col("p_line").alias("line"), "m.bfs_id", "m.node_type"))
