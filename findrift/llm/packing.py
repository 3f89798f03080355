"""Best-fit packing with large-item matching.

Documents become pieces of at most ``capacity`` tokens.  Pieces longer than a
third of the capacity go at most two to a sequence: greedily, the longest with
the longest that still fits beside it.  Shorter pieces, longest first, go where
the remaining gap is tightest.

Which sequence a piece goes to depends on its length and on its number among
the pieces of that length alone, so the plan is made from the histogram of
lengths (at most ``capacity`` rows, whatever the input) as runs of like
sequences, and every piece finds its place in the plan by arithmetic.

Defined cases: null and empty texts give one piece that holds the end id only;
null ids and repeated rows are pieces like any other; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.llm.encoding import Encoder, slices
from findrift.llm.numbering import numbered
from findrift.session import scratch_path

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: tuple[str, ...], capacity: int, end_id: int = 0,
           id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents; only longer ones are cut, the first piece taking the rest."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*vocabulary)
        for batch in batches:
            for texts, ids in slices(batch.column(1), batch.column(0).to_pylist()):
                out = []
                for doc, blob in zip(ids, encoder.encode(texts), strict=True):
                    blob += end
                    n, at, k = len(blob) // 4, 0, 0
                    size = (n - 1) % capacity + 1
                    while at < n:
                        out.append((doc, k, at, size, zlib.crc32(memoryview(blob)[4 * at:4 * (at + size)])))
                        at, k, size = at + size, k + 1, capacity
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, _PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, pieces per sequence, first sequence, offset).

    A run ends where the next of its length begins; within it, each sequence
    takes that many consecutive numbers.  Its size depends on the number of
    distinct lengths, not on how many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first sequence, sequences)
    made = 0

    def place(length: int, first: int, bins: int, each: int, gap: int) -> None:
        runs.append((length, used[length], each, first, capacity - gap))
        used[length] += bins * each
        left[length] -= bins * each
        gaps[gap - each * length].append((first, bins))

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        partners = iter([p for p in large if p <= min(n, capacity - n)])
        partner = next(partners, None)
        while left[n]:
            while partner is not None and left[partner] < (2 if partner == n else 1):
                partner = next(partners, None)
            bins = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
            first, made = made, made + bins
            if partner == n:
                place(n, first, bins, 2, capacity)
            else:
                place(n, first, bins, 1, capacity)
                if partner is not None:
                    gaps[capacity - n].pop()
                    place(partner, first, bins, 1, capacity - n)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in range(n, capacity + 1):
            fit = gap // n
            while left[n] and gaps[gap]:
                first, bins = gaps[gap].pop()
                full = min(bins, left[n] // fit)
                if full:
                    place(n, first, full, fit, gap)
                    first, bins = first + full, bins - full
                if bins and left[n]:
                    place(n, first, 1, left[n], gap)
                    first, bins = first + 1, bins - 1
                if bins:
                    gaps[gap].append((first, bins))
        if left[n]:
            fit = capacity // n
            full, rest = divmod(left[n], fit)
            if full:
                place(n, made, full, fit, capacity)
            if rest:
                place(n, made + full, 1, rest, capacity)
            made += full + bool(rest)
    return runs


def pack(docs: DataFrame, vocabulary: tuple[str, ...], capacity: int = 2048, end_id: int = 0,
         id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")  # encoded once, read for the histogram and for the numbers
    pieces(docs, vocabulary, capacity, end_id, id_col, text).write.parquet(path)
    cut = spark.read.parquet(path)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan(counts, capacity)) or [(0, 0, 1, 0, 0)], np.int64)
    keys, (_, firsts, each, seqs, offsets) = (runs[:, 0] << 44) + runs[:, 1], runs.T

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = (b.column(c).to_numpy() for c in ("length", "number"))
            run = np.searchsorted(keys, (length << 44) + number, side="right") - 1
            seq, nth = np.divmod(number - firsts[run], each[run])
            yield pa.record_batch([*b.columns[:5], pa.array(seqs[run] + seq), pa.array(offsets[run] + nth * length)],
                                  [*b.schema.names[:5], "sequence_id", "offset"])

    return (numbered(cut, "length", "number")
            .select("doc_id", "piece", "start", "length", "ids_crc32", "number")
            .mapInArrow(place, _PIECES + ", sequence_id long, offset long"))
