"""Alignment of two tokenizers' tokens by galloping intersection of their ends.

Both tokenizers cut the same bytes; the byte offsets where their tokens end are
two increasing lists.  The shorter list of a text drives: from the place of the
element before it, each element probes the longer list in doubling steps and
ends with a binary search in the last step.  Equal ends cut the tokens into
groups, and the differences of the places found are the ranges of tokens that
overlap.  Numpy runs the searches of many texts in lockstep: every 2^k-th
element starts from the one 2^k before it, whose place is known by then.

Pairs of ids are counted over the corpus: chunks of texts count their different
pairs, Spark adds them up, and each chunk gets the counts of its own pairs
back.  A pair that occurs everywhere is one row for each chunk.

Defined cases: null and empty texts, and texts whose tokens' joined bytes are
not the blank and the text (for one tokenizer U+2581 is a blank), have no
tokens: zeros and ''; strings of special tokens are ordinary text; rows with
equal or null ids count each; long texts are aligned piece by piece, cut where
tokens of both end; an empty table gives an empty result; other columns do not
matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.llm.encoding import SEGMENT_CHARS, Encoder, segments
from findrift.session import scratch_path

#: Characters tokenized at a time, and those of a chunk (one text at least).
PART_CHARS, CHUNK_CHARS = 2_000_000, 8_000_000

_CHUNK = ("chunk long, ids array<long>, sizes binary, hashes array<string>, links binary, "
          "pairs array<long>, times array<long>")
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# --------------------------------------------------------------------------- search
def _search(x: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """First place from ``start`` on where ``ends`` (closed by a greatest number) reaches x."""
    low, high = start.copy(), start.copy()
    todo, step, last = np.arange(len(x)), 1, len(ends) - 1
    while len(todo):
        probe = np.minimum(start[todo] + (step - 1), last)
        less = ends[probe] < x[todo]
        high[todo[~less]] = probe[~less]
        todo = todo[less]
        low[todo] = probe[less] + 1
        step *= 2
    todo = np.flatnonzero(low < high)
    while len(todo):
        mid = (low[todo] + high[todo]) >> 1
        less = ends[mid] < x[todo]
        low[todo[less]] = mid[less] + 1
        high[todo[~less]] = mid[~less]
        todo = todo[low[todo] < high[todo]]
    return low


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each element of ``short`` the first place in ``long`` that is not less (both increase)."""
    n = len(short)
    at = np.zeros(n, np.int64)
    if n:
        closed = np.append(long, np.iinfo(np.int64).max)
        at[:1] = _search(short[:1], closed, at[:1])
        stride = 1 << (n - 1).bit_length()
        while stride:
            lanes = np.arange(stride, n, 2 * stride)
            at[lanes] = _search(short[lanes], closed, at[lanes - stride])
            stride >>= 1
    return at


class Aligned:
    """Links and groups of two lists of tokens over the same bytes, by their ends."""

    def __init__(self, a_ends: np.ndarray, b_ends: np.ndarray):
        swap = len(b_ends) < len(a_ends)
        short, long = (b_ends, a_ends) if swap else (a_ends, b_ends)
        at = gallop(short, long)
        equal = long[at] == short if len(short) else np.zeros(0, bool)
        in_long = np.zeros(len(long), bool)
        in_long[at[equal]] = True
        first = np.zeros(len(short), np.int64)
        first[1:] = at[:-1] + equal[:-1]
        n = at - first + 1
        one = np.repeat(np.arange(len(short)), n)
        other = np.arange(len(one)) + np.repeat(first - (np.cumsum(n) - n), n)
        self.a, self.b = (other, one) if swap else (one, other)  # linked places
        self.a_common, self.b_common = (in_long, equal) if swap else (equal, in_long)


# --------------------------------------------------------------------------- tokens
def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


class Pair:
    """The two tokenizers: ids and bytes of pieces of texts, and how groups are written."""

    def __init__(self, ranks: str, pattern: str, tokenizer_file: str, pieces: str):
        import sentencepiece
        self.one = Encoder(ranks, pattern, tokenizer_file, plain=True)
        self.two = sentencepiece.SentencePieceProcessor(model_file=pieces)
        a = [b""] * (max(self.one.ranks.values()) + 1)
        for token, rank in self.one.ranks.items():
            a[rank] = token
        b = [piece_bytes(self.two.id_to_piece(i), self.two.is_byte(i)) for i in range(self.two.get_piece_size())]
        self.a_bytes, self.b_bytes = a, b
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (a, b))
        # ids with what follows them: , or | after one of A; , or ; or nothing after one of B
        self.words = [f"{i}{sep}" for v, seps in ((a, ",|"), (b, (",", ";", ""))) for sep in seps for i in range(len(v))]

    def encode(self, pieces: list[tuple[bool, str]]) -> tuple[list, list]:
        """(starts its text, piece) -> ids of each piece by either tokenizer."""
        one = [self.one.ids(" " + t if first else t) for first, t in pieces]
        # this tokenizer puts a blank before each piece itself
        two = self.two.encode([t if first else t[1:] for first, t in pieces], num_threads=1)
        return one, two


def align(pair: Pair, pieces: list[tuple[bool, str]]) -> list[tuple | None]:
    """For each piece (n_a, n_b, n_groups, written groups, linked pairs of ids), or None where bytes differ."""
    out: list[tuple | None] = [None] * len(pieces)
    one, two = pair.encode(pieces)
    good: dict[bool, list[int]] = {False: [], True: []}
    for i, ((first, t), a, b) in enumerate(zip(pieces, one, two, strict=True)):
        raw = (" " + t if first else t).encode()
        if b"".join(map(pair.a_bytes.__getitem__, a)) == raw == b"".join(map(pair.b_bytes.__getitem__, b)):
            good[len(b) < len(a)].append(i)
    v_a, v_b = len(pair.a_bytes), len(pair.b_bytes)
    for which in good.values():  # the shorter list drives: texts where it is A's, and those where it is B's
        if not which:
            continue
        n_a, n_b = (np.array([len(x[i]) for i in which]) for x in (one, two))
        a, b = (np.fromiter(chain.from_iterable(x[i] for i in which), np.int64, n.sum()) for x, n in ((one, n_a), (two, n_b)))
        got = Aligned(np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b]))  # the texts end to end
        close_a, close_b = np.flatnonzero(got.a_common) + 1, np.flatnonzero(got.b_common) + 1
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        # groups are written A's tokens first; what follows a token tells where its group and its text end
        code = np.empty(len(a) + len(b), np.int64)
        of_a = np.cumsum(got.a_common) - got.a_common
        of_b = np.cumsum(got.b_common) - got.b_common
        code[np.arange(len(a)) + np.append(0, close_b)[of_a]] = a + v_a * got.a_common
        after = got.b_common.astype(np.int64)
        after[end_b - 1] = 2
        code[np.arange(len(b)) + close_a[of_b]] = b + 2 * v_a + v_b * after
        groups = np.diff(np.searchsorted(close_a, end_a, side="right"), prepend=0)
        ids = (a[got.a] << 32) | b[got.b]
        cut = np.searchsorted(got.a, end_a)
        written, spans = code.tolist(), np.append(0, end_a + end_b).tolist()
        for k, i in enumerate(which):
            text = "".join(map(pair.words.__getitem__, written[spans[k]:spans[k + 1]]))
            out[i] = (int(n_a[k]), int(n_b[k]), int(groups[k]), text, ids[cut[k - 1] if k else 0:cut[k]])
    return out


# --------------------------------------------------------------------------- chunks
class _Chunk:
    def __init__(self):
        self.ids, self.sizes, self.hashes, self.links, self.chars = [], [], [], [], 0

    def row(self, number: int) -> pa.RecordBatch:
        pairs, local, times = np.unique(np.concatenate([np.empty(0, np.int64), *chain.from_iterable(self.links)]),
                                        return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")  # frequent pairs get small numbers, which compress well
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        cols = [pa.array([number], pa.int64()), pa.array([self.ids], pa.list_(pa.int64())),
                pa.array([np.array(self.sizes, "<i8").tobytes()], pa.binary()), pa.array([self.hashes], pa.list_(pa.string())),
                pa.array([zstandard.compress(rank[local].astype("<u4").tobytes(), 1)], pa.binary()),
                pa.array([pairs[order]], pa.list_(pa.int64())), pa.array([times[order]], pa.list_(pa.int64()))]
        return pa.record_batch(cols, ["chunk", "ids", "sizes", "hashes", "links", "pairs", "times"])


def _chunks(docs: DataFrame, vocabularies: tuple[str, ...], segment: int, chunk_chars: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, made = TaskContext.get().partitionId(), 0
        pair = Pair(*vocabularies)
        chunk, held, size = _Chunk(), [], 0

        def flush():
            for (key, last, _), got in zip(held, align(pair, [h[2] for h in held]), strict=True):
                add(key, last, got)
            held.clear()

        open_ = []  # results of the pieces of the text that is being read

        def add(key, last, got):
            open_.append(got)
            if not last:
                return
            whole = [] if any(g is None for g in open_) else open_
            digest = hashlib.sha256()
            for k, g in enumerate(whole):
                digest.update((";" if k else "").encode() + g[3].encode())
            links = [g[4] for g in whole]
            chunk.ids.append(key)
            chunk.sizes.append([*(sum(g[k] for g in whole) for k in range(3)), sum(map(len, links))])
            chunk.hashes.append(digest.hexdigest() if whole else "")
            chunk.links.append(links)
            open_.clear()

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = key.as_py(), text.as_py() or ""
                chunk.chars += len(text)
                if not text or "▁" in text:
                    flush()
                    add(key, True, None)
                else:
                    cut = list(segments(text, segment))
                    for k, s in enumerate(cut):
                        held.append((key, k == len(cut) - 1, (k == 0, s)))
                        size += len(s)
                        if size >= PART_CHARS:
                            flush()
                            size = 0
                if chunk.chars >= chunk_chars:
                    flush()
                    yield chunk.row((part << 32) + made)
                    chunk, size, made = _Chunk(), 0, made + 1
        flush()
        if chunk.ids:
            yield chunk.row((part << 32) + made)

    return docs.mapInArrow(build, _CHUNK)


def _sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Results of a chunk's texts from the counts of its pairs."""
    place = right.column("pos").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place] = right.column("c").to_numpy()
    best[place] = right.column("best").to_numpy()
    out = []
    for r in left.to_pylist():
        link = np.frombuffer(zstandard.decompress(r["links"]), "<u4")
        n = np.frombuffer(r["sizes"], "<i8").reshape(-1, 4)
        ends = np.cumsum(n[:, 3])

        def total(x, ends=ends, link=link):
            run = np.append(0, np.cumsum(x[link]))
            return pa.array(np.diff(run[ends], prepend=0), pa.int64())

        out.append(pa.table([pa.array(r["ids"], pa.int64()), *(pa.array(n[:, k]) for k in range(4)), total(best), total(count),
                             pa.array(r["hashes"], pa.string())],
                            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(out)


def align_documents(docs: DataFrame, vocabularies: tuple[str, str, str, str], id_col: str = "doc_id", text_col: str = "text",
                    segment: int = SEGMENT_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``vocabularies``: the byte-level vocabulary's file of ranks, its pattern and
    its ``tokenizers`` file, and the piece model's file.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    _chunks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")),
            vocabularies, segment, chunk_chars).write.parquet(path)
    chunks = spark.read.parquet(path)
    pairs = (chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "times")).alias("pos", "x"))
             .select("chunk", "pos", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n")))
    path = scratch_path(spark, "pairs")
    pairs.groupBy("pair").agg(F.sum("n").alias("c")).write.parquet(path)
    counts = spark.read.parquet(path).withColumn("b", F.col("pair").bitwiseAND(0xFFFF_FFFF))
    # one row for each id of the second vocabulary at most, so it may be broadcast
    tops = counts.groupBy("b").agg(F.max("c").alias("top"))
    counts = counts.join(F.broadcast(tops), "b").select("pair", "c", (F.col("c") == F.col("top")).cast("int").alias("best"))
    told = pairs.select(F.col("chunk").alias("of"), "pos", "pair").join(counts, "pair").select("of", "pos", "c", "best")
    return (chunks.select("chunk", "ids", "sizes", "hashes", "links").groupBy("chunk")
            .cogroup(told.groupBy("of")).applyInArrow(_sums, _RESULT))
