"""Removal of repeated byte strings by suffix arrays of shards.

A byte goes if a string of WINDOW bytes that covers it also starts elsewhere.

* Anchors.  Each window of WINDOW bytes names the least hash among its strings
  of ANCHOR bytes.  Equal windows name the same anchor, so windows whose anchor
  occurs once in all texts can't be repeated.  Neighbouring windows that name
  one anchor are a strip; strips of anchors met more than once go on, and equal
  strips are counted as one before they are dealt out.
* Shards.  Strips are dealt to shards by their anchor, so that equal windows
  meet.  A shard sorts all its suffixes by Larsson and Sadakane's refinement
  (by 8 bytes first, then by doubling, only in groups that are still tied),
  and Kasai's scan gives the common prefixes of neighbours, in many places of
  the shard in lockstep.  Neighbours that share WINDOW bytes are repeated.
* Merging.  An anchor with more strips than a shard takes is dealt over several.
  Their sorted lists of different windows (as 128-bit fingerprints) are cut at
  fixed bounds, and for each range one list after the other is searched in the
  merged ones by binary search and inserted.

Equal texts are handled once: a text that occurs twice is repeated as a whole.

Defined cases: null is an empty text; texts below WINDOW bytes lose nothing but
take part in no match either; rows count each, so a row that is there twice is
repeated; ids may be null or equal; an empty table gives an empty result; other
columns do not matter.  A text is held whole in memory, as it is in its row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findrift.session import scratch_path

#: Bytes of a repeated string (2 at least), and of the strings whose hashes name anchors.
WINDOW, ANCHOR = 200, 64
#: Bytes of texts hashed at a time, windows of a strip at most, bytes of a shard, bytes of texts in a bucket.
SLICE_BYTES, STRIP, SHARD_BYTES, BUCKET_BYTES = 3_000_000, 4096, 4_000_000, 64_000_000
#: Fingerprints in a range of the merging.
RANGE = 1_000_000

U = np.uint64
_rng = np.random.default_rng(13)
_BYTE = _rng.integers(0, 1 << 63, (2, 256), dtype=U) * U(2) + U(1)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOW = U((1 << 24) - 1)


def rolling(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on (those at the end are of no use)."""
    step, total, done, n = _BYTE[which][data], None, 0, len(data)
    power, length, base = _BASE[which], 1, _BASE[which]
    while True:
        if size & length:
            if total is None:
                total = step.copy()
            else:
                total[:max(n - done, 0)] = total[:max(n - done, 0)] * U(pow(base, length, 1 << 64)) + step[done:]
            done += length
        if length * 2 > size:
            return total
        step[:max(n - length, 0)] = step[:max(n - length, 0)] * U(power) + step[length:]
        power, length = power * power % (1 << 64), length * 2


def least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the ``width`` values from each place on, in place."""
    n, s = len(x), 1
    while s * 2 <= width:
        np.minimum(x[:max(n - s, 0)], x[s:], out=x[:max(n - s, 0)])
        s *= 2
    if width > s:
        s = width - s
        np.minimum(x[:max(n - s, 0)], x[s:], out=x[:max(n - s, 0)])
    return x


def strips(data: np.ndarray, ends: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Strips of texts that lie end to end: anchor, first window's place, windows, places of the anchor among them."""
    h = rolling(data, anchor)
    x = (h ^ (h >> U(29))) * U(0xFF51AFD7ED558CCD)
    x = (x & ~_LOW) | np.arange(len(x), dtype=U)  # ties go to the left
    place = (least(x, window - anchor + 1) & _LOW).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int8)
    starts = np.append(0, ends[:-1])
    has = ends - starts >= window
    valid[starts[has]] = 1
    valid[ends[has] - window + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1]))
    key = h[place[at]]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    if len(n) and n.max() > STRIP:  # periodic text
        pieces = -(-n // STRIP)
        inner = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRIP
        first = np.repeat(first, pieces) + inner
        n = np.minimum(np.repeat(n, pieces) - inner, STRIP)
    moved = np.ones(len(at), np.int64)
    moved[1:] = place[at[1:]] != place[at[:-1]]
    moved[first] = 1
    times = np.add.reduceat(moved, first) if len(first) else np.empty(0, np.int64)
    return key[first], at[first], n, times


def _slices(texts: pa.Array, slice_bytes: int) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t.as_py())
        size += len(held[-1])
        if size >= slice_bytes:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def _long_parts(texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, number of the text of each part, its start in the text); parts of a long text overlap by
    window - 1 bytes, so that each window lies in one of them and numbers of places fit."""
    most = int(_LOW) // 2
    if sum(map(len, texts)) <= most:
        yield (np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]), np.arange(len(texts)),
               np.zeros(len(texts), np.int64))
        return
    for k, t in enumerate(texts):
        for a in range(0, max(len(t) - window + 1, 1), most - window):
            part = t[a:a + most - 1]
            yield np.frombuffer(part, np.uint8), np.array([len(part)]), np.array([k]), np.array([a])


def cut(texts: list[bytes], window: int, anchor: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor, number of the text, start in it, windows, times) of the strips of some texts."""
    for data, ends, number, offset in _long_parts(texts, window):
        key, at, n, times = strips(data, ends, window, anchor)
        part = np.searchsorted(ends, at, side="right")
        yield key.view(np.int64), number[part], at - np.append(0, ends[:-1])[part] + offset[part], n, times


# --------------------------------------------------------------------------- suffix array of a shard
def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number (0 beyond the end)."""
    k = np.zeros(len(data) + 8, U)
    k[:len(data)] = data
    for s in (1, 2, 4):
        k[:-s] = (k[:-s] << U(8 * s)) | k[s:]
    return k[:len(data)]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    key = eights(data)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    slots = np.arange(n)
    rank = np.zeros(n + 1, U)  # place -> 1 + first slot of its group; beyond the end 0
    h = 8

    def regroup(slots, key):
        """Ranks of sorted keys; what is still tied remains."""
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank[sa[slots]] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]] + 1
        tied = ~new
        tied[:-1] |= ~new[1:]
        return slots[tied]

    slots = regroup(slots, key)
    while len(slots):
        at = sa[slots]
        key = (rank[at] << U(32)) | rank[np.minimum(at + h, n)]
        order = np.argsort(key, kind="stable")
        sa[slots] = at[order]
        slots = regroup(slots, key[order])
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """Bytes that the suffix in each slot shares with the one before it, ``most`` at most.

    Kasai's scan: going from a place to the next one loses one byte at most.
    Lanes of ``lane`` neighbouring places run in lockstep, 8 bytes a step.
    """
    n = len(data)
    out = np.zeros(n, np.int32)
    if n < 2:
        return out
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    shared = np.zeros(n, np.int32)
    key = np.append(eights(data), np.zeros(most + 9, U))
    lanes = np.arange(0, n, lane)
    h = np.zeros(len(lanes), np.int64)
    for step in range(lane):
        at = lanes + step
        if at[-1] >= n:
            lanes, h, at = lanes[:-1], h[:-1], at[:-1]
            if not len(at):
                break
        prev = before[at]
        h = np.maximum(h - 1, 0)
        h[prev < 0] = 0
        todo = np.flatnonzero(prev >= 0)
        while len(todo):
            a, b = at[todo] + h[todo], prev[todo] + h[todo]
            differ = key[a] ^ key[b]
            same = differ == 0
            more = todo[same]
            h[more] += 8
            rest, differ = todo[~same], differ[~same]
            for s in (32, 16, 8):  # leading bytes that agree
                none = differ >> U(64 - s) == 0
                h[rest[none]] += s // 8
                differ = np.where(none, differ << U(s), differ)
            todo = more[(h[more] < most) & (np.maximum(at[more], prev[more]) + h[more] < n)]
        h = np.minimum(h, np.minimum(most, n - np.maximum(at, prev)))
        shared[at] = h
    out[:] = shared[sa]
    out[0] = 0
    return out


def repeated_windows(data: np.ndarray, is_start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows' places in suffix order, and for each whether it shares all its bytes with the window before it."""
    sa = suffix_array(data)
    shared = common_prefixes(data, sa, window)
    slots = np.flatnonzero(is_start[sa])
    if not len(slots):
        return np.empty(0, np.int64), np.empty(0, bool)
    # what two windows share is the least of what neighbours between them share
    least_between = np.minimum.reduceat(shared[:slots[-1] + 1], np.append(0, slots[:-1] + 1))
    tied = least_between >= window
    tied[0] = False
    return sa[slots], tied


def ranges(flags: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[int], list[int]]]:
    """Runs of set flags in each span (spans start at ``first``): (span, starts, ends), relative to the span."""
    for k, (a, z) in enumerate(zip(first, np.append(first[1:], len(flags)), strict=True)):
        edge = np.diff(np.concatenate([[0], flags[a:z].view(np.int8), [0]]))
        low = np.flatnonzero(edge == 1)
        if len(low):
            yield k, low.tolist(), np.flatnonzero(edge == -1).tolist()


# --------------------------------------------------------------------------- tasks
def _batch(schema: pa.Schema, cols: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _anchors(window: int, anchor: int, slice_bytes: int):
    """(t1, text) -> (anchor, t1, times)."""
    schema = pa.schema([("key", pa.int64()), ("t1", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1 = b.column(0).to_numpy()
            for first, texts in _slices(b.column(1), slice_bytes):
                for key, number, _, _, times in cut(texts, window, anchor):
                    yield _batch(schema, [key, t1[first + number], times])
    return run


def _candidates(window: int, anchor: int, slice_bytes: int):
    """(t1, sha, text, keys) -> one row a strip of those keys; its bytes go with the first of equal ones."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.binary()), ("bytes", pa.binary()), ("t1", pa.int64()), ("sha", pa.string()),
                        ("start", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t1, sha, wanted = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(3)
            for first, texts in _slices(b.column(2), slice_bytes):
                keys = [wanted[first + k].values.to_numpy() for k in range(len(texts))]
                pairs = np.stack([np.concatenate(keys), np.repeat(np.arange(len(texts)), [len(k) for k in keys])])
                pairs = pairs[:, np.lexsort(pairs)]  # by text, then by key
                at = np.searchsorted(pairs[1], np.arange(len(texts) + 1))
                seen: set[bytes] = set()
                for key, number, start, n, _ in cut(texts, window, anchor):
                    out = []
                    for k in np.unique(number):
                        mine = np.arange(*np.searchsorted(number, (k, k + 1)))
                        for i in mine[np.isin(key[mine], pairs[0, at[k]:at[k + 1]])]:
                            raw = texts[k][start[i]:start[i] + n[i] + window - 1]
                            sid = hashlib.blake2b(raw, digest_size=16).digest()
                            out.append((key[i], sid, None if sid in seen else raw, t1[first + k], sha[first + k], start[i], n[i]))
                            seen.add(sid)
                    if out:
                        yield _batch(schema, list(zip(*out, strict=True)))
    return run


_SORTED = "kind int, sid binary, low array<int>, high array<int>, bucket long, prints binary"


def _sort_shard(window: int):
    """Strips of a shard -> (0, sid, ranges of repeated windows), and for anchors dealt over
    several shards (1, anchor's range, sorted fingerprints of different windows)."""
    kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.binary()]

    def run(group: pa.Table) -> pa.Table:
        raw, sid = group.column("bytes").to_pylist(), group.column("sid").to_pylist()
        key, pieces = group.column("key").to_numpy(), group.column("cuts").to_numpy()
        often = group.column("times").to_numpy() > 1
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(r) for r in raw])
        first = np.cumsum(sizes) - sizes
        edge = np.zeros(len(data) + 1, np.int8)
        edge[first] += 1
        edge[first + sizes - window + 1] -= 1
        at, tied = repeated_windows(data, np.cumsum(edge[:-1]).astype(bool), window)
        again = tied.copy()
        again[:-1] |= tied[1:]
        flags = np.zeros(len(data), bool)
        flags[at[again]] = True
        for k in np.flatnonzero(often):  # the strip itself is there again
            flags[first[k]:first[k] + sizes[k] - window + 1] = True
        out = [(0, sid[k], low, high, None, None) for k, low, high in ranges(flags, first)]
        heavy = np.flatnonzero(pieces > 0)
        if len(heavy):
            lone = at[~tied]  # one of each kind of window
            strip = np.searchsorted(first, lone, side="right") - 1
            mine = pieces[strip] > 0
            lone, strip = lone[mine], strip[mine]
            one, two = (rolling(data, window, w)[lone] for w in (0, 1))
            bucket = ((one >> U(32)) * pieces[strip].astype(U)) >> U(32)
            order = np.lexsort((two, one, bucket, key[strip]))
            lone, strip, one, two, bucket = (x[order] for x in (lone, strip, one, two, bucket))
            change = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (key[strip][1:] != key[strip][:-1]))) if len(lone) else []
            for a, z in zip(change, np.append(change[1:], len(lone)).astype(int), strict=True):
                rec = np.zeros(z - a, _PRINT)
                rec["one"], rec["two"], rec["told"] = one[a:z], two[a:z], flags[lone[a:z]]
                rec["sid"] = [sid[k] for k in strip[a:z]]
                rec["at"] = lone[a:z] - first[strip[a:z]]
                # the range's number is told by anchor and bucket together
                name = int.from_bytes(hashlib.blake2b(f"{key[strip[a]]},{bucket[a]}".encode(), digest_size=8).digest(), "big", signed=True)
                out.append((1, None, None, None, name, rec.tobytes()))
        cols = list(zip(*out, strict=True)) or [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "sid", "low", "high", "bucket", "prints"])
    return run


_PRINT = np.dtype([("one", "<u8"), ("two", "<u8"), ("sid", "V16"), ("at", "<i4"), ("told", "?")])


def merge_sorted(lists: Iterator[np.ndarray]) -> list[np.ndarray]:
    """Rows of sorted lists of fingerprints, each different within its list, that occur in another list too.

    Each list is searched in the merged ones by binary search, and what isn't
    there is inserted at the places found.
    """
    pair = np.dtype([("one", "<u8"), ("two", "<u8")])
    merged, found, out = np.empty(0, pair), np.empty(0, bool), []
    lists = [np.frombuffer(x, _PRINT) if isinstance(x, bytes) else x for x in lists]
    for rec in lists:
        p = np.empty(len(rec), pair)
        p["one"], p["two"] = rec["one"], rec["two"]
        at = _find(merged, p)
        hit = np.zeros(len(p), bool)
        inside = at < len(merged)
        hit[inside] = merged[at[inside]] == p[inside]
        found[at[hit]] = True
        merged = np.insert(merged, at[~hit], p[~hit])
        found = np.insert(found, at[~hit], False)
    for rec in lists:  # once more, now that all are known
        p = np.empty(len(rec), pair)
        p["one"], p["two"] = rec["one"], rec["two"]
        out.append(rec[found[_find(merged, p)] & ~rec["told"]])
    return out


def _find(merged: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Lower bounds by (one, two)."""
    low, high = np.searchsorted(merged["one"], p["one"]), np.searchsorted(merged["one"], p["one"], side="right")
    while True:  # equal first halves are rare
        todo = np.flatnonzero(low < high)
        todo = todo[merged["two"][low[todo]] < p["two"][todo]]
        if not len(todo):
            return low
        low[todo] += 1


def _merge(group: pa.Table) -> pa.Table:
    hits = merge_sorted(group.column("prints").to_pylist())
    rec = np.concatenate(hits) if hits else np.empty(0, _PRINT)
    return pa.table([pa.array([s.tobytes() for s in rec["sid"]], pa.binary()), pa.array([[a] for a in rec["at"].tolist()], pa.list_(pa.int32())),
                     pa.array([[a + 1] for a in rec["at"].tolist()], pa.list_(pa.int32()))], names=["sid", "low", "high"])


def removed(text: bytes, low: np.ndarray, high: np.ndarray, window: int) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs, and what is kept, for windows that start in [low, high)."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high + window - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept


def _strip_texts(window: int):
    """(sha, text, spans) -> (sha, n_removed, n_spans, kept_sha256, kept)."""
    schema = pa.schema([("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
                        ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for sha, text, spans in zip(*(b.column(k) for k in range(3)), strict=True):
                sha, text, spans = sha.as_py(), text.as_py(), [s for s in spans.as_py() if s["sha"] == sha.as_py()]
                if spans:
                    low, high = (np.array([s[c] for s in spans]) for c in ("low", "high"))
                    n, k, kept = removed(text, low, high, window)
                    yield _batch(schema, [[sha], [n], [k], [hashlib.sha256(kept).hexdigest()], [kept]])
    return run


# --------------------------------------------------------------------------- jobs
def _different(docs: DataFrame, text_col: str, window: int, bucket_bytes: int) -> DataFrame:
    """Each different text of at least ``window`` bytes once (t1, sha, text), stored in buckets by t1,
    so that the joins below leave the texts where they are."""
    spark = docs.sparkSession
    texts = (docs.select(F.col(text_col).alias("text")).where(F.octet_length("text") >= window)
             .withColumn("sha", F.sha2("text", 256)).withColumn("t1", F.xxhash64("sha")))
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # of this task's texts: a text that is everywhere is sent once by each task
        for b in batches:
            keep = []
            for i, s in enumerate(b.column(1).to_pylist()):
                if s not in seen:
                    seen.add(s)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    name = f"texts_{uuid.uuid4().hex[:12]}"
    (texts.select("t1", "sha", "text").mapInArrow(once, "t1 long, sha string, text string")
     .repartition(n, "t1").dropDuplicates(["t1", "sha"])
     .write.option("path", scratch_path(spark, "texts")).option("compression", "zstd").bucketBy(n, "t1").saveAsTable(name))
    return spark.table(name)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                   shard_bytes: int = SHARD_BYTES, slice_bytes: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES,
                   range_prints: int = RANGE, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the remaining bytes, if asked for)."""
    spark = docs.sparkSession
    texts = _different(docs, text_col, window, bucket_bytes)
    raw = F.col("text").cast("binary").alias("text")
    named = texts.select("t1", raw).mapInArrow(_anchors(window, anchor, slice_bytes), "key long, t1 long, times long")
    often = named.groupBy("key").agg(F.sum("times").alias("times")).where("times > 1").select("key")
    wanted = named.select("key", "t1").join(often, "key").groupBy("t1").agg(F.collect_set("key").alias("keys"))

    path = scratch_path(spark, "strips")
    (texts.join(wanted.hint("shuffle_hash"), "t1").select("t1", "sha", raw, "keys")
     .mapInArrow(_candidates(window, anchor, slice_bytes), "key long, sid binary, bytes binary, t1 long, sha string, start long, n long")
     .write.option("compression", "zstd").parquet(path))
    members = spark.read.parquet(path)
    path = scratch_path(spark, "different-strips")
    (members.groupBy("key", "sid").agg(F.first("bytes", ignorenulls=True).alias("bytes"), F.count("*").alias("times"))
     .write.option("compression", "zstd").parquet(path))
    different = spark.read.parquet(path)

    size = F.octet_length("bytes").cast("long")
    total = different.agg(F.sum(size)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    # anchors that are dealt over several shards, and ranges for merging their windows
    heavy = (different.groupBy("key").agg(F.sum(size).alias("size")).where(F.col("size") > shard_bytes // 2)
             .select("key", F.ceil(F.col("size") / (shard_bytes // 2)).alias("parts"), F.ceil(F.col("size") / range_prints).alias("cuts")))
    dealt = (different.join(heavy, "key", "left")
             .withColumn("shard", F.pmod(F.xxhash64("key", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("sid"), F.col("parts"))).otherwise(0)),
                                         F.lit(shards)).cast("int"))
             .select("shard", "key", "sid", "bytes", "times", F.coalesce("cuts", F.lit(0)).cast("long").alias("cuts")))
    path = scratch_path(spark, "sorted")
    (dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_sort_shard(window), _SORTED).write.parquet(path))
    ordered = spark.read.parquet(path)
    merged = (ordered.where("kind = 1").select("bucket", "prints").groupBy("bucket")
              .applyInArrow(_merge, "sid binary, low array<int>, high array<int>"))
    hits = ordered.where("kind = 0").select("sid", "low", "high").unionByName(merged)

    spans = (members.select("sid", "t1", "sha", "start").join(hits, "sid")
             .select("t1", "sha", "start", F.explode(F.arrays_zip("low", "high")).alias("r"))
             .groupBy("t1").agg(F.collect_list(F.struct("sha", (F.col("start") + F.col("r.low")).alias("low"),
                                                        (F.col("start") + F.col("r.high")).alias("high"))).alias("spans")))
    cols = ["sha", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    cleaned = (texts.join(spans.hint("shuffle_hash"), "t1").select("sha", raw, "spans")
               .mapInArrow(_strip_texts(window), "sha string, n_removed long, n_spans long, kept_sha256 string, kept binary").select(cols))

    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
            .withColumn("sha", F.sha2("text", 256)).withColumn("n_bytes", F.octet_length("text").cast("long")))
    copied = rows.where(F.col("n_bytes") >= window).groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")
    out = (rows.select("doc_id", "sha", "n_bytes", *(["text"] if with_text else []))
           .join(copied, "sha", "left").join(cleaned, "sha", "left"))
    whole = F.col("copies") > 1
    out = out.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
                     F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                     F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
                     *([F.when(whole, F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept")] if with_text else []))
    return out
