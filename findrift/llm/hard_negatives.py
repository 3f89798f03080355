"""Hard negatives of anchors by a vertical scan (BOND) of blocks of vectors.

Vectors become whole numbers, floor(scale * x), and are stored block by block,
dimension by dimension.  An anchor reads a block's dimensions in descending
order of its own magnitudes.  After every few dimensions the least and greatest
that the remaining ones can add (from the block's minima and maxima) bound each
candidate's inner product; candidates that can't be among the wanted ones leave
the bitmap, until the rest have their exact products.  The first scan finds the
positives (rows of the anchor's label), the second the negatives (rows of other
labels) whose score lies in the window of each positive.

Rows are dealt by hash, so a label or a vector that holds a third of all rows is
spread over all blocks.  A task holds one block of anchors and one of rows at a
time, and carries what it has found from block to block.  Each anchor meets
each block; nothing is emitted but its best few per run of blocks.

Defined cases: rows without an id or label, and vectors that are null or hold
null or non-finite components take no part, nor do vectors whose codes have a
norm of 2^31 or more (their products may not fit a long); an empty or zero
vector scores 0; vectors of unequal length never meet, nor do rows of equal id;
rows equal in id, label and codes count once, other rows of one id each count;
ties go to the smaller id; an empty table gives an empty result; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findrift.session import scratch_path

#: Rows of a block, at least and at most; anchors of a block; blocks that one task reads in turn.
ROW_BLOCK, ANCHOR_BLOCK, RUN = (2048, 16384), 16384, 16
#: Dimensions read between two prunings.
STEP = 8

_BLOCK = "block int, dim int, n int, ids binary, labels binary, width int, codes binary"
_FOUND = "ab int, dim int, at int, anchor_id long, p int, positive_id long, positive_score long, id long, score long"
_NONE = np.iinfo(np.int64).min


def codes(vec: Column, scale: int = 256) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(vec: Column, scale: int = 256) -> Column:
    """Not null, no null or non-finite component, and a norm below 2^31 once coded."""
    inf = float("inf")
    square = F.aggregate(vec, F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * float(scale)).cast("double"), 2.0))
    return (vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
            & (square < float(1 << 62)))


# --------------------------------------------------------------------------- blocks
def _packed(group: pa.Table) -> pa.Table:
    """One row for a block: ids, labels, and the codes dimension by dimension."""
    dim, n = group.column("dim")[0].as_py(), group.num_rows
    ids, labels = (group.column(c).to_numpy() for c in ("id", "label"))
    x = group.column("codes").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, dim)
    order = np.lexsort((*x.T[::-1], labels, ids))
    x = x[order]
    most = int(np.abs(x).max()) if x.size else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
    return pa.table([pa.array([group.column("block")[0].as_py()], pa.int32()), pa.array([dim], pa.int32()), pa.array([n], pa.int32()),
                     pa.array([ids[order].tobytes()], pa.binary()), pa.array([labels[order].tobytes()], pa.binary()),
                     pa.array([width], pa.int32()), pa.array([np.ascontiguousarray(x.T).astype(f"<i{width}").tobytes()], pa.binary())],
                    names=["block", "dim", "n", "ids", "labels", "width", "codes"])


def _blocks(rows: DataFrame, n_blocks: int) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "label", "codes"), F.lit(n_blocks)).cast("int"))
    return (dealt.select("block", "dim", "id", "label", "codes").repartition(n_blocks, "block", "dim")
            .groupBy("block", "dim").applyInArrow(_packed, _BLOCK))


class Block:
    def __init__(self, row: dict):
        self.dim, self.n = row["dim"], row["n"]
        self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels"))
        self.columns = np.frombuffer(row["codes"], f"<i{row['width']}").reshape(self.dim, self.n).astype(np.int64)
        self.low, self.high = ((self.columns.min(axis=1), self.columns.max(axis=1)) if self.n else (np.zeros(self.dim, np.int64),) * 2)


# --------------------------------------------------------------------------- the scan
def scan(anchor: np.ndarray, block: Block, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Places in the block that ``keep`` never turned down, with their exact products.

    ``alive`` is the bitmap to start from; ``keep(low, high)`` gets the bounds of
    the candidates' products and says which of them stay.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor * block.low, anchor * block.high])[:, order]
    rest = np.zeros((2, block.dim + 1), np.int64)  # least and greatest that dimensions from d on add
    rest[0, :-1] = np.cumsum(ends.min(axis=0)[::-1])[::-1]
    rest[1, :-1] = np.cumsum(ends.max(axis=0)[::-1])[::-1]
    whole = bool(alive.all())
    at = np.flatnonzero(alive)
    part = np.zeros(len(at), np.int64)
    for d in range(0, block.dim, STEP):
        for k in order[d:d + STEP]:
            if anchor[k]:
                part += (block.columns[k] if whole else block.columns[k][at]) * anchor[k]
        e = min(d + STEP, block.dim)
        stays = keep(part + rest[0, e], part + rest[1, e])
        if not stays.all():
            at, part, whole = at[stays], part[stays], False
        if not len(at):
            break
    return at, part


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, or the least number where there are fewer."""
    return int(np.partition(values, -k)[-k]) if len(values) >= k else _NONE


class Best:
    """The k best (score, id) met so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else _NONE

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
            order = np.lexsort((ids, -scores))[:self.k]
            self.ids, self.scores = ids[order], scores[order]


def positives_of(anchor: np.ndarray, block: Block, alive: np.ndarray, best: Best) -> None:
    known = best.least
    at, score = scan(anchor, block, alive, lambda low, high: high >= max(known, kth(low, best.k)))
    best.add(block.ids[at], score)


def window(score: int, lowest: int, highest: int) -> tuple[int, int]:
    """Scores s with lowest * score <= 100 * s <= highest * score; empty where the first is greater."""
    return -(-lowest * score // 100), highest * score // 100


def negatives_of(anchor: np.ndarray, block: Block, alive: np.ndarray, windows: list[tuple[int, int]], best: list[Best]) -> None:
    known = [b.least for b in best]

    def keep(low, high):
        stays = np.zeros(len(low), bool)
        for (a, z), least, b in zip(windows, known, best, strict=True):
            sure = low[(low >= a) & (high <= z)]
            stays |= (high >= max(a, least, kth(sure, b.k))) & (low <= z)
        return stays

    at, score = scan(anchor, block, alive, keep)
    for (a, z), b in zip(windows, best, strict=True):
        inside = (score >= a) & (score <= z)
        b.add(block.ids[at[inside]], score[inside])


# --------------------------------------------------------------------------- tasks
def _found(ab: int, dim: int, anchors: Block, hits: list[tuple]) -> pa.RecordBatch:
    """hits: (place of the anchor, positive's number, its id, its score, Best)."""
    n = [len(h[4].ids) for h in hits]
    at = np.repeat([h[0] for h in hits], n).astype(np.int64)
    rep = lambda i, kind: pa.array(np.repeat(np.array([h[i] for h in hits], np.int64), n), kind)
    join = lambda name: pa.array(np.concatenate([getattr(h[4], name) for h in hits]) if hits else np.empty(0, np.int64), pa.int64())
    return pa.record_batch([pa.array(np.full(len(at), ab), pa.int32()), pa.array(np.full(len(at), dim), pa.int32()), pa.array(at, pa.int32()),
                            pa.array(anchors.ids[at], pa.int64()), rep(1, pa.int32()), rep(2, pa.int64()), rep(3, pa.int64()),
                            join("ids"), join("scores")],
                           names=["ab", "dim", "at", "anchor_id", "p", "positive_id", "positive_score", "id", "score"])


def _task(n_pos: int, n_neg: int, lowest: int, highest: int, negatives: bool):
    """Rows sorted by (ab, run, dim), the anchors first, then the run's blocks one by one."""
    def start(row: dict):
        anchors = Block(row)
        if not negatives:
            return anchors, [(i, [(-1, 0, 0, Best(n_pos))], []) for i in range(anchors.n)]
        at, ids, scores = (np.frombuffer(row[c], np.int64) for c in ("p_at", "p_id", "p_score"))
        wanted: dict[int, tuple[list, list]] = {}
        for i, pid, s in zip(at.tolist(), ids.tolist(), scores.tolist(), strict=True):
            bests, windows = wanted.setdefault(i, ([], []))
            bests.append((len(bests), pid, s, Best(n_neg)))
            windows.append(window(s, lowest, highest))
        return anchors, [(i, b, w) for i, (b, w) in wanted.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, state = None, None, []

        def done():
            return _found(key[0], key[2], anchors, [(i, *b) for i, bests, _ in state for b in bests])

        for batch in batches:
            for j in range(batch.num_rows):
                row = batch.slice(j, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if anchors is not None:
                        yield done()
                    key = (row["ab"], row["run"], row["dim"])
                    anchors, state = start(row)
                    x = np.ascontiguousarray(anchors.columns.T)
                    continue
                if key != (row["ab"], row["run"], row["dim"]):
                    continue  # no anchors of that length
                block = Block(row)
                for i, bests, windows in state:
                    alive = (block.labels != anchors.labels[i] if negatives else block.labels == anchors.labels[i])
                    alive &= block.ids != anchors.ids[i]
                    if not alive.any():
                        continue
                    if negatives:
                        open_ = [w for w in range(len(windows)) if windows[w][0] <= windows[w][1]]
                        if open_:
                            negatives_of(x[i], block, alive, [windows[w] for w in open_], [bests[w][3] for w in open_])
                    else:
                        positives_of(x[i], block, alive, bests[0][3])
        if anchors is not None:
            yield done()
    return run


def _pack_positives(group: pa.Table) -> pa.Table:
    cols = [group.column(c).to_numpy() for c in ("at", "id", "score")]
    order = np.lexsort((cols[1], -cols[2], cols[0]))
    return pa.table([pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("ab", "dim")]
                    + [pa.array([c.astype(np.int64)[order].tobytes()], pa.binary()) for c in cols],
                    names=["ab", "dim", "p_at", "p_id", "p_score"])


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, lowest: int = 30, highest: int = 90,
         scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         row_block: int | None = None, anchor_block: int = ANCHOR_BLOCK, run: int = RUN) -> DataFrame:
    """For each anchor and each of its ``n_positives`` best rows of its own label,
    the ``n_negatives`` best rows of other labels whose score lies between
    ``lowest`` and ``highest`` percent of the positive's: anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score.

    Copies moved: rows once for each ``anchor_block`` anchors, anchors once for
    each ``run`` blocks of rows.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                           F.col(vec_col).alias("vec"), is_anchor.alias("anchor"))
            .where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec"), scale))
            .select("id", "label", codes(F.col("vec"), scale).alias("codes"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
            .withColumn("dim", F.size("codes")))
    n, n_anchors = vectors.count(), vectors.where(is_anchor).count()
    # smaller blocks for small tables, so that all cores have some; the result does not depend on them
    size = row_block or min(max(n // (4 * spark.sparkContext.defaultParallelism), ROW_BLOCK[0]), ROW_BLOCK[1])
    r_blocks, a_blocks = max(1, -(-n // size)), max(1, -(-n_anchors // anchor_block))
    run = max(1, min(run, r_blocks // (4 * spark.sparkContext.defaultParallelism)))
    runs = -(-r_blocks // run)

    def stored(df, name, count):
        path = scratch_path(spark, name)
        _blocks(df.select("id", "label", "codes", "dim").distinct(), count).write.parquet(path)
        return spark.read.parquet(path)

    row_blocks, anchor_blocks = stored(rows, "rows", r_blocks), stored(rows.where("anchor"), "anchors", a_blocks)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    payload = ["n", "ids", "labels", "width", "codes"]
    scanned = row_blocks.select(every(a_blocks).alias("ab"), F.floor(F.col("block") / run).cast("int").alias("run"), "dim",
                                F.lit(1).alias("kind"), "block", *payload,
                                *(F.lit(None).cast("binary").alias(c) for c in ("p_at", "p_id", "p_score")))

    def tiles(anchors: DataFrame, negatives: bool) -> DataFrame:
        asked = anchors.select(F.col("block").alias("ab"), every(runs).alias("run"), "dim", F.lit(0).alias("kind"), F.lit(-1).alias("block"),
                               *payload, "p_at", "p_id", "p_score")
        return (asked.unionByName(scanned).repartition(a_blocks * runs, "ab", "run", "dim")
                .sortWithinPartitions("ab", "run", "dim", "kind", "block")
                .mapInArrow(_task(n_positives, n_negatives, lowest, highest, negatives), _FOUND))

    no_positives = [F.lit(None).cast("binary").alias(c) for c in ("p_at", "p_id", "p_score")]
    place = ["ab", "dim", "at"]
    first = Window.partitionBy(*place).orderBy(F.desc("score"), "id")
    positives = (tiles(anchor_blocks.select("*", *no_positives), False)
                 .withColumn("p", F.row_number().over(first)).where(F.col("p") <= n_positives)
                 .groupBy("ab", "dim").applyInArrow(_pack_positives, "ab int, dim int, p_at binary, p_id binary, p_score binary"))
    with_positives = anchor_blocks.withColumnRenamed("block", "ab").join(positives, ["ab", "dim"]).withColumnRenamed("ab", "block")
    best = Window.partitionBy(*place, "p").orderBy(F.desc("score"), "id")
    return (tiles(with_positives, True).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))
