"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 with a scale each.  A tile holds a block of
queries and a block of candidates; the int8 product gives every inner product
up to a proven bound, ``|<x,y> - <x',y'>| <= |x-x'| |y| + |x'| |y-y'|`` for the
quantised x', y'.  A candidate whose upper bound is below the k-th best lower
bound of its query can't be among the k nearest; the rest are computed again
in double precision, and each tile hands on one sorted list per query.  Heaps
merge a query's lists while they stream by, so the result is exact.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, nor do rows without an id; rows equal in id and vector
count once; vectors of unequal length never meet; ties go to the smaller id; an
empty table gives an empty result; a query with fewer than k candidates gets
all of them; other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a tile; they bound a task's memory (64 dimensions: about 30 MB).
QUERY_BLOCK, ROW_BLOCK, _STEP = 4096, 8192, 256
_TILE = "query long, ids array<long>, scores array<double>"


def usable(vec: Column) -> Column:
    inf = float("inf")
    return (vec.isNotNull()
            & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
            & F.exists(vec, lambda x: x != 0))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), scales, norms of the decoded vectors, norms of the errors."""
    scale = np.abs(x).max(axis=1) / 127.0
    scale[scale == 0] = np.finfo(np.float64).tiny  # of subnormal vectors
    code = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    back = code * scale[:, None]
    return code, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, added from left to right."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def tile_top(qid: np.ndarray, q: np.ndarray, rid: np.ndarray, r: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, ids, scores) of the k best rows of a tile for each query, best first."""
    order = np.argsort(rid, kind="stable")
    rid, r = rid[order], r[order]
    qc, qs, qn, qe = quantise(q)
    rc, rs, _, re = quantise(r)
    rn = np.sqrt((r * r).sum(axis=1))
    # products of int8 codes are whole numbers below 2**24 for up to 1040
    # dimensions, so float32 holds them exactly; longer vectors take doubles
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    rt = rc.astype(kind).T
    for a in range(0, len(q), _STEP):
        s = slice(a, a + _STEP)
        near = (qc[s].astype(kind) @ rt) * qs[s, None] * rs[None, :]
        slack = (qe[s, None] * rn[None, :] + qn[s, None] * re[None, :]) * (1 + 1e-9) + 1e-12 * np.outer(qn[s] + qe[s], rn)
        own = qid[s, None] == rid[None, :]
        low = np.where(own, -np.inf, near - slack)
        least = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        i, j = np.nonzero(~own & (near + slack >= least[:, None]))
        score = np.concatenate([exact(q[s][i[b:b + 65536]], r[j[b:b + 65536]]) for b in range(0, len(i), 65536)] or [np.empty(0)])
        best = np.lexsort((rid[j], -score, i))
        i, j, score = i[best], j[best], score[best]
        ends = np.searchsorted(i, np.arange(len(low) + 1))
        for n in range(len(low)):
            b, e = ends[n], min(ends[n + 1], ends[n] + k)
            if b < e:
                yield int(qid[a + n]), rid[j[b:e]], score[b:e]


def _merged(k: int):
    """Streams (query, ids, scores) sorted by query; a heap merges each query's lists."""
    def rank(query, best):
        return pd.DataFrame({"query_id": np.int64(query), "rank": np.arange(1, len(best) + 1, dtype=np.int32),
                             "vec_id": [i for _, i in best], "score": [-s for s, _ in best]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, best, out = None, [], []
        for batch in batches:
            for q, ids, scores in zip(batch["query"], batch["ids"], batch["scores"], strict=True):
                if q != query:
                    if best:
                        out.append(rank(query, best))
                    if len(out) >= 500:
                        yield pd.concat(out)
                        out = []
                    query, best = q, []
                best = list(islice(heapq.merge(best, zip(-scores, ids, strict=True)), k))
        if best:
            out.append(rank(query, best))
        if out:
            yield pd.concat(out)
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
            query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """The k rows of ``vectors`` with the largest inner product for each row of
    ``queries``, its own id excepted: query_id, rank, vec_id, score."""
    def clean(df):
        return (df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)))
                .select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
                .distinct().withColumn("dim", F.size("vec")))

    rows, asked = clean(vectors), clean(queries)
    # block counts follow the input, so a tile's size does not
    n_rows, n_asked = vectors.count(), queries.count()
    r_blocks, q_blocks = max(1, -(-n_rows // row_block)), max(1, -(-n_asked // query_block))
    deal = lambda n: F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("rb", deal(r_blocks)).withColumn("qb", every(q_blocks))
    asked = asked.withColumn("qb", deal(q_blocks)).withColumn("rb", every(r_blocks))

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            def read(t):
                dim = t.column("dim")[0].as_py()
                flat = t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                return t.column("id").to_numpy(), flat.reshape(-1, dim)
            out = list(tile_top(*read(right), *read(left), k))
        return pa.table({"query": pa.array([o[0] for o in out], pa.int64()),
                         "ids": pa.array([o[1] for o in out], pa.list_(pa.int64())),
                         "scores": pa.array([o[2] for o in out], pa.list_(pa.float64()))})

    keys = ["rb", "qb", "dim"]
    lists = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(tile, _TILE)
    return (lists.repartition("query").sortWithinPartitions("query")
            .mapInPandas(_merged(k), "query_id long, rank int, vec_id long, score double"))
