"""Token counts: an exact histogram of encoded lengths with suffix sums.

Documents are encoded once and counted by length inside each task; the
histogram answers, for every context limit, how many documents fit, the tokens
of those that don't, the total after truncation, and any quantile.

Defined cases: null and empty texts have length 0; repeated rows count each;
ids and other columns do not matter; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findrift.llm.encoding import Encoder, slices
from findrift.session import materialize

#: Lengths that share a block of the two-level sums.
_BLOCK = 1024


def length_histogram(docs: DataFrame, vocabulary: tuple[str, ...], text: str = "text") -> DataFrame:
    """n_tokens, n_docs: one row per length that occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*vocabulary)
        for batch in batches:
            for texts, _ in slices(batch.column(0), range(batch.num_rows)):
                n, c = np.unique([len(x) // 4 for x in encoder.encode(texts)], return_counts=True)
                yield pa.record_batch([pa.array(n, pa.int64()), pa.array(c, pa.int64())], ["n_tokens", "n"])

    hist = (docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long, n long")
            .groupBy("n_tokens").agg(F.sum("n").alias("n_docs")))
    return materialize(hist)  # the sums read it several times; texts are encoded once


def with_suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: docs_over and tokens_over (documents longer than L, their
    tokens), docs_upto, tokens_upto, truncated_total (tokens left if every
    document is cut to L tokens) and share_upto (the quantile of L).

    Sums run inside blocks of lengths and over the blocks' totals, so no task
    gets the whole histogram.
    """
    h = (hist.withColumn("_b", F.floor(F.col("n_tokens") / _BLOCK))
         .withColumn("_t", F.col("n_tokens") * F.col("n_docs")))
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("_bd"), F.sum("_t").alias("_bt"))
    after = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select("_b", F.coalesce(F.sum("_bd").over(after), F.lit(0)).alias("_ad"),
                           F.coalesce(F.sum("_bt").over(after), F.lit(0)).alias("_at"),
                           F.sum("_bd").over(whole).alias("_nd"), F.sum("_bt").over(whole).alias("_nt"))
    inside = Window.partitionBy("_b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    h = (h.join(blocks, "_b")
         .withColumn("docs_over", F.col("_ad") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)))
         .withColumn("tokens_over", F.col("_at") + F.coalesce(F.sum("_t").over(inside), F.lit(0))))
    return h.select("n_tokens", "n_docs", "docs_over", "tokens_over",
                    (F.col("_nd") - F.col("docs_over")).alias("docs_upto"),
                    (F.col("_nt") - F.col("tokens_over")).alias("tokens_upto"),
                    (F.col("_nt") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
                    ((F.col("_nd") - F.col("docs_over")) / F.col("_nd")).alias("share_upto"))


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """One row: docs, tokens and truncated_total for any limit, from the suffix sums."""
    below = sums.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "tokens_upto", "docs_over", "tokens_over")).alias("x"))
    total = sums.agg(F.max(F.col("docs_upto") + F.col("docs_over")).alias("docs"),
                     F.max(F.col("tokens_upto") + F.col("tokens_over")).alias("tokens"))
    return total.crossJoin(below).select(  # one row on either side
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("x.tokens_upto") + F.col("x.docs_over") * limit, F.col("docs") * limit, F.lit(0)).alias("truncated_total"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share q of the documents doesn't exceed."""
    return sums.where(F.col("share_upto") >= q).agg(F.min("n_tokens").alias("n_tokens"))
