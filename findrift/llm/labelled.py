"""Bounded samples of labelled documents, folds, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.session import scratch_path


def held_out(doc_id: Column, folds: int, held: int) -> Column:
    """True for ids kept from learning; false for a null id (which has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int,
                    per_class: int, calibration: int) -> DataFrame:
    """y, part ('fit' or 'calibrate'), text of a bounded sample of labelled rows.

    Of the ids outside the held-out fold, a fifth (by a hash of the id) may
    calibrate, in their natural shares; the rest fit, up to ``per_class`` ids of
    each class in the order of that hash.  The bounds hold at every size, so
    the picked ids (at most 2 x per_class + calibration) are broadcast and the
    documents are read once; of a repeated id one row is kept, that with the
    least hash of its text, so only texts of picked ids are shuffled.
    """
    spark = docs.sparkSession
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, held))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.max(label).alias("y"))
             .withColumn("_h", F.xxhash64(F.lit(label), "_id")))
    first = lambda df, n: df.orderBy("_h", "_id").limit(n)
    fifth = F.pmod("_h", F.lit(5)) == 0
    picked = (first(known.where(~fifth & (F.col("y") == 0)), per_class)
              .unionAll(first(known.where(~fifth & (F.col("y") == 1)), per_class)).withColumn("part", F.lit("fit"))
              .unionAll(first(known.where(fifth), calibration).withColumn("part", F.lit("calibrate"))))
    path = scratch_path(spark, "sample")
    (docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
     .join(F.broadcast(picked), "_id").groupBy("_id", "y", "part")
     .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
     .select("y", "part", "row.text").write.parquet(path))
    return spark.read.parquet(path)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias first) of a ridge-regularised logistic fit, by Newton steps."""
    if len(y) == 0 or y.min() == y.max():
        rate = float(np.clip(y.mean() if len(y) else 0.5, 0.001, 0.999))
        return np.array([np.log(rate / (1 - rate)), *np.zeros(x.shape[1])])
    mid, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mid) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return np.array([w[0] - (w[1:] * mid / spread).sum(), *(w[1:] / spread)])


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -50, 50)))
