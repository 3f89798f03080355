"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's documents.  All but the last return
the columns of ``documents``.

Decisions: a document goes if its toxicity score reaches TOXIC; if its quality
score is below GOOD; if it isn't the one that its group of near duplicates
keeps; if it holds a benchmark item within the edit budget.  What is left is
packed into sequences.

Defined cases: documents with null or empty text are kept by the toxicity and
benchmark stages, judged as any other by the quality stage, and count as copies
of each other; where no labels of both classes are found, the classifiers keep
everything; columns beyond those of ``documents`` pass through all but the last
stage.  Filters act on the rows themselves, so repeated rows and null ids need
no special care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm import decontamination, near_duplicates, packing, quality, queries, toxicity
from findrift.session import scratch_path

#: Scores from which a document is rejected as toxic, and below which as poor.
TOXIC, GOOD = queries.THRESHOLD, queries.THRESHOLD


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return docs.where(model.score(F.col("text")) < TOXIC)


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, _labels(spark, sf_dir))
    return docs.where(model.score(F.col("text")) >= GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.one_of_each_group(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.byte_bpe_added())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: The stages learn models and compare texts by sketches, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
