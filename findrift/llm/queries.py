"""Queries of this package: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm import (
    alignment,
    decontamination,
    hard_negatives,
    labelled,
    near_duplicates,
    nearest,
    ngram_lm,
    packing,
    quality,
    sharding,
    suffix_dedup,
    token_counts,
    toxicity,
    url_filter,
)

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def _query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The site's own rules; the longest that fits wins over every pattern rule.
SITE_RULES = (
    url_filter.host_rule("org", "/", "allow"),
    url_filter.host_rule("example.org", "/es/", "block"),
    url_filter.host_rule("example.org", "/en/1", "block"),
    url_filter.host_rule("com", "/fr/", "allow"),
    url_filter.host_rule("com", "/de/", "block"),
)


@_query("op3_url_filter")
def op3_url_filter(spark, sf_dir):
    rules = url_filter.rules_table(spark, [*SITE_RULES, *url_filter.default_patterns()])
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules)


@_query("op7_sharding")
def op7_sharding(spark, sf_dir):
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), 8)


@_query("op1_nearest_neighbours")
def op1_nearest_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def byte_bpe() -> tuple[str, str]:
    """The file of ranks, and the pattern that cuts texts into words."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def byte_bpe_added() -> tuple[str, str, str]:
    """The same, with the file that names the added tokens."""
    return *byte_bpe(), public_tokenizers.path("byte_bpe_50k.json")


@_query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return token_counts.with_suffix_sums(token_counts.length_histogram(docs, byte_bpe_added()))


@_query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe_added())


#: Scores from which a document counts as its class.
THRESHOLD = 0.3


def _judged(docs, model, folds, held):
    scored = docs.select("doc_id", labelled.held_out(F.col("doc_id"), folds, held).alias("held_out"),
                         model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


@_query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _judged(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"), 4, 2), 4, 2)


@_query("op5_quality")
def op5_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return _judged(docs, quality.fit(docs, _table(spark, sf_dir, "labels"), 5, 0), 5, 0)


@_query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op6_near_duplicates")
def op6_near_duplicates(spark, sf_dir):
    return (near_duplicates.grouped(_table(spark, sf_dir, "documents"))
            .select("doc_id", F.col("group_id").alias("class_id"), "is_kept"))


@_query("op9_lm_scores")
def op9_lm_scores(spark, sf_dir):
    return ngram_lm.score_documents(_table(spark, sf_dir, "documents"))


@_query("op11_hard_negatives")
def op11_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


@_query("op12_token_alignment")
def op12_token_alignment(spark, sf_dir):
    return alignment.align_documents(_table(spark, sf_dir, "documents"),
                                     (*byte_bpe_added(), public_tokenizers.path("piece_bpe_32k.model")))


@_query("op13_suffix_dedup")
def op13_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
