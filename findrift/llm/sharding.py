"""Sharding by jump consistent hashing.

A stable key walks through a fixed sequence of pseudo-random numbers (one per
step, here ``xxhash64(key, step)``) and jumps forward until it would pass the
shard count; no ring table exists, and a shard appended at the end takes only
the rows that jump into it.  Everything is DataFrame code.

Defined cases: a null key is a key like any other; a null text counts no bytes
and has a null checksum; repeated rows keep their number and get slots of their
own; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findrift.llm.numbering import numbered

_SHORT = 64


def _uniform(key: Column, step: Column) -> Column:
    """In (0, 1]: the step-th number of the key's sequence."""
    return (F.shiftrightunsigned(F.xxhash64(key, step), 33) + 1) / F.lit(float(1 << 31))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a key; for n+1 shards only rows that move to shard n differ."""
    def walk(steps: int) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("to")),
            lambda s, i: F.when(s["to"] >= shards, s).otherwise(F.struct(
                s["to"].alias("at"), F.floor((s["to"] + 1) / _uniform(key, i)).cast("long").alias("to"))))

    # a walk takes about ln(shards) steps and at most shards; the long form runs
    # only for keys that the short one has not brought to their end
    short = walk(min(shards, _SHORT))
    if shards <= _SHORT:
        return short["at"].cast("int")
    return F.when(short["to"] >= shards, short["at"]).otherwise(walk(shards)["at"]).cast("int")


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                    lanes: int | None = None) -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard; slots are
    gapless from 0 in each shard, and no shard is numbered in one task."""
    rows = docs.select(F.col(key).alias("_k"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
                       F.crc32(F.col(text).cast("binary")).alias("_crc"),
                       jump_hash(F.col(key), shards).alias("_shard"))
    return numbered(rows, "_shard", "_slot", lanes).select(
        F.col("_k").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"),
        jump_hash(F.col("_k"), shards + 1).alias("grown_shard"))
