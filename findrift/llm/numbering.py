"""Gapless numbers inside groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def default_lanes(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, group: str, name: str, lanes: int | None = None) -> DataFrame:
    """``df`` with column ``name``: 0, 1, 2, ... within each value of ``group``.

    The rows of a group are dealt over ``lanes`` parts by a hash of the whole
    row, numbered within each part, and shifted by the counts of the parts
    before it (a table of groups x lanes rows), so a group that holds a third
    of all rows is still many tasks.  Rows equal in every column are counted
    first and expanded last, so they don't meet in one part either.
    """
    lanes, cols = lanes or default_lanes(df), df.columns
    rows = (df.groupBy(*cols).agg(F.count("*").alias("_n"))
            .withColumn("_lane", F.pmod(F.xxhash64(F.lit("lane"), *cols), F.lit(lanes)).cast("int")))
    starts = (rows.groupBy(group, "_lane").agg(F.sum("_n").alias("_in"))
              .withColumn("_base", F.sum("_in").over(Window.partitionBy(group).orderBy("_lane")) - F.col("_in"))
              .select(group, "_lane", "_base"))
    order = Window.partitionBy(group, "_lane").orderBy(*cols)
    return (rows.withColumn("_before", F.sum("_n").over(order) - F.col("_n"))
            .join(starts, [group, "_lane"])
            .withColumn("_first", F.col("_base") + F.col("_before"))
            # two steps, so that no array grows with the number of equal rows
            .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(65536).cast("long"))))
            .withColumn("_i", F.explode(F.sequence("_block", F.least(F.col("_block") + 65535, F.col("_n") - 1))))
            .select(*cols, (F.col("_first") + F.col("_i")).alias(name)))
