"""Runs of consecutive positions of one type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 1 << 16


def islands(rows: DataFrame, key: str = "seq_id", pos: str = "pos", kind: str = "type", block: int = BLOCK) -> DataFrame:
    """``(key, type, first, end)`` of the maximal runs [first, end) in ``rows(key, pos, type)``.

    Runs are found inside blocks of positions, in parallel for one sequence too; then those that touch are joined, on far fewer rows.
    """
    at = rows.select(F.col(key).alias("key"), F.col(kind).alias("type"), F.col(pos).alias("pos"), F.floor(F.col(pos) / block).alias("block"))
    run = F.col("pos") - F.row_number().over(Window.partitionBy("key", "block", "type").orderBy("pos"))
    local = at.withColumn("run", run).groupBy("key", "block", "type", "run").agg(F.min("pos").alias("first"), (F.max("pos") + 1).alias("end"))
    order = Window.partitionBy("key", "type").orderBy("first")
    starts = F.when(F.col("first") == F.lag("end").over(order), 0).otherwise(1)
    joined = local.withColumn("new", starts).withColumn("nth", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("key", "type", "nth").agg(F.min("first").alias("first"), F.max("end").alias("end"))
    return out.select(F.col("key").alias(key), "type", "first", "end")
