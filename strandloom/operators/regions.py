"""Stretches of sequence that a table hardly supports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.operators.islands import islands
from strandloom.operators.lookup import annotate
from strandloom.operators.options import RegionOptions


def low_support(seqs: DataFrame, table: DataFrame, k: int, opt: RegionOptions = RegionOptions()) -> DataFrame:
    """``(seq_id, name, start, end, streak)``: runs of more than ``min_streak`` k-mers with counts below ``min_count``.

    An absent k-mer counts as -1, so with ``min_count`` 0 only absent ones are low. Intervals are half-open.
    """
    low = annotate(seqs, table, k).filter(F.coalesce("cnt", F.lit(-1)) < opt.min_count).select("seq_id", "pos", F.lit(1).alias("type"))
    run = islands(low).withColumn("streak", F.col("end") - F.col("first")).filter(F.col("streak") > opt.min_streak)
    return run.join(seqs.select("seq_id", "name"), "seq_id").select("seq_id", "name", (F.col("first") + 1 - k).alias("start"), "end", "streak")
