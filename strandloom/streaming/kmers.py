"""Streaming forms: counts that grow with arriving sequences, and the join of a stream with a fixed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.functions.bases import saturated
from strandloom.operators.kmers import explode_kmers


def counts(seqs: DataFrame, k: int) -> DataFrame:
    """Running counts of a stream of sequences; write it in update or complete mode."""
    return explode_kmers(seqs, k).groupBy("kmer").agg(saturated(F.count(F.lit(1))).alias("cnt"))


def annotate(seqs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Occurrences of a stream with the value of a batch table."""
    return explode_kmers(seqs, k).join(table, "kmer", "left")


def read_sequences(spark, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet sequence files ``(seq_id long, name string, seq string)``, so many files a batch."""
    return spark.readStream.schema("seq_id long, name string, seq string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
