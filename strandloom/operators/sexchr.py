"""Sex-chromosome k-mers of haplotype contigs, and the partition that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.operators.lookup import annotate_bags, totals
from strandloom.operators.options import PartitionOptions


def sex_counts(seqs: DataFrame, flags: DataFrame, k: int) -> DataFrame:
    """A row for every sequence of ``seqs(seq_id, name, hap, seq)``: ``(seq_id, name, hap, nk, ns, n1, n2)``.

    ``ns`` counts k-mers of any of the flag tables, n1 and n2 those of the first or second alone.
    """
    flag = F.col("flag")
    part = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias(name)
    got = annotate_bags(seqs, flags.filter("flag > 0"), k).groupBy("seq_id").agg(F.sum("n").alias("ns"), part(flag == 1, "n1"), part(flag == 2, "n2"))
    all_ = seqs.select("seq_id", "name", "hap").join(totals(seqs, k).withColumnRenamed("tot", "nk"), "seq_id", "left").join(got, "seq_id", "left")
    return all_.fillna(0, ["nk", "ns", "n1", "n2"])


def partition(rows: DataFrame, opt: PartitionOptions = PartitionOptions()) -> DataFrame:
    """``rows`` with ``part`` 1 or 2: contigs of one sex chromosome go together, the others stay with their haplotype or swap with it."""
    both = F.col("n1") + F.col("n2")
    clear = (F.col("ns") >= F.col("nk") * opt.min_sex) & (both >= F.col("ns") * opt.min_specific)
    chrom = F.when(clear & (F.col("n1") > both * opt.min_ratio), 1).when(clear & (F.col("n2") > both * opt.min_ratio), 2)
    marked = rows.withColumn("chrom", chrom)
    total = lambda hap, c: F.coalesce(F.sum(F.when(F.col("chrom").isNotNull() & (F.col("hap") == hap), F.col(c))), F.lit(0))
    sums = marked.agg(*(total(h, c).alias(f"h{h}{c}") for h in (1, 2) for c in ("n1", "n2")))
    first = F.col("h1n1") + F.col("h2n1") > F.col("h1n2") + F.col("h2n2")
    ahead = F.when(first, F.col("h1n1") > F.col("h2n1")).otherwise(F.col("h1n2") > F.col("h2n2"))
    straight = sums.select((first == ahead).alias("straight"))  # one row
    part = F.coalesce("chrom", F.when(F.col("straight"), F.col("hap")).otherwise(3 - F.col("hap")))
    return marked.crossJoin(F.broadcast(straight)).withColumn("part", part.cast("int")).drop("chrom", "straight")
