"""Flag tables and the join of k-mer occurrences with a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strandloom.operators import table as tables
from strandloom.operators.kmers import dealt, explode_codes, parts_of, windows
from strandloom.operators.options import TrioOptions


def trio_flags(first: DataFrame, second: DataFrame, opt: TrioOptions = TrioOptions()) -> DataFrame:
    """``(kmer, flag)``: two bits a parent, 2 for counts of at least mid, 1 of at least min; the second parent's shifted by two."""
    level = F.when(F.col("cnt") >= opt.mid_count, 2).when(F.col("cnt") >= opt.min_count, 1)
    sides = [t.select("kmer", F.shiftleft(level, s).cast("int").alias("flag")).filter("flag is not null") for t, s in ((first, 0), (second, 2))]
    return sides[0].unionAll(sides[1]).groupBy("kmer").agg(F.bit_or("flag").alias("flag"))


def set_flags(*members: DataFrame) -> DataFrame:
    """``(kmer, flag)``: bit i for membership of table i, whatever the counts."""
    return reduce(DataFrame.unionAll, [t.select("kmer", F.lit(1 << i).alias("flag")) for i, t in enumerate(members)]).groupBy("kmer").agg(F.bit_or("flag").alias("flag"))


def _side(table: DataFrame, k: int) -> DataFrame:
    """The packed table as a side of a join; one of short k-mers is broadcast, as its size has a bound that no input moves."""
    table = tables.packed(table, k)
    return F.broadcast(table) if k <= tables.SHORT else table


def totals(seqs: DataFrame, k: int) -> DataFrame:
    """``(seq_id, tot)``: the number of k-mers of each sequence."""
    return seqs.groupBy("seq_id").agg(F.sum(F.coalesce(windows("seq", k), F.lit(0))).alias("tot"))


def annotate(seqs: DataFrame, table: DataFrame, k: int, *keys: str) -> DataFrame:
    """Every occurrence ``(seq_id, *keys, pos, kmer)`` with the table's value, null where it has none; k-mers are packed."""
    occ = explode_codes(seqs, k, "seq_id", *keys)
    return (occ if k <= tables.SHORT else dealt(occ, parts_of(seqs), "kmer")).join(_side(table, k), "kmer", "left")


def annotate_known(seqs: DataFrame, table: DataFrame, k: int, *keys: str) -> DataFrame:
    """The occurrences ``(seq_id, *keys, pos, kmer)`` that the table holds, with its value; k-mers are packed."""
    occ = explode_codes(seqs, k, "seq_id", *keys)
    return (occ if k <= tables.SHORT else dealt(occ, parts_of(seqs), "kmer")).join(_side(table, k), "kmer")


def annotate_bags(seqs: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """``(seq_id, n)`` with the table's value for the k-mers that the table holds, dealt by sequence.

    Long k-mers are counted within their sequence before they are dealt to the table; short ones meet it where they are.
    """
    occ, parts = explode_codes(seqs, k).select("seq_id", "kmer"), parts_of(seqs)
    if k <= tables.SHORT:
        return occ.withColumn("n", F.lit(1).cast("long")).join(_side(table, k), "kmer").drop("kmer")
    bags = occ.groupBy("seq_id", "kmer").agg(F.count(F.lit(1)).alias("n"))
    return dealt(dealt(bags, parts, "kmer").join(_side(table, k), "kmer").drop("kmer"), parts, "seq_id")
