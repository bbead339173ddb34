"""Parental origin of sequences, and phasing errors, from the parents' k-mers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.bases import ceil_div, parent_type
from strandloom.operators.islands import islands
from strandloom.operators.kmers import windows
from strandloom.operators.lookup import annotate_known
from strandloom.operators.options import TrioOptions


def typed_islands(seqs: DataFrame, flags: DataFrame, k: int) -> DataFrame:
    """Runs of strong k-mers of one parent; only typed positions are joined out and ordered."""
    typed = flags.withColumn("type", parent_type(F.col("flag"))).filter("type > 0").select("kmer", "type")
    occ = annotate_known(seqs, typed, k).select("seq_id", "pos", "type")
    return islands(occ)


def classify(k: int, s0, s1, p, m, ratio: float):
    """``p``, ``m``, ``a`` (both) or ``0`` (neither) from the run lengths and counts of both parents; the first rule that holds."""
    alone = (
        F.when(p == m, "0")
        .when((p >= k - 4 + m) & ((m <= 1) | (p * 0.05 > m)), "p")
        .when((m >= k - 4 + p) & ((p <= 1) | (m * 0.05 > p)), "m")
        .otherwise("0")
    )
    return (
        F.when((s0 == 0) & (s1 == 0), alone)
        .when((s0 > k) & (s1 > k), "a")
        .when((s0 >= k - 4 + s1) & (s0 * 0.05 >= s1) & (p * ratio > m), "p")
        .when((s1 >= k - 4 + s0) & (s1 * 0.05 >= s0) & (m * ratio > p), "m")
        .otherwise("a")
    )


def binning(seqs: DataFrame, flags: DataFrame, k: int, opt: TrioOptions = TrioOptions()) -> DataFrame:
    """A row for every sequence: ``(seq_id, name, type, sc0, sc1, c2, c8, c1, c4, nk, c0)``."""
    hits = annotate_known(seqs, flags.filter("flag <> 0"), k)
    per = hits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("known"), *(F.count(F.when(F.col("flag") == f, 1)).alias(f"c{f}") for f in (1, 2, 4, 8)))
    long = typed_islands(seqs, flags, k).withColumn("n", F.col("end") - F.col("first")).filter(F.col("n") >= k - 4)
    bases = long.groupBy("seq_id").agg(*(F.sum(F.when(F.col("type") == i + 1, F.col("n")).otherwise(0)).alias(f"sc{i}") for i in (0, 1)))
    names = ["known", "c1", "c2", "c4", "c8", "sc0", "sc1"]
    all_ = seqs.select("seq_id", "name", windows("seq", k).alias("nk")).join(per, "seq_id", "left").join(bases, "seq_id", "left").fillna(0, ["nk", *names])
    kind = classify(k, F.col("sc0"), F.col("sc1"), F.col("c2"), F.col("c8"), opt.ratio)
    return all_.select("seq_id", "name", kind.alias("type"), "sc0", "sc1", "c2", "c8", "c1", "c4", "nk", (F.col("nk") - F.col("known")).alias("c0"))


def differences(seqs: DataFrame, flags: DataFrame, k: int) -> DataFrame:
    """``(seq_id, name, pos, pat, mat)`` of the positions where the parents' levels differ."""
    pat, mat = F.col("flag").bitwiseAND(F.lit(3)), F.shiftright("flag", 2).bitwiseAND(F.lit(3))
    unequal = flags.select("kmer", pat.alias("pat"), mat.alias("mat")).filter("pat <> mat")
    return annotate_known(seqs, unequal, k, "name").select("seq_id", "name", "pos", "pat", "mat")


def streaks(seqs: DataFrame, flags: DataFrame, k: int, opt: TrioOptions = TrioOptions()) -> DataFrame:
    """Runs of at least ``min_streak`` positions with the type of the one before: ``(seq_id, type, first, end, last)``."""
    long = typed_islands(seqs, flags, k).filter(F.col("end") - F.col("first") >= opt.min_streak)
    return long.withColumn("last", F.lag("type").over(Window.partitionBy("seq_id").orderBy("first")))


def phasing(seqs: DataFrame, flags: DataFrame, k: int, opt: TrioOptions = TrioOptions()) -> DataFrame:
    """A row for every sequence: ``(seq_id, name, d0, d1, c00, c01, c10, c11, len)``."""
    n = ceil_div(F.col("end") - F.col("first"), k)
    run = streaks(seqs, flags, k, opt).withColumn("n", n)
    cell = lambda a, b: F.sum((F.when(F.col("type") == a, F.col("n") - 1).otherwise(0) if a == b else F.lit(0)) + F.when((F.col("last") == a) & (F.col("type") == b), 1).otherwise(0))
    got = run.groupBy("seq_id").agg(*(F.sum(F.when(F.col("type") == t, F.col("n")).otherwise(0)).alias(f"d{t - 1}") for t in (1, 2)), *(cell(a, b).alias(f"c{a - 1}{b - 1}") for a in (1, 2) for b in (1, 2)))
    names = ["d0", "d1", "c00", "c01", "c10", "c11"]
    return seqs.select("seq_id", "name", F.col("len").cast("long").alias("len")).join(got, "seq_id", "left").fillna(0, names).select("seq_id", "name", *names, "len")


def phase_errors(seqs: DataFrame, flags: DataFrame, k: int, opt: TrioOptions = TrioOptions()) -> DataFrame:
    """``(seq_id, name, pos, prev, cur)`` where the type switches; pos is the end of the new run."""
    run = streaks(seqs, flags, k, opt).filter("last <> type")
    return run.join(seqs.select("seq_id", "name"), "seq_id").select("seq_id", "name", F.col("end").alias("pos"), F.col("last").alias("prev"), F.col("type").alias("cur"))


def fragments(seqs: DataFrame, flags: DataFrame, k: int, opt: TrioOptions = TrioOptions()) -> DataFrame:
    """``(seq_id, name, type, st, en, n)``: neighbouring runs of one type joined.

    ``en`` is one past the exclusive end, as the format has it, so it can exceed the sequence by one.
    """
    order = Window.partitionBy("seq_id").orderBy("first")
    nth = F.sum(F.when(F.col("last") == F.col("type"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = streaks(seqs, flags, k, opt).withColumn("nth", nth).groupBy("seq_id", "nth", "type").agg((F.min("first") + 1 - k).alias("st"), (F.max("end") + 1).alias("en"), F.count(F.lit(1)).alias("n"))
    return run.join(seqs.select("seq_id", "name"), "seq_id").select("seq_id", "name", "type", "st", "en", "n")


def phasing_totals(per: DataFrame) -> DataFrame:
    """Switch (W), Hamming (H) and parental (N) totals ``(kind, num, den, rate)`` of ``phasing`` rows; a rate over 0 is null."""
    counted = F.col("d0") + F.col("d1") >= 2
    over = lambda c: F.coalesce(F.sum(F.when(counted, c)), F.lit(0))
    t = per.agg(
        over(F.col("c01") + F.col("c10")).alias("switch"), over(F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")).alias("pair"),
        over(F.least("d0", "d1")).alias("err"), over(F.col("d0") + F.col("d1")).alias("site"),
        F.coalesce(F.sum("d0"), F.lit(0)).alias("p0"), F.coalesce(F.sum("d1"), F.lit(0)).alias("p1"),
    )
    row = lambda kind, a, b, num, den: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("num"), b.cast("long").alias("den"), F.try_divide(num.cast("double"), den).alias("rate"))
    c = F.col
    rows = F.array(row("W", c("switch"), c("pair"), c("switch"), c("pair")), row("H", c("err"), c("site"), c("err"), c("site")), row("N", c("p0"), c("p1"), F.least("p0", "p1"), c("p0") + c("p1")))
    return t.select(F.inline(rows))
