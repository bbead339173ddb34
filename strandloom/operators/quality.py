"""Base quality of sequences against a k-mer table, and the adjusted model of the whole spectrum."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from strandloom.functions.bases import MAX_COUNT, phred, raw_quality
from strandloom.operators import table as tables
from strandloom.operators.lookup import annotate, annotate_bags, totals
from strandloom.operators.options import QualityOptions

#: Highest degree of the fit, steps it looks at, least factor of the extension (fixed values of the model).
DEGREE, STEPS, LEAST = 2, 8, 1.01


def of_length(seqs: DataFrame, min_len: int) -> DataFrame:
    """Sequences of at least so many bases. The condition stays where it is: below the caller's exchange it would make each sequence a second time."""
    return seqs.filter((F.col("len") >= min_len) | (F.spark_partition_id() < 0))


def per_sequence(seqs: DataFrame, table: DataFrame, k: int, opt: QualityOptions = QualityOptions()) -> DataFrame:
    """``(seq_id, name, len, tot, non0, qv)`` of every sequence of at least ``min_len`` bases."""
    kept = of_length(seqs, opt.min_len)
    hits = annotate_bags(kept, table.filter("cnt > 0"), k).groupBy("seq_id").agg(F.sum("n").alias("non0"))
    all_ = kept.select("seq_id", "name", "len").join(totals(kept, k), "seq_id", "left").join(hits, "seq_id", "left").fillna(0, ["tot", "non0"])
    return all_.withColumn("qv", phred(F.col("tot"), F.col("non0"), k))


def absent_kmers(seqs: DataFrame, table: DataFrame, k: int, opt: QualityOptions = QualityOptions()) -> DataFrame:
    """``(seq_id, name, start)`` of the windows whose k-mer the table has not."""
    kept = of_length(seqs, opt.min_len)
    return annotate(kept, table, k, "name").filter(F.coalesce("cnt", F.lit(0)) == 0).select("seq_id", (F.col("pos") + 1 - k).alias("start"), "name")


def spectrum(seqs: DataFrame, table: DataFrame, k: int, opt: QualityOptions = QualityOptions()) -> DataFrame:
    """``(c, hist, cnt)`` for every count c: k-mers of the table with it, and occurrences in the sequences kept.

    A sequence is kept if at least ``min_frac`` of its k-mers are in the table.
    """
    long_ = of_length(seqs, opt.min_len)
    by = annotate_bags(long_, table.filter("cnt > 0"), k).groupBy("seq_id", F.col("cnt").alias("c")).agg(F.sum("n").alias("n"))
    # at most 1,023 rows a sequence are left; a second group-by on the same key instead of a join with the first
    sums = by.groupBy("seq_id").agg(F.sum("n").alias("non0"), F.collect_list(F.struct("c", "n")).alias("bins"))
    all_ = totals(long_, k).join(sums, "seq_id", "left").withColumn("non0", F.coalesce("non0", F.lit(0)))
    absent = F.array(F.struct(F.lit(0).alias("c"), (F.col("tot") - F.col("non0")).alias("n")))
    kept = all_.filter((F.col("tot") > 0) & (F.col("non0") >= F.col("tot") * opt.min_frac)).select(F.inline(F.when(F.col("bins").isNull(), absent).otherwise(F.concat("bins", absent))))
    cnt = kept.groupBy("c").agg(F.sum("n").alias("cnt"))
    return tables.histogram(table).withColumnRenamed("n", "hist").join(cnt, "c", "left").fillna(0, ["cnt"])


def raw_summary(spec: DataFrame, k: int) -> DataFrame:
    """``(tot, absent, qv_raw)`` of a spectrum."""
    return spec.agg(F.sum("cnt").alias("tot"), F.sum(F.when(F.col("c") == 0, F.col("cnt")).otherwise(0)).alias("absent")).withColumn("qv_raw", raw_quality(F.col("tot"), F.col("absent"), k))


def solve(hist, cnt, k: int, fpr: float = 4e-5) -> dict:
    """The adjusted model on dense arrays over counts.

    The peak of ``cnt`` gives the coverage and the valley before it where errors end; bins between are cleared of false
    positives, a parabola through the ratios of neighbouring bins extends them down to zero, and what the extended spectrum lacks are errors.
    A fit that is not finite leaves the raw quality.
    """
    hist, cnt = np.asarray(hist, float), np.asarray(cnt, float)
    tot, qv_raw = cnt.sum(), -1.0
    decibel = lambda good: -10 * np.log10(np.log(tot / good) / k) if good < tot else np.inf
    if tot > cnt[0]:
        qv_raw = float(decibel(tot - cnt[0]))
    out = {"tot": int(tot), "qv_raw": qv_raw, "qv": -1.0, "cov": None, "err": float(cnt[0]), "fpr_lower": 0.0, "fpr_upper": 1.0, "max_c": -1, "min_c": -1, "adj": cnt.copy()}
    inner = cnt[2:-1]
    if not len(inner) or inner.max() <= 0:
        return out
    peak = 2 + int(inner.argmax())
    valley = 2 + int(cnt[2:peak].argmin()) if peak > 2 else -1
    with np.errstate(all="ignore"):
        cov = float(np.float64(cnt[peak]) / hist[peak])
        seen = cnt[2:peak] / (cov * hist[2:peak])
        upper = float(min(1.0, np.nanmin(seen, initial=np.inf)))
        fpr = upper / 2 if fpr > upper else fpr
        lower = 0.0
        if valley > 2 and hist[2] > hist[valley]:
            lower = float(max(0.0, (cnt[2] - cnt[valley]) / (cov * (hist[2] - hist[valley]))))
        fpr = max(fpr, lower)
        out |= {"cov": cov, "fpr_lower": lower, "fpr_upper": upper, "max_c": peak, "min_c": valley}
        n = min(peak - valley + 1, STEPS)
        if peak <= 4 or n < 3:
            return out
        adj, mid = out["adj"], slice(valley, peak)
        adj[mid] = np.maximum(0.0, cnt[mid] - (hist[mid] - cnt[mid] / cov) / (1 - fpr) * cov * fpr)
        x = valley + np.arange(n, dtype=float)
        y = adj[valley + 1 : valley + n + 1] / adj[valley : valley + n]
        if not np.isfinite(y).all():
            return out | {"qv": qv_raw}
        fit = np.linalg.lstsq(np.vander(x, DEGREE + 1, increasing=True), y, rcond=None)[0]
        below = np.arange(valley - 1, -1, -1, dtype=float)
        factor = np.maximum(LEAST, np.vander(below, DEGREE + 1, increasing=True) @ fit)
        adj[:valley] = (adj[valley] / np.cumprod(factor))[::-1]
        good = adj.sum()
        return out | ({"err": float(tot - good), "qv": float(decibel(good))} if good <= tot else {"err": 0.0, "qv": qv_raw})


SOLVED = "tot long, qv_raw double, qv double, cov double, err double, fpr_lower double, fpr_upper double, max_c int, min_c int, adj array<double>"


def solve_groups(spec: DataFrame, k: int, fpr: float = 4e-5, by: str = "grp") -> DataFrame:
    """One solved row for each group of ``spec(by, c, hist, cnt)``; a group has at most 1,024 rows."""
    kind = spec.schema[by].dataType.simpleString()

    def one(key, pdf):
        dense = np.zeros((2, MAX_COUNT + 1))
        dense[0, pdf["c"]], dense[1, pdf["c"]] = pdf["hist"], pdf["cnt"]
        got = solve(dense[0], dense[1], k, fpr)
        return pd.DataFrame([{by: key[0], **got, "adj": got["adj"].tolist()}])

    return spec.select(by, "c", "hist", "cnt").groupBy(by).applyInPandas(one, f"{by} {kind}, {SOLVED}")
