"""Registered queries over the driver's tables.

Sequences are the base letters of ``documents``; samples are sources. Table A holds sources below 10 and B all others; the
parents are English and French documents; the sex tables are three parts of all sources, haplotypes the parity of the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.functions.bases import decode, encode, hash_code, saturated
from strandloom.operators import compare, kmers, lookup, quality, regions, sexchr, table as tables, trio
from strandloom.operators.options import QualityOptions
from strandloom.plans.oracle import ORACLE
from strandloom.sources.sequences import from_documents, raw_documents

K = 21
SHORT = 11

#: Bytes of files for each partition: about 2.5 million k-mers.
PART_BYTES = 8 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    """The table, dealt by document to as many partitions as it has ``PART_BYTES``, so that tasks don't grow with it.

    The number stands in the metadata of the id, where operators find it (``kmers.parts_of``). What is grouped by document needs no other exchange.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return docs.repartition(parts, "doc_id").withMetadata("doc_id", {"parts": parts})


def sequences(spark, sf_dir: str) -> DataFrame:
    return from_documents(documents(spark, sf_dir))


def part(seqs: DataFrame, low: int, high: int | None = None) -> DataFrame:
    """Sources from ``low`` on, up to ``high``; without it also those that have no number, so that parts add up to all."""
    source = F.substring("sample", 4, 10).try_cast("int")
    return seqs.filter(source.between(low, high)) if high is not None else seqs.filter(F.coalesce(source >= low, F.lit(True)))


def _low(s: DataFrame) -> DataFrame:
    return s.filter(F.substring("sample", 4, 10).try_cast("int") < 10)


def _a(s: DataFrame, k: int = K) -> DataFrame:
    return tables.count_packed(_low(s), k)


def _b(s: DataFrame, k: int = K) -> DataFrame:
    return tables.count_packed(part(s, 10), k)


def _sex_tables(s: DataFrame) -> list[DataFrame]:
    low = F.substring("sample", 4, 10).try_cast("int")
    return [tables.count_packed(x, SHORT) for x in (s.filter(low < 7), part(s, 7, 13), part(s, 14))]


def _flags(s: DataFrame) -> DataFrame:
    return lookup.trio_flags(tables.count_packed(s.filter("lang = 'en'"), SHORT), tables.count_packed(s.filter("lang = 'fr'"), SHORT))


def _windows(s: DataFrame) -> DataFrame:
    """Overlapping windows of 100 bases, so that the spectrum has a coverage peak."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("seq") - 100), F.lit(5))
    return s.filter("len > 0").select("seq_id", "name", F.explode(starts).alias("st"), "seq").select("seq_id", "name", F.substring(F.col("seq"), F.col("st") + 1, F.lit(100)).alias("seq"))


def _window_counts(s: DataFrame, k: int) -> DataFrame:
    """``tables.count(_windows(s), k)`` without the windows."""
    return tables.spelled(_packed_window_counts(s, k))


def _packed_window_counts(s: DataFrame, k: int) -> DataFrame:
    """A k-mer counts once for each window that holds it, as its position tells."""
    last = F.floor(F.greatest(F.lit(0), F.col("len") - 100) / 5)
    held = F.least(last, F.floor((F.col("pos") - (k - 1)) / 5)) - F.greatest(F.lit(0), F.ceil((F.col("pos") - 99) / 5)) + 1
    occ = kmers.explode_codes(s, k, "seq_id", "len").select("kmer", held.alias("held")).filter("held > 0")
    return tables.with_k(tables.tally(occ, k, F.col("held"), kmers.parts_of(s)).select("kmer", saturated("n").alias("cnt")), k)


def _mutated(s: DataFrame) -> DataFrame:
    """Bases at 0-based positions 199, 599, 999, ... are replaced by the next letter of A, C, G, T, A."""
    n = F.floor((F.length("seq") + 200) / 400).cast("int")
    piece = lambda i: F.concat(F.substring(F.col("seq"), F.when(i == 0, 1).otherwise(i * 400 - 199), F.when(i == 0, 199).otherwise(399)), F.translate(F.substring(F.col("seq"), i * 400 + 200, F.lit(1)), "ACGT", "CGTA"))
    return s.withColumn("seq", F.when(n > 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), piece), ""), F.substring(F.col("seq"), n * 400 - 199, F.length("seq")))).otherwise(F.col("seq")))


def _sex(s: DataFrame) -> DataFrame:
    flags = lookup.set_flags(*_sex_tables(s))
    return sexchr.sex_counts(s.withColumn("hap", (F.col("seq_id") % 2 + 1).cast("int")), flags, SHORT)


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


def _solved(s: DataFrame) -> DataFrame:
    """The model over windows of all sources, read against mutated sequences of the same."""
    spec = quality.spectrum(_mutated(s), _packed_window_counts(s, K), K).withColumn("grp", F.lit("all"))
    return _round(quality.solve_groups(spec, K).drop("adj"), qv_raw=3, qv=3, cov=3, err=3, fpr_lower=6, fpr_upper=6)


def _solved_bins(s: DataFrame) -> DataFrame:
    """The model over short k-mers of part B against part A."""
    spec = quality.spectrum(part(s, 10), _a(s, SHORT), SHORT).withColumn("grp", F.lit(1))
    return _round(quality.solve_groups(spec, SHORT), qv_raw=3, qv=3, cov=3, err=3).select("tot", "qv_raw", "qv", "cov", "err", "max_c", "min_c")


def _over(f):
    return lambda spark, sf_dir: f(sequences(spark, sf_dir))


def _spelled(f):
    return _over(lambda s: tables.spelled(f(s)))


QUERIES = {
    "kmer_extract": _over(lambda s: kmers.explode_kmers(s, K)),
    "kmer_breaks": lambda spark, sf_dir: kmers.explode_kmers(raw_documents(documents(spark, sf_dir)), 4),
    "kmer_long_k33": _over(lambda s: tables.count(s, 33)),
    "kmer_count": _over(lambda s: tables.count(s, K)),
    "kmer_count_k31": _over(lambda s: tables.count(s, 31)),
    "kmer_count_min2": _over(lambda s: tables.count(s, K, 2)),
    "kmer_count_two_file": _over(lambda s: tables.count_two(_low(s), part(s, 10), K)),
    "kmer_distinct": _over(lambda s: tables.distinct_kmers(tables.count_packed(s, K))),
    "kmer_hist": _over(lambda s: tables.histogram(tables.count_packed(s, K))),
    "kmer_shrink": _over(lambda s: tables.shrink(tables.count(s, SHORT), 2, 10)),
    "kmer_shrink_open": _over(lambda s: tables.shrink(tables.count(s, SHORT), 50, 0)),
    "kmer_setcnt": _over(lambda s: tables.set_count(tables.count(s, SHORT), 7)),
    "kmer_clear": _over(lambda s: tables.clear(tables.count(s, SHORT))),
    "kmer_recount": _spelled(lambda s: tables.recount(_a(s), part(s, 10), K)),
    "kmer_cntasm": _over(lambda s: tables.collate(s, 7, 1, 60)),
    "kmer_cntasm_maxout": _over(lambda s: tables.collate(s, SHORT, 1, 2, max_out=12)),
    "kmer_cntasm_seed": _over(lambda s: tables.collate(part(s, 10), SHORT, 1, 2, max_out=4, seed=tables.set_count(_a(s, SHORT), 1))),
    "kmer_merge": _spelled(lambda s: tables.merge(_a(s), _b(s), 1, 3)),
    "kmer_subtract": _spelled(lambda s: tables.subtract(_a(s), _b(s))),
    "kmer_isec2": _spelled(lambda s: tables.intersect(_a(s), _b(s))),
    "kmer_isec3": _spelled(lambda s: tables.intersect(*(tables.count_packed(x, SHORT) for x in (part(s, 0, 6), part(s, 7, 12), part(s, 13))))),
    "kmer_print": _over(lambda s: tables.listing(tables.count(s, SHORT))),
    "kmer_codes": _over(lambda s: tables.count(s, SHORT).select("kmer", encode(F.col("kmer")).alias("code"), decode(encode(F.col("kmer")), SHORT).alias("decoded"))),
    "kmer_hash": _over(lambda s: tables.count(s, SHORT).select("kmer", hash_code(encode(F.col("kmer")), SHORT).alias("hash"))),
    "qv_seq": _over(lambda s: _round(quality.per_sequence(part(s, 10), _a(s), K), qv=2)),
    "qv_seq_minlen": _over(lambda s: _round(quality.per_sequence(part(s, 10), _a(s), K, QualityOptions(min_len=300)), qv=2)),
    "qv_err_kmers": _over(lambda s: quality.absent_kmers(part(s, 10), _a(s), K)),
    "qv_spectrum": _over(lambda s: quality.spectrum(part(s, 10), _a(s, SHORT), SHORT)),
    "qv_raw": _over(lambda s: _round(quality.raw_summary(quality.spectrum(part(s, 10), _a(s, SHORT), SHORT), SHORT), qv_raw=3)),
    "qv_solve": _over(_solved),
    "qv_solve_bins": _over(_solved_bins),
    "trio_flags": _spelled(_flags),
    "triobin": _over(lambda s: trio.binning(s, _flags(s), SHORT)),
    "triobin_diff": _over(lambda s: trio.differences(s, _flags(s), SHORT)),
    "trioeval_seq": _over(lambda s: trio.phasing(s, _flags(s), SHORT)),
    "trioeval_err": _over(lambda s: trio.phase_errors(s, _flags(s), SHORT)),
    "trioeval_frag": _over(lambda s: trio.fragments(s, _flags(s), SHORT)),
    "trioeval_totals": _over(lambda s: _round(trio.phasing_totals(trio.phasing(s, _flags(s), SHORT)), rate=6)),
    "chkerr": _over(lambda s: regions.low_support(part(s, 10), _a(s, SHORT), SHORT)),
    "sexchr_flags": _spelled(lambda s: lookup.set_flags(*_sex_tables(s))),
    "sexchr": _over(_sex),
    "groupxy": _over(lambda s: sexchr.partition(_sex(s), sexchr.PartitionOptions(0.3, 0.2, 0.5))),
    "inspect_hist": _over(lambda s: compare.histogram_rows(tables.count_packed(s, SHORT))),
    "inspect_cross": _over(lambda s: compare.cross_counts(_a(s, SHORT), _b(s, SHORT))),
    "inspect_sn": _over(lambda s: _round(compare.sensitivity(_a(s, SHORT), _b(s, SHORT)), frac=4)),
    "inspect_qv": _over(lambda s: _round(compare.qualities(_a(s, SHORT), _b(s, SHORT), SHORT), qv_raw=3, qv=3)),
}
