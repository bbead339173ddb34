"""K-mer tables ``(kmer, cnt)``: counting, set algebra, histograms, storage.

A table's k stands in the metadata of its ``kmer`` column, which Parquet files and derived tables keep, rows or not;
operators on several tables refuse tables of different k. Inside a query tables are packed: ``kmer`` is a number (``packed``),
which ``spelled`` turns into text at the end. Operators take either form, all of their tables in one form.

Every combination of tables is an equi-join or a group-by on ``kmer``; tables saved with ``save`` are bucketed by it, so these
need no exchange between saved tables of equal bucket number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strandloom.functions.bases import MAX_COUNT, pack, saturated, spell
from strandloom.operators.kmers import dealt, explode_codes, parts_of


def told_k(table: DataFrame) -> int | None:
    """The k of a table, None if it doesn't say."""
    return table.schema["kmer"].metadata.get("k")


def with_k(table: DataFrame, k: int | None) -> DataFrame:
    return table if k is None else table.withMetadata("kmer", {"k": k})


def same_k(*tables: DataFrame, k: int | None = None) -> int | None:
    """The one k that the tables, and the caller, tell of; another one is an error."""
    found = {t for t in (k, *map(told_k, tables)) if t is not None}
    if len(found) > 1:
        raise ValueError(f"tables of different k: {sorted(found)}")
    return found.pop() if found else None


#: Tables of at most so many bases have 4 ** 11 / 2 rows at most, whatever the input: partial sums help, and joins broadcast them.
SHORT = 11


def is_packed(table: DataFrame) -> bool:
    return table.schema["kmer"].dataType.typeName() != "string"


def packed(table: DataFrame, k: int) -> DataFrame:
    """The table with numbers for k-mers; rows whose text is no k-mer of k bases, which match nothing, are left out."""
    if is_packed(table):
        return table
    bases_only = (F.length("kmer") == k) & (F.translate("kmer", "ACGT", "") == "")
    return with_k(table.filter(bases_only).withColumn("kmer", pack(F.col("kmer"), k)), k)


def spelled(table: DataFrame) -> DataFrame:
    """The table with text for k-mers; a packed one says its k."""
    if not is_packed(table):
        return table
    k = told_k(table)
    return with_k(table.withColumn("kmer", spell(F.col("kmer"), k)), k)


def tally(occ: DataFrame, k: int, weight=None, parts: int | None = None) -> DataFrame:
    """``(kmer, n)`` of packed occurrences: their number, or the sum of a weight.

    Long k-mers hardly repeat in a task, so they are dealt to ``parts`` partitions before they are counted.
    """
    occ = occ if k <= SHORT else dealt(occ, parts, "kmer")
    return occ.groupBy("kmer").agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))


def count_packed(seqs: DataFrame, k: int, min_count: int = 1) -> DataFrame:
    """``count`` with numbers for k-mers."""
    n = tally(explode_codes(seqs, k).select("kmer"), k, parts=parts_of(seqs))
    return with_k(n.filter(F.col("n") >= min_count).select("kmer", saturated("n").alias("cnt")), k)


def count(seqs: DataFrame, k: int, min_count: int = 1) -> DataFrame:
    """Saturating counts of canonical k-mers seen ``min_count`` times or more."""
    return spelled(count_packed(seqs, k, min_count))


def count_two(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Counts in ``second`` of the k-mers seen twice or more in ``first``, of those seen twice or more there too."""
    return spelled(intersect(count_packed(second, k, 2), count_packed(first, k, 2)))


def recount(table: DataFrame, seqs: DataFrame, k: int) -> DataFrame:
    """The table's k-mers with their counts in ``seqs``; unseen ones stay with 0."""
    k = same_k(table, k=k)
    seen = count_packed(seqs, k) if is_packed(table) else count(seqs, k)
    return with_k(table.select("kmer").join(seen, "kmer", "left").select("kmer", F.coalesce("cnt", F.lit(0)).alias("cnt")), k)


def shrink(table: DataFrame, low: int, high: int = MAX_COUNT) -> DataFrame:
    """Rows with counts in [low, high]; a ``high`` below ``low`` or over the maximum means no upper bound."""
    high = MAX_COUNT if high < low or high > MAX_COUNT else high
    return table.filter(F.col("cnt").between(low, high))


def set_count(table: DataFrame, value: int) -> DataFrame:
    return table.select("kmer", F.lit(value).cast("int").alias("cnt"))


def clear(table: DataFrame) -> DataFrame:
    return set_count(table, 0)


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows whose k-mer is not in ``right``."""
    k = same_k(left, right)
    return with_k(left.join(right.select("kmer"), "kmer", "left_anti"), k)


def intersect(left: DataFrame, *others: DataFrame) -> DataFrame:
    """Left rows whose k-mer is in all the others; left counts stay.

    The others are one union and one group-by, so n tables take one join.
    """
    k = same_k(left, *others)
    if len(others) == 1:
        return with_k(left.join(others[0].select("kmer"), "kmer", "left_semi"), k)
    every = reduce(DataFrame.unionAll, [o.select("kmer").distinct() for o in others]).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return with_k(left.join(every.filter(F.col("n") == len(others)), "kmer", "left_semi"), k)


def merge(left: DataFrame, right: DataFrame, low: int = 1, high: int = MAX_COUNT) -> DataFrame:
    """Left counts plus one for each right row with a count in [low, high]; such rows not in left enter with 1."""
    k = same_k(left, right)
    added = shrink(right, low, high).select("kmer", F.lit(1).alias("more"))
    # a join, as tables that are dealt by k-mer already need no exchange for it
    return with_k(left.join(added, "kmer", "full").select("kmer", saturated(F.coalesce("cnt", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("cnt")), k)


def collate(samples: DataFrame, k: int, low: int = 1, high: int = 1, max_out: int = 0, seed: DataFrame | None = None, sample_col: str = "sample", n_samples: int | None = None) -> DataFrame:
    """In how many samples a k-mer has a count in [low, high], of those in all but ``max_out`` samples or more.

    One plan for all samples. A ``seed`` table's counts are added, but the threshold counts only the new samples.
    ``n_samples`` defaults to the number of distinct samples, those without k-mers included.
    """
    same_k(*(t for t in [seed] if t is not None), k=k)
    n = n_samples if n_samples is not None else samples.select(sample_col).distinct().count()
    per = explode_codes(samples, k, sample_col).groupBy(sample_col, "kmer").agg(saturated(F.count(F.lit(1))).alias("cnt"))
    rows = set_count(shrink(per, low, high), 1)
    rows = rows.unionAll(packed(seed, k).select("kmer", "cnt")) if seed is not None else rows
    found = rows.groupBy("kmer").agg(saturated(F.sum("cnt")).alias("cnt"))
    return spelled(with_k(found.filter(F.col("cnt") >= n - max_out), k))


def histogram(table: DataFrame) -> DataFrame:
    """``(c, n)`` for every count from 0 to the maximum."""
    spark = table.sparkSession
    got = table.groupBy(F.col("cnt").cast("long").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    return spark.range(MAX_COUNT + 1).withColumnRenamed("id", "c").join(got, "c", "left").select(F.col("c").cast("int"), F.coalesce("n", F.lit(0)).alias("n"))


def distinct_kmers(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("tot"))


def listing(table: DataFrame, with_count: bool = True) -> DataFrame:
    return table.select("kmer", "cnt") if with_count else table.select("kmer")


def save(table: DataFrame, name: str, k: int, buckets: int = 64) -> None:
    """A catalogue table bucketed and sorted by k-mer, k kept as a property."""
    table.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").saveAsTable(name)
    table.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('strandloom.k' = '{k}')")


def load(spark, name: str, k: int | None = None) -> DataFrame:
    """A saved table; ``k``, if given, must be the table's."""
    told = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    found = int(told.get("strandloom.k", 0))
    if not 1 <= found < 64 or k not in (None, found):
        raise ValueError(f"{name} holds k = {found}")
    return with_k(spark.table(name), found)


def save_parquet(table: DataFrame, path: str, k: int) -> None:
    """A folder of Parquet files, one for each partition of the table; k is a column, and metadata of the ``kmer`` column, which an empty table has too."""
    with_k(table, same_k(table, k=k)).withColumn("k", F.lit(k)).write.mode("overwrite").parquet(path)


def load_parquet(spark, path: str, k: int | None = None) -> DataFrame:
    """A saved folder; ``k``, if given, must be the table's. A folder without metadata tells its k by its rows."""
    got = spark.read.parquet(path)
    if told_k(got) is None and "k" in got.columns:
        rows = got.select("k").distinct().limit(2).collect()
        if len(rows) > 1:
            raise ValueError(f"{path} mixes tables of different k")
        got = with_k(got, rows[0].k if rows else None)
    same_k(got, k=k)
    return got.drop("k")
