"""A table's histogram, and one table against another by count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strandloom.functions.bases import MAX_COUNT
from strandloom.operators import table as tables
from strandloom.operators.quality import solve_groups


def histogram_rows(table: DataFrame) -> DataFrame:
    """``(c, hist, tot, acc)`` from the highest count present down to 0; ``hist`` is 0, as there is no second table."""
    acc = F.sum("n").over(Window.orderBy(F.desc("c")))  # 1,024 rows
    return tables.histogram(table).withColumn("acc", acc).filter("acc > 0").select("c", F.lit(0).cast("long").alias("hist"), F.col("n").alias("tot"), "acc")


def cross_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(c0, c1, n)``: left k-mers by their count and the right one's, 0 where right has none."""
    both = left.select("kmer", F.col("cnt").alias("c0")).join(right.select("kmer", F.col("cnt").alias("c1")), "kmer", "left")
    return both.groupBy("c0", F.coalesce("c1", F.lit(0)).alias("c1")).agg(F.count(F.lit(1)).alias("n"))


def _checked(max_count: int) -> int:
    if not 1 <= max_count <= MAX_COUNT:
        raise ValueError(f"max_count must be between 1 and {MAX_COUNT}")
    return max_count


def sensitivity(left: DataFrame, right: DataFrame, max_count: int = 20) -> DataFrame:
    """``(c, tot, hist, j, frac)``: of the left k-mers with counts of c or more, the part that right has j times or more.

    A row for each c that occurs in left and each j up to ``max_count``; ``hist`` is right's number of k-mers with count c.
    """
    cells = cross_counts(left, right)
    js = cells.sparkSession.range(1, _checked(max_count) + 1).withColumnRenamed("id", "j")
    at = cells.groupBy("c0").agg(F.sum("n").alias("tot"), F.collect_list(F.struct("c1", "n")).alias("row"))  # at most 1,024 by 1,024 cells
    reach = F.aggregate(F.filter("row", lambda x: x["c1"] >= F.col("j")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    down = Window.partitionBy("j").orderBy(F.desc("c0"))
    rows = at.crossJoin(F.broadcast(js)).withColumn("hit", reach).select("c0", "tot", "j", (F.sum("hit").over(down) / F.sum("tot").over(down)).alias("frac"))
    return rows.join(tables.histogram(right), rows["c0"] == F.col("c")).select(F.col("c0").alias("c"), "tot", F.col("n").alias("hist"), F.col("j").cast("int"), "frac")


def qualities(left: DataFrame, right: DataFrame, k: int, max_count: int = 20, fpr: float = 4e-5) -> DataFrame:
    """``(c, tot, cnt0, qv_raw, qv)`` for c up to ``max_count`` that occur in left: the model on the right counts of left k-mers with counts of c or more."""
    cells = cross_counts(left, right)
    present = cells.select(F.col("c0").alias("grp")).distinct().filter(F.col("grp").between(1, _checked(max_count)))
    cnt = present.join(cells, F.col("c0") >= F.col("grp")).groupBy("grp", F.col("c1").alias("c")).agg(F.sum("n").alias("cnt"))
    spec = present.crossJoin(F.broadcast(tables.histogram(right).withColumnRenamed("n", "hist"))).join(cnt, ["grp", "c"], "left").fillna(0, ["cnt"])
    got = solve_groups(spec, k, fpr)
    zero = cnt.filter("c = 0").select("grp", F.col("cnt").alias("cnt0"))
    return got.join(zero, "grp", "left").fillna(0, ["cnt0"]).select(F.col("grp").alias("c"), "tot", "cnt0", "qv_raw", "qv")
