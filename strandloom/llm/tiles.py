"""Block joins of a stated query set against all rows: both sides are dealt to tiles by id hash.

Rows are hashed into blocks, never by value, so equal vectors spread over all tiles. A
tile holds one block of rows and one block of queries; its memory is bounded by the two
block sizes, which grow with the work until their caps, in bytes of a row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def finite_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, vec, dim)`` of the rows that take part: no null, non-finite or only zero components, id not null; repeated rows once.

    Vectors of floats stay floats, all others become doubles. Different vectors under one id are rows of their own.
    """
    kind = df.schema[vec_col].dataType.simpleString()
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("vec"))
    kept = kept.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull()))
    kept = kept.filter(F.forall("vec", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    return kept.dropDuplicates(["id", "vec"]).withColumn("dim", F.size("vec"))


#: Bytes of the vectors of a block of rows, and of a block of queries, at most, as doubles or as bytes of a code.
ROW_BYTES, QUERY_BYTES = 1 << 26, 1 << 25


def block_rows(n: int, share: int, least: int, row_bytes: int, most_bytes: int) -> int:
    """Rows of a block: a share of all, at least ``least``, and never more than fit in ``most_bytes``."""
    return max(1, min(most_bytes // max(1, row_bytes), max(least, n // share)))


def dealt(rows: DataFrame, row_bytes, every: int, row_block: int | None = None, query_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows, and those of them whose id is divisible by ``every``, with the tile keys ``dim``, ``rb`` and ``qb``.

    Each row goes to every query block and each query to every row block. ``row_bytes`` gives the bytes of a row of a dimension.
    """
    queries = rows.filter(F.col("id") % every == 0)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q"), F.coalesce(F.max("dim"), F.lit(1)).alias("dim")).first()
    n_rows, n_queries, width = size.n, size.q, row_bytes(size.dim)
    row_block = row_block or block_rows(n_rows, 64, 1 << 13, width, ROW_BYTES)
    query_block = query_block or block_rows(n_queries, 16, 1 << 9, width, QUERY_BYTES)
    nr, nq = max(1, math.ceil(n_rows / row_block)), max(1, math.ceil(n_queries / query_block))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return rows.withColumn("rb", own(nr)).withColumn("qb", each(nq)), queries.withColumn("qb", own(nq)).withColumn("rb", each(nr))
