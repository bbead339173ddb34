"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two group-bys and two joins on node ids and is written to the shared
checkpoint folder, so lineage stays short and a lost executor costs one round. Stars
need only each node's smallest neighbour, an aggregate with map-side partials; no
neighbour list is gathered in one task, so a hub of any degree is fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    return e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of long ids to ``(node, root)``; root is the smallest id reachable. Only linked nodes appear.

    Self-loops and repeated or reversed edges are allowed; an empty table gives an empty table.
    """
    e = cut(edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.count_if(F.col("u") < F.col("v"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        e = cut(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
