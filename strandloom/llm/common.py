"""Session helpers that the operators share: lineage cuts, shared folders, table access."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def others(df: DataFrame, *added: str) -> list[str]:
    """The columns of ``df`` without those that ``added`` names in any case, as Spark resolves names."""
    names = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in names]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where none is set, a local session gets one, a cluster an error."""
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not known and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not known:
        sc.setCheckpointDir(known := tempfile.mkdtemp(prefix="strandloom-"))
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known if ":" in known.split("/")[0] else f"file://{known}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back: the lineage ends there."""
    shared_dir(df.sparkSession)
    with shuffle_cleanup(df.sparkSession):
        return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those of the smallest id hash.

    A large table is thinned by the same hash before the sort, so that about 1.5 times the sample meets in its last task, not ``rows`` rows of every task.
    """
    total, h = df.count(), F.xxhash64(id_col)
    if total > 2 * rows:
        low, span = -(1 << 63), int((1 << 64) * 1.5 * rows / total)
        df = df.filter(h < F.lit(low + span))
    return df.orderBy(h, id_col).limit(rows)


def slices(batches, rows: int = 1_000):
    """Arrow batches cut to at most ``rows`` rows: a worker never holds more texts than that as Python objects."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Shuffle files of the queries that run inside are removed as each query ends, not when the driver collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)

