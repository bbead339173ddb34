"""A training-data pipeline over ``documents``: five stages, each an operator of ``strandloom.llm``.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read
again, so a lost executor never costs more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.llm import bpe, line_dedup, mixing, simhash, toxicity
from strandloom.llm.common import scratch, table

#: Domains of the fourth stage, and the shares of all tokens that it mixes them to (labelled texts have about 0.87 and 0.13 of their own).
DOMAINS, TARGETS = {"high": "quality = 1", "low": "quality = 0"}, (0.80, 0.20)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.3 or more go.

    A null or empty text is scored by its form and stays unless that is toxic; a null id counts as not held out; rows that
    repeat stay or go together; without labels all stay; an empty table gives none. All columns are kept, whatever their names.
    """
    scored = toxicity.toxicity(_row(docs), table(spark, sf_dir, "labels"))
    return _columns(scored.filter("predicted = 0"), docs)


def dedup_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line windows are cut; documents of which only blanks remain go.

    Of windows that occur more than once the one of the smallest id and position stays. A null text stays as it is, and so does one
    that was empty before; rows that repeat both id and text are cut alike. ``n_chars``, where there is such a column, is that of
    the text that is left. Other columns are kept, whatever their names; an empty table gives none.
    """
    cut = line_dedup.line_dedup(_row(docs)).filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return cut.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def dedup_near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest id, nulls first.

    Null and blank texts are one group; rows that repeat id and text are one document; of different texts under one id each
    is a document of its own; an empty table gives none. All columns are kept, whatever their names.
    """
    return simhash.near_dedup(docs)


def mix_domains(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at rates of 1 or more so that the domains' tokens meet ``TARGETS``; none is dropped.

    A null or empty text has no tokens and is repeated by its posterior alone; rows that repeat are repeated alike; without labels
    each stays once; an empty table gives none. All columns are kept, whatever their names.
    """
    mixed = mixing.mix(_row(docs), table(spark, sf_dir, "labels"), TARGETS, floor=1.0, domains=DOMAINS)
    return _columns(mixing.repeated(mixed), docs)


def encode_texts(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids)`` of every row; a null or empty text has no ids; an empty table gives none."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, bpe.compile_lexicon(docs, path)).drop("text")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


def _row(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the other columns as one, so that no column that an operator adds meets one of the table's."""
    rest = [f"`{c}`" for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*rest).alias("row"))


def _columns(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return packed.select(*("text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix_domains), ("bpe", encode_texts)]

#: Classifier, fingerprints, rates and merges are not to be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
