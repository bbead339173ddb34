"""Line dedup: windows of three consecutive lines that occurred before are removed.

Only built-in column functions are used. Lines are hashed in the scan; what is shuffled
per window is a 128-bit hash, the document's key and a position. The first occurrence of
a window is an aggregate with map-side partials, so a window that a third of all
documents hold costs one row per map task; the join that marks later occurrences is a
plain equi-join, whose hot partitions AQE splits.

Defined results:

* Lines are the parts between ``\\n`` (a trailing newline ends in an empty line). A window is
  three consecutive lines that are not all blank (spaces only). Documents of fewer lines
  have no window and stay as they are.
* Occurrences are ordered by (id, text hash, position), nulls first; the first one stays,
  and a line covered by any later occurrence is removed, also inside one document.
* Rows with the same id and the same text are one document and share its result.
* A null text stays null, an empty text stays empty; an empty table gives an empty table.
* Extra columns are carried through; internal columns carry the prefix ``__ld_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import others

WINDOW = 3


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__ld_id": F.col(id_col), "__ld_a": F.xxhash64(text), "__ld_b": F.xxhash64(F.lit("b"), text)})


def _lines(text_col: str):
    return F.split(F.col(text_col), "\n", -1)


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per window: document key, position of its first line, 128-bit hash."""
    keyed = _keyed(docs.select(id_col, text_col), id_col, text_col).filter(F.col(text_col).isNotNull())
    key = ["__ld_id", "__ld_a", "__ld_b"]
    hashed = (
        keyed.select(*key, _lines(text_col).alias("__ld_lines"))
        .filter(F.size("__ld_lines") >= WINDOW)
        .select(*key, F.transform("__ld_lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit("b"), x).alias("b"), (F.trim(x) == "").alias("blank"))).alias("__ld_h"))
    )

    def window(x, i):
        part = [F.element_at("__ld_h", (i + j + 1).cast("int")) for j in range(WINDOW)]
        blank = part[0]["blank"] & part[1]["blank"] & part[2]["blank"]
        return F.when(~blank, F.struct(F.xxhash64(*(p["a"] for p in part)).alias("a"), F.xxhash64(F.lit("b"), *(p["b"] for p in part)).alias("b")))

    starts = F.slice("__ld_h", 1, F.size("__ld_h") - (WINDOW - 1))
    return (
        hashed.select(*key, F.posexplode(F.transform(starts, window)).alias("__ld_pos", "__ld_w"))
        .filter(F.col("__ld_w").isNotNull())
        .select(*key, "__ld_pos", F.col("__ld_w.a").alias("__ld_wa"), F.col("__ld_w.b").alias("__ld_wb"))
    )


def repeated_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document key, the start positions of windows that occurred before."""
    occ = windows(docs, id_col, text_col)
    here = F.struct("__ld_id", "__ld_a", "__ld_b", "__ld_pos")
    first = occ.groupBy("__ld_wa", "__ld_wb").agg(F.min(here).alias("__ld_first"), F.count(F.lit(1)).alias("__ld_n")).filter("__ld_n > 1").drop("__ld_n")
    later = occ.join(first, ["__ld_wa", "__ld_wb"]).filter(~here.eqNullSafe(F.col("__ld_first")))
    return later.groupBy("__ld_id", "__ld_a", "__ld_b").agg(F.collect_set("__ld_pos").alias("__ld_starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut out of its text, plus ``n_lines`` and ``n_removed``.

    A document's own columns of these two names, in any case, are replaced.
    """
    rep = repeated_positions(docs, id_col, text_col).select(F.col("__ld_id").alias("__ld_rid"), F.col("__ld_a").alias("__ld_ra"), F.col("__ld_b").alias("__ld_rb"), "__ld_starts")
    keyed = _keyed(docs, id_col, text_col)
    on = F.col("__ld_id").eqNullSafe(F.col("__ld_rid")) & (F.col("__ld_a") == F.col("__ld_ra")) & (F.col("__ld_b") == F.col("__ld_rb"))
    joined = keyed.join(rep, on, "left").withColumn("__ld_lines", _lines(text_col))
    covered = F.flatten(F.transform("__ld_starts", lambda p: F.sequence(p, p + (WINDOW - 1))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), covered)
    joined = joined.withColumn("__ld_keep", F.when(F.col("__ld_starts").isNotNull(), kept))
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__ld_lines")).cast("long")
    text = F.when(F.col("__ld_keep").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform("__ld_keep", lambda i: F.element_at("__ld_lines", i + 1)), "\n"))
    out = {"n_lines": n, "n_removed": F.when(F.col("__ld_keep").isNull(), 0).otherwise(n - F.size("__ld_keep")).cast("long")}
    keep = others(docs, "n_lines", "n_removed")
    return joined.select(*(text.alias(c) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in keep), *(out[c].alias(c) for c in ("n_lines", "n_removed")))


def op9_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, pos, line AS l0,
         lead(line, 1) OVER d AS l1, lead(line, 2) OVER d AS l2
  FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
o AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY l0, l1, l2 ORDER BY doc_id, pos) AS nth
  FROM w WHERE l2 IS NOT NULL AND NOT (trim(l0) = '' AND trim(l1) = '' AND trim(l2) = '')),
c AS (SELECT DISTINCT doc_id, pos + j AS pos FROM o, (SELECT unnest([0, 1, 2]) AS j) WHERE nth > 1),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
       length(k.text)::BIGINT AS n_chars, md5(k.text) AS text_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
