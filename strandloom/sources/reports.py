"""Report lines: tab-separated text rows, the record type first."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Number formats of report columns (fixed values of the report formats).
FORMATS = {"qv": "%.2f", "adj": "%.3f", "err": "%.3f", "cov": "%.3f", "frac": "%.4f", "rate": "%.6f"}


def lines(df: DataFrame, kind: str | None = None, columns=None, formats: dict[str, str] | None = None) -> DataFrame:
    """``(value)``: one text line a row."""
    formats = FORMATS | (formats or {})
    cols = columns or df.columns
    cells = [F.format_string(formats[c], c) if c in formats else F.col(c).cast("string") for c in cols]
    return df.select(F.concat_ws("\t", *([F.lit(kind)] if kind else []), *(F.coalesce(c, F.lit("nan")) for c in cells)).alias("value"))


def write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)
