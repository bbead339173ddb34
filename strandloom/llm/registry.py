"""Queries and SQL of this folder, by name."""

from __future__ import annotations

from strandloom.llm import bpe, hamming, langid, line_dedup, mixing, nearest, pii, simhash, token_files, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_hamming": hamming.op2_hamming,
    "op3_langid": langid.op3_langid,
    "op4_token_files": token_files.op4_token_files,
    "op5_pii": pii.op5_pii,
    "op6_bpe": bpe.op6_bpe,
    "op7_nearest": nearest.op7_nearest,
    "op8_mixing": mixing.op8_mixing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE = {"op2_hamming": hamming.ORACLE, "op7_nearest": nearest.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
