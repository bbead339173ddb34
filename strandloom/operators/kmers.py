"""K-mer extraction: sequences to (seq_id, pos, kmer) rows.

A sequence is cut into chunks that overlap by k - 1 bases, so that taking substrings
costs time in proportion to the length and a long contig can be spread over tasks. A chunk's
bases become numbers of 31 bases each, once for each strand; a window is shifted out of two
neighbouring ones. K-mers stay numbers until somebody wants to read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.functions.bases import BLOCK, bases, spell, words

CHUNK = 8 * BLOCK


def parts_of(seqs: DataFrame) -> int | None:
    """In how many partitions the caller wants the k-mers of these sequences, which are dealt by ``seq_id`` to as many; None if it doesn't say."""
    return seqs.schema["seq_id"].metadata.get("parts") if "seq_id" in seqs.columns else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """Rows dealt by the keys to a number of partitions that grows with the input, so that no task does; unchanged without a number."""
    return df.repartition(parts, *keys) if parts else df


def chunks(seqs: DataFrame, k: int, *keys: str, size: int = CHUNK) -> DataFrame:
    """``(*keys, off, part)``: parts of ``size + k - 1`` bases that hold every window once; N stands for whatever is no base."""
    clean = F.when(F.col("seq").rlike("[^ACGT]"), F.regexp_replace(bases("seq"), "[^ACGT]", "N")).otherwise(F.col("seq"))
    seq = seqs.select(*keys, clean.cast("binary").alias("seq"))
    # no filter on the length: it would be pushed below the caller's exchange, and all that makes the sequence with it
    starts = F.when(F.length("seq") >= k, F.sequence(F.lit(0), F.floor((F.length("seq") - k) / size).cast("int")))
    parts = F.transform(starts, lambda c: F.struct((c * size).alias("off"), F.substring(F.col("seq"), c * size + 1, F.lit(size + k - 1)).alias("part")))
    return seq.select(*keys, F.explode(parts).alias("c")).select(*keys, "c.off", F.col("c.part").cast("string").alias("part"))


def _shifted(codes: str, at: str, k: int) -> str:
    """SQL: the number of the k bases (31 at most) from base ``at`` on, out of an array of numbers of 31 bases."""
    j, r = f"cast({at} div {BLOCK} as int)", f"({at} % {BLOCK})"
    one, two = f"{codes}[{j}]", f"{codes}[{j} + 1]"
    whole = f"shiftright({one}, 2 * ({BLOCK - k} - {r}))"
    split = f"(shiftleft({one}, 2 * ({r} - {BLOCK - k})) | shiftright({two}, 2 * ({2 * BLOCK - k} - {r})))"
    return f"((case when {r} <= {BLOCK - k} then {whole} else {split} end) & {(1 << 2 * k) - 1}L)"


def explode_codes(seqs: DataFrame, k: int, *keys: str, size: int = CHUNK) -> DataFrame:
    """``(*keys, pos, kmer)``: canonical k-mers as numbers, two bits a base; beyond 31 bases as a struct of numbers (``bases.words``).

    ``pos`` is the 0-based index of the window's last base. Windows with a letter other than A, C, G, T (U) are left out; positions
    count them. Numbers have the order of the letters.
    """
    keys = keys or ("seq_id",)
    if not 1 <= k < 64:
        raise ValueError("k must be between 1 and 63")
    over = max(0, k - BLOCK)
    blocks = (size - 1 + over) // BLOCK + 2
    of = lambda text: f"transform(sequence(0, {blocks - 1}), j -> cast(conv(substring({text}, j * {BLOCK} + 1, {BLOCK}), 4, 10) as bigint))"
    part = chunks(seqs, k, *keys, size=size).select(*keys, "off", F.length("part").alias("n"), F.translate("part", "ACGTN", "01230").alias("d"), F.when(F.instr("part", "N") > 0, F.translate("part", "ACGTN", "00003")).alias("b"))
    wide = lambda text: f"rpad({text}, {blocks * BLOCK}, '0')"
    part = part.selectExpr(*keys, "off", "n", f"{wide('d')} as d", f"{wide('reverse(d)')} as r", f"{wide('b')} as b")
    # the other strand's numbers: those of the reversed bases, each base complemented
    part = part.selectExpr(*keys, "off", "n", f"{of('d')} as fwd", f"transform({of('r')}, x -> x ^ {(1 << 2 * BLOCK) - 1}L) as rev", f"case when b is not null then {of('b')} end as bad")
    rows = part.selectExpr(*keys, "off", "n", "fwd", "rev", "bad", f"explode(sequence(0, n - {k})) as i")
    sizes = words(k)
    fwd, rev, bad = ([_shifted(name, f"({at} + {sum(sizes[:j])})", n) for j, n in enumerate(sizes)] for name, at in (("fwd", "i"), ("rev", f"n - {k} - i"), ("bad", "i")))
    rows = rows.filter(f"bad is null or ({' and '.join(f'{x} = 0' for x in bad)})")
    pos = f"cast(off + i + {k - 1} as bigint) as pos"
    if not over:
        # never null, and Spark is to know it: else each join brings a filter down here that makes every window once more
        return rows.selectExpr(*keys, pos, f"coalesce(least({fwd[0]}, {rev[0]}), 0L) as kmer")
    rows = rows.selectExpr(*keys, pos, *(f"{x} as {s}{j}" for s, each in (("f", fwd), ("r", rev)) for j, x in enumerate(each)))
    smaller = "true"
    for j in reversed(range(len(sizes))):
        smaller = f"(f{j} < r{j} or f{j} = r{j} and {smaller})"
    return rows.selectExpr(*keys, "pos", f"named_struct({', '.join(f"'w{j}', if({smaller}, f{j}, r{j})" for j in range(len(sizes)))}) as kmer")


def explode_kmers(seqs: DataFrame, k: int, *keys: str, size: int = CHUNK) -> DataFrame:
    """As ``explode_codes``, with k-mers as text."""
    return explode_codes(seqs, k, *keys, size=size).withColumn("kmer", spell(F.col("kmer"), k))


def windows(seq, k: int):
    """How many rows ``explode_kmers`` makes of a sequence: the windows of its runs of A, C, G, T (U)."""
    return F.aggregate(F.split(bases(seq), "[^ACGT]+"), F.lit(0).cast("long"), lambda n, run: n + F.greatest(F.length(run) - (k - 1), F.lit(0)))
