"""Column functions on bases, k-mers and counts. All of them stay inside the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, functions as F

#: Counts saturate here (fixed value of the table format: ten bits).
MAX_COUNT = 1023

#: Bases of a number: two bits each, so that it is never negative.
BLOCK = 31


def bases(seq) -> Column:
    """Upper-case bases with U read as T; other letters stay, keep their positions, and break k-mers."""
    return F.translate(seq, "acgtuU", "ACGTTT")


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(kmer) -> Column:
    """The smaller of a k-mer and its reverse complement, in alphabetical order."""
    return F.least(kmer, reverse_complement(kmer))


def saturated(count) -> Column:
    return F.least(count, F.lit(MAX_COUNT)).cast("int")


def encode(kmer) -> Column:
    """Two bits a base (A 0, C 1, G 2, T 3), first base highest; k up to 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def decode(code, k: int) -> Column:
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def words(k: int) -> list[int]:
    """How many bases each number of a k-mer holds: 31, the first what is left."""
    return [k - BLOCK * ((k - 1) // BLOCK)] + [BLOCK] * ((k - 1) // BLOCK)


def pack(kmer, k: int) -> Column:
    """A k-mer's number; of more than 31 bases a struct of numbers ``w0``, ``w1``, ... (``words``)."""
    if k <= BLOCK:
        return encode(kmer)
    sizes = words(k)
    return F.struct(*(encode(F.substring(kmer, sum(sizes[:j]) + 1, n)).alias(f"w{j}") for j, n in enumerate(sizes)))


_FIVE = " ".join(map("".join, product("ACGT", repeat=5)))


def spell(code, k: int) -> Column:
    """The text of a number of ``pack``, five bases at a look-up."""
    if k > BLOCK:
        return F.concat(*(spell(code[f"w{j}"], n) for j, n in enumerate(words(k))))
    five, first = F.split(F.lit(_FIVE), " "), k % 5
    word = lambda left: five[F.shiftright(code, 2 * left).bitwiseAND(F.lit(1023)).cast("int")]
    head = [F.substring(word(k - first), 6 - first, first)] if first else []
    return F.concat(*head, *(word(left) for left in range(k - first - 5, -1, -5)))


def _add(a, b, mask: int) -> Column:
    """Sum modulo mask + 1 of two masked numbers; a carry into the sign bit can't happen below 63 bits."""
    return (a.bitwiseAND(F.lit(mask)) + b.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(mask))


def hash_code(code, k: int) -> Column:
    """The invertible integer mix of a 2k-bit code (k up to 31); shifts and order are fixed values of the table format."""
    mask = (1 << (2 * k)) - 1
    left = lambda x, n: F.shiftleft(x, n).bitwiseAND(F.lit(mask)) if n < 2 * k else F.lit(0).cast("long")
    x = code.cast("long").bitwiseAND(F.lit(mask))
    x = _add(F.bitwise_not(x), left(x, 21), mask)
    x = x.bitwiseXOR(F.shiftright(x, 24))
    x = _add(_add(x, left(x, 3), mask), left(x, 8), mask)
    x = x.bitwiseXOR(F.shiftright(x, 14))
    x = _add(_add(x, left(x, 2), mask), left(x, 4), mask)
    x = x.bitwiseXOR(F.shiftright(x, 28))
    return _add(x, left(x, 31), mask)


def phred(total, hits, k: int) -> Column:
    """Quality of a sequence from its k-mers and those found: -1 without k-mers, 0 without hits, 99 if all were found."""
    ratio = F.log(total / F.when(hits > 0, hits)) / k
    return F.when(total == 0, -1.0).when(hits == 0, 0.0).when(hits == total, 99.0).otherwise(-10 * F.log10(F.when(ratio > 0, ratio)))


def raw_quality(total, absent, k: int) -> Column:
    """Quality of a set from its k-mers and those absent: infinite if none is, -1 if all are or there is none."""
    ratio = F.log(total / F.when(total > absent, total - absent)) / k
    return F.when(total <= absent, -1.0).when(absent == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(F.when(ratio > 0, ratio)))


def parent_type(flag) -> Column:
    """1: only the first parent's strong k-mer, 2: only the second's, 0: neither."""
    return F.when(flag == 2, 1).when(flag == 8, 2).otherwise(0)


def ceil_div(n, k: int) -> Column:
    return F.floor((n + (k - 1)) / k).cast("long")


def parse_number(text: str) -> int:
    """A number with an optional suffix k, m or g, in thousands, rounded."""
    text = text.strip()
    scale = {"k": 1e3, "m": 1e6, "g": 1e9}.get(text[-1:].lower(), 1)
    return int(float(text[:-1] if scale != 1 else text) * scale + 0.499)
