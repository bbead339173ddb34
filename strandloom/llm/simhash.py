"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 2h bits apart share a variant that is at most h bits from each,
and two fingerprints that share such a variant are at most 2h bits apart. So every
distinct fingerprint emits its ball of radius h = 2 (2,081 variants of 64 bits), equal
variants meet, and all that meet at one variant are linked by a star, not by pairs.

The shuffle is on a prefix of the variant. Prefix bits are flipped before the shuffle
(with k prefix bits a fingerprint goes to 1 + k + k(k-1)/2 buckets, 37 for k = 8 and 106
for k = 14, instead of 2,081 rows), the other bits inside the bucket, where the flips
already spent are known. Each bucket joins its equal variants with a sort and returns a
spanning forest: at most one link for each fingerprint in it, deduplicated there.
A bucket that holds far more variants than the mean, as that of a large group of near
copies does, is salted: each salt takes the variants of one hash class, all of them
are taken by some salt, and no task has to hold more than about ``per_task`` variants.
The class is linear (the exclusive or of a code for each bit), so that of a variant is
that of its fingerprint with that of its flips: a salt looks up the flips that lead to
it and makes no other variant; over all salts each is made once.

Copies have one fingerprint and meet in a group-by before all this.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import cut, slices, table
from strandloom.llm.components import connected_components
from strandloom.llm.near_copies import forest, near_groups

BITS, HALF = 64, 2


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text; words are parts between ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -width])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, width: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes; no words: zero."""
    h = _shingle_hashes(text, width)
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(id_col, text_hash long, fp long)`` for every row; the fingerprint is the signed form of 64 bits."""

    def run(batches):
        for b in slices(batches):
            fp = np.fromiter((fingerprint(x.as_py(), width) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["__id", "text_hash", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("__text"))
    return src.mapInArrow(run, f"__id {kind}, text_hash long, fp long").withColumnRenamed("__id", id_col)


def _masks(bits: list[int], most: int) -> list[tuple[int, int]]:
    """(mask, flips) for up to ``most`` (at most two) flips among ``bits``."""
    out = [(0, 0)]
    if most >= 1:
        out += [(1 << b, 1) for b in bits]
    if most >= 2:
        out += [(1 << a | 1 << b, 2) for i, a in enumerate(bits) for b in bits[:i]]
    return out


def _bit_codes(bits: list[int]) -> np.ndarray:
    """A 32-bit code for each bit; a variant's class is the exclusive or of the codes of its bits, in as many low bits as the bucket has salts."""
    v = np.array(bits, np.uint64) + np.uint64(1)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        v = (v ^ (v >> np.uint64(33))) * np.uint64(factor)
    return (v >> np.uint64(32)).astype(np.int64)


def _classes(values: np.ndarray, bits: list[int], codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for b, c in zip(bits, codes.tolist(), strict=True):
        out ^= (values >> np.uint64(b) & np.uint64(1)).astype(np.int64) * c
    return out


def ball_links(fps: DataFrame, per_task: int = 2_000_000, prefix_bits: int | None = None) -> DataFrame:
    """``fps(fp long)``, distinct, to links ``(u, v)`` that connect all fingerprints at most 4 bits apart.

    ``prefix_bits`` is derived from the number of fingerprints so that a bucket holds about ``per_task`` variants.
    """
    if prefix_bits is None:
        n = fps.count()
        prefix_bits = min(24, max(8, math.ceil(math.log2(max(n, 1) * 2081 / per_task + 1e-9))))
    k = prefix_bits
    flips = F.array(*(F.struct(F.lit(m).cast("int").alias("m"), F.lit(w).cast("byte").alias("w")) for m, w in _masks(list(range(k)), HALF)))
    low = F.col("fp").bitwiseAND(F.lit((1 << k) - 1)).cast("int")
    dealt = fps.select("fp", F.explode(flips).alias("f")).select("fp", low.bitwiseXOR(F.col("f.m")).alias("bucket"), F.col("f.w").alias("w"))
    rest = list(range(k, BITS))
    sizes = [len(_masks(rest, HALF - w)) for w in range(HALF + 1)]
    codes = _bit_codes(rest)
    cost = F.element_at(F.array(*(F.lit(s).cast("long") for s in sizes)), F.col("w") + 1)
    over = F.sum(cost) / (2 * per_task)
    hot = dealt.groupBy("bucket").agg(over.alias("over")).filter("over > 1").select("bucket", F.pow(2, F.ceil(F.log2("over"))).cast("int").alias("salts"))
    # up to 16 bits at most 2^16 rows of 12 bytes, whatever the input; beyond, AQE decides by their size
    dealt = dealt.join(F.broadcast(hot) if k <= 16 else hot, "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def meet(key, got):
        fp, w = got.column("fp").to_numpy().view(np.uint64), got.column("w").to_numpy()
        salt, salts = key[1].as_py(), got.column("salts")[0].as_py()
        node, first = np.unique(fp, return_index=True)
        fp, w = node, w[first]
        var, src = [], []
        for x in range(HALF + 1):
            rows = np.flatnonzero(w == x)
            masks = np.array([m for m, _ in _masks(rest, HALF - x)], np.uint64)
            kind = _classes(masks, rest, codes) % salts
            order = np.argsort(kind)
            starts = np.searchsorted(kind[order], np.arange(salts + 1))
            want = _classes(fp[rows], rest, codes) % salts ^ salt
            n = starts[want + 1] - starts[want]
            ends = np.cumsum(n)
            at = np.arange(n.sum()) + np.repeat(starts[want] + n - ends, n)
            s = np.repeat(rows, n)
            v = fp[s] ^ masks[order[at]]
            v &= ~np.uint64((1 << k) - 1)  # the prefix is the bucket's for all
            var.append(v), src.append(s.astype(np.int32))
        var, src = np.concatenate(var), np.concatenate(src)
        order = np.argsort(var)
        var, src = var[order], src[order]
        same = np.flatnonzero(var[1:] == var[:-1])
        pairs = np.unique(src[same].astype(np.int64) * len(fp) + src[same + 1])
        label = forest(len(fp), pairs // len(fp), pairs % len(fp))
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"u": fp[linked].view(np.int64), "v": fp[label[linked]].view(np.int64)})

    return dealt.select("bucket", "salt", "salts", "fp", "w").groupBy("bucket", "salt").applyInArrow(meet, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """Every row's ``(id_col, text_hash, fp, component_id, root)``: documents are linked at 4 or fewer differing fingerprint bits.

    Defined results: component_id is the smallest id reachable, the document included; root, a fingerprint, names the component. A null or
    blank text has fingerprint zero and is linked like any other. A null id is carried but is never a
    component's id unless all ids are null. Rows that repeat an id keep their own rows. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    fps = cut(fingerprints(docs, id_col, text_col, width))
    own = fps.groupBy("fp").agg(F.min(id_col).alias("__low"))
    roots = connected_components(ball_links(cut(own.select("fp"))))
    rooted = cut(own.join(roots, own["fp"] == roots["node"], "left").select("fp", "__low", F.coalesce("root", "fp").alias("root")))
    low = rooted.groupBy("root").agg(F.min("__low").alias("component_id"))
    by_fp = rooted.join(low, "root").select("fp", "component_id", "root")
    return fps.join(by_fp, "fp").select(id_col, "text_hash", "fp", "component_id", "root")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest (id, text hash), nulls first; rows that repeat both count as one.

    Documents are linked if their sets of shingles of ``width`` words have a Jaccard similarity of 0.8 or more and one of their
    short fingerprints meets (see ``near_copies``; of pairs at just 0.8 about one in 200 does not). Every link is verified on whole sets.

    Defined results: null and blank texts are one component; a text of fewer than ``width`` words is one shingle; a null id
    is carried; an empty table gives no rows. Other columns are kept and never read, whatever their names.
    """
    groups = near_groups(docs, id_col, text_col, width)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").alias("i"), F.col("text_hash").alias("h"))).alias("m"))
    kept = first.select(F.col("m.i").alias("i"), F.col("m.h").alias("h"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), row).alias("d")
    same = F.col("d.i").eqNullSafe(F.col("k.i")) & (F.col("d.h") == F.col("k.h"))
    return keyed.join(kept.alias("k"), same, "left_semi").dropDuplicates(["i", "h"]).select("row.*")


def op1_simhash(spark, sf_dir):
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
