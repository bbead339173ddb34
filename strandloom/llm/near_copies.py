"""Near copies: several short SimHash fingerprints a text, met by ball hashing, then verified on whole shingle sets.

A pair at Jaccard similarity 0.8 differs in about 15 % of SimHash bits, so one long fingerprint with a small
radius misses most such pairs. Here a text has ``tables`` short fingerprints, each from hashes of its own. In every
table a fingerprint emits all variants within half the radius (``HALF`` bits); two fingerprints at most ``RADIUS``
bits apart share a variant. The number of tables follows from ``MISS``, the share of pairs at 0.8 that no table may bring together; the
length of the fingerprints follows from the number of rows, so that chance meetings stay a few for each text at any size.

1. The shuffle is on table and variant prefix, as for one fingerprint (see ``simhash``). In a bucket, texts that share a variant are
   held against each other by one more, 64-bit fingerprint, which drops nearly all chance meetings. A bucket returns a
   forest, not pairs. What is connected is a family: it holds all links of its members, and some that are none.
2. Inside families pairs are verified exactly. A family is cut into blocks of bounded size, and a task holds two blocks of shingle sets: it
   compares 512-bit fingerprints of all pairs of the two, and whole sets where those are near, and returns a forest of the
   pairs at 0.8 or more. So a large family spreads over tasks, no task holds more than two blocks, and no row is made for a pair.

Equal sets are one node before all this. The work in a family of n different texts is n * n / 2 comparisons of 64 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import cut, slices
from strandloom.llm.components import connected_components

#: Radius of the short fingerprints, and half of it; the share of pairs at 0.8 that may be missed; bits that the 64-bit fingerprint may differ in.
RADIUS, HALF, MISS, CHECK = 2, 1, 0.005, 18
#: Chance links that a text may bring to its family, on the mean; variants of a bucket; texts and shingles of a block.
CHANCE, PER_TASK, BLOCK_TEXTS, BLOCK_SHINGLES = 0.05, 4_000_000, 1_024, 2_000_000
#: Fingerprints that are compared inside families, the bits that they may differ in, and sets too small for them.
LANES, SKETCH, SMALL = 8, 110, 32
#: Runs of equal variants up to this length are compared pair by pair; longer ones are one family.
RUN = 64
_EIGHTH = np.uint64(0x0101010101010101)


def differing(similarity: float = 0.8) -> float:
    """The chance that a SimHash bit differs for two sets of one size at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _within(bits: int, radius: int, p: float) -> float:
    return sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(radius + 1))


def tables_for(bits: int) -> int:
    return math.ceil(math.log(MISS) / math.log1p(-_within(bits, RADIUS, differing())))


def bits_for(rows: int) -> int:
    """The shortest fingerprint at which a text has at most ``CHANCE`` chance links."""
    for bits in range(20, 64):
        if rows * tables_for(bits) * _within(bits, RADIUS, 0.5) * _within(64, CHECK, 0.5) <= CHANCE:
            return bits
    return 64


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    m = h * np.uint64((0x9E3779B97F4A7C15 * (2 * lane + 3)) & (1 << 64) - 1)
    m ^= m >> np.uint64(31)
    m *= np.uint64(0xD6E8FEB86659FD93)
    m ^= m >> np.uint64(32)
    return m


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; words are parts between ASCII white space, A-Z lower-cased.

    A text of fewer words has one shingle, all of them; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    take = min(width, len(w))
    h = np.full(len(w) - take + 1, take, np.uint64)
    for i in range(take):
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h += w[i : i + len(h)]
    return np.unique(_mixed(h, 0))


def lanes_of(sets: list[np.ndarray], lanes: range) -> np.ndarray:
    """``(len(sets), len(lanes))`` 64-bit SimHash fingerprints; a bit is 1 if it is set in over half of a set's hashes in that lane."""
    out = np.zeros((len(sets), len(lanes)), np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    own = np.flatnonzero(sizes)
    if not len(own):
        return out
    flat = np.concatenate([sets[i] for i in own])
    # eight counters of a byte each stand in a word, so at most 255 hashes are added before they are widened
    parts = -(-sizes[own] // 255)
    first = np.repeat(np.cumsum(sizes[own]) - sizes[own], parts)
    of = np.cumsum(parts) - parts
    starts = first + 255 * (np.arange(len(first)) - np.repeat(of, parts))
    half = sizes[own, None]
    for n, lane in enumerate(lanes):
        m = _mixed(flat, lane)
        bits = np.empty((len(own), 64), bool)
        for j in range(8):
            sums = np.add.reduceat((m >> np.uint64(j)) & _EIGHTH, starts)
            counts = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), of, axis=0, dtype=np.int64)
            bits[:, j::8] = 2 * counts > half
        out[own, n] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int, tables: int) -> DataFrame:
    """``(id, text_hash, key, n, fp, parts)`` for every row: the key stands for the set of n shingles, fp is the 64-bit fingerprint, parts are those of the tables."""
    each = 2 if bits <= 32 else 1
    lanes, mask = range(1, 2 + -(-tables // each)), np.uint64((1 << bits) - 1)

    def run(batches):
        for b in slices(batches):
            sets = [shingle_set(x.as_py(), width) for x in b.column(2)]
            got = lanes_of(sets, lanes)
            parts = got[:, 1:] & mask
            if each == 2:
                parts = np.stack([parts, got[:, 1:] >> np.uint64(32) & mask], axis=2).reshape(len(sets), -1)
            flat = np.ascontiguousarray(parts[:, :tables]).view(np.int64).ravel()
            keys = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * tables), pa.array(flat))
            columns = [b.column(0), b.column(1), pa.array(keys), pa.array(list(map(len, sets)), pa.int32()), pa.array(got[:, 0].copy().view(np.int64)), listed]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "key", "n", "fp", "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, f"id {kind}, text_hash long, key long, n int, fp long, parts array<long>")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node index reachable from each of n nodes over edges a-b."""
    label = np.arange(n)
    while len(a):
        ra, rb = label[a], label[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])  # roots hang on smaller roots
        while True:
            deeper = label[label]
            if (deeper == label).all():
                break
            label = deeper
    return label


def _met(variants: np.ndarray, src: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a common variant whose 64-bit fingerprints are near, those of one long run as a chain."""
    order = np.argsort(variants)
    variants, src = variants[order], src[order]
    at = np.flatnonzero(variants[1:] == variants[:-1])
    new = np.concatenate(([True], variants[1:] != variants[:-1]))
    run_length = np.diff(np.append(np.flatnonzero(new), len(variants)))
    long = np.repeat(run_length > RUN, run_length)
    chained = at[long[at]]
    left, right = [src[chained]], [src[chained + 1]]
    at, step = at[~long[at]], 1
    while len(at):
        a, b = src[at], src[at + step]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= CHECK
        left.append(a[near]), right.append(b[near])
        step += 1
        at = at[at + step < len(variants)]
        at = at[variants[at] == variants[at + step]]
    return np.concatenate(left), np.concatenate(right)


def family_links(nodes: DataFrame, bits: int, per_task: int = PER_TASK) -> DataFrame:
    """``nodes(fp, parts)`` to links ``(u, v)`` of 64-bit fingerprints that connect all that meet in a table."""
    k = min(bits - 8, max(2, math.ceil(math.log2(max(1, nodes.count()) * (1 + bits) / per_task + 1e-9))))
    rest = [1 << b for b in range(bits - k)]
    flips = F.array(*(F.struct(F.lit(m).cast("int").alias("m"), F.lit(w).cast("byte").alias("w")) for m, w in [(0, 0), *((1 << b, 1) for b in range(k))]))
    each = nodes.select("fp", F.posexplode("parts").alias("t", "part")).select("fp", "t", "part", F.explode(flips).alias("f"))
    low = F.col("part").bitwiseAND(F.lit((1 << k) - 1)).cast("int").bitwiseXOR(F.col("f.m"))
    dealt = each.select("fp", F.shiftright("part", k).alias("rest"), F.col("f.w").alias("w"), (F.col("t") * F.lit(1 << k) + low).alias("bucket"))
    # one row for each table and prefix, whatever the input
    cost = F.when(F.col("w") == 0, 1 + len(rest)).otherwise(1).cast("long")
    hot = dealt.groupBy("bucket").agg(F.ceil(F.sum(cost) / (2 * per_task)).cast("int").alias("salts")).filter("salts > 1")
    dealt = dealt.join(F.broadcast(hot), "bucket", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    dealt = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    masks = np.array([0, *rest], np.int64)

    def meet(key, got):
        fp, part, whole = got.column("fp").to_numpy().view(np.uint64), got.column("rest").to_numpy(), got.column("w").to_numpy() == 0
        salt, salts = np.uint64(key[1].as_py()), np.uint64(got.column("salts")[0].as_py())
        variants, src = [], []
        step = max(1, per_task // len(masks))
        for at in range(0, len(fp), step):
            own, done = np.flatnonzero(whole[at : at + step]) + at, np.flatnonzero(~whole[at : at + step]) + at
            v = np.concatenate(((part[own][:, None] ^ masks).ravel(), part[done]))
            s = np.concatenate((np.repeat(own, len(masks)), done))
            if salts > 1:
                mine = _mixed(v.view(np.uint64), 1) % salts == salt
                v, s = v[mine], s[mine]
            variants.append(v), src.append(s.astype(np.int32))
        node, at = np.unique(fp, return_inverse=True)
        a, b = _met(np.concatenate(variants), np.concatenate(src), fp)
        label = forest(len(node), at[a], at[b])
        linked = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"u": node[linked].view(np.int64), "v": node[label[linked]].view(np.int64)})

    return dealt.select("bucket", "salt", "salts", "fp", "rest", "w").groupBy("bucket", "salt").applyInArrow(meet, "u long, v long")


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def verified(sets: list[np.ndarray], side: np.ndarray, sketch: bool = True) -> list[tuple[int, int]]:
    """A forest of the pairs at Jaccard 0.8 or more, of all pairs of one side or, if there are two sides, of those across."""
    n, union, out = len(sets), _Union(len(sets)), []
    sizes = np.fromiter(map(len, sets), np.int64, n)
    across, lanes = bool((side != side[0]).any()), None
    if n > 8 and sketch:
        lanes = lanes_of(sets, range(100, 100 + LANES))

    def try_all(i: int, js: np.ndarray) -> None:
        js = js[np.fromiter((union.find(int(j)) != union.find(i) for j in js), bool, len(js))]
        for at in range(0, len(js), 256):
            part = js[at : at + 256]
            flat, base = np.concatenate([sets[j] for j in part]), sets[i]
            found = np.minimum(np.searchsorted(base, flat), len(base) - 1)
            both = np.add.reduceat((base[found] == flat).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            for j in part[9 * both >= 4 * (sizes[part] + sizes[i])].tolist():
                if (a := union.find(i)) != (b := union.find(j)):
                    union.up[max(a, b)] = min(a, b)
                    out.append((i, j))

    rows = np.flatnonzero(side == side[0]) if across else np.arange(n)
    others = np.flatnonzero(side != side[0]) if across else np.arange(n)

    def near(i: int) -> tuple[np.ndarray, np.ndarray]:
        js = others if across else others[i + 1 :]
        js = js[(5 * np.minimum(sizes[js], sizes[i]) >= 4 * np.maximum(sizes[js], sizes[i])) & (sizes[js] > 0)]
        if lanes is None or not len(js):
            return js, np.zeros(len(js), np.int64)
        apart = np.bitwise_count(lanes[js] ^ lanes[i]).sum(axis=1, dtype=np.int64)
        ok = (apart <= SKETCH) | (np.minimum(sizes[js], sizes[i]) < SMALL)
        return js[ok], apart[ok]

    for first in (True, False) if lanes is not None else (False,):  # nearest first: most of a family is connected before the rest is looked at
        for i in rows.tolist():
            js, apart = near(i)
            if len(js):
                try_all(i, js[[apart.argmin()]] if first else js)
    return out


def _groups(batches, columns: list[str]) -> Iterator[pa.Table]:
    """Tables of rows that agree in ``columns``, from batches in their order."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in columns], axis=1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), b.num_rows]
        for s, e in zip(starts, starts[1:], strict=False):
            now = tuple(keys[s].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def verified_links(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """``members(id, text_hash, key, family, blocks)``, a row for each set, to a forest of verified links ``(u, v)`` of keys."""
    src = docs.select(F.col(id_col).alias("__i"), F.xxhash64(text_col).alias("__h"), F.col(text_col).alias("t"))
    texts = src.join(members, F.col("__i").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("text_hash"))).select("family", "blocks", "key", "t")

    def hashed(batches):
        for b in slices(batches, 200):
            sets = [shingle_set(x.as_py(), width).view(np.int64) for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.list_(pa.int64()))], ["family", "blocks", "key", "s"])

    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    sets = texts.mapInArrow(hashed, "family long, blocks int, key long, s array<long>").withColumn("own", own)
    dealt = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "key", "s")
    dealt = dealt.repartition("family", "x", "y").sortWithinPartitions("family", "x", "y")

    def verify(batches):
        for group in _groups(slices(batches, 500), ["family", "x", "y"]):
            keys, first = np.unique(group.column("key").to_numpy(), return_index=True)  # rows that repeat id and text come more than once
            flat, ends = group.column("s").combine_chunks(), None
            flat, ends = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy()
            sets = [flat[ends[i] : ends[i + 1]] for i in first.tolist()]
            side = group.column("own").to_numpy()[first]
            x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
            links = verified(sets, side) if x == y or (side != side[0]).any() else []
            if links:
                u, v = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(keys[u]), pa.array(keys[v])], ["u", "v"])

    return dealt.mapInArrow(verify, "u long, v long")


def near_groups(docs: DataFrame, id_col: str, text_col: str, width: int, per_task: int = PER_TASK, block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """``(id, text_hash, root)`` for every row; equal roots are one component of the links. Texts without words are one component."""
    bits = bits_for(docs.count())
    found = cut(sketches(docs, id_col, text_col, width, bits, tables_for(bits)))
    links = family_links(found.dropDuplicates(["key"]).filter("n > 0").select("fp", "parts"), bits, per_task)
    families = connected_components(links).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    one = found.filter("n > 0").groupBy("key", "fp", "n").agg(F.min(F.struct("id", "text_hash")).alias("m"))
    one = one.join(families, "fp", "left").select("key", "n", "m.id", "m.text_hash", F.coalesce("family", "fp").alias("family"))
    one = cut(one)
    # cut, so that both sides of the join come straight from exchanges and a large family's rows can be split
    sized = cut(one.groupBy("family").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).filter("c > 1"))
    blocks = F.ceil(F.greatest(F.col("c") / block_texts, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    members = one.drop("n").join(sized.select("family", blocks), "family")
    roots = connected_components(verified_links(members, docs, id_col, text_col, width))
    return found.join(roots, found["key"] == roots["node"], "left").select("id", "text_hash", F.coalesce("root", "key").alias("root"))
