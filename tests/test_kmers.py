import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.bases import canonical, decode, encode, hash_code, parse_number
from strandloom.operators import kmers, table as tables

LETTERS = {"A": "T", "C": "G", "G": "C", "T": "A"}


def canon(w):
    return min(w, "".join(LETTERS[c] for c in reversed(w)))


def windows(seq, k):
    seq = seq.upper().replace("U", "T")
    return [(i + k - 1, canon(seq[i : i + k])) for i in range(len(seq) - k + 1) if set(seq[i : i + k]) <= set("ACGT")]


def seqs(spark, *texts, sample=None):
    rows = [(i, f"n{i}", sample[i] if sample else "s", t, len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "seq_id long, name string, sample string, seq string, len int")


def counts(df):
    return {r.kmer: r.cnt for r in df.collect()}


def brute(texts, k, least=1):
    out = {}
    for t in texts:
        for _, w in windows(t, k):
            out[w] = out.get(w, 0) + 1
    return {w: min(n, 1023) for w, n in out.items() if n >= least}


def test_count_of_the_golden_sequence(spark):
    got = counts(tables.count(seqs(spark, "ACGTNACGGTAUccgta"), 5))
    assert got == dict.fromkeys(("ACCGT", "ACGGA", "ATACC", "ATCCG", "CCGTA", "CGGTA", "GATAC", "GGATA"), 1)


@pytest.mark.parametrize("k", [3, 4, 11, 33])
@pytest.mark.parametrize("size", [1, 7, 256])
def test_extraction_matches_a_scan(spark, k, size):
    r = random.Random(k * size)
    texts = ["".join(r.choice("ACGTacgtuN") for _ in range(n)) for n in (0, k - 1, k, 90, 300)] + ["N" * 40, "ACGT" * 20]
    got = sorted((r.seq_id, r.pos, r.kmer) for r in kmers.explode_kmers(seqs(spark, *texts), k, size=size).collect())
    assert got == sorted((i, p, w) for i, t in enumerate(texts) for p, w in windows(t, k))


def test_counts_do_not_depend_on_the_strand(spark):
    r = random.Random(5)
    text = "".join(r.choice("ACGT") for _ in range(400))
    other = "".join(LETTERS[c] for c in reversed(text))
    assert counts(tables.count(seqs(spark, text), 9)) == counts(tables.count(seqs(spark, other), 9))


def test_counts_saturate(spark):
    assert counts(tables.count(seqs(spark, "A" * 3000), 5)) == {"AAAAA": 1023}


def test_table_algebra(spark):
    r = random.Random(1)
    one, two, three = ("".join(r.choice("ACGT") for _ in range(200)) for _ in range(3))
    a, b, c = (tables.count(seqs(spark, t), 4) for t in (one + two, two, two + three))
    A, B, C = brute([one + two], 4), brute([two], 4), brute([two + three], 4)
    assert counts(tables.subtract(a, b)) == {w: n for w, n in A.items() if w not in B}
    assert counts(tables.intersect(a, b)) == {w: n for w, n in A.items() if w in B}
    assert counts(tables.intersect(a, b, c)) == {w: n for w, n in A.items() if w in B and w in C}
    assert counts(tables.subtract(a, b).unionAll(tables.intersect(a, b))) == A
    assert counts(tables.merge(a, b, 1, 1)) == {w: A.get(w, 0) + (B.get(w) == 1) for w in A.keys() | {w for w, n in B.items() if n == 1}}
    assert counts(tables.recount(a, seqs(spark, three), 4)) == {w: brute([three], 4).get(w, 0) for w in A}
    assert counts(tables.recount(a, seqs(spark, one + two), 4)) == A
    assert counts(tables.count_two(seqs(spark, one), seqs(spark, two), 4)) == {w: n for w, n in brute([two], 4, 2).items() if w in brute([one], 4, 2)}
    assert counts(tables.shrink(a, 3, 2)) == {w: n for w, n in A.items() if n >= 3}
    assert counts(tables.shrink(a, 1, 2)) == {w: n for w, n in A.items() if n <= 2}
    assert set(counts(tables.clear(a)).values()) == {0}
    assert counts(tables.subtract(a, b.limit(0))) == A
    assert counts(tables.intersect(a, b.limit(0))) == {}
    hist = {r.c: r.n for r in tables.histogram(a).collect()}
    assert len(hist) == 1024 and sum(hist.values()) == len(A) == tables.distinct_kmers(a).first().tot


def test_collation(spark):
    texts = ["ACGTACCA", "ACGTTTGA", "ACGTCCCC", ""]
    df = seqs(spark, *texts, sample=["a", "b", "c", "d"])
    per = [brute([t], 3) for t in texts]
    for low, high, out in ((1, 1, 1), (1, 5, 2), (2, 5, 3), (1, 1, 4)):
        want = {}
        for p in per:
            for w, n in p.items():
                if low <= n <= high:
                    want[w] = want.get(w, 0) + 1
        assert counts(tables.collate(df, 3, low, high, out)) == {w: n for w, n in want.items() if n >= 4 - out}
    seed = spark.createDataFrame([("AAA", 5), ("ACG", 1)], "kmer string, cnt int")
    got = counts(tables.collate(df, 3, 1, 1, 1, seed=seed))
    assert got["AAA"] == 6  # the seed's 5, and TTT once in a sample


def test_codes_and_hashes(spark):
    df = spark.createDataFrame([("AAAAA",), ("ACGTA",), ("TTTTT",)], "kmer string")
    rows = df.select("kmer", encode(F.col("kmer")).alias("c"), decode(encode(F.col("kmer")), 5).alias("d"), canonical(F.col("kmer")).alias("m")).collect()
    assert [(r.c, r.d == r.kmer) for r in rows] == [(0, True), (108, True), (1023, True)]
    assert [r.m for r in rows] == ["AAAAA", "ACGTA", "AAAAA"]
    for k, pairs in ((31, {0: 2158324264573792932, 1: 2002549777813010638, 12345: 3046764554690202211, (1 << 62) - 1: 4015643844226056017}), (5, {0: 579, 1: 134, 27: 852, 1023: 0})):
        codes = spark.createDataFrame([(c,) for c in pairs], "c long")
        assert {r.c: r.h for r in codes.select("c", hash_code(F.col("c"), k).alias("h")).collect()} == pairs


def test_numbers():
    assert [parse_number(x) for x in ("10", "1.5k", "2M", "3g")] == [10, 1500, 2_000_000, 3_000_000_000]


def test_saved_tables_need_no_exchange(spark):
    t = tables.count(seqs(spark, "ACGTACCATTGACCA" * 5), 5)
    for name in ("left_t", "right_t"):
        tables.save(t, name, 5, buckets=4)
    a, b = tables.load(spark, "left_t", 5), tables.load(spark, "right_t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = tables.subtract(a, b)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        tables.load(spark, "left_t", 6)
