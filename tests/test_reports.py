import math

import numpy as np
import pytest

from strandloom.operators import compare, islands as isl, lookup, quality, regions, sexchr, table as tables, trio
from strandloom.operators.options import QualityOptions, RegionOptions, TrioOptions
from strandloom.plans import catalog
from tests.test_kmers import seqs

PAT = "TTTCCTCATGCAATTCAAAACCATGTCCGTAATGTAGGCGAAATAGTAAACCATTTTACG"
MAT = "GAGGATACCAAATTCCTCCTTATTCAGGACCTAACCTGAGGTAAACCAGGTCTCTCCGCC"


@pytest.fixture(scope="module")
def family(spark):
    flags = lookup.trio_flags(tables.count(seqs(spark, *[PAT] * 6), 5), tables.count(seqs(spark, *[MAT] * 6), 5))
    reads = seqs(spark, PAT[5:45], MAT[10:50], PAT[:30] + MAT[30:], PAT[:20] + "N" + MAT[:20] + "N" + PAT[40:], "", "NNN")
    return reads, flags.cache()


def test_triobin_golden(family):
    rows = {r.seq_id: tuple(r)[2:] for r in trio.binning(*family, 5).collect()}
    assert rows[0] == ("p", 32, 0, 32, 0, 0, 0, 36, 0)
    assert rows[1] == ("m", 0, 27, 0, 27, 0, 0, 36, 0)
    assert rows[2] == ("a", 19, 21, 19, 21, 0, 0, 56, 4)
    assert rows[3] == ("a", 22, 12, 22, 12, 0, 0, 48, 0)
    assert rows[4] == rows[5] == ("0", 0, 0, 0, 0, 0, 0, 0, 0)


def test_trioeval_golden(family):
    rows = {r.seq_id: tuple(r)[2:] for r in trio.phasing(*family, 5).collect()}
    assert [rows[i] for i in range(5)] == [(8, 0, 7, 0, 0, 0, 40), (0, 7, 0, 0, 0, 6, 40), (5, 6, 4, 1, 0, 5, 60), (5, 3, 3, 1, 1, 2, 62), (0, 0, 0, 0, 0, 0, 0)]
    errors = sorted((r.seq_id, r.pos, r.prev, r.cur) for r in trio.phase_errors(*family, 5).collect())
    assert errors == [(2, 40, 1, 2), (3, 35, 1, 2), (3, 51, 2, 1)]
    frags = sorted((r.seq_id, r.st, r.type, r.en, r.n) for r in trio.fragments(*family, 5).collect())
    assert frags == [(0, 0, 1, 41, 3), (1, 4, 2, 41, 4), (2, 4, 1, 31, 3), (2, 30, 2, 61, 3), (3, 4, 1, 21, 2), (3, 22, 2, 42, 2), (3, 42, 1, 61, 2)]
    totals = {r.kind: (r.num, r.den) for r in trio.phasing_totals(trio.phasing(*family, 5)).collect()}
    assert totals == {"W": (3, 7 + 6 + 10 + 7), "H": (0 + 0 + 5 + 3, 8 + 7 + 11 + 8), "N": (18, 16)}


def test_totals_over_nothing_are_null(spark, family):
    none = trio.phasing(family[0].filter("seq_id > 3"), family[1], 5, TrioOptions())
    assert [r.rate for r in trio.phasing_totals(none).collect()] == [None] * 3


def test_low_support_golden(spark):
    base = "CCCTTATAAAAGCTGTTGCACCTAGCCAAGTTCAACGGCAGCTGCAATGGAAATAGGCAA"
    bad = base[:30] + "A" + base[31:]
    assert base[30] == "T"
    table = tables.count(seqs(spark, *[base] * 4), 11)
    got = regions.low_support(seqs(spark, bad, "", base), table, 11).collect()
    assert [tuple(r)[2:] for r in got] == [(20, 41, 11)]
    assert regions.low_support(seqs(spark, bad), table, 11, RegionOptions(min_streak=11)).count() == 0
    assert [r.streak for r in regions.low_support(seqs(spark, bad), table, 11, RegionOptions(min_count=0)).collect()] == [11]


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_islands_match_a_scan(spark, block):
    rng = np.random.default_rng(block)
    types = rng.integers(0, 3, 200).tolist()
    rows = [(1, i, t) for i, t in enumerate(types) if t]
    got = sorted((r.first, r.end, r.type) for r in isl.islands(spark.createDataFrame(rows, "seq_id long, pos long, type int"), block=block).collect())
    want, at = [], 0
    for i in range(1, 201):
        if i == 200 or types[i] != types[at]:
            want += [(at, i, types[at])] if types[at] else []
            at = i
    assert got == want


def bell(c):
    return 1e6 * math.exp(-((c - 30) ** 2) / 72)


def test_solver_golden():
    hist, cnt = np.zeros(1024), np.zeros(1024)
    for c in range(1, 80):
        hist[c] = int(bell(c)) + int(5e6 * math.exp(-1.5 * (c - 1)))
        cnt[c] = int(bell(c)) + int(300 * math.exp(-1.5 * (c - 1)))
    cnt[0] = 2000
    got = quality.solve(hist, cnt, 31)
    assert (got["tot"], got["max_c"], got["min_c"]) == (15042115, 30, 3)
    for name, value in (("cov", 1.0), ("fpr_lower", 3.461433e-05), ("fpr_upper", 7.529122e-05), ("qv_raw", 53.676117), ("qv", 52.951160), ("err", 2363.3089)):
        assert got[name] == pytest.approx(value, rel=1e-5), name
    assert got["adj"][:6] == pytest.approx([6.576, 12.086, 22.846, 44.043, 83.778, 168.504], rel=1e-3)


def test_solver_edges():
    zero = np.zeros(1024)
    assert quality.solve(zero, zero, 31)["qv"] == -1
    only = zero.copy()
    only[0] = 5
    assert quality.solve(zero, only, 31)["qv_raw"] == -1
    full = zero.copy()
    full[5] = 5
    assert quality.solve(zero, full, 31)["qv_raw"] == math.inf
    assert quality.solve(zero, full, 31)["max_c"] == 5


def test_quality_rows(spark):
    table = tables.count(seqs(spark, "ACGTTGCATGGA"), 5)
    reads = seqs(spark, "ACGTTGCATGGA", "CCCCCCCC", "", "ACGTTGCCC", "ACG")
    rows = {r.seq_id: (r.tot, r.non0, round(r.qv, 2)) for r in quality.per_sequence(reads, table, 5).collect()}
    some = round(-10 * math.log10(math.log(5 / 3) / 5), 2)
    assert rows == {0: (8, 8, 99.0), 1: (4, 0, 0.0), 2: (0, 0, -1.0), 3: (5, 3, some), 4: (0, 0, -1.0)}
    assert quality.per_sequence(reads, table, 5, QualityOptions(min_len=8)).count() == 3
    spec = quality.spectrum(reads, table, 5, QualityOptions(min_frac=0.5))
    cnt = {r.c: r.cnt for r in spec.collect() if r.cnt}
    assert sum(cnt.values()) == 13 and cnt[0] == 2
    raw = quality.raw_summary(spec, 5).first()
    assert (raw.tot, raw.absent) == (13, 2)
    lost = sorted((r.seq_id, r.start) for r in quality.absent_kmers(reads, table, 5).collect())
    assert lost == [(1, 0), (1, 1), (1, 2), (1, 3), (3, 3), (3, 4)]


def test_sex_chromosomes(spark):
    y, x, par = "ACGGTCATTA", "CCATGGAACT", "GTGTCCGATC"
    flags = lookup.set_flags(*(tables.count(seqs(spark, t), 5) for t in (y, x, par)))
    rows = [(1, "a", 1, y), (2, "b", 2, x), (3, "c", 1, "TTTTTTTTTT"), (4, "d", 2, "")]
    got = sexchr.sex_counts(spark.createDataFrame(rows, "seq_id long, name string, hap int, seq string"), flags, 5)
    parts = {r.seq_id: (r.nk, r.ns, r.n1, r.n2, r.part) for r in sexchr.partition(got).collect()}
    assert parts == {1: (6, 6, 6, 0, 1), 2: (6, 6, 0, 6, 2), 3: (6, 0, 0, 0, 1), 4: (0, 0, 0, 0, 2)}
    swapped = got.withColumn("hap", 3 - got.hap)
    assert {r.seq_id: r.part for r in sexchr.partition(swapped).collect()} == {1: 1, 2: 2, 3: 1, 4: 2}


def test_comparison(spark):
    left = spark.createDataFrame([("A", 3), ("C", 1), ("G", 3), ("T", 2)], "kmer string, cnt int")
    right = spark.createDataFrame([("A", 5), ("G", 1), ("T", 1), ("X", 9)], "kmer string, cnt int")
    frac = {(r.c, r.j): r.frac for r in compare.sensitivity(left, right, 2).collect()}
    assert frac == {(3, 1): 1.0, (3, 2): 0.5, (2, 1): 1.0, (2, 2): 1 / 3, (1, 1): 0.75, (1, 2): 0.25}
    rows = [(r.c, r.tot, r.acc) for r in compare.histogram_rows(left).orderBy("c").collect()]
    assert rows == [(0, 0, 4), (1, 1, 4), (2, 1, 3), (3, 2, 2)]
    got = {r.c: (r.tot, r.cnt0) for r in compare.qualities(left, right, 5, 3).collect()}
    assert got == {3: (2, 0), 2: (3, 0), 1: (4, 1)}
    with pytest.raises(ValueError):
        compare.sensitivity(left, right, 2000)


def test_solver_query_reads_all_sources(spark, tmp_path):
    rng = np.random.default_rng(6)
    genome = "".join(rng.choice(list("ACGT"), 3000))
    rows = [(i, genome[a : a + n], "en", f"src{i % 20}") for i, (a, n) in enumerate(zip(rng.integers(0, 2000, 60).tolist(), [*rng.integers(0, 900, 54).tolist(), 20, 21, 99, 100, 101, 104], strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    s = catalog.sequences(spark, str(tmp_path))
    for own in (s, catalog.part(s, 0, 1)):
        want = {r.kmer: r.cnt for r in tables.count(catalog._windows(own), catalog.K).collect()}
        assert {r.kmer: r.cnt for r in catalog._window_counts(own, catalog.K).collect()} == want
    got = catalog.QUERIES["qv_solve"](spark, str(tmp_path)).collect()
    assert [r.tot for r in got] == [sum(max(0, len(t) - catalog.K + 1) for _, t, _, _ in rows)]
