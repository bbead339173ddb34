"""What keeps tasks from growing with the input, and odd letters."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.operators import kmers, table as tables
from strandloom.plans import catalog
from tests.test_kmers import brute, counts, seqs, windows

#: Queries of k-mers that are too many for any bound: all is dealt by k-mer or sequence to as many partitions as the documents are.
LONG = ["qv_solve", "qv_seq", "kmer_long_k33", "qv_seq_minlen", "kmer_hist", "kmer_recount", "kmer_subtract", "kmer_isec2", "kmer_count_two_file", "kmer_merge"]
#: Queries of short k-mers: their tables have a bound, and are brought to the sequences.
SHORT = ["qv_solve_bins", "qv_spectrum", "qv_raw", "groupxy", "sexchr", "triobin", "trioeval_totals", "trioeval_seq", "triobin_diff", "trioeval_err"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("size")
    r = random.Random(3)
    genome = "".join(r.choice("ACGT") for _ in range(900))
    texts = [(genome[a : a + 300] if i % 3 else " ".join(r.choice(["gat", "Cat", "tag", "ẗ", "straße", "ﬆ", "u"]) for _ in range(60))) for i, a in enumerate(r.choices(range(600), k=60))]
    rows = [(i, t, ("en", "fr", "de")[i % 3], f"src{i % 20}") for i, t in enumerate([*texts, "", None, "xyz"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(top / "documents.parquet"))
    return str(top)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(catalog, "PART_BYTES", 700)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt_by_spark(text, *columns):
    return re.findall(rf"Exchange hashpartitioning\((?:{'|'.join(columns)})#[^\n]*ENSURE_REQUIREMENTS", text)


def test_documents_are_dealt_by_their_size(spark, folder, small_parts):
    s = catalog.sequences(spark, folder)
    parts = kmers.parts_of(s)
    assert parts > 4 and s.rdd.getNumPartitions() == parts
    assert tables.count_packed(s, catalog.K).rdd.getNumPartitions() == parts
    assert kmers.parts_of(catalog.part(s, 10)) == parts


@pytest.mark.parametrize("name", LONG)
def test_long_kmers_are_dealt_by_the_size_of_the_input(spark, folder, small_parts, name):
    text = plan(catalog.QUERIES[name](spark, folder))
    assert "REPARTITION_BY_NUM" in text
    assert not dealt_by_spark(text, "kmer", "seq_id", "doc_id")


@pytest.mark.parametrize("name", SHORT)
def test_occurrences_of_short_kmers_stay_with_their_sequence(spark, folder, small_parts, name):
    text = plan(catalog.QUERIES[name](spark, folder))
    assert "BroadcastHashJoin [kmer" in text and "SortMergeJoin [kmer" not in text
    assert not dealt_by_spark(text, "seq_id", "doc_id", "key")


@pytest.mark.parametrize("name", [*LONG, *SHORT])
def test_sequences_are_not_made_below_the_exchange(spark, folder, name):
    below = re.findall(r"FileScan parquet[^\n]*", plan(catalog.QUERIES[name](spark, folder)))
    assert below and not any("regexp_replace" in x for x in below)


@pytest.mark.parametrize("name", [*LONG, *SHORT])
def test_rows_are_those_of_the_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, folder)
    key = lambda r: tuple((x is not None, x) for x in r)
    want = sorted((tuple(r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE[name]})").fetchall()), key=key)
    assert sorted((tuple(r) for r in df.collect()), key=key) == want


@pytest.mark.parametrize("k", [1, 5, 11, 21, 30, 31, 32, 33, 62, 63])
@pytest.mark.parametrize("size", [5, 31, kmers.CHUNK])
def test_numbers_are_the_kmers(spark, k, size):
    r = random.Random(k + size)
    texts = ["".join(r.choice("ACGTacgtuN") if r.random() < 0.05 else r.choice("ACGT") for _ in range(n)) for n in (0, k - 1, k, k + 1, 400)] + ["ACGé" * 30 + "ACGT" * 40, "😀" + "ACGTTGCA" * 20, "A" * 200, "T" * 200]
    got = kmers.explode_codes(seqs(spark, *texts), k, size=size).collect()
    text = {(i, p): w for i, t in enumerate(texts) for p, w in windows(t, k)}
    assert len(got) == len(text)
    number = lambda w: sum("ACGT".index(c) * 4 ** (len(w) - 1 - j) for j, c in enumerate(w))
    for x in got:
        w = text[x.seq_id, x.pos]
        first = (k - 1) % 31 + 1
        assert (tuple(x.kmer) if k > 31 else (x.kmer,)) == tuple(number(w[max(0, e - 31) : e]) for e in range(first, k + 1, 31))


def test_packed_tables_are_the_others(spark):
    r = random.Random(2)
    one, two = ("".join(r.choice("ACGT") for _ in range(300)) for _ in range(2))
    for k in (4, 12, 33, 63):
        a, b = (tables.count_packed(seqs(spark, t), k) for t in (one, two))
        assert counts(tables.spelled(a)) == brute([one], k) == counts(tables.spelled(tables.packed(tables.count(seqs(spark, one), k), k)))
        for f in (tables.subtract, tables.intersect, tables.merge):
            assert counts(tables.spelled(f(a, b))) == counts(f(tables.spelled(a), tables.spelled(b)))
        assert counts(tables.spelled(tables.recount(a, seqs(spark, two), k))) == counts(tables.recount(tables.spelled(a), seqs(spark, two), k))
    odd = spark.createDataFrame([("ACGN", 1), ("ACG", 2), ("ACGTA", 3), ("ACGT", 4)], "kmer string, cnt int")
    assert [tuple(x) for x in tables.packed(odd, 4).collect()] == [(27, 4)]
