import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from strandloom.sources import reports
from strandloom.sources.sequences import Malformed, lines_of, read_fastx, read_report, records
from strandloom.streaming import kmers as stream

TEXT = "junk\n>r1 a comment\nACGT\nAC\r\n@r2\nGGTT\n+\nII@I\n>r3\n\n@r4\nAC\nGT\n+r4\nII\n>I\n"
WANT = [("r1", "ACGTAC", None), ("r2", "GGTT", "II@I"), ("r3", "", None), ("r4", "ACGT", "II>I")]


def test_records():
    assert list(records(TEXT.splitlines(True))) == WANT
    bad = ["@a\n", "AC\n", "+\n", "I\n", "I\n", ">b\n", "GG\n", "@c\n", "ACGT\n", "+\n", "II\n"]
    assert list(records(bad, strict=False)) == [("a", "AC", "II"), ("b", "GG", None)]
    with pytest.raises(Malformed):
        list(records(bad))
    assert list(records([])) == []


def test_fastx_source(spark, tmp_path):
    (tmp_path / "a.fq").write_text(TEXT)
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nAC\n")
    got = sorted((r.name, r.seq, r.qual, r.len) for r in read_fastx(spark, str(tmp_path)).collect())
    assert got == sorted([(n, s, q, len(s)) for n, s, q in WANT] + [("z", "AC", None, 2)])


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 99.0), ("b", 2, -1.0)], "name string, len int, qv double")
    reports.write(reports.lines(df, "SQ"), str(tmp_path / "out"))
    back = read_report(spark, str(tmp_path / "out"), "SQ", "name string, len int, qv double")
    assert sorted(map(tuple, back.collect())) == [("a", 1, 99.0), ("b", 2, -1.0)]


def test_stream_counts(spark, tmp_path):
    spark.createDataFrame([(1, "a", "ACGTACGT"), (2, "b", "AAAA")], "seq_id long, name string, seq string").repartition(2).write.parquet(str(tmp_path / "in"))
    q = stream.counts(stream.read_sequences(spark, str(tmp_path / "in"), 1), 4).writeStream.format("memory").queryName("kc").outputMode("complete").start()
    try:
        q.processAllAvailable()
        assert {r.kmer: r.cnt for r in spark.table("kc").collect()} == {"ACGT": 2, "CGTA": 2, "GTAC": 1, "AAAA": 1}
    finally:
        q.stop()
    table = spark.createDataFrame([("AAAA", 7)], "kmer string, cnt int")
    q = stream.annotate(stream.read_sequences(spark, str(tmp_path / "in")), table, 4).writeStream.format("memory").queryName("ka").start()
    try:
        q.processAllAvailable()
        assert spark.table("ka").filter(F.col("cnt") == 7).count() == 1
    finally:
        q.stop()


@pytest.mark.parametrize("size", [1, 7, 40, 10_000])
def test_splits_are_the_whole_file(spark, tmp_path, size):
    r = random.Random(size)
    fasta, fastq = "junk\n\n", ""
    for i in range(60):
        seq = "".join(r.choice("ACGT") for _ in range(r.randint(0, 30)))
        fasta += f">f{i} {'x>y' * r.randint(0, 2)}\n" + "".join(seq[a : a + 9] + r.choice(("\n", "\r\n")) for a in range(0, len(seq), 9))
        fastq += f"@q{i} c\n{seq}A\n+\n" + "".join(r.choice("@+>I") for _ in range(len(seq) + 1)) + "\n"
    (tmp_path / "a.fa").write_bytes(fasta.encode())
    (tmp_path / "b.fq").write_bytes(fastq.rstrip("\n").encode())
    for name, text, layout in (("a.fa", fasta, "auto"), ("b.fq", fastq, "fastq4")):
        raw, got = (tmp_path / name).read_bytes(), []
        for at in range(0, len(raw), size):
            got += records(lines_of(io.BytesIO(raw), at, at + size, "fasta" if layout == "auto" else layout))
        assert got == list(records(io.StringIO(text, newline="\n")))
    if size >= 40:
        df = read_fastx(spark, str(tmp_path / "a.fa"), split_bytes=size)
        assert df.rdd.getNumPartitions() == -(-len(fasta.encode()) // size)
        assert sorted((x.name, x.seq) for x in df.collect()) == sorted((n, s) for n, s, _ in records(io.StringIO(fasta, newline="\n")))
    with pytest.raises(Malformed):
        list(lines_of(io.BytesIO(b">a\nAC\n@b\nGG\n"), 0, 100, "fasta"))
