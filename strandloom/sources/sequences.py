"""Sequence records: from the document table, from FASTA and FASTQ files, and report rows from TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "name string, seq string, qual string, len int"


def from_documents(docs: DataFrame) -> DataFrame:
    """``(seq_id, name, sample, lang, seq, len)``: the letters A, C, G, T (U) of each text, upper-case, as its sequence."""
    seq = F.replace(F.upper(F.regexp_replace("text", "[^ACGTUacgtu]+", "")), F.lit("U"), F.lit("T"))
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("doc_id").cast("string").alias("name"), F.col("source").alias("sample"), "lang", seq.alias("seq")).withColumn("len", F.length("seq"))


def raw_documents(docs: DataFrame) -> DataFrame:
    """As ``from_documents`` with all letters kept, so that most break k-mers."""
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("doc_id").cast("string").alias("name"), F.col("source").alias("sample"), "lang", F.col("text").alias("seq")).withColumn("len", F.length("seq"))


class Malformed(ValueError):
    pass


def records(lines, strict: bool = True):
    """(name, seq, qual) of the records in an iterable of text lines.

    A record starts at a line that begins with ``>`` or ``@``; what precedes the first is skipped. Sequence lines run until one that begins with ``>``,
    ``@`` or ``+``; after ``+`` quality lines run until they are as long as the sequence. A quality of another length
    raises, or ends the input if not ``strict``.
    """
    header, seq, qual = None, [], None
    size = got = 0
    for line in lines:
        line = line.rstrip("\n").removesuffix("\r")
        if qual is not None and got < size:
            qual.append(line)
            got += len(line)
            continue
        if qual is not None and got > size:
            break
        if line[:1] in (">", "@"):
            if header is not None:
                yield header, "".join(seq), "".join(qual) if qual is not None else None
            header, seq, qual, size, got = (line[1:].split(None, 1) or [""])[0] if not line[1:2].isspace() else "", [], None, 0, 0
        elif header is None or qual is not None:
            continue
        elif line[:1] == "+":
            qual, size = [], sum(map(len, seq))
        else:
            seq.append(line)
    if header is None:
        return
    if qual is not None and got != size:
        if strict:
            raise Malformed(f"record {header!r}: quality of {got} for {size} bases")
        return
    yield header, "".join(seq), "".join(qual) if qual is not None else None


#: Name endings of files that hold FASTA records only, and bytes of a split.
FASTA, SPLIT = (".fa", ".fasta", ".fna", ".fas", ".ffn"), 64 << 20


class _Split(InputPartition):
    """The records of a file whose headers begin at ``start`` or later and before ``end`` (-1: all of the file)."""

    def __init__(self, path: str, start: int, end: int, layout: str):
        super().__init__(path)
        self.start, self.end, self.layout = start, end, layout


def lines_of(f, start: int, end: int, layout: str):
    """Text lines of the records that begin in a range of a plain file.

    ``fasta``: a record begins at every line with ``>``; one with ``@`` or ``+`` raises. ``fastq4``: records are four lines, and a line with ``@``
    begins one if a line with ``+`` is the second after it; a line of qualities never has one there.
    """
    f.seek(max(0, start - 1))
    if start:
        f.readline()  # the rest of a line that began before the range
    held: list[tuple[int, bytes]] = []

    def line(i: int) -> bytes:
        while len(held) <= i:
            at = f.tell()
            held.append((at, f.readline()))
        return held[i][1]

    inside = False
    while line(0):
        first = held[0][1][:1]
        if layout == "fasta":
            begins = first == b">"
            if first in (b"@", b"+"):
                raise Malformed(f"a line that begins with {first.decode()!r} in a file read as FASTA; use the option layout = whole")
        else:
            begins = first == b"@" and line(2)[:1] == b"+"
        if begins and held[0][0] >= end:
            return
        take = 4 if begins and layout == "fastq4" else 1
        inside = inside or begins
        for i in range(take):
            text = line(i)
            if inside and text:
                yield text.decode("latin-1")
        del held[:take]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.strict = str(options.get("strict", "true")).lower() == "true"
        self.layout, self.split = options.get("layout", "auto"), int(options.get("splitBytes", SPLIT))
        if self.layout not in ("auto", "whole", "fasta", "fastq4"):
            raise ValueError(f"layout {self.layout!r} is none of auto, whole, fasta, fastq4")
        if not self.paths:
            raise ValueError("a path is needed")

    def partitions(self):
        from pyarrow import fs

        out = []
        for p in self.paths:
            system, path = fs.FileSystem.from_uri(p) if "://" in p or p.startswith("/") else fs.FileSystem.from_uri(f"file://{p}")
            info = system.get_file_info(path)
            found = system.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else [info]
            prefix = p.split("://")[0] + "://" if "://" in p else ""
            for f in sorted(found, key=lambda f: f.path):
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                    out += self._splits(system, prefix + f.path, f)
        return out

    def _splits(self, system, uri: str, info) -> list[_Split]:
        layout = self.layout
        if layout == "auto":
            layout = "fasta" if info.base_name.lower().endswith(FASTA) else "whole"
        if layout != "whole" and info.size > self.split:
            with system.open_input_file(info.path) as f:
                if f.read(2) != b"\x1f\x8b":  # gzip can't be entered in the middle
                    return [_Split(uri, at, at + self.split, layout) for at in range(0, info.size, self.split)]
        return [_Split(uri, 0, -1, "whole")]

    def read(self, partition):
        import gzip
        import io

        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.value)
        with system.open_input_file(path) as f:
            if partition.end >= 0:
                lines = lines_of(io.BufferedReader(f, 1 << 20), partition.start, partition.end, partition.layout)
            else:
                zipped = f.read(2) == b"\x1f\x8b"
                f.seek(0)
                lines = io.TextIOWrapper(gzip.GzipFile(fileobj=f) if zipped else f, encoding="latin-1", newline="\n")
            yield from batches(records(lines, self.strict))


class FastxSource(DataSource):
    """``spark.read.format("fastx")``: plain or gzip files by content; options ``strict`` (true), ``layout`` and ``splitBytes``.

    Layout ``fasta`` and ``fastq4`` (four lines a record) let several tasks read a plain file; ``whole`` takes any mix of records, one task a
    file; ``auto`` is ``fasta`` for files with such a name and ``whole`` for others. Gzip files are one task each.
    """

    @classmethod
    def name(cls):
        return "fastx"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def batches(found, size: int = 4 << 20):
    """Records as Arrow batches of about ``size`` bases; a record is never cut."""
    import pyarrow as pa

    def out():
        names, seqs, quals = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.string()), pa.array(quals, pa.string()), pa.array(list(map(len, seqs)), pa.int32())], ["name", "seq", "qual", "len"])

    rows, held = [], 0
    for r in found:
        rows.append(r)
        held += len(r[1])
        if held >= size or len(rows) >= 10_000:
            yield out()
            rows, held = [], 0
    if rows:
        yield out()


def read_fastx(spark, *paths: str, strict: bool = True, layout: str = "auto", split_bytes: int = SPLIT) -> DataFrame:
    """``(seq_id, name, seq, qual, len)``: ``seq_id`` tells records of equal names apart."""
    spark.dataSource.register(FastxSource)
    got = spark.read.format("fastx").option("path", ",".join(paths)).option("strict", strict).option("layout", layout).option("splitBytes", split_bytes).load()
    return got.withColumn("seq_id", F.monotonically_increasing_id())


def read_report(spark, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of one record type from a tab-separated report; ``schema`` names the columns after the type."""
    return spark.read.csv(path, sep="\t", schema=f"rec string, {schema}").filter(F.col("rec") == kind).drop("rec")
