"""Token-ID files: one zstandard frame a document under a shared dictionary.

A writer task takes one range of ids, sorted, and writes one shard; what it returns is
one manifest row. The path holds the attempt number and only returned paths enter the
manifest, so a task that ran twice or died leaves at most an unlisted file. The shuffle
carries texts, once, for the ranges; ids never go through one.

Shard layout, little-endian::

    b"SLTOK1\\0\\0"  sha256 of the dictionary (32 bytes)
    frames, one a document, each the document's ids as uint16 or uint32
    index: for each document  id int64, has_id uint8, offset uint64, bytes uint64, n_tokens uint64 (five arrays)
    footer: offset of the index uint64, number of documents uint64, bytes of an id uint32, b"SLTK"

A reader opens the index alone and decompresses only the frames that it wants. The
manifest (JSON) lists shards in order, with the number of documents and ids before each.
"""

from __future__ import annotations

import hashlib
import json
import struct
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, models

from strandloom.llm.common import bounded_sample, scratch, shuffle_cleanup, slices, table
from strandloom.llm.files import open_in, open_out
from strandloom.llm.words import Dictionary, byte_letters

MAGIC, END = b"SLTOK1\0\0", b"SLTK"
#: The dictionary is trained on this many documents, those of the smallest id hash, of each at most so many bytes of ids.
SAMPLE_DOCS, SAMPLE_BYTES, BLOCK_BYTES, DICTIONARY_BYTES = 1_000, 4_096, 512, 65_536
#: Chunks that a worker keeps.
KEPT = 500_000
INDEX = (("id", np.int64), ("has_id", np.uint8), ("offset", np.uint64), ("bytes", np.uint64), ("n_tokens", np.uint64))


#: What a byte-level file must say of its splitter and its model so that pre-tokens can be handed to the library's model on their own.
SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


class LibraryEncoder:
    """The tokenizers library with a bounded dictionary from chunk to ids: each distinct pre-token is encoded once by a worker.

    New pre-tokens go to the library's model, without its cache, which costs more than the merges of a word that is met once.
    """

    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation(), self.lib.no_padding()
        self.width = np.dtype(np.uint16 if self.lib.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.dictionary = Dictionary(self._words, KEPT)
        told = json.loads(self.lib.to_str())
        model = told["model"]
        self.splits = told["normalizer"] is None and told["post_processor"] is None and told["pre_tokenizer"] == SPLITTER and model["type"] == "BPE" and PLAIN.items() <= model.items()
        if self.splits:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self.model = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
            self.letters = np.zeros(256, np.uint16)
            for letter, byte in byte_letters().items():
                self.letters[byte] = ord(letter)

    def _raw(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.width).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens, in the letters that stand for bytes in the model."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        spelled = self.letters[np.frombuffer(b"".join(raw), np.uint8)].tobytes().decode("utf-16-le")
        tokenize, ids, at, ends = self.model.tokenize, array("I"), 0, []
        for w in raw:
            end = at + len(w)
            ids.extend([t.id for t in tokenize(spelled[at:end])])
            ends.append(len(ids))
            at = end
        flat, size = np.frombuffer(ids, np.uint32).astype(self.width).tobytes(), self.width.itemsize
        return [flat[size * a : size * b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width``."""
        texts = [t or "" for t in texts]
        if not self.splits:
            return [self._raw(t) for t in texts]
        marked = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        plain = iter(self.dictionary.encode([t for i, t in enumerate(texts) if i not in marked]))
        return [self._raw(t) if i in marked else next(plain) for i, t in enumerate(texts)]


_encoders: dict[str, LibraryEncoder] = {}


def _encoder(path: str) -> LibraryEncoder:
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def spread(raw: bytes, width: int) -> bytes:
    """At most ``SAMPLE_BYTES`` of a document's ids: all, or blocks at even distances from its first id to its last."""
    if len(raw) <= SAMPLE_BYTES:
        return raw
    n = SAMPLE_BYTES // BLOCK_BYTES
    starts = [(len(raw) - BLOCK_BYTES) // width * i // (n - 1) * width for i in range(n)]
    return b"".join(raw[a : a + BLOCK_BYTES] for a in starts)


def train_dictionary(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int | None) -> bytes:
    """A zstandard dictionary from the serialized ids of a bounded sample; empty if the sample is too small to train on."""

    def run(batches):
        enc = _encoder(tokenizer)
        for b in slices(batches):
            tail = b"" if end_id is None else np.array([end_id], enc.width).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([spread(x + tail, np.dtype(enc.width).itemsize) for x in enc.encode(b.column(0).to_pylist())], pa.binary())], ["ids"])

    sample = bounded_sample(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", SAMPLE_DOCS)
    rows = [bytes(r[0]) for r in sample.select("__text").mapInArrow(run, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, rows)) // 8)), rows).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_token_files(docs: DataFrame, uri: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Encodes every text and writes shards in ascending id order (nulls first; equal ids by text hash); returns the manifest.

    A null text is an empty one. An empty table writes a manifest without shards. Other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    dictionary = train_dictionary(src, tokenizer, "id", "text", end_id)
    name = hashlib.sha256(dictionary).digest()
    with open_out(f"{uri}/dictionary.zdict") as f:
        f.write(dictionary)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        enc, task = _encoder(tokenizer), TaskContext.get()
        zstd = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        tail = b"" if end_id is None else np.array([end_id], enc.width).tobytes()
        path, out, at, index = f"{uri}/shard-{task.partitionId():06d}.{task.taskAttemptId()}.tok", None, len(MAGIC) + len(name), []
        for b in slices(batches):
            for i, raw in zip(b.column(0).to_pylist(), enc.encode(b.column(1).to_pylist()), strict=True):
                if out is None:
                    out = open_out(path)
                    out.write(MAGIC + name)
                raw += tail
                frame = zstd.compress(raw)
                out.write(frame)
                index.append((i or 0, i is not None, at, len(frame), len(raw) // enc.width.itemsize))
                at += len(frame)
        if out is None:
            return
        columns = [np.array(c, kind) for c, (_, kind) in zip(zip(*index, strict=True), INDEX, strict=True)]
        for c in columns:
            out.write(c.tobytes())
        out.write(struct.pack("<QQI", at, len(index), enc.width.itemsize) + END)
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([path]), pa.array([len(index)], pa.int64()), pa.array([int(columns[4].sum())], pa.int64())], ["part", "path", "n_docs", "n_tokens"])

    dealt = src.repartitionByRange(shards, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    with shuffle_cleanup(spark):
        done = sorted(dealt.mapInArrow(run, "part long, path string, n_docs long, n_tokens long").collect())
    found, docs_before, before = [], 0, 0
    for r in done:
        found.append({"path": r.path, "n_docs": r.n_docs, "n_tokens": r.n_tokens, "docs_before": docs_before, "start": before})
        docs_before, before = docs_before + r.n_docs, before + r.n_tokens
    manifest = {"dictionary": name.hex(), "shards": found, "n_docs": docs_before, "n_tokens": before}
    with open_out(f"{uri}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class Shard:
    """A shard's index, and its documents by position."""

    def __init__(self, path: str, dictionary: bytes):
        self.file = open_in(path)
        size = self.file.size()
        self.file.seek(size - 24)
        at, n, self.item, end = struct.unpack("<QQI4s", self.file.read(24))
        if end != END:
            raise ValueError(f"{path} is no shard")
        self.file.seek(0)
        head = self.file.read(len(MAGIC) + 32)
        if head != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.file.seek(at)
        for name, kind in INDEX:
            setattr(self, name, np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind))
        self.zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        self.file.seek(int(self.offset[i]))
        raw = self.zstd.decompress(self.file.read(int(self.bytes[i])))
        return np.frombuffer(raw, np.uint16 if self.item == 2 else np.uint32).astype(np.uint32)


def _manifest(uri: str) -> tuple[dict, bytes]:
    with open_in(f"{uri}/manifest.json") as f:
        manifest = json.loads(f.read())
    with open_in(f"{uri}/dictionary.zdict") as f:
        return manifest, f.read()


def read_document(uri: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents of one id: a binary search in the index of the shards that may hold it."""
    manifest, dictionary = _manifest(uri)
    out = []
    for s in manifest["shards"]:
        shard = Shard(s["path"], dictionary)
        skip = int((shard.has_id == 0).sum())
        low, high = (skip + np.searchsorted(shard.id[skip:], doc_id, side) for side in ("left", "right"))
        out += [shard.ids(i) for i in range(low, high)]
    return out


def read_token_files(spark, uri: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, ``start`` (ids before it), ``n_tokens`` and ``ids_le`` (uint32, little-endian)."""
    manifest, dictionary = _manifest(uri)
    kind = f"{id_col} long, start long, n_tokens long, ids_le binary"
    shards = [(s["path"], s["start"]) for s in manifest["shards"]]
    if not shards:
        return spark.createDataFrame([], kind)

    def run(batches):
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(path, dictionary)
                starts = start + np.concatenate(([0], np.cumsum(shard.n_tokens[:-1]))).astype(np.int64)
                for at in range(0, len(shard.id), 512):
                    rows = slice(at, at + 512)
                    ids = [shard.ids(i).tobytes() for i in range(at, min(at + 512, len(shard.id)))]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.id[rows], mask=shard.has_id[rows] == 0), pa.array(starts[rows]), pa.array(shard.n_tokens[rows].astype(np.int64)), pa.array(ids, pa.binary())], [id_col, "start", "n_tokens", "ids_le"])

    rows = spark.createDataFrame(shards, "path string, start long").repartition(len(shards))
    return rows.mapInArrow(run, kind)


def op4_token_files(spark, sf_dir):
    import public_tokenizers

    uri = scratch(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), uri, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, uri).select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))
