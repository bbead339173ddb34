"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The words (pre-tokens) of all documents are counted by a grouped aggregation; the most
frequent are merged once and compiled into a minimal acyclic automaton whose equal
suffixes are shared. Arcs carry numbers whose sum along a path is the word's rank, and
the rank points to the word's ids. The automaton is one file in the shared folder,
which Spark hands to each executor (``addFile``) and every worker maps into memory, so
its size, bounded by ``lexicon_words``, does not grow with the corpus. Words outside of
the lexicon are merged exactly, by rank, with a heap when they are long.

Defined results: a null text encodes as an empty one; an empty text has no ids; the
string of a special token in a text is that token; ids outside of the vocabulary decode
to nothing and bytes that are no UTF-8 to U+FFFD; null ids decode to an empty text.
"""

from __future__ import annotations

import heapq
import json
import mmap
import struct
from array import array
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import cut, others, scratch, slices, table
from strandloom.llm.files import open_out
from strandloom.llm.words import Dictionary, byte_letters, chunks, words_of, words_of_spaced

LEXICON = 32_768
#: Counted chunks whose words a worker holds at once.
BLOCK = 16_384
NONE = np.int32(2**31 - 1)
MAGIC = b"LEXA"


class Slots:
    """A hash table of distinct non-negative keys for look-ups of whole arrays: a key that finds its slot taken goes to the next, smaller level."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(keys):
            bits = max(4, (8 * len(keys)).bit_length())
            held, value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            multiplier = np.uint64((0x9E3779B97F4A7C15 + 0x632BE59BD9B4E01A * len(self.levels)) % (1 << 64) | 1)
            self.levels.append((multiplier, np.uint64(64 - bits), held, value))
            slot = self._slot(keys, *self.levels[-1][:2])
            held[slot], value[slot] = keys, values
            left = held[slot] != keys
            keys, values = keys[left], values[left]

    @staticmethod
    def _slot(keys: np.ndarray, multiplier: np.uint64, shift: np.uint64) -> np.ndarray:
        return ((keys.view(np.uint64) * multiplier) >> shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, ``NONE`` for one that the table hasn't."""
        out = np.full(keys.shape, NONE, np.int32)
        flat, todo, asked = out.reshape(-1), None, keys.reshape(-1)
        for multiplier, shift, held, value in self.levels:
            slot = self._slot(asked, multiplier, shift)
            found = held[slot]
            same = found == asked
            at = np.flatnonzero(same)
            flat[at if todo is None else todo[at]] = value[slot[at]]
            other = np.flatnonzero(~same & (found >= 0))
            if not len(other):
                break
            todo, asked = other if todo is None else todo[other], asked[other]
        return out


class Vocabulary:
    """Ranks, ids and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters, vocab = byte_letters(), told["model"]["vocab"]
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {a["content"]: a["id"] for a in told["added_tokens"]}
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = raw(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.rank, self.made = {}, []
        for n, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[a] << 20 | vocab[b], n)
            self.made.append(vocab[a + b])
        self.pairs = Slots(np.array([*self.rank], np.int64), np.array([*self.rank.values()], np.int32))
        self.made_ids, self.byte_ids = np.array(self.made, np.int64), np.array(self.byte_id, np.int64)
        self.byte_rank = self.pairs.get(self.byte_ids[:, None] << 20 | self.byte_ids)
        lengths = np.array([*map(len, self.bytes), 0], np.int64)
        self.letters, self.sizes, self.starts = np.frombuffer(b"".join(self.bytes), np.uint8), lengths, np.cumsum(lengths) - lengths
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the adjacent pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, made, none = self.rank, self.made, 1 << 30
        ranks = [rank.get(a << 20 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = rank.get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """``merge`` of many words at once, ids as little-endian uint32: the same merges, a step for all words at a time."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > 32).tolist():
            out[i] = array("I", self.merge(words[i])).tobytes()
        for low, high in ((1, 8), (9, 16), (17, 32)):
            own = np.flatnonzero((lengths >= low) & (lengths <= high))
            for at in range(0, len(own), 1 << 16):
                rows = own[at : at + (1 << 16)]
                for i, ids in zip(rows.tolist(), self._merge_rows([words[i] for i in rows.tolist()], lengths[rows], high), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], lengths: np.ndarray, width: int) -> list[bytes]:
        """A row of ``width`` places a word; a merge keeps its pair's left place, the right one leaves the chain of neighbours."""
        n = len(words)
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        inside = np.arange(width) < lengths[:, None]
        ids = np.where(inside, self.byte_ids[raw], -1)
        rank = np.full((n, width), NONE, np.int32)  # of the pair that begins at each place
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_rank[raw[:, :-1], raw[:, 1:]], NONE)
        place = np.arange(n * width).reshape(n, width)
        left, right = np.where(place % width > 0, place - 1, -1).ravel(), np.where((place + 1) % width > 0, place + 1, -1)
        right[~np.roll(inside, -1, axis=1)] = -1
        ids, flat, right = ids.ravel(), rank.ravel(), right.ravel()
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1) + live * width
            low = flat[best]
            going = low < NONE
            live, at, low = live[going], best[going], low[going]
            gone = right[at]
            after, before = right[gone], left[at]
            made = self.made_ids[low]
            ids[at], ids[gone], flat[gone], right[at] = made, -1, NONE, after
            has = after >= 0
            left[after[has]] = at[has]
            flat[at] = NONE
            flat[at[has]] = self.pairs.get(made[has] << 20 | ids[after[has]])
            has = before >= 0
            flat[before[has]] = self.pairs.get(ids[before[has]] << 20 | made[has])
        own = ids >= 0
        ends = (4 * np.cumsum(own.reshape(n, width).sum(axis=1))).tolist()
        out = ids[own].astype(np.uint32).tobytes()
        return [out[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.made[r], -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (q := rank.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def build_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """Compiles words to a minimal acyclic automaton with rank outputs, followed by the words' ids.

    Layout, little-endian: magic, counts of states, arcs, words and ids; then uint32 arrays: first arc
    of each state (one more than states), arc targets, arc outputs, first id of each word (one more than
    words), ids; then arc labels and final flags, one byte each. State 0 is the start.
    """
    order = sorted(words)
    # States on the path of the last word are open: [final, [(label, target), ...]]; closed ones are in `known`.
    known: dict[tuple, int] = {}
    closed: list[tuple[bool, tuple]] = []
    path: list[list] = [[False, []]]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            at = known.get(key)
            if at is None:
                at = known[key] = len(closed)
                closed.append(key)
            label, _ = path[-1][1][-1]
            path[-1][1][-1] = (label, at)

    last = b""
    for word in order:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        close(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    states = [(path[0][0], tuple(path[0][1])), *closed]  # closed state i is state i + 1
    below = [0] * len(states)
    for s in [*range(1, len(states)), 0]:  # targets are closed before their sources
        below[s] = states[s][0] + sum(below[t + 1] for _, t in states[s][1])
    first, labels, targets, outs = array("I", [0]), bytearray(), array("I"), array("I")
    for final, arcs in states:
        out = int(final)
        for label, t in arcs:
            labels.append(label), targets.append(t + 1), outs.append(out)
            out += below[t + 1]
        first.append(len(labels))
    at, ids = array("I", [0]), array("I")
    for word in order:
        ids.extend(words[word])
        at.append(len(ids))
    head = MAGIC + struct.pack("<4I", len(states), len(labels), len(order), len(ids))
    return head + b"".join(x.tobytes() for x in (first, targets, outs, at, ids)) + bytes(labels) + bytes(int(f) for f, _ in states)


class Lexicon:
    """A compiled lexicon over a buffer or a mapped file."""

    def __init__(self, data):
        self.data = data
        if data[:4] != MAGIC:
            raise ValueError("not a lexicon file")
        n_states, n_arcs, n_words, n_ids = struct.unpack("<4I", data[4:20])
        view, at = memoryview(data), 20
        for name, n in (("first", n_states + 1), ("target", n_arcs), ("out", n_arcs), ("at", n_words + 1), ("ids", n_ids)):
            setattr(self, name, view[at : at + 4 * n].cast("I"))
            at += 4 * n
        self.raw_ids = bytes(self.ids)
        self.labels, self.final, self.states, self.words = at, view[at + n_arcs : at + n_arcs + n_states], n_states, n_words

        self.arrays = {name: np.frombuffer(getattr(self, name), np.uint32).astype(np.int64) for name in ("first", "target", "out", "at")}
        source = np.repeat(np.arange(n_states), np.diff(self.arrays["first"]))
        self.arcs = Slots(source << 8 | np.frombuffer(view[at : at + n_arcs], np.uint8), np.arange(n_arcs, dtype=np.int32))
        self.ends = np.frombuffer(self.final, np.uint8) > 0

    def get_many(self, words: list[bytes]) -> list[bytes | None]:
        """``get`` of many words at once, a letter of all of them at a time; ids as little-endian uint32."""
        out: list[bytes | None] = [None] * len(words)
        if not self.words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        letters, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        live = np.arange(len(words))
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i in range(int(lengths.max(initial=0)) + 1):
            done = live[lengths[live] == i]
            done = done[self.ends[state[done]]]
            for w, a, b in zip(done.tolist(), (4 * self.arrays["at"][rank[done]]).tolist(), (4 * self.arrays["at"][rank[done] + 1]).tolist(), strict=True):
                out[w] = self.raw_ids[a:b]
            live = live[lengths[live] > i]
            if not len(live):
                break
            arc = self.arcs.get(state[live] << 8 | letters[starts[live] + i])
            has = arc != NONE
            live, arc = live[has], arc[has]
            rank[live] += self.arrays["out"][arc]
            state[live] = self.arrays["target"][arc]
        return out

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, word: bytes):
        """The ids of a word, or None if the lexicon hasn't it."""
        first, base, find, state, rank = self.first, self.labels, self.data.find, 0, 0
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            rank += self.out[arc]
            state = self.target[arc]
        return self.ids[self.at[rank] : self.at[rank + 1]] if self.final[state] else None


class Encoder:
    def __init__(self, vocab: Vocabulary, lexicon: Lexicon | None = None):
        self.vocab, self.lexicon, self.dictionary = vocab, lexicon, Dictionary(self._words)

    def _words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out = self.lexicon.get_many(raw) if self.lexicon else [None] * len(raw)
        unseen = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(unseen, self.vocab.merge_many([raw[i] for i in unseen]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        texts, special = [t or "" for t in texts], self.vocab.special
        marked = [i for i, t in enumerate(texts) if any(s in t for s in special)]
        if not marked:
            return self.dictionary.encode(texts)
        held = set(marked)
        out = dict(zip((i for i in range(len(texts)) if i not in held), self.dictionary.encode([t for i, t in enumerate(texts) if i not in held]), strict=True))
        for i in marked:
            parts = [p for p in self.vocab.split_special.split(texts[i]) if p]
            ids = iter(self.dictionary.encode([p for p in parts if p not in special]))
            out[i] = b"".join(struct.pack("<I", special[p]) if p in special else next(ids) for p in parts)
        return [out[i] for i in range(len(texts))]


_encoders: dict = {}


def _encoder(path: str, lexicon: str | None) -> Encoder:
    """One encoder for each worker process: its dictionary outlives a task."""
    if (path, lexicon) not in _encoders:
        _encoders.clear()
        _encoders[path, lexicon] = Encoder(vocabulary(path), Lexicon.mapped(SparkFiles.get(lexicon)) if lexicon else None)
    return _encoders[path, lexicon]


def _forget() -> None:
    """Frees the dictionary of a lexicon that is to be compiled anew."""
    _encoders.clear()


def word_counts(docs: DataFrame, text_col: str = "text", flush: int = 500_000) -> DataFrame:
    """``(word, n)``: how often each pre-token occurs in all texts."""

    def run(batches):
        _forget()
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            words: Counter = Counter()
            for spaced, part in zip((False, True), seen, strict=True):
                counted = iter(part.items())
                while block := list(islice(counted, BLOCK)):
                    bodies = [c for c, _ in block]
                    split = words_of_spaced(bodies) if spaced else map(words_of, bodies)
                    for own, (_, n) in zip(split, block, strict=True):
                        for w in own:
                            words[w] += n
                part.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                for part, got in zip(seen, chunks(text or ""), strict=True):
                    part.update(got)
                if sum(map(len, seen)) >= flush:
                    yield out()
        yield out()

    return docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", lexicon_words: int = LEXICON) -> str:
    """Compiles the ``lexicon_words`` most frequent words of all documents (ties: smaller word) and hands the file to the executors; returns its name."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs, text_col).filter("word <> ''"))
    # counts fall into classes of an eighth of an octave, a few hundred; rows below the class that holds the last word of the lexicon never leave their tasks
    octave = F.floor(F.log2("n") * 8).cast("int")
    least, total = None, 0
    for r in sorted(counts.groupBy(octave.alias("o")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        least, total = r.o, total + r.n
        if total >= lexicon_words:
            break
    top = counts.filter(octave >= F.lit(least)).orderBy(F.desc("n"), "word").limit(lexicon_words)
    vocab = vocabulary(tokenizer)
    words = {w: vocab.merge(w) for w in (r[0].encode() for r in top.select("word").collect())}
    uri = scratch(spark, "lexicon")
    with open_out(uri) as f:
        f.write(build_lexicon(words))
    spark.sparkContext.addFile(uri)
    return uri.rsplit("/", 1)[1]


def _with(fields: list[T.StructField], added: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([*fields, *(T.StructField(name, kind) for name, kind in added.items())])


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of its text as ``array<int>``; a column of that name is replaced.

    With ``decoded_col`` the worker also decodes the ids, as ``decode`` does in a worker of its own; that column may replace the text.
    """
    added = {ids_col: T.ArrayType(T.IntegerType())} | ({decoded_col: T.StringType()} if decoded_col else {})
    read, stay = others(docs, ids_col), others(docs, *added)
    at, kept = read.index(text_col), [read.index(c) for c in stay]

    def run(batches):
        enc = _encoder(tokenizer, lexicon)
        for b in slices(batches):
            raw = enc.encode(b.column(at).to_pylist())
            offsets = np.zeros(len(raw) + 1, np.int32)
            np.cumsum([len(r) // 4 for r in raw], out=offsets[1:])
            flat = np.frombuffer(b"".join(raw), np.int32)
            new = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded_col:
                new.append(decode_many(enc.vocab, flat, offsets[1:]))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), *new], [*stay, *added])

    src = docs.select(*(f"`{c}`" for c in read))
    return src.mapInArrow(run, _with([src.schema.fields[i] for i in kept], added))


def decode_ids(vocab: Vocabulary, ids) -> bytes:
    known = vocab.bytes
    return b"".join([known[i] for i in ids if 0 <= i < len(known)]) if len(ids) else b""


def decode_many(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray, block: int = 1 << 16) -> pa.Array:
    """The texts of several documents' ids, given one after the other with the end of each."""
    bounds, parts = np.zeros(len(ids) + 1, np.int64), []
    for at in range(0, len(ids), block):
        own = ids[at : at + block].astype(np.int64)
        own[(own < 0) | (own >= len(vocab.bytes))] = len(vocab.bytes)  # whose bytes are none
        size = vocab.sizes[own]
        after = np.cumsum(size)
        bounds[at + 1 : at + 1 + len(own)] = bounds[at] + after
        parts.append(vocab.letters[np.arange(after[-1]) + np.repeat(vocab.starts[own] - after + size, size)].tobytes())
    raw, cuts = b"".join(parts), bounds[np.concatenate(([0], ends))]
    if len(raw) < 1 << 31:
        texts = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(raw)])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            pass
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.string())


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids in ``out_col``."""
    keep = others(df, out_col)
    at = keep.index(ids_col)

    def run(batches):
        vocab = vocabulary(tokenizer)
        for b in slices(batches):
            col = b.column(at)
            ends = np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            texts = decode_many(vocab, col.flatten().to_numpy(zero_copy_only=False), ends)
            yield pa.RecordBatch.from_arrays([*b.columns, texts], [*keep, out_col])

    src = df.select(*(f"`{c}`" for c in keep))
    return src.mapInArrow(run, _with(src.schema.fields, {out_col: T.StringType()}))


def op6_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = encode(docs, path, compile_lexicon(docs, path), decoded_col="text")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
