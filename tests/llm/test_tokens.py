import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from strandloom.llm import bpe, token_files, words
from strandloom.llm.words import SPLIT, split

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
VOCAB = bpe.vocabulary(PATH)
OWN, LIBRARY = bpe.Encoder(VOCAB), token_files.LibraryEncoder(PATH)
ODD = ["", None, "a", " ", "  a  b ", "It's 12½ o'clock\n\n  ok", "<|endoftext|>x<|endoftext|>", "中文 🙂 ﷽", "ab" * 3000, "é" * 500, "x\n  b", "tab\t tab", "a\x1cb", "line\r\nline "]


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def lexicon():
    words = {w.encode() for t in ODD if t for w in split(t)} | {b"the", b" the", b"then", b"s", b" cats", b"bats"}
    return bpe.Lexicon(bpe.build_lexicon({w: VOCAB.merge(w) for w in words})), words


def test_lexicon_is_minimal_and_complete():
    lex, words = lexicon()
    assert lex.words == len(words)
    for w in words:
        assert lex.get(w).tolist() == VOCAB.merge(w)
    assert lex.get(b"th") is None and lex.get(b"thenx") is None and lex.get(b"") is None
    probe = [*words, b"th", b"thenx", b"", b"zz"]
    assert [None if x is None else list(np.frombuffer(x, np.uint32)) for x in lex.get_many(probe)] == [None if (x := lex.get(w)) is None else x.tolist() for w in probe]
    few = bpe.Lexicon(bpe.build_lexicon({w: [1] for w in (b"tap", b"taps", b"top", b"tops")}))
    assert few.states == 5  # both "ap" and "op" end in the same states
    assert bpe.Lexicon(bpe.build_lexicon({})).get(b"a") is None


@pytest.mark.parametrize("with_lexicon", [False, True])
def test_encoder_is_the_library(with_lexicon):
    enc = bpe.Encoder(VOCAB, lexicon()[0] if with_lexicon else None)
    got = [np.frombuffer(x, np.uint32).tolist() for x in enc.encode(ODD)]
    assert got == [ids_of(t) for t in ODD]
    assert [bpe.decode_ids(VOCAB, i).decode() for i in got] == [t or "" for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sreAZé1½中_!"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    want = ids_of(text)
    assert np.frombuffer(OWN.encode([text])[0], np.uint32).tolist() == want
    assert np.frombuffer(LIBRARY.encode([text])[0], np.uint16).tolist() == want


def test_merges_of_random_words():
    r = random.Random(2)
    words = ["".join(r.choice("etaoin shé") for _ in range(r.randint(0, 60))).encode() for _ in range(500)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in VOCAB.merge_many(words)] == [VOCAB.merge(w) for w in words]
    for w in words:
        ids = [VOCAB.byte_id[b] for b in w]
        assert VOCAB._merge_long(ids) == VOCAB.merge(w)


def test_split_keeps_all_letters():
    for t in ODD:
        assert "".join(split(t or "")) == (t or "") and "".join(SPLIT.findall("a b")) == "a b"


def test_lines_share_their_chunks():
    ends, starts = [f"end{a}." for a in "abcdefghij"], [f"Start{a}" for a in "abcdefghij"]
    text = " ".join(f"{a}\n{b}" for a in ends for b in starts)
    for enc, kind in ((bpe.Encoder(VOCAB), np.uint32), (token_files.LibraryEncoder(PATH), np.uint16)):
        assert np.frombuffer(enc.encode([text])[0], kind).tolist() == ids_of(text)
        assert len(enc.dictionary.spaced) < 40  # not one for each of 100 pairs


@pytest.mark.parametrize("encoder, kind", [(OWN, np.uint32), (LIBRARY, np.uint16)])
def test_breaks_and_white_space(encoder, kind):
    texts = ["".join(t) for n in range(1, 6) for t in itertools.product("a. \n\r", repeat=n)]
    assert [np.frombuffer(x, kind).tolist() for x in encoder.encode(texts)] == [ids_of(t) for t in texts]
    odd = ["".join(t) for n in range(1, 5) for t in itertools.product("b'\n\t\xa0\x85\x1c中1", repeat=n)]
    assert [np.frombuffer(x, kind).tolist() for x in encoder.encode(odd)] == [ids_of(t) for t in odd]


class CountedPattern:
    def __init__(self):
        self.calls = 0

    def findall(self, text):
        self.calls += 1
        return SPLIT.findall(text)


def test_new_chunks_are_split_together(monkeypatch):
    texts = ["start " + " ".join(f"it's{i}.\nNext,{i}\n" if i % 3 else f"(é{i})\xa0" for i in range(n, n + 500)) for n in (0, 500)]
    counted = CountedPattern()
    monkeypatch.setattr(words, "SPLIT", counted)
    got = bpe.Encoder(VOCAB).encode(texts)
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == [ids_of(t) for t in texts]
    assert counted.calls < 10  # not one for each of 1,000 chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("\n\t'sreAZé1½中_!.\xa0\x85"), st.characters(codec="utf-8", exclude_characters=" ")), min_size=1, max_size=8), max_size=6))
def test_chunks_split_together_as_alone(bodies):
    bodies = [b for b in bodies if not words.UNSAFE.search(" " + b)]
    assert words.words_of_spaced([x for b in bodies for x in (b, "\n" + b)]) == [x for b in bodies for x in (split(" " + b), split("\n" + b))]
    assert words.words_of_spaced(bodies) == [split(" " + b) for b in bodies]


def test_slots_find_all_keys_and_no_others():
    r = np.random.default_rng(3)
    keys = np.unique(r.integers(0, 1 << 36, 20_000))
    held, others = keys[::2], keys[1::2]
    slots = bpe.Slots(held, np.arange(len(held), dtype=np.int32))
    assert len(slots.levels) > 1
    assert (slots.get(held) == np.arange(len(held))).all() and (slots.get(others) == bpe.NONE).all()
    assert slots.get(held[:6].reshape(2, 3)).tolist() == [[0, 1, 2], [3, 4, 5]]
    assert bpe.Slots(held[:0], np.zeros(0, np.int32)).get(others[:3]).tolist() == [bpe.NONE] * 3


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_many_documents_decode_as_one_by_one(block):
    r = random.Random(5)
    size = len(VOCAB.bytes)
    for odd in (False, True):  # with ids outside of the vocabulary and bytes that are no UTF-8, or without
        rows = [ids_of(t) for t in ODD] + ([[r.randrange(-3, size + 3) for _ in range(r.randint(0, 30))] for _ in range(50)] if odd else [])
        got = bpe.decode_many(VOCAB, np.array([i for row in rows for i in row], np.int32), np.cumsum([len(row) for row in rows]), block)
        assert got.to_pylist() == [bpe.decode_ids(VOCAB, row).decode("utf-8", "replace") for row in rows]
    assert bpe.decode_many(VOCAB, np.zeros(0, np.int32), np.zeros(0, np.int64)).to_pylist() == []


def documents(spark, texts=ODD):
    return spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, ids int")


def test_encode_and_decode_frames(spark):
    docs = documents(spark)
    name = bpe.compile_lexicon(docs, PATH, lexicon_words=20)
    ids = bpe.encode(docs, PATH, name)
    assert ids.columns == ["doc_id", "text", "ids"]
    rows = bpe.decode(ids, PATH, out_col="text").orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [ids_of(t) for t in ODD] and [r.text for r in rows] == [t or "" for t in ODD]
    none = bpe.encode(docs.limit(0), PATH, bpe.compile_lexicon(docs.limit(0), PATH))
    assert none.count() == 0
    odd = spark.createDataFrame([(1, None), (2, [70000, 64, 255])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == ["", bpe.decode_ids(VOCAB, [64, 255]).decode("utf-8", "replace")]


def test_one_worker_encodes_and_decodes(spark, tmp_path, capsys):
    docs = documents(spark)
    both = bpe.encode(docs, PATH, bpe.compile_lexicon(docs, PATH, lexicon_words=20), decoded_col="text")
    assert both.columns == ["doc_id", "ids", "text"]
    assert [(r.ids, r.text) for r in both.orderBy("doc_id").collect()] == [(ids_of(t), t or "") for t in ODD]
    beside = bpe.encode(docs, PATH, decoded_col="decoded")
    assert beside.columns == ["doc_id", "text", "ids", "decoded"]
    assert [(r.text, r.decoded) for r in beside.orderBy("doc_id").collect()] == [(t, t or "") for t in ODD]
    assert bpe.encode(docs.limit(0), PATH, decoded_col="text").count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bpe.op6_bpe(spark, str(tmp_path)).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1  # a second one is a second worker for each running task


def test_a_new_count_frees_the_dictionary(spark):
    docs = documents(spark).coalesce(1)
    before = bpe.encode(docs, PATH).collect()

    def held(batches):
        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([len(bpe._encoders)], pa.int64())], ["n"])

    def workers():
        return max(r.n for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n long").collect())

    assert workers() == 1
    bpe.word_counts(spark.range(0, 64, 1, 64).selectExpr("string(id) text")).collect()
    assert workers() == 0
    assert bpe.encode(docs, PATH).collect() == before


def test_word_counts_in_blocks(spark, monkeypatch):
    texts = ["start " + " ".join(f"it's{i % 7}.\nNext,{i}\n" if i % 3 else f"(é{i})\xa0 中{i}" for i in range(200)), "a  b", *ODD]
    rows = lambda: sorted(map(tuple, bpe.word_counts(documents(spark, texts)).collect()))
    want = rows()
    monkeypatch.setattr(bpe, "BLOCK", 7)
    assert rows() == want
    told = Counter(w for t in texts for w in split(t or ""))
    assert {w: n for w, n in want if w} == dict(told)


def test_word_counts(spark):
    docs = documents(spark, ["the cat the", "the", None, "cat  sat"])
    got = {r.word: r.n for r in bpe.word_counts(docs, flush=2).filter("word <> ''").collect()}
    assert got == {"the": 2, " cat": 1, " the": 1, "cat": 1, " ": 1, " sat": 1}


def test_op6_against_the_library(spark, tmp_path):
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(ODD)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op6_bpe(spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {i: (len(ids_of(t)), sha(",".join(map(str, ids_of(t)))), sha(LIB.decode(ids_of(t), skip_special_tokens=False))) for i, t in enumerate(ODD)}


def test_token_files(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, r.choice([None, "", "some words here", "word " * r.randint(1, 50)]), "x") for i in range(-5, 60)] + [(7, "again", "x"), (None, "no id", "x")]
    spark.createDataFrame(r.sample(rows, len(rows)), "doc_id long, text string, start string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.op4_token_files(spark, str(tmp_path)).collect())
    start, want = 0, []
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for i, n, c in [(g[1], g[2], g[3]) for g in got]:
        want.append((start, i, n, c))
        start += n
    assert got == want
    assert [g[1] for g in got] == [None, *sorted(i for i, _, _ in rows if i is not None)]
    told = sorted((str(i), len(ids_of(t)) + 1, crc([*ids_of(t), 2])) for i, t, _ in rows)
    assert sorted((str(g[1]), g[2], g[3]) for g in got) == told


def test_short_document_access_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 7)) for i in range(200)], "doc_id long, text string")
    uri = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(docs, uri, PATH, shards=5)
    assert manifest["n_docs"] == 200 and len(manifest["shards"]) > 1
    for i in (0, 13, 199):
        assert [x.tolist() for x in token_files.read_document(uri, i)] == [[*ids_of(f"text number {i} " * (i % 7)), 2]]
    assert token_files.read_document(uri, 500) == []
    empty = token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/none", PATH)
    assert empty["shards"] == [] and token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_dictionary_sample_spans_the_document():
    for kind in ("<u2", "<u4"):
        for n in (0, 5, 1_024, 2_048, 2_049, 3_001, 60_000):
            ids = np.arange(n, dtype=kind)
            got = np.frombuffer(token_files.spread(ids.tobytes(), ids.itemsize), kind)
            assert got.nbytes == min(ids.nbytes, token_files.SAMPLE_BYTES) and (np.diff(got.astype(int)) > 0).all()
            assert not n or (got[0] == 0 and got[-1] == n - 1)
            assert n < 60_000 or np.diff(got.astype(int)).max() <= n // 7


def test_dictionary_is_trained_on_long_documents(spark):
    r = random.Random(2)
    docs = [(i, " ".join(r.choice(("alpha", "beta", "gamma", "delta")) for _ in range(4_000))) for i in range(12)]
    assert token_files.train_dictionary(spark.createDataFrame(docs, "id long, text string"), PATH, "id", "text", 2)
