import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_dedup import brute_lines, brute_near
from tests.llm.test_models import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, labels, bad = corpus(300, seed=9)
    rows = [(i, t, lang, s, len(t)) for i, t, lang, s in docs]
    clean = [x for x in rows if x[0] not in bad]
    shared = "one line that many share\nsecond line of it\nthird line of it"
    rows += [(1000 + i, clean[i][1] + "\n" + shared, "en", "s", 0) for i in range(5)] + [(2000, clean[30][1], "en", "s", 0), (2001, clean[31][1].upper(), "en", "s", 0), (2002, None, "en", "s", None), (2003, "", "en", "s", 0)]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(top / "labels.parquet"))
    return str(top), bad


def test_stages(spark, tables, tmp_path):
    import public_tokenizers

    sf_dir, bad = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = (before, docs.collect())
        if name != "bpe":
            assert docs.columns == columns
    before, after = kept["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert len(gone & bad) >= 0.95 * len(bad) and len(gone - bad) <= 2
    before, after = kept["line_dedup"]
    want = brute_lines([(r.doc_id, r.text) for r in before])
    assert {r.doc_id: r.text for r in after if r.text is not None} == {i: t for i, (_, n, t) in want.items() if not n or t.strip(" ")}
    before, after = kept["near_dedup"]
    rows = sorted(((r.doc_id, r.text) for r in before), key=lambda x: x[0])
    low, _ = brute_near(rows)
    assert sorted(r.doc_id for r in after) == sorted({rows[c][0] for c in low})
    before, after = kept["mixing"]
    assert {r.doc_id for r in before} == {r.doc_id for r in after} and len(after) >= len(before)
    before, after = kept["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    assert all(r.ids == lib.encode(texts[r.doc_id] or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in after)


def test_run_and_registration(spark, tables):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run and corpus_pipeline.ORACLE_SQL is None
    assert [n for n in range(1, 11) if not any(re.match(rf"op{n}_", q) for q in entry.queries())] == []
    assert corpus_pipeline.run(spark, tables[0]).count() > 150


def test_stages_of_odd_tables(spark, tables, tmp_path):
    sf_dir, _ = tables
    labels = str(tmp_path)
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{labels}/labels.parquet")
    kind = "doc_id long, text string, lang string, source string, n_lines int, score double, RATE int, __h string, __copy int, row string"
    rows = [(5001, None, None, None, 1, 0.1, 2, "a", 3, "r"), (5001, None, None, None, 1, 0.1, 2, "a", 3, "r"), (None, "one two", "en", None, None, None, None, None, None, None),
            (5002, "", "en", "s", 7, 0.9, 9, "b", 4, "q"), (5003, "long " * 60_000, "en", "s", 7, 0.9, 9, "b", 4, "q"), (5003, "long " * 60_000, "en", "s", 7, 0.9, 9, "b", 4, "q")]
    # none of the ids has a label
    for found in (rows, []):
        docs = spark.createDataFrame(found, kind)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, labels)
            got = out.collect()
            if name == "bpe":
                assert len(got) == len(found) and all(r.n_tokens == len(r.ids) for r in got)
            else:
                assert out.columns == docs.columns
            if name in ("toxicity", "line_dedup"):
                assert sorted(map(str, got)) == sorted(map(str, docs.collect()))
            if name == "near_dedup" and found:
                assert {(r.doc_id, r["row"]) for r in got} == {(5001, "r"), (None, None), (5003, "q")} and len(got) == 3
            if name == "mixing":
                assert {r.doc_id for r in got} == {r[0] for r in found} and len(got) >= len(found)
