import io

import pytest

from strandloom.__main__ import k_of, main
from strandloom.operators import table as tables
from tests.test_reports import MAT, PAT


def text(path):
    return sorted(x for f in path.glob("part-*") for x in f.read_text().splitlines())


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("cli")
    (top / "pat.fa").write_text("".join(f">p{i}\n{PAT}\n" for i in range(6)))
    (top / "mat.fa").write_text("".join(f">m{i}\n{MAT}\n" for i in range(6)))
    (top / "reads.fa").write_text(f">a\n{PAT[5:45]}\n>b\n{PAT[:30] + MAT[30:]}\n")
    for name in ("pat", "mat"):
        main(["count", "-k5", "-o", str(top / name), str(top / f"{name}.fa")], spark)
    return top


def test_commands(spark, files):
    go = lambda *a: main([*map(str, a), "-o", str(files / "out")], spark)
    p, m, r = files / "pat", files / "mat", files / "reads.fa"
    go("triobin", p, m, r)
    assert text(files / "out") == ["a\tp\t32\t0\t32\t0\t0\t0\t36\t0", "b\ta\t19\t21\t19\t21\t0\t0\t56\t4"]
    go("trioeval", "-e", "-F", p, m, r)
    got = text(files / "out")
    assert "S\ta\t8\t0\t7\t0\t0\t0\t40" in got and "E\tb\t40\t1\t2" in got and "F\tb\t1\t4\t31\t3" in got and "W\t1\t17\t0.058824" in got
    go("subtract", p, m)
    left = spark.read.parquet(str(files / "out"))
    assert left.columns == ["kmer", "cnt", "k"] and left.count() == spark.read.parquet(str(p)).join(spark.read.parquet(str(m)), "kmer", "left_anti").count()
    go("isec", p, m)
    go("recount", p, files / "mat.fa")
    go("cntasm", "-k5", "-x", 9, files / "pat.fa", files / "mat.fa")
    go("count", "-b", "-k5", files / "pat.fa", files / "mat.fa")
    go("print", "-c", p)
    assert all(x.endswith(("\t6", "\t12")) for x in text(files / "out"))
    go("qv", "-p", "-E", p, r)
    kinds = {x.split("\t")[0] for x in text(files / "out")}
    assert kinds == {"CC", "EK", "SQ", "CT", "FR", "ER", "CV", "QV"}
    go("chkerr", "-s", 3, p, r)
    assert text(files / "out")
    go("inspect", p)
    assert {x.split("\t")[0] for x in text(files / "out")} == {"HS"}
    go("inspect", "-m", 12, p, m)
    assert {x.split("\t")[0] for x in text(files / "out")} == {"SN", "QV"}
    go("sexchr", p, m, m, r, r)
    rows = text(files / "out")
    assert len(rows) == 4 and all(x.startswith("S\t") for x in rows)
    main(["groupxy", str(files / "out"), "-o", str(files / "parts")], spark)
    assert len(text(files / "parts")) == 4


def test_tables_of_different_k(spark, files):
    main(["count", "-k7", "-o", str(files / "seven"), str(files / "pat.fa")], spark)
    with pytest.raises(ValueError):
        main(["subtract", str(files / "pat"), str(files / "seven"), "-o", str(files / "x")], spark)


def test_version(capsys):
    main(["version"])
    assert capsys.readouterr().out.strip()


def test_seed_of_another_k_and_tables_without_rows(spark, files):
    with pytest.raises(ValueError):
        main(["cntasm", "-k7", "-i", str(files / "pat"), "-o", str(files / "x"), str(files / "pat.fa")], spark)
    main(["subtract", str(files / "pat"), str(files / "pat"), "-o", str(files / "none")], spark)
    assert k_of(spark, str(files / "none")) == 5 and spark.read.parquet(str(files / "none")).count() == 0
    with pytest.raises(ValueError):
        tables.subtract(tables.load_parquet(spark, str(files / "none")), tables.with_k(spark.createDataFrame([("ACG", 1)], "kmer string, cnt int"), 3))
    with pytest.warns(UserWarning, match="only the first"):
        main(["count", "-k5", "-o", str(files / "x"), str(files / "pat.fa"), str(files / "mat.fa")], spark)


def test_standard_input_and_headers(spark, files, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO((files / "pat.fa").read_text()))
    main(["count", "-k5", "-o", str(files / "piped"), "-"], spark)
    rows = lambda p: sorted(map(tuple, spark.read.parquet(str(p)).collect()))
    assert rows(files / "piped") == rows(files / "pat")
    main(["qv", str(files / "pat"), str(files / "reads.fa"), "-o", str(files / "report")], spark)
    assert [x.split("\t")[1] for x in text(files / "report") if x.startswith("CC")] == ["CT", "CV", "ER", "FR", "QV"]
