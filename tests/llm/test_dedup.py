import random
import re

import numpy as np
import pytest
import xxhash

from strandloom.llm import components, line_dedup, near_copies, simhash


def brute_groups(rows, width=4):
    ids, fps = [r[0] for r in rows], []
    for _, t in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sh = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else ([" ".join(w)] if w else [])
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return fps, brute_components(fps, ids)


def brute_components(fps, ids):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            label[max(a, b)] = min(a, b)
    low = {}
    for i in range(len(f)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(f))]


def test_groups_match_brute_force(spark, tmp_path):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdeÉ") for _ in range(3))
    base = [" ".join(word() for _ in range(n)) for n in (300, 200, 40, 6, 3)]
    rows = []
    for i in range(80):
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        rows.append((r.randrange(10**6), r.choice(["\n", " ", "  "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    rows += [(5, None), (3, ""), (9, " \t\n"), (11, "one"), (12, "ONE "), (13, base[0]), (13, base[0]), (None, base[1])]
    spark.createDataFrame([(*x, "extra") for x in rows], "doc_id long, text string, fp string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((str(x.doc_id), x.fingerprint, x.component_id) for x in simhash.op1_simhash(spark, str(tmp_path)).collect())
    fps, low = brute_groups(rows)
    assert got == sorted((str(i), format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, low, strict=True))
    assert {x[2] for x in got if x[1] == "0" * 16} == {3}


@pytest.mark.parametrize("per_task", [2_000_000, 3_000])
def test_links_near_the_radius(spark, per_task):
    r = random.Random(per_task)
    fps = set()
    for _ in range(12):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(30):
            fps.add(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"), per_task=per_task)
    got = {x.node: x.root for x in components.connected_components(links).collect()}
    low = brute_components(fps, list(range(len(fps))))
    by = {}
    for x, c in zip(signed, low, strict=True):
        by.setdefault(c, set()).add(got.get(x, x))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set().union(*by.values()))


def test_salts_make_every_variant_once():
    bits = list(range(8, 64))
    codes, masks = simhash._bit_codes(bits), np.array([m for m, _ in simhash._masks(bits, 2)], np.uint64)
    assert len(set(codes.tolist())) == len(codes)
    of_masks = simhash._classes(masks, bits, codes)
    for fp in (0, 1 << 63, 0x0123456789ABCDEF):
        variants = np.uint64(fp) ^ masks
        assert (simhash._classes(variants, bits, codes) == simhash._classes(np.array([fp], np.uint64), bits, codes)[0] ^ of_masks).all()
    sizes = np.bincount(of_masks % 16, minlength=16)
    assert sizes.sum() == len(masks) and sizes.max() < 2 * sizes.mean()


@pytest.mark.parametrize("prefix_bits", [None, 17])
def test_links_of_one_hot_cluster(spark, prefix_bits):
    r = random.Random(7)
    base = r.getrandbits(63)
    fps = sorted({base ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 2, 3, 7]))) for _ in range(120)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.ball_links(spark.createDataFrame([(x,) for x in signed], "fp long"), per_task=2_000, prefix_bits=prefix_bits)
    got = {x.node: x.root for x in components.connected_components(links).collect()}
    by = {}
    for x, c in zip(signed, brute_components(fps, list(range(len(fps)))), strict=True):
        by.setdefault(c, set()).add(got.get(x, x))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len(set().union(*by.values()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (300, 200), (200, 250)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_near(rows, width=5):
    """The smallest index that each row is connected with by pairs of shingle sets at 0.8 or more, and how many pairs are under 0.9."""
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label, close = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            both, whole = len(sets[i] & sets[j]), len(sets[i]) + len(sets[j])
            if 9 * both >= 4 * whole and (both or not whole):
                close += 10 * both < 9 * (whole - both)
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label, close


def test_near_dedup_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    near = text.replace("w100 ", "w100x ", 1)
    rows = [(4, text, "b"), (2, near, "a"), (2, near, "a"), (2, "another text altogether", "c"), (None, None, "d"), (8, "", "e"), (9, text.upper(), "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = sorted((str(r.doc_id), r.text, r.root) for r in simhash.near_dedup(docs).collect())
    assert len(kept) == 3 and ("2", near, "a") in kept and ("2", "another text altogether", "c") in kept
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def brute_lines(rows):
    keyed = sorted({(i, t) for i, t in rows if t is not None}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, t in keyed:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


def test_line_windows_match_a_scan(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["", " ", "a", "b", "c", "d", "long line " * 9]) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(100, "x\ny\nz\nx\ny\nz\n"), (101, ""), (102, "\n\n\n\n"), (103, None), (104, "p\nq")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_lines int, __x string")
    want = brute_lines(rows)
    for x in line_dedup.line_dedup(docs).collect():
        assert (x.n_lines, x.n_removed, x.text) == want.get(x.doc_id, (0, 0, None)), x.doc_id
        assert x["__x"] == "k"
    assert line_dedup.line_dedup(docs.limit(0)).count() == 0


def test_line_windows_of_repeated_rows_and_null_ids(spark):
    text = "one\ntwo\nthree"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "a\nb\nc")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.line_dedup(docs).collect())
    assert got == [("1", text), ("1", text), ("2", ""), ("None", "a\nb\nc")]


def test_near_dedup_links_every_pair_at_four_fifths(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(12))
    rows, changes = [], ((1, 30), (1, 50), (2, 90), (3, 150), (6, 300), (5, 200), (4, 100), (20, 1000))
    for n_changed, n in changes * 4:
        w = [word() for _ in range(n)]
        rows.append((len(rows), " ".join(w) + " " + line))
        for at in r.sample(range(n), n_changed):
            w[at] = word()
        rows.append((len(rows), " ".join(w) + " " + line))
    rows += [(len(rows) + i, line + " " + word()) for i in range(5)]
    low, close = brute_near(rows)
    assert close >= 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.near_dedup(docs).collect()) == sorted(set(low))


@pytest.mark.parametrize("block_texts", [1024, 20])
def test_families_that_fill_several_blocks(spark, block_texts):
    r = random.Random(block_texts)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    first = [word() for _ in range(150)]
    rows = []
    for i in range(150):
        w = list(first)
        for at in r.sample(range(150), r.choice((0, 1, 2, 4, 8))):
            w[at] = word()
        rows.append((i, " ".join(w)))
    low, _ = brute_near(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for x in near_copies.near_groups(docs, "doc_id", "text", 5, per_task=3_000, block_texts=block_texts).collect():
        got.setdefault(x.root, set()).add(x.id)
    want = {}
    for i, c in enumerate(low):
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 5 < len(want) < 120


def test_recall_at_the_similarity_itself():
    r = np.random.default_rng(1)
    bits = near_copies.bits_for(250_000)
    tables, sets = near_copies.tables_for(bits), []
    for _ in range(400):
        every = r.integers(0, 2**64, 111, dtype=np.uint64)
        sets += [np.sort(every[:100]), np.sort(every[11:])]
    got = near_copies.lanes_of(sets, range(1, 2 + tables))
    apart = np.bitwise_count((got[0::2] ^ got[1::2]) & np.uint64((1 << bits) - 1))
    assert (apart[:, 1:].min(axis=1) <= near_copies.RADIUS).mean() >= 0.98
    assert (np.bitwise_count(got[0::2, 0] ^ got[1::2, 0]) <= near_copies.CHECK).mean() >= 0.98


def test_fingerprints_count_bits_of_long_sets():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 2**64, n, dtype=np.uint64)) for n in (0, 1, 255, 256, 2_000)]
    got = near_copies.lanes_of(sets, range(3, 5))
    for s, row in zip(sets, got, strict=True):
        for lane, fp in zip((3, 4), row, strict=True):
            h = near_copies._mixed(s, lane)
            assert int(fp) == sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(s))
