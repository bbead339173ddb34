"""SQL for the registered queries, put together from named parts."""

from __future__ import annotations

SEQ = """s AS (SELECT doc_id AS seq_id, CAST(doc_id AS VARCHAR) AS name, source AS sample, lang, TRY_CAST(substr(source, 4) AS INTEGER) AS src,
  regexp_replace(replace(upper(text), 'U', 'T'), '[^ACGT]', '', 'g') AS seq FROM documents)"""


def occ(k: int, name: str = "o", where: str = "TRUE") -> str:
    """Occurrences: seq_id, sample, lang, src, pos (last base), kmer."""
    return f"""{name}p AS (SELECT *, unnest(generate_series(1, length(seq) - {k} + 1)) AS i FROM s WHERE length(seq) >= {k} AND {where}),
{name} AS (SELECT seq_id, name, sample, lang, src, i + {k} - 2 AS pos, least(substr(seq, i, {k}), reverse(translate(substr(seq, i, {k}), 'ACGT', 'TGCA'))) AS kmer FROM {name}p)"""


def tab(name: str, source: str, where: str = "TRUE", having: str = "TRUE") -> str:
    return f"{name} AS (SELECT kmer, CAST(least(count(*), 1023) AS INTEGER) AS cnt FROM {source} WHERE {where} GROUP BY kmer HAVING {having})"


def q(*parts: str, last: str) -> str:
    return "WITH " + ",\n".join([SEQ, *parts]) + "\n" + last


A, B = "src < 10", "coalesce(src >= 10, TRUE)"
AB21 = (occ(21), tab("a", "o", A), tab("b", "o", B))
AB11 = (occ(11), tab("a", "o", A), tab("b", "o", B))
ALL11 = (occ(11), tab("t", "o"))
BINS = "bins AS (SELECT CAST(unnest(range(1024)) AS INTEGER) AS c)"

FLAGS = """f AS (SELECT kmer, CAST(bit_or(flag) AS INTEGER) AS flag FROM (
  SELECT kmer, CASE WHEN cnt >= 5 THEN 2 WHEN cnt >= 2 THEN 1 END AS flag FROM p1
  UNION ALL SELECT kmer, CASE WHEN cnt >= 5 THEN 8 WHEN cnt >= 2 THEN 4 END FROM p2) WHERE flag IS NOT NULL GROUP BY kmer)"""
TRIO = (occ(11), tab("p1", "o", "lang = 'en'"), tab("p2", "o", "lang = 'fr'"), FLAGS, "x AS (SELECT o.seq_id, o.name, o.pos, coalesce(f.flag, 0) AS flag FROM o LEFT JOIN f ON o.kmer = f.kmer)")
ISLANDS = """ty AS (SELECT seq_id, name, pos, CASE flag WHEN 2 THEN 1 WHEN 8 THEN 2 END AS ty FROM x WHERE flag IN (2, 8)),
isl AS (SELECT seq_id, name, ty, min(pos) AS l, max(pos) + 1 AS e, count(*) AS n FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY seq_id, ty ORDER BY pos) AS g FROM ty) GROUP BY seq_id, name, ty, g)"""
STREAKS = "st AS (SELECT *, lag(ty) OVER (PARTITION BY seq_id ORDER BY l) AS last, (n + 10) // 11 AS m FROM isl WHERE n >= 2)"
PHASE = """ph AS (SELECT s.seq_id, s.name,
  CAST(coalesce(sum(m) FILTER (WHERE ty = 1), 0) AS BIGINT) AS d0, CAST(coalesce(sum(m) FILTER (WHERE ty = 2), 0) AS BIGINT) AS d1,
  CAST(coalesce(sum(m - 1) FILTER (WHERE ty = 1), 0) + count(*) FILTER (WHERE last = 1 AND ty = 1) AS BIGINT) AS c00, count(*) FILTER (WHERE last = 1 AND ty = 2) AS c01,
  count(*) FILTER (WHERE last = 2 AND ty = 1) AS c10, CAST(coalesce(sum(m - 1) FILTER (WHERE ty = 2), 0) + count(*) FILTER (WHERE last = 2 AND ty = 2) AS BIGINT) AS c11,
  CAST(length(s.seq) AS BIGINT) AS len
  FROM s LEFT JOIN st ON s.seq_id = st.seq_id GROUP BY s.seq_id, s.name, s.seq)"""
QV = (*AB21, "h AS (SELECT seq_id, count(*) AS tot, count(a.kmer) AS non0 FROM o LEFT JOIN a ON o.kmer = a.kmer WHERE " + B + " GROUP BY seq_id)")


def qv_seq(min_len: int) -> str:
    return q(*QV, last=f"""SELECT s.seq_id, s.name, CAST(length(s.seq) AS INTEGER) AS len, coalesce(tot, 0) AS tot, coalesce(non0, 0) AS non0,
round(CASE WHEN coalesce(tot, 0) = 0 THEN -1.0 WHEN non0 = 0 THEN 0.0 WHEN non0 = tot THEN 99.0 ELSE -10 * log10(ln(tot / non0) / 21) END, 2) AS qv
FROM s LEFT JOIN h ON s.seq_id = h.seq_id WHERE {B} AND length(s.seq) >= {min_len}""")


SPECTRUM = (
    *AB11, BINS,
    f"ann AS (SELECT o.seq_id, coalesce(a.cnt, 0) AS c FROM o LEFT JOIN a ON o.kmer = a.kmer WHERE {B})",
    "keep AS (SELECT seq_id FROM ann GROUP BY seq_id HAVING count(*) FILTER (WHERE c > 0) >= count(*) * 0.5)",
    "spec AS (SELECT bins.c, coalesce(x.n, 0) AS hist, coalesce(y.n, 0) AS cnt FROM bins LEFT JOIN (SELECT cnt AS c, count(*) AS n FROM a GROUP BY cnt) x ON bins.c = x.c LEFT JOIN (SELECT c, count(*) AS n FROM ann SEMI JOIN keep ON ann.seq_id = keep.seq_id GROUP BY c) y ON bins.c = y.c)",
)
SEX = (
    occ(11), tab("y", "o", "src < 7"), tab("x", "o", "src BETWEEN 7 AND 13"), tab("r", "o", "coalesce(src > 13, TRUE)"),
    "f AS (SELECT kmer, CAST(bit_or(flag) AS INTEGER) AS flag FROM (SELECT kmer, 1 AS flag FROM y UNION ALL SELECT kmer, 2 FROM x UNION ALL SELECT kmer, 4 FROM r) GROUP BY kmer)",
    """sx AS (SELECT s.seq_id, s.name, CAST(s.seq_id % 2 + 1 AS INTEGER) AS hap, count(o.kmer) AS nk, count(f.flag) AS ns, count(*) FILTER (WHERE f.flag = 1) AS n1, count(*) FILTER (WHERE f.flag = 2) AS n2
  FROM s LEFT JOIN o ON s.seq_id = o.seq_id LEFT JOIN f ON o.kmer = f.kmer GROUP BY s.seq_id, s.name)""",
)
COLLATE = "SELECT kmer, CAST(least(count(*), 1023) AS INTEGER) AS cnt FROM (SELECT sample, kmer, count(*) AS n FROM o WHERE {where} GROUP BY sample, kmer) WHERE n BETWEEN 1 AND {high} GROUP BY kmer HAVING count(*) >= {least}"


def _hash(k: int) -> str:
    """The integer mix over HUGEINT, masked to 2k bits after each step."""
    m = (1 << 2 * k) - 1
    steps = ["h AS (SELECT kmer, list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(kmer, ''), lambda c: CAST(instr('ACGT', c) - 1 AS HUGEINT))), lambda a, b: a * 4 + b) AS x FROM t)"]
    for i, step in enumerate((f"({m} - x) + x * {1 << 21}", f"xor(x, x // {1 << 24})", f"x * {1 + 8 + 256}", f"xor(x, x // {1 << 14})", f"x * {1 + 4 + 16}", f"xor(x, x // {1 << 28})", f"x + x * {1 << 31}")):
        steps.append(f"h{i} AS (SELECT kmer, ({step}) % {m + 1}::HUGEINT AS x FROM {'h' if not i else f'h{i - 1}'})")
    return q(*ALL11, *steps, last="SELECT kmer, CAST(x AS BIGINT) AS hash FROM h6")


def solved(k: int, fpr: float = 4e-5) -> str:
    """The adjusted model over ``spec(grp, c, hist, cnt)``, all 1,024 bins of each group, as ``solved``: the parabola by Cramer's rule on moments about the valley."""
    moments = ", ".join([*(f"sum(pow(x, {i})) AS s{i}" for i in range(5)), *(f"sum(pow(x, {i}) * y) AS t{i}" for i in range(3))])
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]}) + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"
    u, v, w, t = ("s0", "s1", "s2"), ("s1", "s2", "s3"), ("s2", "s3", "s4"), ("t0", "t1", "t2")
    whole = det(u, v, w)
    return f"""tot AS (SELECT grp, sum(cnt)::DOUBLE AS tot, sum(cnt) FILTER (WHERE c = 0)::DOUBLE AS c0 FROM spec GROUP BY grp),
pk AS (SELECT grp, first(c ORDER BY cnt DESC, c) AS peak, first(cnt ORDER BY cnt DESC, c)::DOUBLE AS pcnt, first(hist ORDER BY cnt DESC, c)::DOUBLE AS phist FROM spec WHERE c BETWEEN 2 AND 1022 GROUP BY grp HAVING max(cnt) > 0),
vl AS (SELECT pk.*, pcnt / phist AS cov, valley, vcnt, vhist, least(1.0, coalesce(up, 1.0)) AS upper FROM pk LEFT JOIN (
  SELECT spec.grp, first(c ORDER BY cnt, c) AS valley, first(cnt ORDER BY cnt, c)::DOUBLE AS vcnt, first(hist ORDER BY cnt, c)::DOUBLE AS vhist, min(cnt / (pcnt / phist * hist)) FILTER (WHERE hist > 0) AS up
  FROM spec JOIN pk ON spec.grp = pk.grp WHERE c >= 2 AND c < peak GROUP BY spec.grp) z ON pk.grp = z.grp),
rt AS (SELECT vl.*, CASE WHEN valley > 2 AND h2.hist > vhist THEN greatest(0.0, (h2.cnt - vcnt) / (cov * (h2.hist - vhist))) ELSE 0.0 END AS lower FROM vl LEFT JOIN spec h2 ON h2.grp = vl.grp AND h2.c = 2),
md AS (SELECT *, greatest(CASE WHEN {fpr} > upper THEN upper / 2 ELSE {fpr} END, lower) AS fpr, least(peak - valley + 1, 8) AS n FROM rt),
go AS (SELECT * FROM md WHERE peak > 4 AND n >= 3),
aj AS (SELECT spec.grp, c, CASE WHEN c >= valley AND c < peak THEN greatest(0.0, cnt - (hist - cnt / cov) / (1 - fpr) * cov * fpr) ELSE cnt::DOUBLE END AS adj FROM spec JOIN go ON spec.grp = go.grp WHERE c >= valley),
yy AS (SELECT a.grp, (a.c - valley)::DOUBLE AS x, CASE WHEN a.adj > 0 THEN b.adj / a.adj END AS y FROM aj a JOIN aj b ON a.grp = b.grp AND b.c = a.c + 1 JOIN go ON go.grp = a.grp WHERE a.c < valley + n),
mo AS (SELECT grp, count(*) AS m, count(y) AS good, {moments} FROM yy GROUP BY grp),
ft AS (SELECT grp, {det(t, v, w)} / {whole} AS f0, {det(u, t, w)} / {whole} AS f1, {det(u, v, t)} / {whole} AS f2 FROM mo WHERE good = m),
ex AS (SELECT ft.grp, sum(adj * exp(lg)) AS below FROM ft JOIN go ON go.grp = ft.grp JOIN aj ON aj.grp = ft.grp AND aj.c = go.valley JOIN (
  SELECT ft.grp, spec.c, -sum(ln(greatest(1.01, f0 + f1 * (spec.c - valley) + f2 * (spec.c - valley) * (spec.c - valley)))) OVER (PARTITION BY ft.grp ORDER BY spec.c DESC) AS lg
  FROM ft JOIN go ON go.grp = ft.grp JOIN spec ON spec.grp = ft.grp AND spec.c < valley) z ON z.grp = ft.grp GROUP BY ft.grp),
fin AS (SELECT ft.grp, coalesce(below, 0) + above AS good FROM ft LEFT JOIN ex ON ex.grp = ft.grp JOIN (SELECT grp, sum(adj) AS above FROM aj GROUP BY grp) z ON z.grp = ft.grp),
raw AS (SELECT *, CASE WHEN tot <= c0 THEN -1.0 WHEN c0 = 0 THEN 'inf'::DOUBLE ELSE -10 * log10(ln(tot / (tot - c0)) / {k}) END AS qv_raw FROM tot),
solved AS (SELECT raw.grp, CAST(tot AS BIGINT) AS tot, CAST(c0 AS BIGINT) AS cnt0, qv_raw,
  CASE WHEN go.grp IS NULL THEN -1.0 WHEN good IS NULL OR good > tot THEN qv_raw WHEN good = tot THEN 'inf'::DOUBLE ELSE -10 * log10(ln(tot / good) / {k}) END AS qv,
  md.cov, CASE WHEN good IS NULL THEN c0 WHEN good > tot THEN 0.0 ELSE tot - good END AS err, coalesce(md.lower, 0.0) AS fpr_lower, coalesce(md.upper, 1.0) AS fpr_upper,
  CAST(coalesce(md.peak, -1) AS INTEGER) AS max_c, CAST(coalesce(md.valley, -1) AS INTEGER) AS min_c
  FROM raw LEFT JOIN (SELECT grp, peak, valley, cov, lower, upper FROM md) md ON md.grp = raw.grp LEFT JOIN go ON go.grp = raw.grp LEFT JOIN fin ON fin.grp = raw.grp)"""


#: Counts of k-mers in windows of 100 bases every 5, by the windows that hold each occurrence; and sequences with every 400th base from 199 on replaced.
WINDOWS = (
    occ(21),
    """wh AS (SELECT kmer, least(greatest(0, length(s.seq) - 100) // 5, (pos - 20) // 5) - greatest(0, CAST(ceil((pos - 99) / 5.0) AS BIGINT)) + 1 AS held FROM o JOIN s ON s.seq_id = o.seq_id),
a AS (SELECT kmer, CAST(least(sum(held), 1023) AS INTEGER) AS cnt FROM wh WHERE held > 0 GROUP BY kmer)""",
    """mu AS (SELECT seq_id, array_to_string(list_transform(string_split(seq, ''), lambda x, i: CASE WHEN i % 400 = 200 THEN translate(x, 'ACGT', 'CGTA') ELSE x END), '') AS seq FROM s),
mp AS (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 20)) AS i FROM mu WHERE length(seq) >= 21),
mo_ AS (SELECT seq_id, least(substr(seq, i, 21), reverse(translate(substr(seq, i, 21), 'ACGT', 'TGCA'))) AS kmer FROM mp)""",
    BINS,
    "ann AS (SELECT m.seq_id, coalesce(a.cnt, 0) AS c FROM mo_ m LEFT JOIN a ON m.kmer = a.kmer)",
    "keep AS (SELECT seq_id FROM ann GROUP BY seq_id HAVING count(*) FILTER (WHERE c > 0) >= count(*) * 0.5)",
    "spec AS (SELECT 'all' AS grp, bins.c, coalesce(x.n, 0) AS hist, coalesce(y.n, 0) AS cnt FROM bins LEFT JOIN (SELECT cnt AS c, count(*) AS n FROM a GROUP BY cnt) x ON bins.c = x.c LEFT JOIN (SELECT c, count(*) AS n FROM ann SEMI JOIN keep ON ann.seq_id = keep.seq_id GROUP BY c) y ON bins.c = y.c)",
)
INSPECTED = (
    *AB11, BINS,
    "z AS (SELECT a.cnt AS c0, coalesce(b.cnt, 0) AS c1, count(*) AS n FROM a LEFT JOIN b ON a.kmer = b.kmer GROUP BY ALL)",
    "hb AS (SELECT cnt AS c, count(*) AS n FROM b GROUP BY cnt)",
    "gr AS (SELECT DISTINCT c0 AS grp FROM z WHERE c0 BETWEEN 1 AND 20)",
    "sp AS (SELECT grp, c1 AS c, CAST(sum(n) AS BIGINT) AS cnt FROM gr JOIN z ON c0 >= grp GROUP BY grp, c1)",
    "spec AS (SELECT gr.grp, bins.c, coalesce(hb.n, 0) AS hist, coalesce(sp.cnt, 0) AS cnt FROM gr CROSS JOIN bins LEFT JOIN hb ON hb.c = bins.c LEFT JOIN sp ON sp.grp = gr.grp AND sp.c = bins.c)",
)


ORACLE = {
    "kmer_extract": q(occ(21), last="SELECT seq_id, pos, kmer FROM o"),
    "kmer_breaks": """WITH s AS (SELECT doc_id AS seq_id, translate(text, 'acgtuU', 'ACGTTT') AS seq FROM documents),
p AS (SELECT seq_id, seq, unnest(generate_series(1, length(seq) - 3)) AS i FROM s WHERE length(seq) >= 4),
w AS (SELECT seq_id, i + 2 AS pos, substr(seq, i, 4) AS w FROM p)
SELECT seq_id, pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM w WHERE regexp_full_match(w, '[ACGT]{4}')""",
    "kmer_long_k33": q(occ(33), tab("t", "o"), last="SELECT * FROM t"),
    "kmer_count": q(occ(21), tab("t", "o"), last="SELECT * FROM t"),
    "kmer_count_k31": q(occ(31), tab("t", "o"), last="SELECT * FROM t"),
    "kmer_count_min2": q(occ(21), tab("t", "o", having="count(*) >= 2"), last="SELECT * FROM t"),
    "kmer_count_two_file": q(occ(21), tab("a", "o", A, "count(*) >= 2"), tab("b", "o", B, "count(*) >= 2"), last="SELECT b.* FROM b SEMI JOIN a ON a.kmer = b.kmer"),
    "kmer_distinct": q(occ(21), last="SELECT count(DISTINCT kmer) AS tot FROM o"),
    "kmer_hist": q(occ(21), tab("t", "o"), BINS, last="SELECT bins.c, count(t.kmer) AS n FROM bins LEFT JOIN t ON bins.c = t.cnt GROUP BY bins.c"),
    "kmer_shrink": q(*ALL11, last="SELECT * FROM t WHERE cnt BETWEEN 2 AND 10"),
    "kmer_shrink_open": q(*ALL11, last="SELECT * FROM t WHERE cnt >= 50"),
    "kmer_setcnt": q(*ALL11, last="SELECT kmer, CAST(7 AS INTEGER) AS cnt FROM t"),
    "kmer_clear": q(*ALL11, last="SELECT kmer, CAST(0 AS INTEGER) AS cnt FROM t"),
    "kmer_recount": q(*AB21, last="SELECT a.kmer, coalesce(b.cnt, 0) AS cnt FROM a LEFT JOIN b ON a.kmer = b.kmer"),
    "kmer_cntasm": q(occ(7), last=COLLATE.format(where="TRUE", high=60, least="(SELECT count(DISTINCT sample) FROM s)")),
    "kmer_cntasm_maxout": q(occ(11), last=COLLATE.format(where="TRUE", high=2, least="(SELECT count(DISTINCT sample) - 12 FROM s)")),
    "kmer_cntasm_seed": q(occ(11), last=f"SELECT kmer, CAST(least(sum(n), 1023) AS INTEGER) AS cnt FROM (SELECT kmer, 1 AS n FROM (SELECT sample, kmer, count(*) AS n FROM o WHERE {B} GROUP BY sample, kmer) WHERE n BETWEEN 1 AND 2 UNION ALL SELECT DISTINCT kmer, 1 FROM o WHERE {A}) GROUP BY kmer HAVING sum(n) >= (SELECT count(DISTINCT sample) - 4 FROM s WHERE {B})"),
    "kmer_merge": q(*AB21, last="SELECT coalesce(a.kmer, b.kmer) AS kmer, CAST(least(coalesce(a.cnt, 0) + CASE WHEN b.kmer IS NULL THEN 0 ELSE 1 END, 1023) AS INTEGER) AS cnt FROM a FULL JOIN (SELECT * FROM b WHERE cnt BETWEEN 1 AND 3) b ON a.kmer = b.kmer"),
    "kmer_subtract": q(*AB21, last="SELECT a.* FROM a ANTI JOIN b ON a.kmer = b.kmer"),
    "kmer_isec2": q(*AB21, last="SELECT a.* FROM a SEMI JOIN b ON a.kmer = b.kmer"),
    "kmer_isec3": q(occ(11), tab("a", "o", "src <= 6"), tab("b", "o", "src BETWEEN 7 AND 12"), tab("c", "o", "coalesce(src >= 13, TRUE)"), last="SELECT a.* FROM a SEMI JOIN b ON a.kmer = b.kmer SEMI JOIN c ON a.kmer = c.kmer"),
    "kmer_print": q(*ALL11, last="SELECT * FROM t"),
    "kmer_codes": q(*ALL11, last="SELECT kmer, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(kmer, ''), lambda c: CAST(instr('ACGT', c) - 1 AS BIGINT))), lambda a, b: a * 4 + b) AS BIGINT) AS code, kmer AS decoded FROM t"),
    "kmer_hash": _hash(11),
    "qv_seq": qv_seq(0),
    "qv_seq_minlen": qv_seq(300),
    "qv_err_kmers": q(*AB21, last=f"SELECT seq_id, name, pos - 20 AS start FROM o ANTI JOIN a ON o.kmer = a.kmer WHERE {B}"),
    "qv_spectrum": q(*SPECTRUM, last="SELECT * FROM spec"),
    "qv_raw": q(*SPECTRUM, last="SELECT tot, absent, round(CASE WHEN tot <= absent THEN -1.0 WHEN absent = 0 THEN 'inf'::DOUBLE ELSE -10 * log10(ln(tot / (tot - absent)) / 11) END, 3) AS qv_raw FROM (SELECT CAST(sum(cnt) AS BIGINT) AS tot, CAST(sum(cnt) FILTER (WHERE c = 0) AS BIGINT) AS absent FROM spec)"),
    "qv_solve": q(*WINDOWS, solved(21), last="SELECT grp, tot, round(qv_raw, 3) AS qv_raw, round(qv, 3) AS qv, round(cov, 3) AS cov, round(err, 3) AS err, round(fpr_lower, 6) AS fpr_lower, round(fpr_upper, 6) AS fpr_upper, max_c, min_c FROM solved"),
    "qv_solve_bins": q(*SPECTRUM[:-1], SPECTRUM[-1].replace("SELECT bins.c", "SELECT 1 AS grp, bins.c"), solved(11), last="SELECT tot, round(qv_raw, 3) AS qv_raw, round(qv, 3) AS qv, round(cov, 3) AS cov, round(err, 3) AS err, max_c, min_c FROM solved"),
    "trio_flags": q(*TRIO, last="SELECT * FROM f"),
    "triobin": q(*TRIO, ISLANDS, """cn AS (SELECT s.seq_id, s.name, count(x.pos) AS nk, count(*) FILTER (WHERE flag = 0) AS c0, count(*) FILTER (WHERE flag = 1) AS c1, count(*) FILTER (WHERE flag = 2) AS c2, count(*) FILTER (WHERE flag = 4) AS c4, count(*) FILTER (WHERE flag = 8) AS c8 FROM s LEFT JOIN x ON s.seq_id = x.seq_id GROUP BY s.seq_id, s.name),
sc AS (SELECT seq_id, sum(n) FILTER (WHERE ty = 1) AS sc0, sum(n) FILTER (WHERE ty = 2) AS sc1 FROM isl WHERE n >= 7 GROUP BY seq_id),
j AS (SELECT cn.*, CAST(coalesce(sc0, 0) AS BIGINT) AS sc0, CAST(coalesce(sc1, 0) AS BIGINT) AS sc1 FROM cn LEFT JOIN sc ON cn.seq_id = sc.seq_id)""", last="""SELECT seq_id, name, sc0, sc1, c2, c8, c1, c4, nk, c0, CASE
 WHEN sc0 = 0 AND sc1 = 0 THEN CASE WHEN c2 = c8 THEN '0' WHEN c2 >= 7 + c8 AND (c8 <= 1 OR c2 * 0.05 > c8) THEN 'p' WHEN c8 >= 7 + c2 AND (c2 <= 1 OR c8 * 0.05 > c2) THEN 'm' ELSE '0' END
 WHEN sc0 > 11 AND sc1 > 11 THEN 'a'
 WHEN sc0 >= 7 + sc1 AND sc0 * 0.05 >= sc1 AND c2 * 0.33 > c8 THEN 'p'
 WHEN sc1 >= 7 + sc0 AND sc1 * 0.05 >= sc0 AND c8 * 0.33 > c2 THEN 'm' ELSE 'a' END AS type FROM j"""),
    "triobin_diff": q(*TRIO, last="SELECT seq_id, name, pos, flag & 3 AS pat, (flag >> 2) & 3 AS mat FROM x WHERE (flag & 3) <> ((flag >> 2) & 3)"),
    "trioeval_seq": q(*TRIO, ISLANDS, STREAKS, PHASE, last="SELECT * FROM ph"),
    "trioeval_err": q(*TRIO, ISLANDS, STREAKS, last="SELECT seq_id, name, e AS pos, last AS prev, ty AS cur FROM st WHERE last <> ty"),
    "trioeval_frag": q(*TRIO, ISLANDS, STREAKS, "fr AS (SELECT *, sum(CASE WHEN last = ty THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY l) AS g FROM st)", last="SELECT seq_id, name, ty AS type, min(l) + 1 - 11 AS st, max(e) + 1 AS en, count(*) AS n FROM fr GROUP BY seq_id, name, ty, g"),
    "trioeval_totals": q(*TRIO, ISLANDS, STREAKS, PHASE, """tt AS (SELECT coalesce(sum(c01 + c10) FILTER (WHERE d0 + d1 >= 2), 0) AS sw, coalesce(sum(c00 + c01 + c10 + c11) FILTER (WHERE d0 + d1 >= 2), 0) AS pr,
 coalesce(sum(least(d0, d1)) FILTER (WHERE d0 + d1 >= 2), 0) AS er, coalesce(sum(d0 + d1) FILTER (WHERE d0 + d1 >= 2), 0) AS si, coalesce(sum(d0), 0) AS p0, coalesce(sum(d1), 0) AS p1 FROM ph),
tr AS (SELECT 'W' AS kind, sw AS num, pr AS den, sw AS a, pr AS b FROM tt UNION ALL SELECT 'H', er, si, er, si FROM tt UNION ALL SELECT 'N', p0, p1, least(p0, p1), p0 + p1 FROM tt)""", last="SELECT kind, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den, round(CASE WHEN b <> 0 THEN a::DOUBLE / b END, 6) AS rate FROM tr"),
    "chkerr": q(*AB11, f"""lo AS (SELECT seq_id, name, pos FROM o LEFT JOIN a ON o.kmer = a.kmer WHERE {B} AND coalesce(a.cnt, -1) < 3),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS g FROM lo)""", last="SELECT seq_id, name, min(pos) + 1 - 11 AS start, max(pos) + 1 AS \"end\", count(*) AS streak FROM g GROUP BY seq_id, name, g HAVING count(*) > 5"),
    "sexchr_flags": q(*SEX, last="SELECT * FROM f"),
    "sexchr": q(*SEX, last="SELECT * FROM sx"),
    "groupxy": q(*SEX, """m AS (SELECT *, CASE WHEN ns >= nk * 0.3 AND n1 + n2 >= ns * 0.2 THEN CASE WHEN n1 > (n1 + n2) * 0.5 THEN 1 WHEN n2 > (n1 + n2) * 0.5 THEN 2 END END AS chr FROM sx),
u AS (SELECT coalesce(sum(n1) FILTER (WHERE hap = 1), 0) AS a1, coalesce(sum(n2) FILTER (WHERE hap = 1), 0) AS a2, coalesce(sum(n1) FILTER (WHERE hap = 2), 0) AS b1, coalesce(sum(n2) FILTER (WHERE hap = 2), 0) AS b2 FROM m WHERE chr IS NOT NULL),
v AS (SELECT CASE WHEN a1 + b1 > a2 + b2 THEN CASE WHEN a1 > b1 THEN 0 ELSE 1 END ELSE CASE WHEN a2 > b2 THEN 1 ELSE 0 END END AS swap FROM u)""", last="SELECT seq_id, name, hap, nk, ns, n1, n2, CAST(coalesce(chr, CASE WHEN swap = 0 THEN hap ELSE 3 - hap END) AS INTEGER) AS part FROM m, v"),
    "inspect_hist": q(*ALL11, BINS, "hh AS (SELECT bins.c, count(t.kmer) AS n FROM bins LEFT JOIN t ON bins.c = t.cnt GROUP BY bins.c)", last="SELECT * FROM (SELECT c, CAST(0 AS BIGINT) AS hist, n AS tot, CAST(sum(n) OVER (ORDER BY c DESC) AS BIGINT) AS acc FROM hh) WHERE acc > 0"),
    "inspect_cross": q(*AB11, last="SELECT a.cnt AS c0, coalesce(b.cnt, 0) AS c1, count(*) AS n FROM a LEFT JOIN b ON a.kmer = b.kmer GROUP BY ALL"),
    "inspect_sn": q(*AB11, "z AS (SELECT a.cnt AS c0, coalesce(b.cnt, 0) AS c1, count(*) AS n FROM a LEFT JOIN b ON a.kmer = b.kmer GROUP BY ALL)", """r AS (SELECT c0, j, sum(n) AS tot, coalesce(sum(n) FILTER (WHERE c1 >= j), 0) AS hit FROM z, (SELECT unnest(range(1, 21)) AS j) GROUP BY c0, j),
hb AS (SELECT cnt AS c, count(*) AS n FROM b GROUP BY cnt)""", last="SELECT c0 AS c, CAST(tot AS BIGINT) AS tot, coalesce(hb.n, 0) AS hist, CAST(j AS INTEGER) AS j, round(sum(hit) OVER w / sum(tot) OVER w, 4) AS frac FROM r LEFT JOIN hb ON hb.c = r.c0 WINDOW w AS (PARTITION BY j ORDER BY c0 DESC)"),
    "inspect_qv": q(*INSPECTED, solved(11), last="SELECT grp AS c, tot, cnt0, round(qv_raw, 3) AS qv_raw, round(qv, 3) AS qv FROM solved"),
}
