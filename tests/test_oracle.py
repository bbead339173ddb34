import duckdb
import numpy as np
import pytest

from strandloom.operators import quality
from strandloom.plans import oracle


def spectrum(seed):
    """Counts with errors below a valley and a peak, as of windows over sequences that differ."""
    r = np.random.default_rng(seed)
    c, peak = np.arange(1024), int(r.integers(8, 60))
    good = 1e5 * np.exp(-0.5 * ((c - peak) / np.sqrt(peak)) ** 2)
    hist = np.floor(good + 4e5 * 0.3**c + r.random(1024))
    cnt = np.floor(12 * (good + 2 * 0.5**c) + 900 * r.random() * 0.4**c)
    cnt[0] = r.integers(0, 5_000)
    hist[0] = 0
    return hist, cnt


def test_solver_in_sql_is_the_solver():
    every = [spectrum(i) for i in range(60)] + [(np.zeros(1024), np.zeros(1024))]
    lone = np.zeros(1024)
    lone[3] = 7
    every += [(lone, lone), (lone, np.eye(1024)[0] * 5)]
    rows = [(g, c, int(h[c]), int(n[c])) for g, (h, n) in enumerate(every) for c in range(1024)]
    con = duckdb.connect()
    grp, c, hist, cnt = (np.array(x) for x in zip(*rows, strict=True))
    con.register("bins_", {"grp": grp, "c": c, "hist": hist, "cnt": cnt})
    sql = f"WITH spec AS (SELECT * FROM bins_), {oracle.solved(21)} SELECT grp, tot, cnt0, qv_raw, qv, cov, err, fpr_lower, fpr_upper, max_c, min_c FROM solved ORDER BY grp"
    fitted = 0
    for row, (h, n) in zip(con.execute(sql).fetchall(), every, strict=True):
        want = quality.solve(h, n, 21)
        got = dict(zip(("grp", "tot", "cnt0", "qv_raw", "qv", "cov", "err", "fpr_lower", "fpr_upper", "max_c", "min_c"), row, strict=True))
        fitted += want["qv"] not in (-1.0, want["qv_raw"])
        for k in ("tot", "qv_raw", "qv", "cov", "err", "fpr_lower", "fpr_upper", "max_c", "min_c"):
            assert got[k] == (want[k] if want[k] is None else pytest.approx(want[k], rel=1e-6, abs=1e-6)), (row[0], k)
    assert fitted >= 15
