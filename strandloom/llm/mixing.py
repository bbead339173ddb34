"""Mixing to target weights with soft memberships.

1. A classifier, fitted to a bounded sample of the labelled table, gives every document a posterior over domains
   (``DOMAINS``, conditions on the labels), so unlabelled documents are members of each to a degree.
2. Nonnegative rates are fitted by distributed projected-gradient least squares: with w_d the document's share of all tokens
   and p_d its posterior, minimise |sum_d w_d r_d p_d - target|^2 over r_d >= floor. The start is r = 1; a step is
   ``r <- max(floor, r - p_d . M . residual)``, the gradient scaled by M, the inverse of the K x K matrix ``sum w p p'``
   (mostly over the documents that are off the floor), so steps are of the right length and the fit takes few rounds.

A round is one aggregation that returns K + K (K + 1) / 2 numbers to the driver; rates are not stored between rounds but follow from
the list of steps, an array of at most ``ROUNDS`` times K numbers. No round shuffles rows.

The floor is 0 for the plain operator. With floor 1 nothing is dropped: the total is raised until every domain's target is at
least what it holds, and rates say how often a document is repeated.

Defined results: tokens are parts between white space; a null or empty text has none, and its rate is that of its posterior;
rows that repeat an id are documents of their own; without labels all documents have equal posteriors and rate 1; an empty
table gives no rows. Extra columns are kept; columns of the added names are replaced.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import bounded_sample, cut, others, slices, table

#: Domains: a condition on the labelled table each, the first that holds counts; and their shares of the tokens.
DOMAINS = {"toxic": "toxic = 1", "high": "quality = 1", "low": "quality = 0"}
TARGETS = (0.05, 0.80, 0.15)
TRAIN_ROWS, ROUNDS = 8_000, 40
#: Log-likelihood ratio of a term between the domains, from which on it is a feature (chi-square of two degrees: one chance in a thousand).
SURE = 13.8
WORD = re.compile(r"\w+")
MARKS, CAPITALS, DIGITS = b"!#$%&*|{}<>=_~^\\@", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
FORM = 13


def form(text: str, words: list[str], distinct: int) -> tuple[float, ...]:
    """Numbers that tell the form of a text: lengths, repeats, marks, capitals, digits, lines."""
    n, m, lines, raw = max(1, len(text)), max(1, len(words)), text.split("\n"), text.encode("utf-8", "surrogatepass")
    marks, caps, digits = (len(raw) - len(raw.translate(None, letters)) for letters in (MARKS, CAPITALS, DIGITS))
    size = (1, math.log1p(len(words)) / 10, math.log1p(len(text)) / 12, len(text) / m / 10, distinct / m)
    kinds = (10 * marks / n, caps / n * 5, digits / n * 5, len(set(lines)) / len(lines), min(1, len(lines) / m * 5))
    return *size, *kinds, len(text) < 200, text.count(".") / m * 5, (text.count("!") + text.count("*")) / m


def terms_of(word: str) -> tuple[str, ...]:
    """A word and, unless it is all of it, its beginning of four letters."""
    return (word,) if len(word) <= 4 else (word, word[:4] + "-")


class Domains:
    """The classifier: weights (features, domains) of the form of a text and of the terms that it holds."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.index, self.weights = {t: FORM + i for i, t in enumerate(terms)}, weights
        self.whole = {t for t in terms if t[-1:] != "-"}
        self.beginnings = {t[:-1]: i for t, i in self.index.items() if t[-1:] == "-"}

    def features(self, text: str | None) -> tuple[tuple[float, ...], list[int]]:
        text = text or ""
        words, index = WORD.findall(text.lower()), self.index
        distinct = set(words)
        hit = [index[w] for w in distinct & self.whole]
        hit += [self.beginnings[p] for p in {w[:4] for w in distinct if len(w) > 4} & self.beginnings.keys()]
        return form(text, words, len(distinct)), sorted(hit)

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        z = np.zeros((len(texts), self.weights.shape[1]))
        for i, t in enumerate(texts):
            shape, hit = self.features(t)
            z[i] = np.asarray(shape) @ self.weights[:FORM] + self.weights[hit].sum(axis=0)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return np.round(e / e.sum(axis=1, keepdims=True), 9)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int, steps: int = 150, l2: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression by accelerated gradient steps."""
    n = len(x)
    goal = np.zeros((n, k), np.float32)
    goal[np.arange(n), y] = 1
    w = v = np.zeros((x.shape[1], k), np.float32)
    # the largest eigenvalue of the features' second moments, by power steps, bounds the curvature
    u = np.full(x.shape[1], x.shape[1] ** -0.5, np.float32)
    for _ in range(10):
        u = x.T @ (x @ u)
        u /= np.linalg.norm(u) + 1e-12
    rate = 1.0 / (0.55 * float(((x @ u) ** 2).sum()) / n + l2)
    for t in range(1, steps + 1):
        z = x @ v
        e = np.exp(z - z.max(axis=1, keepdims=True))
        w2 = v - rate * (x.T @ (e / e.sum(axis=1, keepdims=True) - goal) / n + l2 * v)
        v, w = w2 + (t - 1) / (t + 2) * (w2 - w), w2
    return w


def choose_terms(sample: DataFrame, sizes: list[int], sure: float = SURE) -> list[str]:
    """The terms of the labelled sample ``(text, y)`` whose log-likelihood ratio between domains is beyond ``sure``, counted in a grouped aggregation."""
    k, n = len(sizes), sum(sizes)

    def run(batches):
        seen = [Counter() for _ in sizes]
        for b in slices(batches):
            for x, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[y].update({t for w in set(WORD.findall((x.as_py() or "").lower())) for t in terms_of(w)})
        every = list(set().union(*seen))
        for at in range(0, len(every), 50_000):
            part = every[at : at + 50_000]
            counts = [pa.array([s[t] for t in part], pa.int64()) for s in seen]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *counts], ["term", *(f"n{i}" for i in range(k))])

    kinds = ", ".join(f"n{i} long" for i in range(k))
    counted = sample.mapInArrow(run, f"term string, {kinds}").groupBy("term").agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k)))
    whole = sum((F.col(f"n{i}") for i in range(k)), F.lit(0))
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    cells = [part(F.col(f"n{i}"), whole * m / n) + part(m - F.col(f"n{i}"), (n - whole) * m / n) for i, m in enumerate(sizes) if m]
    found = counted.filter(whole >= 3).filter(2 * sum(cells, F.lit(0.0)) > sure)
    return sorted(r.term for r in found.select("term").collect())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", domains: dict[str, str] = DOMAINS, rows: int = TRAIN_ROWS) -> Domains | None:
    """The domain classifier, fitted to at most ``rows`` labelled documents (smallest id hash), or None without labelled documents."""
    domain = F.coalesce(*(F.when(F.expr(c), i) for i, c in enumerate(domains.values())))
    own = labels.select(F.col(id_col).alias("__id"), domain.alias("y")).filter("y is not null and __id is not null").groupBy("__id").agg(F.min("y").alias("y"))
    own = bounded_sample(cut(own), "__id", rows)  # two numbers a row
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(own), "__id")
    sample = cut(found.groupBy("text").agg(F.min("y").alias("y")).orderBy(F.xxhash64("text"), "text").limit(rows).repartition(8, "text"))
    counted = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counted:
        return None
    terms = choose_terms(sample, [counted.get(i, 0) for i in range(len(domains))])
    draft = Domains(terms, np.zeros((FORM + len(terms), len(domains))))

    def run(batches):
        for b in slices(batches):
            shapes, hits = zip(*(draft.features(x.as_py()) for x in b.column(0)), strict=True) if b.num_rows else ((), ())
            columns = [pa.array(shapes, pa.list_(pa.float64())), pa.array(hits, pa.list_(pa.int32())), b.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["form", "hit", "y"])

    # at most ``rows`` rows of a few small numbers
    got = sorted((r.form, r.hit, r.y) for r in sample.mapInArrow(run, "form array<double>, hit array<int>, y int").collect())
    x = np.zeros((len(got), FORM + len(terms)), np.float32)
    for i, (shape, hit, _) in enumerate(got):
        x[i, :FORM] = shape
        x[i, hit] = 1
    draft.weights = fit_softmax(x, np.array([y for _, _, y in got]), len(domains)).astype(float)
    return draft


def memberships(docs: DataFrame, classifier: Domains | None, text_col: str = "text", domains: dict[str, str] = DOMAINS) -> DataFrame:
    """``docs`` with ``tokens`` and ``posterior``."""
    keep = others(docs, "tokens", "posterior")
    at, k = keep.index(text_col), len(domains)

    def run(batches):
        for b in slices(batches):
            texts = [x.as_py() or "" for x in b.column(at)]
            p = classifier.posteriors(texts) if classifier and texts else np.full((len(texts), k), 1 / k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], [*keep, "tokens", "posterior"])

    src = docs.select(*(f"`{c}`" for c in keep))
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]))


def _rate(steps: list[np.ndarray], floor: float):
    """The rate after the given steps."""
    if not steps:
        return F.greatest(F.lit(1.0), F.lit(floor))
    history = F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps))
    dot = lambda s: F.aggregate(F.zip_with("posterior", s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(history, F.greatest(F.lit(1.0), F.lit(floor)), lambda r, s: F.greatest(r - dot(s), F.lit(floor)))


def fit_rates(members: DataFrame, targets, floor: float = 0.0, rounds: int = ROUNDS, tolerance: float = 1e-5) -> tuple[list[np.ndarray], list[float]]:
    """The steps, and the norm of the residual before each and at the end; ``members`` has tokens and posterior."""
    k = len(targets)
    p, n = [F.col("posterior")[i] for i in range(k)], F.col("tokens")

    def sums(rate, active) -> tuple[float, np.ndarray, np.ndarray]:
        """Tokens, tokens by domain at a rate, and the matrix over active documents."""
        cells = [(i, j) for i in range(k) for j in range(i + 1)]
        got = members.agg(F.sum(n), *(F.sum(n * rate * x) for x in p), *(F.sum(F.when(active, n * p[i] * p[j]).otherwise(0.0)) for i, j in cells)).first()
        if not got[0]:
            return 0.0, np.zeros(k), np.zeros((k, k))
        h = np.zeros((k, k))
        for (i, j), x in zip(cells, got[1 + k :], strict=True):
            h[i, j] = h[j, i] = x / got[0]
        return float(got[0]), np.array(got[1 : 1 + k]) / got[0], h

    total, share, whole = sums(F.lit(1.0), F.lit(True))
    if not total:
        return [], []
    goal = np.array(targets, float) / sum(targets)
    # a domain that no document belongs to can't be had: its part is left out of the goal
    goal = np.where(share > 1e-9, goal, 0.0)
    goal /= goal.sum()
    if floor:
        goal *= max(1.0, 1.05 * floor * float((share[goal > 0] / goal[goal > 0]).max()))
    steps, norms, matrix = [], [], whole
    for _ in range(rounds):
        rate = _rate(steps, floor)
        _, now, active = sums(rate, rate > floor)
        norms.append(float(np.linalg.norm(now - goal)))
        if norms[-1] < tolerance or len(norms) > 6 and norms[-1] > 0.999 * norms[-4]:
            break
        matrix = 0.9 * active + 0.1 * whole if steps else whole
        steps.append(np.round(np.linalg.solve(matrix + 1e-9 * np.eye(k), now - goal), 12))
    else:
        norms.append(float(np.linalg.norm(sums(_rate(steps, floor), F.lit(False))[1] - goal)))
    if norms[-1] >= tolerance:
        warnings.warn(f"domain shares miss their targets by {norms[-1]:.3g} after {len(steps)} steps", RuntimeWarning, stacklevel=2)
    return steps, norms


def mix(docs: DataFrame, labels: DataFrame, targets=TARGETS, floor: float = 0.0, id_col: str = "doc_id", text_col: str = "text", carry: bool = True, domains: dict[str, str] = DOMAINS) -> DataFrame:
    """``docs`` with ``tokens``, ``posterior`` (by domain) and ``rate``; without its text unless ``carry``.

    Memberships are written to the shared folder once and read by every round. The fit ends when the targets are met, when three
    rounds gain less than a thousandth, or after ``ROUNDS`` rounds; targets that are not met by then are told by
    a ``RuntimeWarning`` with the distance that is left.
    """
    docs = docs.select(*(f"`{c}`" for c in others(docs, "rate")))
    classifier = train(docs, labels, id_col, text_col, domains)
    members = memberships(docs, classifier, text_col, domains)
    members = cut(members if carry else members.drop(text_col))
    steps = fit_rates(members.select("tokens", "posterior"), targets, floor)[0] if classifier else []
    return members.withColumn("rate", F.round(_rate(steps, floor), 6))


def repeated(mixed: DataFrame, id_col: str = "doc_id", seed: int = 8) -> DataFrame:
    """Every row as often as its rate says: the whole part, and once more with the chance of the rest, drawn from the id's hash.

    A null rate counts as 0; rows that repeat an id share its draw; the columns are those of ``mixed``, whatever their names.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 20)) / (1 << 20)
    n = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    row = F.struct(*(F.col(f"`{c}`") for c in mixed.columns))
    # one element for each time, so that no name is added beside the row's
    return mixed.select(F.explode(F.array_repeat(row, F.coalesce(n, F.lit(0)))).alias("row")).select("row.*")


def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mixed = mix(docs, table(spark, sf_dir, "labels"), carry=False)
    return mixed.select("doc_id", "tokens", *(F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate")
