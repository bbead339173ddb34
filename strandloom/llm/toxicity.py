"""Toxicity by weak supervision: voters, a generative label model over all documents, a linear classifier on its posteriors.

1. Terms (words and word beginnings of four and five letters) are counted by class over a bounded sample of labelled rows
   (``TRAIN_ROWS``, smallest id hash) in a grouped aggregation. Every term whose log-likelihood ratio is beyond ``SURE`` is a
   feature, and a lexicon voter if ``PRECISE`` of its labelled texts are toxic. Pattern voters stand beside them: capitals, exclamation
   marks and several lexicon terms vote toxic, the lack of any of these votes clean.
2. All documents vote, labelled or not (those held out do not). The generative model has a latent class; every voter fires at a rate that
   depends on the class and on one other voter, its parent in a tree of maximal conditional mutual information, so the
   correlations of voters are parameters. A given label is one more voter, whose errors are estimated like
   those of the others; it can be outvoted. EM fits all rates. Its sums are made by the tasks over vote
   patterns that were grouped first; only sums, as many as the model has parameters, reach the driver.
3. A logistic regression on terms and patterns is fitted to the posteriors of the labelled sample. It has as many weights as there are
   terms, whatever the corpus, and scores whole texts in one pass without a shuffle.

Scores never read labels, language, source or id.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import bounded_sample, cut, others, slices, table

TRAIN_ROWS, THRESHOLD = 12_000, 0.3
#: Log-likelihood ratio of a term (chi-square of one degree: one chance in a thousand); twice the information of an edge of the tree (two degrees, as rare).
SURE, EDGE = 10.83, 13.8
#: Part of the labelled texts with a term that must be toxic for the term to vote; a vague term is a feature of the classifier only, lest a topic pass for the class.
PRECISE = 0.8
#: Rounds of EM, and those before which the tree is chosen.
ROUNDS, JOINS = 10, (0, 4)
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("!capitals", "!exclaims", "!several", "!none")
BEGINNINGS = (4, 5)


def terms_of(word: str) -> tuple[str, ...]:
    """A lower-case word and its beginnings."""
    return (word, *(word[:n] + "-" for n in BEGINNINGS if len(word) >= n))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def form_of(text: str | None) -> list[str]:
    text = text or ""
    out = []
    if len(text) >= 20 and text.upper() == text and text.lower() != text:
        out.append("!capitals")
    if text.count("!") >= 3:
        out.append("!exclaims")
    return out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def usable_labels(labels: DataFrame, id_col: str) -> DataFrame:
    """``(__id, y)``: labels 0 or 1 of documents that are not held out; of several labels of an id the largest."""
    own = labels.select(F.col(id_col).alias("__id"), F.col("toxic").cast("int").alias("y")).filter("y in (0, 1) and __id is not null").filter(~held_out("__id"))
    return own.groupBy("__id").agg(F.max("y").alias("y"))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """``(text, y)`` of at most ``rows`` labelled documents that are not held out. Copies count once; several labels of an id or text: the largest."""
    own = bounded_sample(cut(usable_labels(labels, id_col)), "__id", rows)
    # at most ``rows`` rows of two numbers
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(own), "__id")
    return cut(found.groupBy("text").agg(F.max("y").alias("y")).orderBy(F.xxhash64("text"), "text").limit(rows))


def term_counts(sample: DataFrame) -> DataFrame:
    """``(term, pos, neg)``: toxic and clean texts of the sample that hold a term."""

    def run(batches):
        seen = (Counter(), Counter())
        for b in slices(batches):
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                seen[1 - y].update({t for w in words_of(text.as_py()) for t in terms_of(w)})
        every = list(seen[0].keys() | seen[1].keys())
        for at in range(0, len(every), 50_000):
            part = every[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[t] for t in part], pa.int64()) for s in seen)], ["term", "pos", "neg"])

    return sample.mapInArrow(run, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_terms(counts: DataFrame, n_pos: int, n_neg: int, sure: float = SURE) -> list[tuple[str, int, int]]:
    """All terms whose log-likelihood ratio between the classes is beyond ``sure``, in order of the term."""
    n, k = float(n_pos + n_neg), F.col("pos") + F.col("neg")
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    cells = [("pos", n_pos), ("neg", n_neg)]
    ratio = sum((part(F.col(c), k * of / n) + part(of - F.col(c), (n - k) * of / n) for c, of in cells), F.lit(0.0))
    held = counts.filter(k >= 3).filter(2 * ratio > sure)
    return sorted((r.term, r.pos, r.neg) for r in held.select("term", "pos", "neg").collect())


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(p) - np.log1p(-p)


class LabelModel:
    """A latent class; voter v fires with ``rate[y, s, v]``, y the class and s whether its parent fired (-1: it has none).

    ``given[y, g]`` is the chance that a document of class y has the label g if it has one.
    """

    def __init__(self, prior: float, rate: np.ndarray):
        """``prior``: share of class 1, which stays that of the labels; ``rate`` (2, voters): where EM starts."""
        self.prior, self.parent = prior, np.full(rate.shape[1], -1)
        self.rate = np.stack([rate, rate], axis=1)
        self.given = np.array([[0.9, 0.1], [0.1, 0.9]])

    def likelihood(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """``(rows, 2)`` log likelihoods with the class, of votes ``x`` (rows, voters; 0 or 1) and labels ``g`` (-1: none)."""
        joined = np.flatnonzero(self.parent >= 0)
        both = x[:, joined] * x[:, self.parent[joined]]
        out = np.empty((len(x), 2))
        for y in (0, 1):
            alone, after = self.rate[y]
            own = _logit(alone)
            np.add.at(own, self.parent[joined], (np.log1p(-after) - np.log1p(-alone))[joined])
            out[:, y] = np.log1p(-alone).sum() + x @ own + both @ (_logit(after) - _logit(alone))[joined]
            out[:, y] += np.log(self.prior if y else 1 - self.prior) + np.where(g < 0, 0.0, np.log(self.given[y])[np.maximum(g, 0)])
        return out

    def posterior(self, x: np.ndarray, g: np.ndarray, rows: int = 1_000) -> np.ndarray:
        """The chance of class 1 of each row, ``rows`` at a time, as doubles of all would not fit beside the rest."""
        out = np.empty(len(x))
        for at in range(0, len(x), rows):
            part = slice(at, at + rows)
            low, high = self.likelihood(x[part].astype(float), g[part]).T
            out[part] = 1 / (1 + np.exp(np.clip(low - high, -500, 500)))
        return out

    def sums(self, x: np.ndarray, g: np.ndarray, n: np.ndarray, pairs: bool = False) -> dict[str, np.ndarray]:
        """What a round of EM needs of rows that occur ``n`` times: by class, documents, votes, votes with the parent's (or of all pairs), labels."""
        p = self.posterior(x, g)
        joined = np.flatnonzero(self.parent >= 0)
        both = x[:, joined] * x[:, self.parent[joined]]
        out = {"all": np.zeros(2), "votes": np.zeros((2, x.shape[1])), "with": np.zeros((2, x.shape[1])), "given": np.zeros((2, 2))}
        if pairs:
            out["pairs"] = np.zeros((2, x.shape[1], x.shape[1]))
        for y, w in enumerate((n * (1 - p), n * p)):
            out["all"][y] = w.sum()
            out["votes"][y] = w @ x
            out["with"][y, joined] = w @ both
            out["given"][y] = [w[g == 0].sum(), w[g == 1].sum()]
            if pairs:
                out["pairs"][y] = (x * w[:, None]).T @ x
        return out

    def update(self, s: dict[str, np.ndarray]) -> None:
        """The rates from the sums; each is drawn a little to the voter's rate in the class, and that to the voter's rate in all documents."""
        whole = (s["votes"].sum(axis=0) + 0.5) / (s["all"].sum() + 1)
        top = np.maximum(self.parent, 0)
        for y in (0, 1):
            own = (s["votes"][y] + whole) / (s["all"][y] + 1)
            fired = np.where(self.parent >= 0, s["votes"][y][top], 0.0)
            alone = (s["votes"][y] - s["with"][y] + own) / (s["all"][y] - fired + 1)
            after = (s["with"][y] + 2 * own) / (fired + 2)
            self.rate[y] = np.clip([alone, np.where(self.parent >= 0, after, alone)], 1e-6, 1 - 1e-6)
        right = np.array([[9.0, 1.0], [1.0, 9.0]])  # ten documents' worth of trust in labels
        self.given = (s["given"] + right) / (s["given"] + right).sum(axis=1, keepdims=True)

    def join(self, s: dict[str, np.ndarray], edge: float = EDGE) -> None:
        """Gives voters their parents: the spanning tree of most mutual information given the class, without edges that chance explains."""
        m = s["votes"].shape[1]
        info = np.zeros((m, m))
        for y in (0, 1):
            n, f, c = s["all"][y] + 1e-9, s["votes"][y], s["pairs"][y]
            for a in (0, 1):
                for b in (0, 1):
                    seen = c if a and b else (f[:, None] - c if a else (f[None, :] - c if b else n - f[:, None] - f[None, :] + c))
                    due = np.outer(f if a else n - f, f if b else n - f) / n
                    with np.errstate(divide="ignore", invalid="ignore"):
                        info += np.where((seen > 1e-9) & (due > 1e-9), seen * np.log(seen / due), 0.0)
        np.fill_diagonal(info, 0)
        self.parent = np.full(m, -1)
        if not m:
            return
        best, by, left = info[0].copy(), np.zeros(m, int), np.arange(m) > 0
        while left.any():
            v = int(np.where(left, best, -np.inf).argmax())
            left[v] = False
            if 2 * best[v] > edge:
                self.parent[v] = by[v]
            closer = left & (info[v] > best)
            best[closer], by[closer] = info[v][closer], v


def fit_labels(model: LabelModel, sums, rounds: int = ROUNDS) -> LabelModel:
    """EM; the tree is chosen before the first round, lest copies of a voter pass for the class, and once more when rates have settled.

    ``sums(model, pairs)`` adds up ``LabelModel.sums`` over all rows.
    """
    for i in range(rounds):
        now = sums(model, i in JOINS)
        if i in JOINS:
            model.join(now)
            now = sums(model, False)
        model.update(now)
    return model


def votes(docs: DataFrame, labels: DataFrame, scorer: Scorer, id_col: str, text_col: str) -> DataFrame:
    """``(on, g, n)``: how many documents that are not held out fire exactly the voters ``on`` and have the label g (-1: none)."""
    voter = {i: v for v, i in enumerate(scorer.voters)}

    def run(batches):
        for b in slices(batches):
            on = [sorted(voter[i] for i in scorer.active(x.as_py()) if i in voter) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(on, pa.list_(pa.int32()))], ["id", "on"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = src.mapInArrow(run, f"id {kind}, on array<int>").join(usable_labels(labels, id_col), F.col("id") == F.col("__id"), "left")
    return cut(found.groupBy("on", F.coalesce("y", F.lit(-1)).alias("g")).agg(F.count(F.lit(1)).alias("n")))


def distributed_sums(patterns: DataFrame, voters: int):
    """``sums`` of ``fit_labels`` over vote patterns: tasks add up blocks of rows, a grouped aggregation adds up the tasks.

    A task returns at most a row for each parameter, so there are only some tasks for each core, however many partitions the patterns have.
    """
    patterns = patterns.coalesce(4 * patterns.sparkSession.sparkContext.defaultParallelism if patterns.count() > 100_000 else 8)

    def sums(model: LabelModel, pairs: bool) -> dict[str, np.ndarray]:
        shapes = {k: v.shape for k, v in model.sums(np.zeros((0, voters)), np.zeros(0, int), np.zeros(0), pairs).items()}

        def run(batches):
            whole = None
            for b in slices(batches, 2_000):
                on = b.column(0)
                x = np.zeros((b.num_rows, voters))
                x[np.repeat(np.arange(b.num_rows), on.value_lengths().to_numpy()), on.flatten().to_numpy()] = 1
                got = model.sums(x, b.column(1).to_numpy(), b.column(2).to_numpy().astype(float), pairs)
                if pairs:
                    got["pairs"] = np.triu(got["pairs"])
                flat = np.concatenate([v.ravel() for v in got.values()])
                whole = flat if whole is None else whole + flat
            if whole is not None:
                at = np.flatnonzero(whole)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(whole[at])], ["at", "v"])

        # as many rows as the model has parameters or, once, pairs of voters
        added = patterns.select("on", "g", "n").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(sum(math.prod(s) for s in shapes.values()))
        flat[added.column("at").to_numpy()] = np.round(added.column("v").to_numpy(), 6)  # whatever the order of the tasks
        ends = np.cumsum([math.prod(s) for s in shapes.values()])
        out = {k: part.reshape(s) for (k, s), part in zip(shapes.items(), np.split(flat, ends[:-1]), strict=True)}
        if pairs:
            out["pairs"] += np.triu(out["pairs"], 1).swapaxes(1, 2)
        return out

    return sums


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 80, memory: int = 8) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by limited-memory quasi-Newton steps with a backtracking line search; the intercept is not shrunk."""
    n, m = x.shape
    one = np.append(np.full(m, l2), 0.0)

    def loss(w):
        z = np.clip(x @ w[:m].astype(np.float32) + w[m], -30, 30).astype(np.float64)
        p = 1 / (1 + np.exp(-z))
        g = np.append(x.T @ (p - y).astype(np.float32), (p - y).sum()) / n + one * w
        return (np.logaddexp(0, z) - y * z).mean() + 0.5 * (one * w * w).sum(), g

    w = np.append(np.zeros(m), np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = -g, []
        for s, t, r in reversed(past):
            kept.append(a := r * (s @ d))
            d = d - a * t
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, t, r), a in zip(past, reversed(kept), strict=True):
            d = d + s * (a - r * (t @ d))
        step = 1.0 if past else 1.0 / max(1e-12, np.abs(g).sum())
        for _ in range(25):
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, t = step * d, g2 - g
        if s @ t > 1e-14:
            past = [*past[-(memory - 1) :], (s, t, 1 / (s @ t))]
        w, f, g, before = w + s, f2, g2, f
        if before - f < 1e-7:
            break
    return w[:m], float(w[m])


class Scorer:
    """The features of a text, and a linear score of them. ``leaning``: the features that vote, with the class they vote for."""

    def __init__(self, terms: list[str], leaning: dict[int, int], weight: np.ndarray, bias: float):
        self.index = {t: i for i, t in enumerate(terms)}
        self.leaning, self.voters, self.weight, self.bias = leaning, sorted(leaning), weight.tolist(), bias
        self.toxic = frozenset(i for i, y in leaning.items() if y and not terms[i].startswith("!"))
        self.whole = {t for t in terms if t[-1:] != "-" and t[:1] != "!"}
        self.beginnings = {n: {t[:-1]: i for i, t in enumerate(terms) if t[-1:] == "-" and len(t) == n + 1} for n in BEGINNINGS}

    def active(self, text: str | None) -> set[int]:
        """The features of a text: its terms, and the patterns."""
        index, words = self.index, words_of(text)
        hit = {index[w] for w in words & self.whole}
        for n, found in self.beginnings.items():
            hit.update([found[p] for p in {w[:n] for w in words if len(w) >= n} & found.keys()])
        form, lexicon = form_of(text), len(hit & self.toxic)
        hit.update(index[p] for p in form)
        if lexicon >= 3:
            hit.add(index["!several"])
        if not lexicon and not form:
            hit.add(index["!none"])
        return hit

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weight[i] for i in sorted(self.active(text)))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Scorer:
    """Fits the scorer; without labels of both classes it returns a constant."""
    sample = training_sample(docs, labels, id_col, text_col, rows)
    size = sample.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("pos"), F.count("y").alias("n")).first()
    if not 0 < size.pos < size.n:
        terms = list(PATTERNS)
        return Scorer(terms, {}, np.zeros(len(terms)), float(np.log((size.pos + 0.5) / (size.n - size.pos + 9.5))))
    n_neg = size.n - size.pos
    chosen = choose_terms(term_counts(sample), size.pos, n_neg)
    terms = [t for t, _, _ in chosen] + list(PATTERNS)
    leaning = {i: 1 for i, (_, p, q) in enumerate(chosen) if p >= PRECISE * (p + q)}
    leaning |= {len(chosen) + i: int(p != "!none") for i, p in enumerate(PATTERNS)}
    draft = Scorer(terms, leaning, np.zeros(len(terms)), 0.0)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([sorted(draft.active(x.as_py())) for x in b.column(0)], pa.list_(pa.int32())), b.column(1)], ["on", "y"])

    # at most ``rows`` rows of a few small numbers
    got = sorted((r.on, r.y) for r in sample.mapInArrow(run, "on array<int>, y int").collect())
    x = np.zeros((len(got), len(terms)), np.float32)
    for i, (on, _) in enumerate(got):
        x[i, on] = 1
    y = np.array([v for _, v in got], np.int64)
    # EM starts at the rates of the labelled sample
    start = np.stack([(x[y == c][:, draft.voters].sum(axis=0, dtype=float) + 0.5) / ((y == c).sum() + 1) for c in (0, 1)])
    model = LabelModel(size.pos / size.n, np.clip(start, 1e-6, 1 - 1e-6))
    fit_labels(model, distributed_sums(votes(docs, labels, draft, id_col, text_col), len(draft.voters)))
    return Scorer(terms, leaning, *fit_linear(x, model.posterior(x[:, draft.voters], y)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted`` (score >= 0.3); columns of these names, in any case, are replaced.

    Defined results: a null or empty text scores by the intercept and its form; a null id is not held out; repeated rows score
    alike; without usable labels all texts score the same, low value; an empty table gives no rows. A text of any length is read whole.
    """
    scorer = train(docs, labels, id_col, text_col, rows)
    return score_with(docs, scorer, id_col, text_col)


def score_with(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    keep = others(docs, "held_out", "score", "predicted")
    at = keep.index(text_col)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([scorer.score(x.as_py()) for x in b.column(at)], pa.float64())], [*keep, "score"])

    src = docs.select(*(f"`{c}`" for c in keep))
    scored = src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("held_out", held_out(id_col)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
