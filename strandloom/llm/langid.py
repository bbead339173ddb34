"""Language of web pages by Bayesian evidence fusion.

For a page and each language k::

    log P(k | page) = t * log P(text | k) + log P(declared | k) + log P(suffix | k) + log prior_host(k) + const

* Text: letter trigrams hashed to ``BUCKETS``, multinomial, add-a smoothed, tempered by ``t`` because neighbouring
  trigrams overlap. Trained on a bounded sample of labelled documents (``TRAIN_ROWS``, smallest id hash).
* Declared markup language and address suffix: rates from sums of text posteriors by value, one grouped
  aggregation each, smoothed (declared: towards the language it names).
* Host prior: sums of text posteriors by host, by domain and over all pages; a host's prior is its own sums plus
  ``KAPPA`` times its domain's, and that the same over the whole. A page's own part is taken out of every
  sum first, so its text counts once.

Sums by host are grouped aggregations with map-side partials and the tables are joined by value, so no table is
collected; a host with a third of the pages is one row of sums, and the join's hot partition is AQE's to split.

Defined results: a null or empty page has no text evidence; a null address has no host or suffix; rows that repeat an id
keep their own results; ties go to the first language in order; with no labelled documents the result has null languages.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.common import bounded_sample, cut, slices, table

TRAIN_ROWS, BUCKETS, KAPPA, TEMPER, SMOOTH = 6_000, 1 << 15, 20.0, 0.4, 5.0
HIDDEN = re.compile(r"<(script|style)\b", re.I)
CLOSING = {name: re.compile(rf"</{name}\b", re.I) for name in ("script", "style")}
ROOT = re.compile(r"<html\b", re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*+=\s*+[\"']?\s*+([A-Za-z]{2,3})\b", re.I)
HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


def declared_of(page: str) -> str | None:
    """The language that the first ``<html`` tag with one declares, wherever it stands. Each tag is read once, up to its end."""
    at = 0
    while m := ROOT.search(page, at):
        end = page.find(">", m.end())
        end = end if end >= 0 else len(page)
        if said := DECLARED.match(page, m.start(), end):
            return said[1].lower()
        at = end
    return None


def text_of(page: str | None) -> str:
    """The text between the tags of a page; comments, scripts and styles, closed or not, are dropped. One pass."""
    page, out, at = page or "", [], 0
    while (tag := page.find("<", at)) >= 0:
        out.append(page[at:tag])
        if page.startswith("<!--", tag):
            end, size = page.find("-->", tag + 4), 3
        else:
            end, size = page.find(">", tag + 1), 1
            if end >= 0 and (m := HIDDEN.match(page, tag)):
                close = CLOSING[m[1].lower()].search(page, end)
                end = page.find(">", close.end()) if close else -1
        at = end + size if end >= 0 else len(page)
    out.append(page[at:])
    return html.unescape(" ".join(out))


def buckets(text: str | None) -> np.ndarray:
    """Hashed letter trigrams of the lower-case words, each word between spaces."""
    words = LETTERS.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    c = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log probability of each trigram bucket by language."""
    known = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"), F.lower(F.col(lang_col)).alias("lang")).filter("lang is not null and text is not null")
    sample = bounded_sample(known, "__id", rows)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS)
                sums[lang] += np.bincount(buckets(text.as_py()), minlength=BUCKETS)
        for lang, s in sums.items():
            yield pa.RecordBatch.from_pylist([{"lang": lang, "counts": s.tobytes()}])

    # a row for each language and task; the sample's size bounds both
    got: dict[str, np.ndarray] = {}
    for r in sample.select("text", "lang").mapInArrow(run, "lang string, counts binary").collect():
        got[r.lang] = got.get(r.lang, 0) + np.frombuffer(r.counts)
    langs = sorted(got)
    table_ = np.array([np.log((got[k] + 0.05) / (got[k].sum() + 0.05 * BUCKETS)) for k in langs]) if langs else np.zeros((0, BUCKETS))
    return langs, table_


def evidence(pages: DataFrame, langs: list[str], table_: np.ndarray, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", temper: float = TEMPER) -> DataFrame:
    """``(id, host, domain, suffix, declared, n_letters, ll, p)``: what a page shows, and its text's log likelihoods and posterior."""
    logs = np.ascontiguousarray(table_.T.astype(np.float32))

    def run(batches):
        for b in slices(batches):
            rows = []
            for url, page in zip(b.column(1), b.column(2), strict=True):
                m = HOST.match(url.as_py() or "")
                host = m[1].lower().rstrip(".") if m else None
                parts = host.split(".") if host else []
                page = page.as_py() or ""
                said = declared_of(page)
                at = buckets(text_of(page))
                ll = temper * logs[at].sum(axis=0, dtype=np.float64) if len(at) else np.zeros(len(langs))
                p = np.exp(ll - ll.max())
                rows.append((host, ".".join(parts[-2:]) or None, parts[-1] if len(parts) > 1 else None, said, len(at), ll.tolist(), (p / p.sum()).tolist()))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))] if rows else [b.column(0), *(pa.array([], k) for k in kinds)], ["id", "host", "domain", "suffix", "declared", "n_letters", "ll", "p"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, host string, domain string, suffix string, declared string, n_letters long, ll array<double>, p array<double>")


def _sums(shown: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Sums of the text posteriors of pages with text, by value."""
    return shown.filter("n_letters > 0").groupBy(*by).agg(F.array(*(F.sum(F.col("p")[k]) for k in range(n))).alias(name))


def fuse(shown: DataFrame, langs: list[str], kappa: float = KAPPA) -> DataFrame:
    """``(id, lang, confidence, declared, host, text_lang, n_letters)`` from the evidence."""
    n = len(langs)
    zero = F.array(*[F.lit(0.0)] * n)
    total = shown.agg(F.array(*(F.coalesce(F.sum(F.when(F.col("n_letters") > 0, F.col("p")[k])), F.lit(0.0)) for k in range(n))).alias("s_all")).first()[0]
    whole = F.array(*(F.lit(float(x)) for x in total))
    hosts = _sums(shown.filter("host is not null"), ["host", "domain"], n, "s_host")
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("s_host")[k]) for k in range(n))).alias("s_domain"))
    by_host = hosts.join(domains, "domain").select("host", "s_host", "s_domain")
    suffixes = _sums(shown.filter("suffix is not null"), ["suffix"], n, "s_suffix")
    declared = _sums(shown.filter("declared is not null"), ["declared"], n, "s_declared")
    all_ = shown.join(by_host, "host", "left").join(suffixes, "suffix", "left").join(declared, "declared", "left")
    own = F.when(F.col("n_letters") > 0, F.col("p")).otherwise(zero)
    less = lambda c: F.zip_with(F.coalesce(c, zero), own, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    all_ = all_.select("*", less(whole).alias("o_all"), less(F.col("s_host")).alias("o_host"), less(F.col("s_domain")).alias("o_domain"), less(F.col("s_suffix")).alias("o_suffix"), less(F.col("s_declared")).alias("o_declared"))
    for c in ("all", "host", "domain"):
        all_ = all_.withColumn(f"n_{c}", size(F.col(f"o_{c}")))
    score = []
    for k, lang in enumerate(langs):
        base = (F.col("o_all")[k] + 1) / (F.col("n_all") + n)
        domain = (F.col("o_domain")[k] + kappa * base) / (F.col("n_domain") + kappa)
        prior = (F.col("o_host")[k] + kappa * domain) / (F.col("n_host") + kappa)
        # P(value | k) up to a factor that is the same for all languages: the value's sums against the language's
        has = F.col("o_suffix")[k] + SMOOTH * base
        suffix = F.when(F.col("suffix").isNotNull(), F.log(has / (F.col("o_all")[k] + SMOOTH))).otherwise(0.0)
        named = F.when(F.substring("declared", 1, 2) == lang, 0.9).otherwise(0.1 / max(1, n - 1))
        said = F.when(F.col("declared").isNotNull(), F.log((F.col("o_declared")[k] + SMOOTH * named) / (F.col("o_all")[k] + SMOOTH))).otherwise(0.0)
        score.append(F.col("ll")[k] + F.log(prior) + suffix + said)
    all_ = all_.withColumn("score", F.array(*score))
    top, names = F.array_max("score"), F.array(*(F.lit(x) for x in langs))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    mass = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return all_.select("id", best(F.col("score")).alias("lang"), (1 / mass).alias("confidence"), "declared", "host", F.when(F.col("n_letters") > 0, best(F.col("p"))).alias("text_lang"), "n_letters")


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", kappa: float = KAPPA) -> DataFrame:
    """One row for each page: ``(id_col, lang, confidence, declared, host, text_lang, n_letters)``."""
    langs, logs = train(docs)
    if not langs:
        return pages.select(id_col, *(F.lit(None).cast(k).alias(c) for c, k in (("lang", "string"), ("confidence", "double"), ("declared", "string"), ("host", "string"), ("text_lang", "string"), ("n_letters", "long"))))
    shown = cut(evidence(pages, langs, logs, id_col, url_col, html_col))
    return fuse(shown, langs, kappa).withColumnRenamed("id", id_col)


def op3_langid(spark, sf_dir):
    found = identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))
    return found.withColumn("confidence", F.round("confidence", 6))
