"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

The base finds e-mail addresses, IPv4 addresses, payment cards and international phone
numbers. The field then reads the stretches of text where further spans can lie (clusters
of digits, addresses written out as "name at host dot org" or "name(at)host.org", in any
case and with any white space), scores every candidate segment as a whole (digit groups, separators, check digit, octets, cue words to its left)
and chooses boundaries and types jointly by dynamic programming over segments of at most
``LONGEST`` tokens. Tokens outside of the stretches hold no candidate segment, so the best path
there is "no entity" and leaving them out is exact. Segments that overlap a base span are dropped.

The weights are fitted by maximum conditional likelihood on sentences that ``examples``
generates from a fixed seed: formats the base misses, and look-alikes (order numbers,
dates, versions, hex keys, numbers that fail the check digit) that must stay untouched.

Every pattern runs in time linear in the text: e-mail addresses are found from their "@".
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandloom.llm.common import others, slices, table

KINDS = ("email", "ip", "card", "phone")
#: A segment has at most so many tokens, and without letters so many groups of digits.
LONGEST, GROUPS = 20, 7
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
SEVEN = re.compile(r"[0-9](?:[^0-9\n]{0,3}[0-9]){6}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return out


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind; matches that fail their check are dropped."""
    text = text or ""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if not DIGITS.search(text):
        return out
    out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The field.

TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\sA-Za-z0-9]")
CLUSTER = re.compile(r"(?<![A-Za-z0-9+(])[+(]?[(]?[0-9](?:[ ().\-/]{0,2}[0-9])++(?![A-Za-z0-9])")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:[\[(]\s?at\s?[\])]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:[\[(]\s?dot\s?[\])]|\sdot\s|\.)\s?[A-Za-z0-9-]{1,63}){1,4}", re.I)
#: What every match of ``SPELLED`` holds.
AT = re.compile(r"[\[(]\s?at\s?[\])]|\sat\s", re.I)
#: Which of them are written out: "look at host.org" is none, "name(at)host.org" is one.
WRITTEN = re.compile(r"[\[(]\s?at\s?[\])]|dot", re.I)
TLDS = ("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "uk", "eu", "io")
CUES = {"email": ("mail", "email", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "mastercard", "amex", "credit"), "phone": ("phone", "tel", "call", "mobile", "fax")}


class Segment:
    """A candidate: tokens [first, last) of a stretch and its features."""

    __slots__ = ("first", "last", "features", "kinds")

    def __init__(self, first: int, last: int, features: tuple[str, ...], kinds: tuple[str, ...]):
        self.first, self.last, self.features, self.kinds = first, last, features, kinds


def kinds_of(features: tuple[str, ...], digits: int) -> tuple[str, ...]:
    """What a segment can be at all: a card passes its check digit, an address has octets, only e-mail has letters."""
    if any(f.startswith("letters") for f in features):
        return ("email",)
    out = ("ip",) if "octets" in features else ()
    out += ("card",) if "check" in features else ()
    return out + (("phone",) if 7 <= digits <= 15 else ())


def features_of(piece: str, before: str, left: str, right: str) -> tuple[str, ...]:
    """Whole-span features: ``before`` is the text to the left, ``left`` and ``right`` the neighbouring characters."""
    groups = DIGITS.findall(piece)
    n, gaps = sum(map(len, groups)), re.sub(r"[0-9]+", "", piece)
    low = piece.lower()
    out = [f"digits{min(n, 20)}", f"groups{min(len(groups), 7)}", "shape" + "-".join(str(len(g)) for g in groups[:6]) if len(groups) < 7 else "shape+"]
    out.append("gaps" + ("none" if not gaps else "mixed" if len(set(gaps)) > 1 else gaps[0]))
    if re.search("[a-z]", low):
        spelled = re.search(r"[\[(]\s?at\s?[\])]", low), re.search(r"\sat\s", low), re.search(r"[\[(]\s?dot\s?[\])]|\sdot\s", low)
        out += [f"letters{bool(spelled[0]):d}{bool(spelled[1]):d}{bool(spelled[2]):d}", "tld" + (w if (w := re.findall("[a-z]+", low)[-1]) in TLDS else "other")]
    elif 13 <= n <= 19:
        out.append("check" if luhn("".join(groups)) else "nocheck")
        out.append(f"issuer{groups[0][0]}")
    if len(groups) == 4 and set(gaps) == {"."}:
        out.append("octets" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "nooctets")
    if piece[0] in "+(":
        out.append("opens" + piece[0])
    if re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", piece):
        out.append("national")
    if re.fullmatch(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}", piece):
        out.append("date")
    words = re.findall("[a-z]+", before[-24:].lower())[-2:]
    out += [f"cue-{k}" for k in KINDS if any(w in CUES[k] for w in words)]
    if left and not left.isspace():
        out.append("glued-left" + ("@" if left in "@#$/=\"'" else ""))
    if right and not right.isspace() and right not in ".,;:!?)":
        out.append("glued-right")
    return tuple(out)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where candidate segments can lie; disjoint, in order."""
    found = []
    if SEVEN.search(text):
        found += [m.span() for m in CLUSTER.finditer(text) if m.end() - m.start() >= 7]
    if AT.search(text):
        found += [m.span() for m in SPELLED.finditer(text) if WRITTEN.search(m[0])]
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[Segment]]:
    """Tokens of a stretch and its candidate segments of at most ``LONGEST`` tokens."""
    tokens = [(start + m.start(), start + m.end()) for m in TOKEN.finditer(text[start:end])]
    digits = [text[a].isdigit() * (b - a) for a, b in tokens]
    out = []
    for i, (a, _) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        n, groups, letters = 0, 0, False
        for j in range(i, min(i + LONGEST, len(tokens))):
            b = tokens[j][1]
            n += digits[j]
            groups += digits[j] > 0
            letters |= text[tokens[j][0]].isalpha()
            if (n > 19 or groups > GROUPS) and not letters:
                break
            if text[b - 1].isalnum() and (n >= 7 or letters and j > i + 2):
                features = features_of(text[a:b], text[max(0, a - 24) : a], text[a - 1 : a] if a else "", text[b : b + 1])
                if kinds := kinds_of(features, n):
                    out.append(Segment(i, j + 1, features, kinds))
    return tokens, out


class Field:
    """Weights by (kind, feature); a segment's score for a kind is their sum, a token outside of entities scores zero."""

    def __init__(self, weights: dict[tuple[str, str], float]):
        self.weights = weights

    def score(self, s: Segment, kind: str) -> float:
        get = self.weights.get
        return get((kind, "bias"), -1.0) + sum(get((kind, f), 0.0) for f in s.features)

    def best(self, n: int, segments: list[Segment]) -> list[tuple[int, int, str]]:
        """The best path over n tokens: (first, last, kind) of its entities."""
        ending: dict[int, list[Segment]] = {}
        for s in segments:
            ending.setdefault(s.last, []).append(s)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        for t in range(1, n + 1):
            value[t] = value[t - 1]
            for s in ending.get(t, ()):
                for kind in s.kinds:
                    v = value[s.first] + self.score(s, kind)
                    if v > value[t]:
                        value[t], back[t] = v, (s.first, kind)
        out, t = [], n
        while t > 0:
            if back[t] is None:
                t -= 1
            else:
                out.append((back[t][0], t, back[t][1]))
                t = back[t][0]
        return out[::-1]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        for start, end in stretches(text):
            tokens, segments = candidates(text, start, end)
            out += [(kind, tokens[i][0], tokens[j - 1][1]) for i, j, kind in self.best(len(tokens), segments)]
        return out


def examples(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with their entities."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("the", "an", "er", "on", "re", "in", "de", "la", "st", "ou")) for _ in range(r.randint(1, 3)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        k = r.choice((13, 14, 15, 15, 16, 16, 16, 19))
        body = r.choice("3456") + num(k - 2)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        if k == 15 and r.random() < 0.5:
            return f"{digits[:4]} {digits[4:10]} {digits[10:]}"
        sep = r.choice(("", ".", "/", " ", "-"))
        return sep.join(digits[i : i + 4] for i in range(0, k, 4)) if sep else digits

    def phone() -> str:
        a, b, c = r.choice("23456789") + num(2), num(3), num(4)
        return r.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"+{r.randint(1, 99)}/{a}/{b}{c}", f"1-{a}-{b}-{c}", f"00{r.randint(30, 49)} {a} {b}{c}"))

    def email() -> str:
        at, dot = r.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)")))
        return f"{word()}{r.choice(('', '.' + word(), num(2)))}{at}{word()}{dot}{r.choice(('org', 'com', 'net', 'example' + dot + 'com'))}"

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def other() -> str:
        k = r.choice((13, 14, 15, 16, 16, 17, 18, 19))
        body = num(k)
        bad = body if not luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)
        return r.choice((bad, " ".join(bad[i : i + 4] for i in range(0, k, 4)), num(r.randint(7, 12)), f"20{num(2)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{num(2)}", f"{num(1)}.{num(1)}.{num(3)}.{num(4)}", f"{r.randint(256, 999)}.{r.randint(256, 999)}.{num(3)}.{num(3)}", f"{num(3)} {num(3)} {num(3)}", f"{num(4)}-{num(4)}", f"20{num(2)} 20{num(2)} 20{num(2)}", f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)}-{num(2)}-{num(5)}-{num(1)}", f"{word()} at {word()} dot", f"{num(5)} {num(5)} {num(5)} {num(5)}"))

    make = {"card": card, "phone": phone, "email": email, "ip": ip}
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(word() for _ in range(r.randint(1, 4))) + " "
            kind = r.choice((*KINDS, "other", "other", "other"))
            if kind in make:
                if r.random() < 0.3:
                    text += r.choice(CUES[kind]) + r.choice((" ", ": "))
                piece = make[kind]()
                spans.append((kind, len(text), len(text) + len(piece)))
                text += piece
            else:
                text += other()
            text += r.choice((" ", ", ", ". "))
        out.append((text + word(), spans))
    return out


def fit(data, steps: int = 40, rate: float = 0.4, l2: float = 1e-3) -> Field:
    """Maximum conditional likelihood by adaptive gradient steps; expectations from the forward-backward recursions over segments."""
    index: dict[tuple[str, str], int] = {}
    cases = []
    for text, gold in data:
        for start, end in stretches(text):
            tokens, segments = candidates(text, start, end)
            if not segments:
                continue
            spans = {(a, b): k for k, a, b in gold}
            rows, truth = [], []
            for s in segments:
                kind = spans.get((tokens[s.first][0], tokens[s.last - 1][1]))
                for k in s.kinds:
                    rows.append((s.first, s.last, [index.setdefault((k, f), len(index)) for f in ("bias", *s.features)]))
                    truth.append(kind == k)
            cases.append((len(tokens), rows, np.array(truth, bool)))
    w, seen = np.zeros(len(index)), np.full(len(index), 1e-8)
    w[[i for (_, f), i in index.items() if f == "bias"]] = -1.0
    flat = [np.array([i for _, _, fs in rows for i in fs]) for _, rows, _ in cases]
    ends = [np.cumsum([0] + [len(fs) for _, _, fs in rows])[:-1] for _, rows, _ in cases]
    for _ in range(steps):
        g = np.zeros_like(w)
        for (n, rows, truth), ids, at in zip(cases, flat, ends, strict=True):
            score = np.add.reduceat(w[ids], at)
            ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
            ahead[0] = behind[n] = 0.0
            by_last: dict[int, list[int]] = {}
            by_first: dict[int, list[int]] = {}
            for i, (a, b, _) in enumerate(rows):
                by_last.setdefault(b, []).append(i), by_first.setdefault(a, []).append(i)
            for t in range(1, n + 1):
                ahead[t] = np.logaddexp.reduce([ahead[t - 1], *(ahead[rows[i][0]] + score[i] for i in by_last.get(t, ()))])
            for t in range(n - 1, -1, -1):
                behind[t] = np.logaddexp.reduce([behind[t + 1], *(behind[rows[i][1]] + score[i] for i in by_first.get(t, ()))])
            expected = np.exp([ahead[a] + s + behind[b] - ahead[n] for (a, b, _), s in zip(rows, score, strict=True)])
            lengths = np.diff([*at, len(ids)])
            np.add.at(g, ids, np.repeat(truth - expected, lengths))
        g -= l2 * len(cases) * w
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return Field({k: float(w[i]) for k, i in index.items()})


@lru_cache(maxsize=1)
def field() -> Field:
    return fit(examples())


def find(text: str | None, crf: Field) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """Base spans by kind, and the spans that the field adds."""
    text = text or ""
    base = base_spans(text)
    taken = sorted(s for spans in base.values() for s in spans)
    added = [x for x in crf.spans(text) if not any(a < x[2] and x[1] < b for a, b in taken)] if text else []
    return base, added


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "pii", crf: Field | None = None) -> DataFrame:
    """``docs`` with ``out_col``: spans (kind, start, end, base) in code points, ends exclusive, by kind as in ``KINDS``, then start.

    A null or empty text has no spans; a column named ``out_col``, in any case, is replaced; repeated rows have equal spans.
    """
    keep = others(docs, out_col)
    at, crf = keep.index(text_col), crf or field()

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for b in slices(batches):
            rows = []
            for x in b.column(at):
                base, added = find(x.as_py(), crf)
                spans = [(KINDS.index(k), s, e, True) for k, found in base.items() for s, e in found] + [(KINDS.index(k), s, e, False) for k, s, e in added]
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "base": own} for k, s, e, own in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*keep, out_col])

    src = docs.select(*(f"`{c}`" for c in keep))
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(out_col, SPAN)]))


def op5_pii(spark, sf_dir):
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("pii")).alias("spans"), F.size(F.filter("pii", lambda s: ~s["base"])).cast("long").alias("n_added"))
