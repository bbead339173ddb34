"""Splitting texts into pre-tokens and keeping their ids: what both encoders share.

A text in which no space stands before other white space or the end splits at its spaces into
chunks; the pre-tokens of a chunk don't depend on what surrounds it. Where the same holds of its
line breaks, it splits before them too, so that the end of a line and the start of the next are
no chunk of their own that hardly comes again. So a text costs one
dictionary look-up a chunk, and a chunk is split and encoded once while a worker's bounded
dictionary holds it. New words of a batch of texts are encoded together.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, islice

import regex
from tokenizers.pre_tokenizers import ByteLevel

#: The split pattern of the byte-level vocabulary (fixed values of the public format).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
#: Beyond these blocks Unicode versions differ in what is a letter, so the library's own splitter decides.
WIDE = re.compile("[^\x00-ɏ]")
_library = ByteLevel(add_prefix_space=False, use_regex=True)
#: A space after which white space or nothing follows; before any other space a pre-token ends, whatever stands around it.
UNSAFE = re.compile(r" (?:\s|\Z)")
#: A line break of that kind; any other is a pre-token, and what follows it begins one.
UNSAFE_BREAK = re.compile(r"\n(?:\s|\Z)")
MARKS = frozenset(".,;:!?")
#: Chunks that a worker keeps. When full, the half that came last goes: frequent chunks come early and stay.
KEPT = 240_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


def split(text: str) -> list[str]:
    """The pre-tokens of a text."""
    if WIDE.search(text):
        return [text[a:b] for _, (a, b) in _library.pre_tokenize_str(text)]
    return SPLIT.findall(text)


def chunks(text: str) -> tuple[list[str], list[str]]:
    """Parts of a text that split on their own, in order: whole ones, then ones that a space precedes, without it, or that begin with a line break."""
    if UNSAFE.search(text):
        return split(text), []
    if "\n" in text and not UNSAFE_BREAK.search(text):
        text = text.replace("\n", " \n")
    first, *rest = text.split(" ")
    return [first], rest


def words_of(chunk: str) -> list[str]:
    """The pre-tokens of a chunk; the common cases, a space and letters with or without a mark at the end, need no pattern."""
    body = chunk[1:] if chunk[:1] == " " else chunk
    if body.isascii() or not WIDE.search(body):
        if body.isalpha():
            return [chunk]
        if body[-1:] in MARKS and body[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
    return split(chunk)


def plain(body: str) -> bool:
    """Whether a part without spaces is one run of letters."""
    return body.isalpha() and (body.isascii() or not WIDE.search(body))


def words_of_spaced(bodies: list[str]) -> list[list[str]]:
    """The pre-tokens of many of the later parts that ``chunks`` returns: one run of the pattern over all that a space precedes."""
    if any(b[0] == "\n" for b in bodies):
        spaced = iter(words_of_spaced([b for b in bodies if b[0] != "\n"]))
        return [["\n", *words_of(b[1:])] if b[0] == "\n" else next(spaced) for b in bodies]
    text = "".join([" " + b for b in bodies])
    if WIDE.search(text):
        return [words_of(" " + b) for b in bodies]
    words = SPLIT.findall(text)
    cuts = [*(i for i, w in enumerate(words) if w[0] == " "), len(words)]
    return [words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


class Dictionary:
    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], kept: int = KEPT):
        """``encode_words``: ids of distinct pre-tokens, as bytes."""
        self.encode_words, self.kept = encode_words, kept
        self.whole: dict[str, bytes] = {"": b""}
        self.spaced: dict[str, bytes] = {}

    def encode(self, texts: list[str], group: int = 128) -> list[bytes]:
        out = []
        for at in range(0, len(texts), group):
            out += self._group(texts[at : at + group])
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        parts = [chunks(t) for t in texts]
        if len(self.whole) + len(self.spaced) > self.kept:
            self.whole, self.spaced = (dict(islice(d.items(), len(d) // 2)) for d in (self.whole, self.spaced))
        whole, spaced = (list(chain.from_iterable(x)) for x in zip(*parts, strict=True))
        of_whole, of_spaced = list(map(self.whole.get, whole)), list(map(self.spaced.get, spaced))
        no_whole, no_spaced = ([i for i, x in enumerate(got) if x is None] for got in (of_whole, of_spaced))
        if no_whole or no_spaced:
            self._fill({whole[i] for i in no_whole}, {spaced[i] for i in no_spaced})
            for i in no_whole:
                of_whole[i] = self.whole[whole[i]]
            for i in no_spaced:
                of_spaced[i] = self.spaced[spaced[i]]
        out, i, j = [], 0, 0
        for w, s in parts:
            out.append(b"".join(of_whole[i : i + len(w)] + of_spaced[j : j + len(s)]))
            i, j = i + len(w), j + len(s)
        return out

    def _fill(self, whole: set[str], spaced: set[str]) -> None:
        """Encodes new chunks: words of letters, alone or before a mark, as spaced chunks of their own, others by their pre-tokens."""
        known, held = self.whole, self.spaced
        letter = plain if WIDE.search("".join(spaced)) else str.isalpha
        letters = set(filter(letter, spaced))
        rest = spaced - letters
        marked = [(c, body) for c in rest if c[-1] in MARKS and letter(body := c[:-1])]
        letters.update([body for _, body in marked if body not in held])
        others = list(rest.difference([c for c, _ in marked]))
        split_spaced = list(zip(others, words_of_spaced(others), strict=True))
        split_whole = [(c, words_of(c)) for c in whole]
        several = {w for _, ws in split_spaced for w in ws} | {w for _, ws in split_whole for w in ws}
        if marked:
            several.update(MARKS)
        new, lone = list(several.difference(known)), list(letters)
        got = self.encode_words(new + [" " + w for w in lone])
        known.update(zip(new, got, strict=False))
        held.update(zip(lone, got[len(new) :], strict=True))
        held.update([(c, held[body] + known[c[-1]]) for c, body in marked])
        held.update([(c, b"".join([known[w] for w in ws])) for c, ws in split_spaced])
        known.update([(c, b"".join([known[w] for w in ws])) for c, ws in split_whole])
