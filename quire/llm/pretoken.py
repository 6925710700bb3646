"""Byte-level BPE pre-splitting over arrays, and a cache of encoded words.

The splitting rule of byte-level BPE files is a regular expression over letters,
numbers, white space and the rest:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Here a table gives the class of every code point and the word starts follow
from comparisons of neighbours, for all texts of a chunk at once.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
import regex

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CHUNK_CHARS = 1 << 20
MAX_WORDS = 500_000         # of a task's word cache; beyond it the cache starts anew

_PAIRS = ("re", "ve", "ll")
_SINGLES = "stmd"


def class_table() -> np.ndarray:
    """Class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        hits = "".join(regex.findall(pattern + "+", every))
        table[np.frombuffer(hits.encode("utf-32-le"), np.uint32)] = kind
    return table


def word_starts(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Flags of the characters that begin a word; ``first`` flags text starts."""
    n = len(points)
    kind = table[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last white-space character before a word: a blank joins the word,
    # another one stands alone; the white space before it is a word of its own
    after = np.flatnonzero(run[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 32
    # contractions: a lone apostrophe that begins a word, before letters
    at = np.flatnonzero((points == 39) & run & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    for i in at.tolist():
        length = 1 if chr(points[i + 1]) in _SINGLES else 0
        if not length and i + 2 < n and not first[i + 2] and chr(points[i + 1]) + chr(points[i + 2]) in _PAIRS:
            length = 2
        if length:
            start[i + 1] = False
            end = i + 1 + length
            if end < n and not first[end] and kind[end] == LETTER:
                start[end] = True
    return start


def split_words(texts: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All words of the texts in order, and the number of words of each text."""
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not joined:
        return [], np.zeros(len(texts), np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.zeros(len(points) + 1, bool)
    heads = np.cumsum(lengths) - lengths
    first[heads] = True
    start = word_starts(points, first[:-1], table)
    begins = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(begins, np.r_[heads, len(points)]))
    return pieces_at(joined, points, begins), counts


#: a code point that is no character, put between the words of a text
_BETWEEN = 0x10FFFF


def pieces_at(text: str, points: np.ndarray, begins: np.ndarray) -> list[str]:
    """Cuts a text at ``begins`` (the first is 0); ``points`` are its code points."""
    if chr(_BETWEEN) in text:
        return [text[a:b] for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(text)])]
    marked = np.insert(points, begins[1:], _BETWEEN)
    return marked.tobytes().decode("utf-32-le", "surrogatepass").split(chr(_BETWEEN))


def distinct_words(words: list[str], text: str) -> tuple[np.ndarray, list[str]]:
    """Code of each word of a text and the distinct words, in order of appearance."""
    if "\0" in text:        # pandas compares strings up to a zero only
        numbers: dict[str, int] = {}
        codes = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        return codes, list(numbers)
    cells = np.empty(len(words), object)
    cells[:] = words
    codes, distinct = pd.factorize(cells)
    return codes, distinct.tolist()


def special_tokens(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer file, which are cut out of the raw text."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    for token in added:
        if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} needs more than a literal match")
    return {token["content"]: token["id"] for token in added}


class WordEncoder:
    """Encodes whole texts word by word; each distinct word of a task is encoded
    once by ``encode`` (a list of words -> their ids, concatenated, and the number of
    ids of each).  The cache holds at most ``MAX_WORDS`` words and the new ones of
    one chunk; when it is full, the words met in the fewest chunks go."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], specials: dict[str, int]):
        self.encode, self.specials = encode, specials
        self.table = class_table()
        self.pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.numbers: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.offsets = np.zeros(1, np.int64)
        self.met = np.zeros(0, np.int64)        # chunks that a word was met in, halved when words go

    def _forget(self):
        """Keeps at most half of the words: those met in the most chunks."""
        least = max(2, int(np.sort(self.met)[-(MAX_WORDS // 2)]) + 1)
        keep = np.flatnonzero(self.met >= least)
        words = list(self.numbers)
        self.ids = self.ids_of(keep)
        self.offsets = np.r_[0, np.cumsum(np.diff(self.offsets)[keep])]
        self.numbers = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.met = self.met[keep] // 2

    def _learn(self, fresh: list[str]):
        plain = [w for w in fresh if w not in self.specials]
        ids, sizes = self.encode(plain)
        for word in fresh:
            self.numbers[word] = len(self.numbers)
        if len(plain) < len(fresh):
            special = np.array([w in self.specials for w in fresh])
            every = np.ones(len(fresh), np.int64)
            every[~special] = sizes
            own = np.repeat(special, every)
            both = np.empty(len(own), np.uint32)
            both[own] = [self.specials[w] for w in fresh if w in self.specials]
            both[~own] = ids
            ids, sizes = both, every
        self.ids = np.concatenate([self.ids, np.asarray(ids, np.uint32)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])

    def _segments(self, text: str) -> list[str]:
        if self.pattern is None or not any(s in text for s in self.specials):
            return [text]
        return [s for s in self.pattern.split(text) if s]

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in order, and each text's count of words."""
        if len(self.numbers) > MAX_WORDS:
            self._forget()
        cut = [self._segments(t) for t in texts]
        if all(len(c) == 1 for c in cut):
            words, counts = split_words(texts, self.table)
        else:
            flat = [s for c in cut for s in c]
            ordinary = [s if s not in self.specials else "" for s in flat]
            found, each = split_words(ordinary, self.table)
            words, at = [], 0
            for segment, k in zip(flat, each.tolist()):
                words += found[at:at + k] if segment not in self.specials else [segment]
                at += k
            each = np.where(np.array([s in self.specials for s in flat], bool), 1, each)
            of = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            counts = np.bincount(of, weights=each, minlength=len(cut)).astype(np.int64)
        codes, distinct = distinct_words(words, "\0" if any("\0" in t for t in texts) else "")
        known, size = self.numbers, len(self.numbers)
        numbers = np.fromiter(map(known.get, distinct, repeat(-1)), np.int64, len(distinct))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            self._learn([distinct[k] for k in fresh.tolist()])
            numbers[fresh] = np.arange(size, size + len(fresh))
        self.met[numbers] += 1
        return numbers[codes], counts

    def ids_of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of a run of words, concatenated."""
        begin = self.offsets[numbers]
        lengths = self.offsets[numbers + 1] - begin
        total = int(lengths.sum())
        shift = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
        return self.ids[shift + np.arange(total)]


def by_chars(texts: list[str], limit: int = CHUNK_CHARS):
    """Slices ``(a, b)`` of a list of whole texts holding about ``limit`` characters."""
    a, size = 0, 0
    for b, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield a, b
            a, size = b, 0
        size += len(text)
    if a < len(texts):
        yield a, len(texts)
