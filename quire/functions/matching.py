"""Many literal strings looked for in many texts at once, over arrays.

Every word gives one anchor, its rarest run of ``GRAM`` characters (by given
frequencies, else by how many words share it), written exactly into 63 bits.  The runs
of all positions of a batch of texts are compared with the anchors in bulk, and only
where one stands the words that have it are compared character by character.  The
work per text hardly depends on the number of words.
"""

from __future__ import annotations

from collections import Counter
from typing import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.pandas.functions import pandas_udf

GRAM = 3
CHUNK_CHARS = 1 << 20
_BITS = 20


def _code(text: str) -> int:
    return sum(ord(c) << (21 * i) for i, c in enumerate(text))


def grams(points: np.ndarray, size: int) -> np.ndarray:
    """The run of ``size`` characters that begins at each position, as one number."""
    n = max(0, len(points) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out |= points[k:k + n].astype(np.uint64) << np.uint64(21 * k)
    return out


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


class Matcher:
    """Finds which of ``words`` (distinct, not empty) occur in texts.  With ``whole`` an
    occurrence may not have a letter, digit or underscore beside it."""

    def __init__(self, words: Sequence[str], frequency: Mapping[str, int] | None = None, whole: bool = False):
        self.words, self.whole = list(words), whole
        if frequency is None:
            frequency = Counter(g for w in self.words for g in {w[i:i + GRAM] for i in range(max(1, len(w) - GRAM + 1))})
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.points = np.zeros((len(self.words), int(self.lengths.max()) if len(self.words) else 0), np.uint32)
        for i, w in enumerate(self.words):
            self.points[i, :len(w)] = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        self.by_size = {}
        for size in range(1, GRAM + 1):
            own = [i for i, w in enumerate(self.words) if min(len(w), GRAM) == size]
            if not own:
                continue
            place = [min(range(len(self.words[i]) - size + 1), key=lambda k, w=self.words[i]: (frequency.get(w[k:k + size], 0), k)) for i in own]
            code = np.array([_code(self.words[i][k:k + size]) for i, k in zip(own, place)], np.uint64)
            order = np.argsort(code, kind="stable")
            anchors, begin = np.unique(code[order], return_index=True)
            table = np.zeros(1 << _BITS, bool)
            table[_slot(anchors)] = True
            self.by_size[size] = (anchors, np.r_[begin, len(own)], np.array(own)[order], np.array(place)[order], table)

    def find(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(text, word)`` numbers of the words that occur, each pair once."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        found = []
        for size, (anchors, begin, words, place, table) in self.by_size.items():
            codes = grams(points, size)
            at = np.flatnonzero(table[_slot(codes)])
            which = np.minimum(np.searchsorted(anchors, codes[at]), len(anchors) - 1)
            hit = anchors[which] == codes[at]
            at, which = at[hit], which[hit]
            n = begin[which + 1] - begin[which]
            entry = np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            word, start = words[entry], np.repeat(at, n) - place[entry]
            text = np.searchsorted(ends, np.repeat(at, n), "right")
            stop = start + self.lengths[word]
            ok = (start >= np.r_[0, ends][text]) & (stop <= ends[text])
            word, start, text, stop = word[ok], start[ok], text[ok], stop[ok]
            same = np.ones(len(word), bool)
            for k in range(int(self.lengths[word].max()) if len(word) else 0):
                live = np.flatnonzero(same & (self.lengths[word] > k))
                same[live] = points[start[live] + k] == self.points[word[live], k]
            word, start, text, stop = word[same], start[same], text[same], stop[same]
            if self.whole and len(word):
                kept = np.fromiter((self._apart(joined, a, b, lo, hi) for a, b, lo, hi in zip(
                    start.tolist(), stop.tolist(), np.r_[0, ends][text].tolist(), ends[text].tolist())), bool, len(word))
                word, text = word[kept], text[kept]
            found.append(text * len(self.words) + word)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.words)), pairs % max(1, len(self.words))

    @staticmethod
    def _apart(joined: str, a: int, b: int, lo: int, hi: int) -> bool:
        beside = (joined[a - 1] if a > lo else " ") + (joined[b] if b < hi else " ")
        return not any(c.isalnum() or c == "_" for c in beside)


def class_hits(lowered: Column, dictionary: Mapping[str, Sequence[str]], whole: bool = False) -> Column:
    """Array of hits per class of ``dictionary``: how many of its entries occur in the
    lower-cased text.  An entry listed twice counts twice, an empty one always."""
    entries = [(c, k.lower()) for c, kws in enumerate(dictionary.values()) for k in kws]
    words = sorted({k for _, k in entries if k})
    number = {w: i for i, w in enumerate(words)}
    weight = np.zeros((len(words), len(dictionary)), np.int64)
    always = np.zeros(len(dictionary), np.int64)
    for c, k in entries:
        if k:
            weight[number[k], c] += 1
        else:
            always[c] += 1
    matcher = Matcher(words, whole=whole)

    @pandas_udf("array<int>")
    def hits(texts: pd.Series) -> pd.Series:
        texts = texts.fillna("").tolist()
        out = np.tile(always, (len(texts), 1))
        begin, size = 0, 0
        for i, text in enumerate([*texts, None]):
            if text is None or size and size + len(text) > CHUNK_CHARS:
                of, word = matcher.find(texts[begin:i])
                np.add.at(out, begin + of, weight[word])
                begin, size = i, 0
            size += len(text or "")
        return pd.Series(list(out.astype(np.int32)))

    return hits(lowered)
