"""BPE as a deterministic token automaton.

The automaton reads the tokens of a word from left to right and accepts exactly
the sequences that the merge rules produce.  It starts as one state that every
byte loops on; each merge rule ``u v -> w`` in order of rank is a gadget on it:

* the state that ``u`` leads to is split off for ``u`` alone and loses its arc ``v``
  (the pair may no longer stand unmerged);
* wherever ``u`` may be read, ``w`` may be read now, and leads to where ``v`` led.

All arcs of a token lead to one state, so the table is the bit matrix "token may
be read in state" plus one target per token.  A word's tokens follow from table
lookups alone: the last token of each prefix is the one token ending there whose
arc exists in the state of the prefix before it.  Decoding emits the arc labels
(the tokens' bytes).

Only arcs that a pre-split word can take are built: the blank that a word may
begin with occurs nowhere else but in runs of white space, so a token with a
leading blank and more than white space is read in the start state only.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire import worker_state

from .common import slices
from .pretoken import WordEncoder, by_chars, special_tokens

#: bytes that occur in the UTF-8 form of white-space characters
_BLANKS = frozenset([*range(9, 14), *range(28, 33), 0xC2, 0x85, 0xA0, 0xE1, 0x9A, 0x80, 0xE2, *range(0x80, 0x8B),
                     0xA8, 0xA9, 0xAF, 0x81, 0x9F, 0xE3])


def byte_characters() -> dict[str, int]:
    """Byte of each character that byte-level vocabulary files write bytes with:
    printable Latin-1 characters stand for themselves, the other bytes for the
    code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """``allowed[state]``: packed bits over the inner tokens' columns;
    ``target[id]``: the state after a token, -1 if no merges make it; ``column[id]``:
    its column or -1."""

    def __init__(self, labels: dict[int, bytes], allowed: np.ndarray, target: np.ndarray, column: np.ndarray):
        self.labels, self.target, self.column = labels, target.tolist(), column.tolist()
        self.rows = [row.tobytes() for row in allowed]
        self.id_of = {label: i for i, label in labels.items() if self.target[i] >= 0}
        self.longest = max(map(len, self.id_of), default=0)

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]      # the start state has an arc for every token that merges make
        id_of, rows, target, column, longest = self.id_of, self.rows, self.target, self.column, self.longest
        n = len(word)
        last, back = [0] * (n + 1), [0] * (n + 1)
        row_at: list = [None] * (n + 1)
        for end in range(1, n + 1):
            for begin in range(max(0, end - longest), end):
                token = id_of.get(word[begin:end])
                if token is None:
                    continue
                if begin:
                    c, row = column[token], row_at[begin]
                    if c < 0 or row is None or not row[c >> 3] & (128 >> (c & 7)):
                        continue
                last[end], back[end], row_at[end] = token, begin, rows[target[token]]
                break
        out, end = [], n
        while end:
            if row_at[end] is None:
                raise ValueError(f"no path for {word!r}")
            out.append(last[end])
            end = back[end]
        return out[::-1]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and the number of ids of each."""
        found = [self.encode_word(w.encode("utf-8")) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes

    def emit(self, ids) -> bytes:
        """The arc labels of a sequence of ids."""
        return b"".join(map(self.labels.__getitem__, ids))


def read_merges(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Vocabulary (bytes -> id) and merge rules of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    of = byte_characters()
    raw = lambda s: bytes(of[c] for c in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return {raw(k): i for k, i in model["vocab"].items()}, [(raw(a), raw(b)) for a, b in merges]


def compile_tables(vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
    """``(labels, allowed, target, column)`` by successive merge gadgets.  While
    compiling, rows are tokens and columns states, so that "w wherever u" copies
    one row; splitting a state copies one column."""
    inner = [t for t in vocab if t[:1] != b" " or _BLANKS.issuperset(t)]
    size = max(vocab.values()) + 1
    column = np.full(size, -1, np.int32)
    for k, t in enumerate(inner):
        column[vocab[t]] = k
    width = 1024
    bits = np.zeros((len(inner), width // 8), np.uint8)
    single = [b for b in inner if len(b) == 1]
    bits[[column[vocab[b]] for b in single], 0] = 128       # state 0: every byte loops
    target = np.full(size, -1, np.int32)                     # -1: no arc yet
    target[[i for t, i in vocab.items() if len(t) == 1]] = 0
    labels_at = {0: 256}                                     # labels that lead to a state
    n_states = 1
    for u, v in merges:
        w = u + v
        iu, iv, iw = vocab[u], vocab[v], vocab[w]
        state = int(target[iu])
        cv = column[iv]
        if state < 0 or cv < 0 or not bits[cv, state >> 3] & (128 >> (state & 7)):
            continue                                         # u v never stands unmerged
        after_v = int(target[iv])
        if labels_at[state] > 1 or iu == iv:
            if n_states == width:
                bits = np.pad(bits, ((0, 0), (0, width // 8)))
                width *= 2
            new = n_states
            n_states += 1
            has = (bits[:, state >> 3] >> (7 - (state & 7))) & 1
            bits[:, new >> 3] |= has << np.uint8(7 - (new & 7))
            labels_at[state] -= 1
            labels_at[new] = 1
            target[iu] = state = new
        bits[cv, state >> 3] &= np.uint8(255 ^ (128 >> (state & 7)))
        target[iw] = after_v
        labels_at[after_v] = labels_at.get(after_v, 0) + 1
        cw = column[iw]
        if cw >= 0:
            bits[cw] = bits[column[iu]] if column[iu] >= 0 else 0
    by_state = np.packbits(np.unpackbits(bits, axis=1)[:, :n_states].T, axis=1)
    allowed, same = np.unique(by_state, axis=0, return_inverse=True)    # equal states are one
    target = np.where(target < 0, -1, same.reshape(-1)[target]).astype(np.int32)
    return {i: t for t, i in vocab.items()}, allowed, target, column


_COMPILED: dict = {}


def compile_file(path: str):
    """Tables of a tokenizer file, compiled once per driver process."""
    if path not in _COMPILED:
        tables = compile_tables(*read_merges(path))
        specials = special_tokens(path)
        tables[0].update({i: s.encode("utf-8") for s, i in specials.items()})
        _COMPILED[path] = (tables, specials)
    return _COMPILED[path]


def _encoder(shared, path: str):
    """The task's automaton and word cache, built once per Python worker."""
    cache = worker_state()
    if ("bpe_automaton", path) not in cache:
        (labels, allowed, target, column), specials = shared.value
        ordinary = {i: t for i, t in labels.items() if i not in set(specials.values())}
        automaton = Automaton(ordinary, allowed, target, column)
        automaton.labels = labels
        cache["bpe_automaton", path] = automaton, WordEncoder(automaton.encode_words, specials)
    return cache["bpe_automaton", path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of every whole text; a null text has no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_file(path))

    def task(batches):
        _, encoder = _encoder(shared, path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id").to_pylist()
            for a, b in by_chars(texts):
                numbers, counts = encoder.words(texts[a:b])
                ends = np.cumsum(counts)
                rows = [encoder.ids_of(numbers[e - c:e]).astype(np.int32) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``: arc labels, read as UTF-8."""
    shared = encoded.sparkSession.sparkContext.broadcast(compile_file(path))

    def task(batches):
        automaton, _ = _encoder(shared, path)
        for batch in slices(batches):
            texts = [automaton.emit(ids or []).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(task, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every whole text in one pass and keeps the digests:
    ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.  Ids and labels are put
    together from the task's cache of encoded words."""
    shared = docs.sparkSession.sparkContext.broadcast(compile_file(path))

    def task(batches):
        automaton, encoder = _encoder(shared, path)
        written, labels, known = [], [], None
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = ([], [], [])
            for a, b in by_chars(texts):
                numbers, counts = encoder.words(texts[a:b])
                if known is not encoder.numbers:
                    written, labels, known = [], [], encoder.numbers
                for k in range(len(written), len(encoder.numbers)):
                    ids = encoder.ids[encoder.offsets[k]:encoder.offsets[k + 1]].tolist()
                    written.append(",".join(map(str, ids)))
                    labels.append(automaton.emit(ids))
                sizes = encoder.offsets[numbers + 1] - encoder.offsets[numbers]
                numbers, end = numbers.tolist(), 0
                for count in counts.tolist():
                    own = numbers[end:end + count]
                    out[0].append(int(sizes[end:end + count].sum()))
                    out[1].append(hashlib.sha256(",".join(map(written.__getitem__, own)).encode()).hexdigest())
                    text = b"".join(map(labels.__getitem__, own)).decode("utf-8", "replace")
                    out[2].append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                    end += count
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
