"""Cost-balanced packing of documents into training sequences.

A document's ids (with a separating id 0 at its end) are cut into pieces of the
sequence length and a rest.  A full piece is a sequence.  Rests are dealt into
blocks of about ``BLOCK_SEQUENCES`` sequences' worth of tokens by the hash of a
row number, so no key, source or group of copies can fill a block, and each
block is packed in one task: in descending order, a rest goes to the sequence of
the lowest cost that still has room, cost being the sum over its pieces of
``length + ATTENTION * length ** 2`` (dense layers are linear in the tokens,
attention inside a document is quadratic).  A block opens
``FILL`` of the sequences that its tokens need; a rest that fits none of them is cut into pieces of power-of-two
lengths, which are placed by the same rule, and one that fits nowhere is a
sequence of its own that needs no padding.

A null text is an empty one: it has the separator only.  Null ids and repeated
rows are packed like others.  An empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from quire import worker_state

from .common import cut, slices
from .pretoken import WordEncoder, by_chars, special_tokens

SEQUENCE = 1024
SEPARATOR = 0
ATTENTION = 1 / 3072
FILL = 0.98              # sequences a block opens at first, as a share of what its tokens need
BLOCK_SEQUENCES = 2048

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<struct<length:long,crc:long>>"
_PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length):
    return length + ATTENTION * length * length


def word_tokenizer(text: str):
    """Encodes lists of words that are split already, by the tokenizers library from
    a file's text: one call and one sequence for a list, without the splitting rule,
    which would find nothing to split.  The sequence is cut where the tokens' bytes
    (a vocabulary entry has one character for each) make up a word's."""
    file = json.loads(text)
    if file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"] or file["normalizer"]:
        raise ValueError("not a plain byte-level tokenizer file")
    file["pre_tokenizer"]["use_regex"] = False
    tokenizer = Tokenizer.from_str(json.dumps(file))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    vocabulary = file["model"]["vocab"]
    n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
    n_bytes[list(vocabulary.values())] = list(map(len, vocabulary))

    def encode(words: list[str]):
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        found = tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0]
        ids = np.array(found.ids, np.uint32)
        ends = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        to = np.searchsorted(np.cumsum(n_bytes[ids]), ends, "right")
        return ids, np.diff(to, prepend=0)

    return encode


def _word_encoder(shared, path):
    cache = worker_state()
    if ("packing_words", path) not in cache:
        text, specials = shared.value
        cache["packing_words", path] = WordEncoder(word_tokenizer(text), specials)
    return cache["packing_words", path]


def piece_rows(ids: np.ndarray, sequence: int):
    """``(start, length, crc, parts)`` of a document's pieces; the parts of a rest
    are its cuts at descending powers of two."""
    data = np.ascontiguousarray(ids, "<u4").tobytes()
    for start in range(0, len(ids), sequence):
        length = min(sequence, len(ids) - start)
        parts, at = [], start
        for power in range(length.bit_length() - 1, -1, -1):
            if length >> power & 1:
                end = at + (1 << power)
                parts.append({"length": 1 << power, "crc": zlib.crc32(data[4 * at:4 * end])})
                at = end
        crc = parts[0]["crc"] if len(parts) == 1 else zlib.crc32(data[4 * start:4 * (start + length)])
        yield start, length, crc, parts


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Tokenizes whole texts and cuts them: one row per piece."""
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast((f.read(), special_tokens(path)))

    def task(batches):
        encoder = _word_encoder(shared, path)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            doc_ids = batch.column("doc_id").to_pylist()
            for a, b in by_chars(texts):
                rows = []
                numbers, counts = encoder.words(texts[a:b])
                end = 0
                for doc_id, count in zip(doc_ids[a:b], counts.tolist()):
                    ids = np.append(encoder.ids_of(numbers[end:end + count]), np.uint32(SEPARATOR))
                    end += count
                    rows += [(doc_id, s, n, crc, len(ids), parts) for s, n, crc, parts in piece_rows(ids, sequence)]
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.list_(pa.struct([("length", pa.int64()), ("crc", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _PIECES)


def assign(lengths: np.ndarray, parts: list, sequence: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """Packs one block.  Returns ``(rest, part, sequence, offset)`` for each
    placed piece; part -1 is the whole rest."""
    n = max(1, round(FILL * int(lengths.sum()) / sequence)) if len(lengths) else 0
    room, load = np.full(n, sequence), np.zeros(n)
    used = [0] * n
    placed = []

    def place(length: int) -> int:
        fits = np.flatnonzero(room >= length)
        if not len(fits):
            return -1
        best = int(fits[load[fits].argmin()])
        room[best] -= length
        load[best] += cost(length)
        return best

    leftover = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        best = place(length)
        if best < 0:
            leftover += [(int(p["length"]), i, k) for k, p in enumerate(parts[i])]
            continue
        placed.append((i, -1, best, used[best]))
        used[best] += length
    for length, i, k in sorted(leftover, key=lambda x: (-x[0], x[1], x[2])):
        best = place(length)
        if best < 0:
            best = len(used)
            used.append(0)
        placed.append((i, k, best, used[best]))
        used[best] += length
    return placed


def _pack_block(key, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row", kind="stable").reset_index(drop=True)
    parts = rows["parts"].tolist()
    placed = assign(rows["length"].to_numpy(), parts)
    out = []
    for r, k, seq, offset in placed:
        if k < 0:
            start, length, crc = rows["start"].iat[r], rows["length"].iat[r], rows["ids_crc32"].iat[r]
        else:
            start = rows["start"].iat[r] + sum(int(p["length"]) for p in parts[r][:k])
            length, crc = parts[r][k]["length"], parts[r][k]["crc"]
        out.append((rows["doc_id"].iat[r], start, length, crc, rows["doc_tokens"].iat[r], (int(key[0]) << 20) + seq, offset))
    out = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return out.astype({"doc_id": "Int64"})


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per placed piece of every document."""
    cut_up = cut(pieces(docs, path).withColumn("row", F.monotonically_increasing_id()))
    full = cut_up.filter(F.col("length") == SEQUENCE).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.lit(1 << 52) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rests = cut_up.filter(F.col("length") < SEQUENCE)
    tokens = rests.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, -(-tokens // (SEQUENCE * BLOCK_SEQUENCES)))
    dealt = rests.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "row"), F.lit(blocks)))
    return full.unionByName(dealt.groupBy("block").applyInPandas(_pack_block, _PLACED))
