"""Alignment of two tokenizers over whole texts.

Tokenizer A is a byte-level BPE file of the tokenizers library, B a sentencepiece
model.  A reads a blank and the text, B the text (it puts the blank itself), so
both spell the same bytes.  Token ends come from the libraries' spans: character
offsets for A, the spans of sentencepiece's immutable proto for B.  These are
coarse where a token ends inside a character (A) or is a byte piece (B); such ends
are refined by counting the tokens' decoded bytes on from the last sure cut.  The
spelling is checked against the text.

Where both tokenizers have an end, the text is cut into groups.  Tokens of A and B
whose byte ranges overlap are linked.  At some places both tokenizers cut for sure:
before a single blank, around a line break, before a mark behind a letter (A's
pre-splitting rule cuts there, and B has no piece that goes on across, which is
looked up in its pieces).  A text is a sequence of units cut there; a task aligns
each distinct unit once, all new ones of a chunk in one call, and keeps them in a
bounded cache.

Corpus counts: the number of documents that hold an id pair linked.  A pair that
occurs in more than 1 of ``HOT`` of all pairs of documents is looked up in a
broadcast table, which cannot have more than ``HOT`` rows for that reason; the
others are joined by a shuffle in which no key can be hot.

A document is a row.  A null or empty text, and one whose joined tokens of A or B do
not spell the blank and the text, has no tokens: its counts are 0 and its digest is
''.  Special tokens inside texts are plain text.  A unit is
aligned whole, whatever its length.  Repeated rows are counted each; an empty table gives no rows.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from quire import worker_state
from quire.session import scratch_path

from .bpe_automaton import byte_characters
from .common import cut, slices
from .pretoken import by_chars, distinct_words, pieces_at

HOT = 1 << 18
MAX_UNITS = 400_000         # of a task's cache; beyond it the cache starts anew
MAX_CACHED_CHARS = 1 << 23
BLANK = "▁"

#: characters whose cuts are sure where they follow one of ``LETTERS``
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZàáâäçèéêëíîïñóôöùúûüß"
_OTHER, _SPACE, _NEWLINE, _WHITE, _LETTER, _MARK = range(6)


def unit_table(pieces: list[str]) -> np.ndarray:
    """Kind of each code point.  A mark or a line break counts as one only if no
    piece of the model joins it to a letter or to anything."""
    joined = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
    ends = {c for pair in joined for c in pair}
    table = np.zeros(0x110000, np.uint8)
    table[[c for c in range(0x110000) if chr(c).isspace()]] = _WHITE
    table[ord(" ")] = _SPACE
    table[ord("\n")] = _WHITE if "\n" in ends else _NEWLINE
    table[[ord(c) for c in LETTERS]] = _LETTER
    table[[ord(c) for c in MARKS if not any(x + c in joined for x in LETTERS)]] = _MARK
    return table


def unit_starts(points: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Flags of the characters before which both tokenizers cut for sure; ``first``
    flags text starts.  These are: a blank, and the character behind a line break, if
    they stand between two characters that are no white space; a line break behind no
    white space; a mark behind a letter."""
    kind = table[points]
    solid = (kind == _OTHER) | (kind >= _LETTER)
    n = len(points)
    behind, ahead = np.zeros(n, bool), np.zeros(n, bool)        # solid neighbours in the same text
    behind[1:] = solid[:-1] & ~first[1:]
    ahead[:-1] = solid[1:] & ~first[1:]
    line = (kind == _NEWLINE) & behind
    start = first | line | ((kind == _SPACE) & behind & ahead)
    start[1:] |= line[:-1] & solid[1:] & ~first[1:]
    start[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _LETTER) & ~first[1:]
    return start


def byte_level_tokens(file: str) -> dict[int, bytes]:
    """The bytes of each id, from the text of a tokenizer file."""
    data = json.loads(file)
    alphabet = byte_characters()
    tokens = {i: bytes(alphabet[c] for c in token) for token, i in data["model"]["vocab"].items()
              if all(c in alphabet for c in token)}
    return tokens | {t["id"]: t["content"].encode() for t in data.get("added_tokens") or []}


class Aligner:
    """Aligns units and keeps what it found.  Takes the files' contents."""

    def __init__(self, a_file: str, b_file: bytes):
        self.a = Tokenizer.from_str(a_file)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        tokens = byte_level_tokens(a_file)
        self.a_size, self.b_size = max(tokens) + 1, self.b.get_piece_size()
        self.a_bytes = np.array([tokens.get(i, b"") for i in range(self.a_size)], object)
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("the model has pieces that go on over a blank")
        self.table = unit_table([p for i, p in enumerate(pieces) if not self.b.is_byte(i)])
        self.b_is_byte = np.array([self.b.is_byte(i) for i in range(self.b_size)])
        self.b_bytes = np.array([bytes([int(p[1:-1], 16)]) if byte else p.replace(BLANK, " ").encode()
                                 for p, byte in zip(pieces, self.b_is_byte)], object)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id with the mark that follows it: inside its side, at the end of A's side, of the group
        self.marked = np.array([[f"{i}{mark}" for i in range(max(self.a_size, self.b_size))] for mark in ",|;"], object)
        self.clear()

    def clear(self):
        self.numbers: dict[str, int] = {}
        self.chars = 0
        self.written: list[str] = []
        self.sums = np.zeros((0, 4), np.int64)      # n_a, n_b, n_groups, n_links of a unit
        self.spelled = np.zeros(0, bool)
        self.links = np.zeros(0, np.int64)          # a * b_size + b, by unit
        self.offsets = np.zeros(1, np.int64)

    # -- spans ------------------------------------------------------------------

    def spans_a(self, text: str, size: np.ndarray):
        """Ids and byte ends; ``size`` holds the bytes of each character."""
        found = self.a.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        coarse = np.r_[0, np.cumsum(size)][spans[:, 1]]
        inside = np.r_[spans[1:, 0] < spans[:-1, 1], False] if len(ids) else np.zeros(0, bool)
        return ids, refine(coarse, inside, self.a_len[ids])

    def spans_b(self, text: str):
        found = self.b.encode(text, return_type="proto").pieces
        ids = np.fromiter((p.id for p in found), np.int64, len(found))
        coarse = np.fromiter((p.end for p in found), np.int64, len(found)) + 1      # of the blank B puts
        return ids, refine(coarse, self.b_is_byte[ids], self.b_len[ids])

    # -- units ------------------------------------------------------------------

    def _align(self, fresh: list[str]):
        """Appends units to the cache, in order.  They are aligned in one text, each
        behind something it is cut from for sure."""
        parts, own = [], []
        for unit in fresh:
            before = [] if unit[0] == " " else [" a"] if unit[0] == "\n" else [" a", "\n"]
            parts += [*before, unit]
            own += [*[False] * len(before), True]
        text = "".join(parts)
        data = text.encode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        a, a_end = self.spans_a(text, size)
        b, b_end = self.spans_b(text[1:])
        if b"".join(self.a_bytes[a].tolist()) != data or b"".join(self.b_bytes[b].tolist()) != data \
                or (a_end != np.cumsum(self.a_len[a])).any() or (b_end != np.cumsum(self.b_len[b])).any():
            if len(fresh) == 1:
                self._append([""], np.zeros((1, 4), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), False)
            else:
                half = len(fresh) // 2
                self._align(fresh[:half])
                self._align(fresh[half:])
            return
        ends = np.cumsum([len(s) if s.isascii() else len(s.encode()) for s in parts])
        common = a_end[b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] == a_end]
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        a_start, b_start = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
        # B tokens from the first that ends behind A's start to the last that begins before A's end
        lo, hi = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        n = hi - lo
        partner = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        links = np.repeat(a, n) * self.b_size + b[partner]
        a_to, b_to = np.searchsorted(a_end, ends, "right"), np.searchsorted(b_end, ends, "right")
        link_to = np.r_[0, np.cumsum(n)][a_to]
        sums = np.diff(np.stack([a_to, b_to, np.searchsorted(common, ends, "right"), link_to], axis=1), axis=0, prepend=0)
        written = self._write(a, a_group, b, b_group, a_to + b_to)
        own = np.array(own)
        self._append([w for w, mine in zip(written, own.tolist()) if mine], sums[own], links[np.repeat(own, sums[:, 3])],
                     sums[own, 3], True)

    def _write(self, a, a_group, b, b_group, to) -> list[str]:
        """Groups of each unit as text; ``to`` counts the tokens up to its end."""
        ids, side = np.r_[a, b], np.repeat([0, 1], [len(a), len(b)])
        last = np.r_[np.r_[a_group[1:] != a_group[:-1], True], np.r_[b_group[1:] != b_group[:-1], True]]
        mark = np.where(last, side + 1, 0)
        order = np.argsort(np.r_[a_group, b_group] * 2 + side, kind="stable")
        parts = self.marked[mark[order], ids[order]].tolist()
        text = "".join(parts)
        at = np.r_[0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))][np.r_[0, to]].tolist()
        return [text[i:j - 1] for i, j in zip(at[:-1], at[1:])]

    def _append(self, written, sums, links, n_links, spelled):
        self.written += written
        self.sums = np.concatenate([self.sums, sums])
        self.spelled = np.r_[self.spelled, np.full(len(written), spelled)]
        self.links = np.r_[self.links, links]
        self.offsets = np.r_[self.offsets, self.offsets[-1] + np.cumsum(n_links)]

    def _loose(self, unit: str) -> bool:
        """White space at an edge, or B's own mark for a blank, would spoil neighbours."""
        return unit != "\n" and (unit[-1].isspace() or unit[:2].isspace() and unit[0] == " ") or BLANK in unit

    def number(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts in order, and each text's count of units."""
        if len(self.numbers) > MAX_UNITS or self.chars > MAX_CACHED_CHARS:
            self.clear()
        heads = [" " + t if t else "" for t in texts]
        joined = "".join(heads)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, heads), np.int64, len(heads))
        begin = np.cumsum(lengths) - lengths
        first = np.zeros(len(points), bool)
        first[begin[lengths > 0]] = True
        starts = np.flatnonzero(unit_starts(points, first, self.table))
        counts = np.diff(np.searchsorted(starts, np.r_[begin, len(points)]))
        codes, distinct = distinct_words(pieces_at(joined, points, starts), joined)
        known = self.numbers
        fresh = [u for u in distinct if u not in known]
        if fresh:
            loose = [u for u in fresh if self._loose(u)]
            apart = set(loose)
            plain = [u for u in fresh if u not in apart]
            for u in (*plain, *loose):
                known[u] = len(known)
            self.chars += sum(map(len, fresh))
            if plain:
                self._align(plain)
            for u in loose:
                self._align([u])
        numbers = np.fromiter(map(known.__getitem__, distinct), np.int64, len(distinct))
        return numbers[codes], counts


def refine(coarse: np.ndarray, unsure: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens: the coarse ones where they are sure, else as many decoded
    bytes behind the last sure end."""
    total = np.cumsum(lengths)
    at = np.where(unsure, -1, np.arange(len(coarse)))
    sure = np.maximum.accumulate(at) if len(at) else at
    base = np.where(sure >= 0, coarse[sure] - total[sure], 0) if len(at) else coarse
    return np.where(unsure, base + total, coarse)


_ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<struct<a:int,b:int,n:int>>")


def _chunk(aligner: Aligner, texts: list[str]):
    """Sums, digests and linked pairs of some texts."""
    numbers, counts = aligner.number(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    ok = (np.bincount(doc, ~aligner.spelled[numbers], len(texts)) == 0) & (counts > 0)
    sums = np.stack([np.bincount(doc, aligner.sums[numbers, k], len(texts)) for k in range(4)], axis=1).astype(np.int64)
    sums[~ok] = 0
    digests, end, flat = [], 0, numbers.tolist()
    for count, spelled in zip(counts.tolist(), ok.tolist()):
        groups = ";".join(map(aligner.written.__getitem__, flat[end:end + count])) if spelled else ""
        digests.append(hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        end += count
    # distinct units of a document first, then the distinct pairs of these
    live = ok[doc]
    of, times = np.unique(doc[live] * max(1, len(aligner.written)) + numbers[live], return_counts=True)
    seg, doc = of % max(1, len(aligner.written)), of // max(1, len(aligner.written))
    begin, size = aligner.offsets[seg], aligner.offsets[seg + 1] - aligner.offsets[seg]
    pair = aligner.links[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    width = aligner.a_size * aligner.b_size
    key = np.repeat(doc, size) * width + pair
    order = np.argsort(key, kind="stable")
    key, weight = key[order], np.repeat(times, size)[order]
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    n = np.add.reduceat(weight, heads) if len(heads) else np.zeros(0, np.int64)
    pair = key[heads] % width
    bounds = np.searchsorted(key[heads] // width, np.arange(len(texts) + 1)).astype(np.int32)
    cells = pa.StructArray.from_arrays([pa.array((pair // aligner.b_size).astype(np.int32)),
                                        pa.array((pair % aligner.b_size).astype(np.int32)), pa.array(n.astype(np.int32))],
                                       ["a", "b", "n"])
    return sums, digests, pa.ListArray.from_arrays(pa.array(bounds), cells)


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: its sums, the digest of its groups and its linked id
    pairs with their numbers of links.  The driver sends the files' contents."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def task(batches):
        cache = worker_state()
        if ("aligner", a_path, b_path) not in cache:
            cache["aligner", a_path, b_path] = Aligner(*shared.value)
        aligner = cache["aligner", a_path, b_path]
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in by_chars(texts):
                sums, digests, pairs = _chunk(aligner, texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[i:j], *(pa.array(c) for c in sums.T), pa.array(digests, pa.string()), pairs],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, _ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """``(a, b, docs, best)``: in how many documents a pair is linked, and whether
    no pair of the same A id has more."""
    counts = cut(rows.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("docs")))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))      # as many rows as A has ids, at most
    return counts.join(F.broadcast(most), "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _looked_up(shared):
    """Document rows with the sums over their hot pairs, and a row for each other pair."""
    def task(batches):
        keys, docs, best, width = shared.value
        for batch in slices(batches):
            pairs = batch.column("pairs").combine_chunks() if isinstance(batch.column("pairs"), pa.ChunkedArray) else batch.column("pairs")
            size = pairs.value_lengths().to_numpy(zero_copy_only=False)
            a, b, n = (pairs.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
            row = np.repeat(np.arange(batch.num_rows), size)
            key = a * width + b
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            value = n[hit] * docs[at[hit]]
            sums = np.zeros(batch.num_rows, np.int64)
            bests = np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[hit], value)
            np.add.at(bests, row[hit], n[hit] * best[at[hit]])
            ids = batch.column("row").to_numpy()
            cold = ~hit
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[ids, ids[row[cold]]]), pa.array(np.r_[-1 - ids, key[cold]]),
                 pa.array(np.r_[bests, n[cold]]), pa.array(np.r_[sums, np.zeros(int(cold.sum()), np.int64)])],
                ["row", "pair", "n", "sum"])

    return task


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256`` and ``pairs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "aligned")
    aligned(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    counts = pair_counts(rows)
    total = counts.agg(F.sum("docs")).first()[0] or 0
    hot = counts.filter(F.col("docs") * HOT > total).toPandas()      # fewer than HOT rows, since the counts add up to total
    width = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    keys = hot["a"].to_numpy(np.int64) * width + hot["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], hot["docs"].to_numpy(np.int64)[order],
                                           hot["best"].to_numpy(bool)[order].astype(np.int64), width))
    # a document's row has a pair of its own, below 0, that joins nothing
    parts = rows.select("row", "pairs").mapInArrow(_looked_up(shared), "row long, pair long, n long, sum long")
    cold = counts.filter(F.col("docs") * HOT <= total).select(
        (F.col("a").cast("long") * width + F.col("b")).alias("pair"), "docs", "best")
    joined = parts.join(cold, "pair", "left")
    own = F.col("pair") < 0
    scores = joined.groupBy("row").agg(
        F.sum(F.when(own, F.col("n")).when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.when(own, F.col("sum")).otherwise(F.col("n") * F.col("docs"))).alias("count_sum"))
    return rows.join(scores, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "pairs")
