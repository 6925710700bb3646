"""Line deduplication by range-partitioned line hashes.

Every non-blank line of every document becomes one record: the 128-bit hash of
its key (the line stripped of ASCII white space and with A-Z lower-cased), the
document and the line's position.  The records are range-partitioned by (hash,
document) and sorted by (hash, document, position), so a task streams one line
after the other, its documents in order, and holds at most the records of
``min_docs - 1`` documents.  A line that very many documents share spans several
partitions; only the first and the last line of a partition can do that, and
these (at most two a partition) are settled by their totals over all partitions.

What comes back is no text but a bitmap for each document that loses lines: bit
``i`` tells whether line ``i`` stays, lines behind the end of the bitmap stay,
and the bits are packed and compressed.  ``apply_bitmaps`` puts them to use.

Lines found in at least ``min_docs`` documents lose all their occurrences, or
with ``keep_first`` all but the first one, in the order of id, text hash and
position; ``min_docs=1`` with ``keep_first`` is the usual deduplication.

A null text is an empty one, which is one empty line.  Blank lines have no key
and always stay.  A document is a distinct pair of id and text: repeated rows
count once and get the same bitmap, rows that share an id but not the text are
two documents, and a null id is an id like others (the smallest).  Texts of any
length are split whole.  An empty table gives no rows.  Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, slices

MIN_DOCS = 10
RECORD = ["h1", "h2", "doc", "t1", "t2", "pos"]
DOCUMENT = ["doc", "t1", "t2"]
#: documents that a task remembers, to skip repeated rows before the shuffle
REMEMBERED = 1 << 18
EMIT = 1 << 16

DROPPED, OPEN, TOTAL = 0, 1, 2


def _documents(docs: DataFrame) -> DataFrame:
    """``doc_id``, the text's bytes and the document's key: the id (null as 0) and
    128 bits of hash over text and nullness of the id."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.cast("binary").alias("text"), F.coalesce(doc_id, F.lit(0)).alias("doc"),
                       F.xxhash64(text, doc_id.isNull()).alias("t1"), F.xxhash64(F.lit("t2"), text, doc_id.isNull()).alias("t2"))


def line_key(line: bytes) -> bytes:
    """``bytes`` methods strip and lower ASCII only."""
    return line.strip().lower()


def _records(batches):
    """A record for each non-blank line."""
    seen = set()
    digests, rest = [], []

    def emit():
        hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        table = np.concatenate([hashes, np.concatenate(rest)], axis=1)
        digests.clear(), rest.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in table.T], RECORD)

    for batch in slices(batches):
        for text, *key in zip(*(batch.column(c).to_pylist() for c in ["text", *DOCUMENT])):
            key = tuple(key)
            if key in seen:
                continue
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(key)
            keys = [line_key(x) for x in text.split(b"\n")]
            found = [i for i, k in enumerate(keys) if k]
            if found:
                digests += [xxhash.xxh3_128_digest(keys[i]) for i in found]
                rows = np.empty((len(found), 4), np.int64)
                rows[:, :3], rows[:, 3] = key, found
                rest.append(rows)
                if len(digests) >= EMIT:
                    yield emit()
    if digests:
        yield emit()


def _changes(rows: np.ndarray) -> np.ndarray:
    """Flags of the rows that differ from the one before."""
    flags = np.ones(len(rows), bool)
    flags[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    return flags


class LineStream:
    """Streams sorted records.  ``feed`` and ``close`` return ``(kind, rows, n)``:
    dropped records, open ones (of a line that may go on in another partition)
    and, for the partition's first and last line, its first record with ``n``,
    the number of its documents here."""

    def __init__(self, min_docs: int, keep_first: bool):
        self.min_docs, self.keep_first = min_docs, keep_first
        self.held = np.zeros((0, 6), np.int64)   # the line in progress, until it has min_docs documents
        self.line = self.first = self.last_doc = self.previous = None
        self.n, self.frequent, self.at_start = 0, False, True

    def _decide(self, rows, edge):
        """Output for the records of a frequent line, the first of them included."""
        if not self.keep_first:
            return [(DROPPED, rows, 0)]
        return ([(OPEN, rows[:1], 0)] if edge else []) + [(DROPPED, rows[1:], 0)]

    def feed(self, rows: np.ndarray):
        out = []
        # repeated rows of the table give equal records: one of them counts
        fresh = _changes(rows)
        fresh[0] = self.previous is None or bool((rows[0] != self.previous).any())
        self.previous = rows[-1]
        rows = rows[fresh]
        if self.frequent:
            same = (rows[:, :2] == self.line).all(axis=1)
            k = len(rows) if same.all() else int(same.argmin())
            mine, rows = rows[:k], rows[k:]
            if k:
                out.append((DROPPED, mine, 0))
                self.n += int(_changes(np.vstack([self.last_doc, mine[:, 2:5]]))[1:].sum())
                self.last_doc = mine[-1, 2:5]
            if not len(rows):
                return out
            out += self._finish(last=False)
        rows = np.vstack([self.held, rows])
        if not len(rows):
            return out
        starts = np.flatnonzero(_changes(rows[:, :2]))
        docs = np.add.reduceat(_changes(rows[:, :5]).astype(np.int64), starts)
        ends = np.r_[starts[1:], len(rows)]
        # lines that begin and end here and are not the partition's first one
        inner = np.flatnonzero((docs >= self.min_docs) & (np.arange(len(starts)) >= (1 if self.at_start else 0))
                               & (np.arange(len(starts)) < len(starts) - 1))
        if len(inner):
            begin = starts[inner] + self.keep_first
            size = ends[inner] - begin
            at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            out.append((DROPPED, rows[at], 0))
        for g in sorted({0, len(starts) - 1} if self.at_start else {len(starts) - 1}):
            mine = rows[starts[g]:ends[g]]
            last = g == len(starts) - 1
            self.line, self.first, self.n, self.last_doc = mine[0, :2], mine[:1], int(docs[g]), mine[-1, 2:5]
            self.frequent = self.n >= self.min_docs
            self.held = mine[:0] if self.frequent else mine
            if self.frequent:
                # a line in progress may turn out to be the partition's last one
                out += self._decide(mine, edge=True)
            if not last:
                out += self._finish(last=False)
        return out

    def _finish(self, last: bool):
        """Ends the line in progress."""
        out = []
        if self.at_start or last:
            out += ([] if self.frequent else [(OPEN, self.held, 0)]) + [(TOTAL, self.first, self.n)]
        self.held, self.frequent, self.at_start = self.held[:0], False, False
        return out

    def close(self):
        return self._finish(last=True) if self.first is not None and (self.frequent or len(self.held)) else []


def _decisions(min_docs: int, keep_first: bool):
    names = ["kind", *RECORD, "n"]

    def task(batches):
        stream = LineStream(min_docs, keep_first)

        def output(found):
            for kind, rows, n in found:
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), kind)), *(pa.array(c) for c in rows.T), pa.array(np.full(len(rows), n))], names)

        for batch in batches:
            if batch.num_rows:
                yield from output(stream.feed(np.stack([batch.column(c).to_numpy() for c in RECORD], axis=1)))
        yield from output(stream.close())

    return task


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``(doc, t1, t2, pos)`` of every line that goes."""
    columns = ", ".join(f"{c} long" for c in RECORD)
    # kept once, since finding the range bounds reads the records a first time
    records = cut(_documents(docs).select("text", *DOCUMENT).mapInArrow(_records, columns))
    dealt = records.repartitionByRange(*RECORD[:5]).sortWithinPartitions(*RECORD)
    found = cut(dealt.mapInArrow(_decisions(min_docs, keep_first), f"kind long, {columns}, n long"))
    place = F.struct(*RECORD[2:])
    # at most two rows a partition
    totals = found.filter(F.col("kind") == TOTAL).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.min(place).alias("head"))
    still = found.filter(F.col("kind") == OPEN).join(F.broadcast(totals), ["h1", "h2"]).filter(F.col("docs") >= min_docs)
    if keep_first:
        still = still.filter(place != F.col("head"))
    return found.filter(F.col("kind") == DROPPED).select(*RECORD[2:]).unionByName(still.select(*RECORD[2:]))


def pack_bits(positions) -> bytes:
    """Compressed keep bits up to the byte of the last dropped line."""
    keep = np.ones(max(positions) // 8 * 8 + 8, bool)
    keep[positions] = False
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def unpack_bits(bitmap: bytes | None, n_lines: int) -> np.ndarray:
    keep = np.ones(n_lines, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines]
        keep[:len(bits)] = bits.astype(bool)
    return keep


def _bitmaps(batches):
    for batch in batches:
        keys = [batch.column(c) for c in DOCUMENT]
        bits = [pack_bits(np.array(p)) for p in batch.column("positions").to_pylist()]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(bits, pa.binary())], [*DOCUMENT, "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """``(doc, t1, t2, keep_bitmap)`` of the documents that lose lines."""
    by_document = dropped_lines(docs, min_docs, keep_first).groupBy(*DOCUMENT).agg(F.collect_set("pos").alias("positions"))
    return by_document.mapInArrow(_bitmaps, "doc long, t1 long, t2 long, keep_bitmap binary")


def _apply(with_text: bool):
    names = ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept"]

    def task(batches):
        for batch in slices(batches):
            out = []
            for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist()):
                lines = text.split(b"\n")
                if bitmap is None:
                    dropped = 0
                else:
                    keep = unpack_bits(bitmap, len(lines))
                    dropped = len(lines) - int(keep.sum())
                    text = b"\n".join([x for x, k in zip(lines, keep.tolist()) if k])
                out.append((len(lines), dropped, bitmap, text.decode() if with_text else hashlib.sha256(text).hexdigest()))
            cols = list(zip(*out)) or [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return task


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, with_text: bool = True) -> DataFrame:
    """Each row's number of lines, of dropped lines, bitmap (null: all stay) and
    ``kept``: the text of the other lines, or its SHA-256."""
    joined = _documents(docs).join(bitmaps, DOCUMENT, "left").select("doc_id", "text", "keep_bitmap")
    return joined.mapInArrow(_apply(with_text), "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept string")


def line_digests(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The query's columns: digests of what stays."""
    found = apply_bitmaps(docs, keep_bitmaps(docs, min_docs), with_text=False)
    return found.select("doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))
