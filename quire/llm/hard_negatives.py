"""Hard negatives for contrastive training, by pruned exact inner-product search.

Components are scaled to whole numbers, ``floor(256 * x)``, and a score is an exact
inner product.  An anchor's positives are the rows of its label that score highest;
the negatives of an anchor and a positive are the rows of other labels whose score
lies in a window relative to the positive's score, highest first.

Anchors and rows meet in cells: rows are dealt into shards and anchors into blocks
of bounded size by a hash of their place in the scan, so neither a label nor a group
of copies can fill a task, and every anchor block meets every shard (for positives:
every shard of the labels that hash alike).  Inside a cell, rows lie in buckets of
similar length, longest first, and a bucket holds every coordinate of its unit
vectors in a sorted list.  A row that scores at least ``t`` with an anchor makes
with it at least the cosine ``t / (anchor length * greatest length in the bucket)``;
if that is above 1 the bucket is skipped.  Else the cosine bounds each coordinate of
the row: the anchor's largest coordinates, its focus, give feasible ranges in the
sorted lists, and rows inside all of them are candidates, which are scored exactly.
The threshold ``t`` rises with what was found in the longer buckets.  A cell returns
at most the wanted number of rows for an anchor, and a window over the cells' rows
picks the final ones.

Rows with a null label, a null vector or a component that is null or not finite take
no part.  A vector without components scores 0 with every other; the shorter of two
vectors counts as filled up with zeros.  Scores beyond the range of a long come back as its
end.  A null id is no anchor's; as a row it comes after the other ids at ties.  The
anchor itself, and rows that share its id, are not its positives.  Repeated rows are
rows each; a repeated anchor is an anchor each time.  An anchor without positives, and a positive
without negatives, has no rows; an empty table has none.  Only ``vec_id``,
``label`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, slices

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90              # per cent of the positive's score
FOCUS = 3                       # coordinates that prune
BUCKET = 1024                   # rows of a length bucket
OWN_BUCKETS = 128               # a label with so many rows in a cell has buckets of its own
SHARD_ROWS = 1 << 16            # of a cell, and CELL_VALUES components
CELL_VALUES = 1 << 22
BLOCK_ANCHORS = 1 << 12
LABEL_GROUPS = 1 << 10
_LONG = 1 << 63
MARGIN = 1e-6                   # what rounding may move a cosine by

KINDS = (np.int16, np.int32, np.float64)

_ROW = "vec_id long, label long, dims int, vector binary"
_FOUND = "anchor long, nth int, vec_id long, score long"


# -- vectors ------------------------------------------------------------------------


def pack_vectors(batches):
    """Whole-number components as bytes: int16 or int32 where they fit, else float64."""
    for batch in slices(batches, 1 << 13):
        lists = batch.column("embedding")
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)     # a null component becomes nan
        with np.errstate(over="ignore"):
            whole = np.nan_to_num(np.floor(SCALE * values))
        size = lists.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(size)
        begin = ends - size
        row = np.repeat(np.arange(len(size)), size)
        known = batch.column("label").is_valid().to_numpy(zero_copy_only=False) & lists.is_valid().to_numpy(zero_copy_only=False)
        known &= np.bincount(row, ~np.isfinite(values), len(size)) == 0
        greatest = np.zeros(len(size))
        np.maximum.at(greatest, row, np.abs(whole))
        kinds = {}
        with np.errstate(invalid="ignore"):
            for kind in KINDS:
                kinds[kind] = whole.astype(kind)
        at = np.flatnonzero(known).tolist()
        kind = np.where(greatest < 1 << 15, 0, np.where(greatest < 1 << 31, 1, 2)).tolist()
        packed = [kinds[KINDS[kind[i]]][begin[i]:ends[i]].tobytes() for i in at]
        if at:
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(take), batch.column("label").take(take),
                                              pa.array(size[at].astype(np.int32)), pa.array(packed, pa.binary())],
                                             ["vec_id", "label", "dims", "vector"])


def vectors(table: DataFrame, relabel: Column | None = None) -> DataFrame:
    """``(vec_id, label, dims, vector)`` of the rows that take part."""
    label = F.col("label").cast("long")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"),
                        (label if relabel is None else relabel).alias("label"), "embedding")
    return rows.mapInArrow(pack_vectors, _ROW)


def unpack(dims: np.ndarray, data: list[bytes]) -> np.ndarray:
    """A matrix of the vectors, zeros behind the shorter ones."""
    out = np.zeros((len(data), int(dims.max()) if len(dims) else 0))
    for i, (d, x) in enumerate(zip(dims.tolist(), data)):
        if d:
            out[i, :d] = np.frombuffer(x, {2: np.int16, 4: np.int32, 8: np.float64}[len(x) // d])
    return out


def exact_scores(rows: np.ndarray, anchor: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of whole-number vectors, as long; ``bound`` is no smaller than
    any product of lengths, so sums below 2**53 are exact in floating point."""
    if bound < 1 << 53:
        return (rows @ anchor).astype(np.int64)
    q = [int(v) for v in anchor]
    sums = (sum(int(a) * b for a, b in zip(row, q)) for row in rows)
    return np.array([min(max(s, -_LONG), _LONG - 1) for s in sums], np.int64)


# -- a cell ---------------------------------------------------------------------------


class Bucket:
    """Rows of similar length with their coordinates in sorted lists.  ``label`` is
    None if the rows have several."""

    def __init__(self, at: np.ndarray, matrix: np.ndarray, length: np.ndarray, label):
        self.at, self.label = at, label
        self.rows = matrix[at]
        self.longest = float(length[at].max())
        unit = self.rows / np.where(length[at] > 0, length[at], 1)[:, None]
        order = np.argsort(unit, axis=0, kind="stable")
        self.order = order.astype(np.uint16)        # BUCKET rows at most
        self.lists = np.take_along_axis(unit, order, axis=0).astype(np.float32)

    def candidates(self, focus: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows whose focus coordinates all lie in their feasible ranges."""
        inside = np.zeros(len(self.at), np.uint8)
        for f, lo, hi in zip(focus.tolist(), low, high):
            a, b = np.searchsorted(self.lists[:, f], lo, "left"), np.searchsorted(self.lists[:, f], hi, "right")
            inside[self.order[a:b, f]] += 1
        return np.flatnonzero(inside == len(focus))


def buckets(matrix: np.ndarray, length: np.ndarray, label: np.ndarray) -> list[Bucket]:
    """Longest first.  Labels with few rows share buckets."""
    values, code, counts = np.unique(label, return_inverse=True, return_counts=True)
    owner = np.where(counts >= OWN_BUCKETS, np.arange(len(values)), -1)[code]
    order = np.lexsort((-length, owner))
    out = []
    bounds = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1], True]) if len(order) else np.zeros(0, int)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        own = owner[order[a]]
        for s in range(a, b, BUCKET):
            out.append(Bucket(order[s:min(b, s + BUCKET)], matrix, length, None if own < 0 else values[own]))
    return sorted(out, key=lambda x: -x.longest)


def feasible(focus: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Range of each focus coordinate of a unit vector that makes at least ``cosine``
    with an anchor whose (unit) coordinates there are ``focus``: its angle to the axis
    differs from the anchor's by no more than the angle between the two."""
    own, between = np.arccos(np.clip(focus, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    low = np.where(own + between >= np.pi, -1.0, np.cos(np.minimum(own + between, np.pi)))
    high = np.where(own <= between, 1.0, np.cos(np.maximum(own - between, 0)))
    return low - MARGIN, high + MARGIN


class Best:
    """The ``k`` best rows so far of a window of scores, by score and id."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score = np.zeros(0, np.int64)
        self.vec_id = np.zeros(0, np.int64)

    def needs(self) -> int:
        """The least score that can still matter."""
        if self.low > self.high:
            return _LONG
        return max(self.low, int(self.score[-1])) if len(self.score) == self.k else self.low

    def offer(self, score: np.ndarray, vec_id: np.ndarray):
        ok = (score >= self.needs()) & (score <= self.high)
        if ok.any():
            score, vec_id = np.r_[self.score, score[ok]], np.r_[self.vec_id, vec_id[ok]]
            order = np.lexsort((vec_id, -score))[:self.k]
            # ids tie by value; the null id was given the greatest one
            self.score, self.vec_id = score[order], vec_id[order]


class Cell:
    """The rows of a shard, searched by one anchor after the other.  ``visited``
    counts the rows that were scored."""

    def __init__(self, vec_id: np.ndarray, label: np.ndarray, matrix: np.ndarray):
        self.vec_id, self.label, self.matrix = vec_id, label, matrix
        length = np.sqrt((matrix * matrix).sum(axis=1))
        self.buckets = buckets(matrix, length, label)
        self.visited = 0

    def search(self, vec_id: int, label: int, anchor: np.ndarray, same: bool, windows: list[Best]):
        """Offers the rows of the anchor's label, or of the other ones, to the windows."""
        width = self.matrix.shape[1]
        full = np.zeros(max(width, len(anchor)))
        full[:len(anchor)] = anchor
        length = float(np.sqrt((full * full).sum()))
        q = full[:width]
        unit = q / length if length else q
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        for bucket in self.buckets:
            if bucket.label is not None and (bucket.label == label) != same:
                continue
            need = min(w.needs() for w in windows)
            reach = length * bucket.longest
            if need > reach * (1 + MARGIN):
                break
            if need > 0 and reach > 0:
                found = bucket.candidates(focus, *feasible(unit[focus], need / reach - MARGIN))
            else:
                found = np.arange(len(bucket.at))
            at = bucket.at[found]
            if bucket.label is None:
                keep = (self.label[at] == label) == same
                found, at = found[keep], at[keep]
            if same:
                other = self.vec_id[at] != vec_id
                found, at = found[other], at[other]
            if not len(at):
                continue
            self.visited += len(at)
            score = exact_scores(bucket.rows[found], q, reach)
            for window in windows:
                window.offer(score, self.vec_id[at])


# -- cells on Spark -------------------------------------------------------------------


def _groups(batches) -> Iterator[pa.Table]:
    """Rows of equal ``cell`` from sorted batches."""
    held = []
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        bounds = np.r_[0, np.flatnonzero(cells[1:] != cells[:-1]) + 1, len(cells)] if len(cells) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column("cell")[0].as_py() != cells[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _ids(column) -> np.ndarray:
    return column.fill_null(_LONG - 1).to_numpy()


def _search(positives: int, negatives: int, low: int, high: int, same: bool):
    def windows(scores):
        if same:
            return [Best(positives, -_LONG, _LONG - 1)]
        # 100 * s between low * p and high * p
        return [Best(negatives, -(-low * p // 100), high * p // 100) for p in scores]

    def task(batches):
        for table in _groups(batches):
            table = table.combine_chunks()
            is_row = table.column("anchor").is_null()
            rows, anchors = table.filter(is_row), table.filter(pc.invert(is_row))
            if not rows.num_rows or not anchors.num_rows:
                continue
            cell = Cell(_ids(rows.column("vec_id")), rows.column("label").to_numpy(),
                        unpack(rows.column("dims").to_numpy(), rows.column("vector").to_pylist()))
            out = []
            for anchor, vec_id, label, dims, vector, scores in zip(
                    *(anchors.column(c).to_pylist() for c in ("anchor", "vec_id", "label", "dims", "vector", "scores"))):
                found = windows(scores)
                cell.search(vec_id, label, unpack(np.array([dims]), [vector])[0], same, found)
                for nth, best in enumerate(found):
                    out += [(anchor, nth, v, s) for v, s in zip(best.vec_id.tolist(), best.score.tolist())]
            if out:
                cols = list(zip(*out))
                ids = pa.array([None if v == _LONG - 1 else v for v in cols[2]], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), ids,
                                                  pa.array(cols[3], pa.int64())], ["anchor", "nth", "vec_id", "score"])

    return task


def _in_cells(rows: DataFrame, anchors: DataFrame, shards: Column, blocks: Column, key: Column) -> DataFrame:
    """Both sides dealt into cells: a row goes to one shard and every block of
    anchors, an anchor to one block and every shard."""
    place = F.xxhash64(F.monotonically_increasing_id())
    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = (rows.withColumn("shard", F.pmod(place, shards).cast("int")).withColumn("block", count(blocks))
            .withColumn("anchor", F.lit(None).cast("long")).withColumn("scores", F.lit(None).cast("array<long>")))
    right = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), blocks).cast("int")).withColumn("shard", count(shards))
    columns = [F.xxhash64(key, "shard", "block").alias("cell"), "anchor", "vec_id", "label", "dims", "vector", "scores"]
    both = left.select(*columns).unionByName(right.select(*columns))
    return both.repartition("cell").sortWithinPartitions("cell")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of every anchor and window over all cells, with their rank."""
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(table: DataFrame, is_anchor: Column, relabel: Column | None = None, positives: int = POSITIVES,
         negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``:
    for each anchor and each of its ``positives`` positives the ``negatives`` best
    negatives with a score of ``low`` to ``high`` per cent of the positive's."""
    rows = vectors(table, relabel)
    anchors = cut(rows.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id())
                  .withColumn("scores", F.lit(None).cast("array<long>")))

    # as many rows in a cell as its memory holds, and cells for all cores
    sides = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_anchor, 1)).alias("a"), F.max("dims").alias("dims")).first()
    most = min(SHARD_ROWS, max(1, CELL_VALUES // max(1, sides["dims"] or 0)))
    spread = -(-sides["n"] // (2 * table.sparkSession.sparkContext.defaultParallelism))
    most = min(most, max(BUCKET, spread))

    # positives: within groups of labels, each cut into as many cells as its rows and anchors need
    group = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")
    sizes = (rows.select(group.alias("group"), F.lit(1).alias("n"), F.when(is_anchor, 1).otherwise(0).alias("a"))
             .groupBy("group").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).filter(F.col("a") > 0)
             .select("group", F.ceil(F.col("n") / most).cast("int").alias("shards"),
                     F.ceil(F.col("a") / BLOCK_ANCHORS).cast("int").alias("blocks")))
    sizes = F.broadcast(cut(sizes))       # LABEL_GROUPS rows at most
    here = _in_cells(rows.withColumn("group", group).join(sizes, "group"), anchors.withColumn("group", group).join(sizes, "group"),
                     F.col("shards"), F.col("blocks"), F.col("group"))
    found = here.mapInArrow(_search(positives, negatives, low, high, True), _FOUND)
    chosen = cut(_best(found, positives).select("anchor", (F.col("rank") - 1).alias("nth"), F.col("vec_id").alias("positive_id"),
                                                F.col("score").alias("positive_score")))

    # negatives: every block of anchors against every shard of all rows
    scores = chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))).alias("p"))
    asking = (anchors.drop("scores").join(scores, "anchor")
              .withColumn("scores", F.transform("p", lambda x: x["positive_score"])).drop("p"))
    shards, blocks = (F.lit(max(1, -(-n // each))) for n, each in ((sides["n"], most), (sides["a"], BLOCK_ANCHORS)))
    everywhere = _in_cells(rows, asking, shards, blocks, F.lit(0))
    best = _best(everywhere.mapInArrow(_search(positives, negatives, low, high, False), _FOUND), negatives)
    best = best.select("anchor", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (best.join(chosen, ["anchor", "nth"]).join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def mine_hard_negatives(table: DataFrame) -> DataFrame:
    """The query: anchors are the ids divisible by 100, and the labels of ids
    divisible by 7 are moved on by one, modulo 10."""
    label = F.col("label").cast("long")
    relabel = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(table, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), relabel)
