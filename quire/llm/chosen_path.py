"""Near-duplicate join of word shingle sets by chosen paths.

Documents are sets of five-word shingles.  Each distinct set is sketched by
``T`` min-hashes, positions at which two sets agree with the probability of their
Jaccard similarity: sampled tokens that similar sets share.  A run grows a tree:
a node samples one position (and with probability 1/threshold - 1 a second one),
and its sets are split by their values there, so similar sets stay together on
some path while unlike ones part.  A node of at most ``LEAF`` sets is a bucket and
is searched by brute force; so is what is left after ``DEPTH`` levels, cut into
blocks of which every pair is searched in a task of its own.  The number of runs
follows from the target recall for a pair just at the threshold, by the survival
probability of the path to the last level.

A bucket's pairs are first compared by sketch, far below the threshold; only sets
with a likely partner are read again, and their shingles compared in full.  A
pair that meets in several buckets is searched in the first one only, which both
know from their lists of buckets, so links are counted once and no list of pairs
is ever made: a bucket returns each set's number of links and one parent in the
bucket.  Classes are the connected components.

Copies (equal shingle sets) are one set.  Words are runs of letters and digits,
lower-cased; a text of fewer than five words is one shingle, and one without
words is a shingle itself, so null and empty texts are copies of each other.
Null ids take part like others.  Repeated rows are copies.  An empty table gives
no rows.  Rows are told apart by id and text, other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, mix64, slices
from .components import connected_components
from .fingerprints import word_hashes

SHINGLE = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9999      # for a pair at the threshold
T = 64
DEPTH = 3
LEAF = 512
SLACK = 4.0                 # standard deviations below the threshold at which a sketch rules a pair out


def survival(similarity: float, threshold: float, depth: int) -> float:
    """Probability that a pair shares a path of ``depth`` levels in one run."""
    second, p = 1 / threshold - 1, 1.0
    for _ in range(depth):
        s = similarity * p
        p = (1 - second) * s + second * (1 - (1 - s) ** 2)
    return p


def runs_for(threshold: float = THRESHOLD, target: float = TARGET_RECALL, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - target) / math.log(1 - survival(threshold, threshold, depth)))


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a document's shingles."""
    w = words.view(np.uint64)
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[k:k + n] + np.uint64(k + 1))
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


_FACTORS = np.random.default_rng(20).integers(1, 1 << 32, (T, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Min-hash of each position: the smallest of the tokens' mixed values."""
    out = np.empty(T, np.uint32)
    x = tokens.astype(np.uint64)
    for a in range(0, T, 16):
        h = _FACTORS[a:a + 16] * x
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9FB21C651E98DF25)
        out[a:a + 16] = (h >> np.uint64(32)).min(axis=1)
    return out


def set_key(tokens: np.ndarray) -> int:
    """64-bit identity of a set."""
    x = mix64(tokens.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    total = int(x.sum(dtype=np.uint64)) ^ (int(np.bitwise_xor.reduce(mix64(x))) * 3 + len(x))
    return (total + (1 << 63)) % (1 << 64) - (1 << 63)


def _lists(column) -> list[np.ndarray]:
    """The arrays of a list column, without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return [flat[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)]


def row_key() -> Column:
    return F.xxhash64("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))


def _sketch_task(batches):
    for batch in slices(batches):
        sets = [shingles(w) for w in _lists(batch.column("words"))]
        keys = pa.array([set_key(s) for s in sets], pa.int64())
        sketches = pa.array([sketch(s).view(np.int32) for s in sets], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), keys, sketches],
                                         ["key", "doc_id", "set_key", "sketch"])


def _set_task(batches):
    for batch in slices(batches):
        sets = [shingles(w).tobytes() for w in _lists(batch.column("words"))]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sets, pa.binary())], ["key", "tokens"])


def sketched(docs: DataFrame) -> DataFrame:
    """``(key, doc_id, set_key, sketch)`` of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), word_hashes(text).alias("words"))
    return rows.mapInArrow(_sketch_task, "key long, doc_id long, set_key long, sketch array<int>")


def _children(node: Column, sketch_col: Column, threshold: float) -> Column:
    """The nodes below ``node`` that a set belongs to."""
    child = lambda pos: F.xxhash64(node, pos, F.element_at(sketch_col, pos + 1))
    first = F.pmod(F.xxhash64(node, F.lit("first")), F.lit(T)).cast("int")
    other = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit("second")), F.lit(T - 1)), F.lit(T)).cast("int")
    forks = F.pmod(F.xxhash64(node, F.lit("forks")), F.lit(1 << 20)) < int((1 / threshold - 1) * (1 << 20))
    return F.when(forks, F.array(child(first), child(other))).otherwise(F.array(child(first)))


def grow(groups: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """``(leaf, gid, size)``: the buckets of all runs with two sets or more."""
    runs = runs_for(threshold, target)
    roots = F.explode(F.array(*[F.xxhash64(F.lit("run"), F.lit(r)) for r in range(runs)]))
    level = groups.select("gid", "sketch", roots.alias("node"))
    leaves = None
    for depth in range(1, DEPTH + 1):
        level = cut(level.select("gid", F.explode(_children(F.col("node"), F.col("sketch"), threshold)).alias("node")))
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 1)
        level = cut(level.join(sizes, "node"))
        done = level if depth == DEPTH else level.filter(F.col("size") <= LEAF)
        done = done.select(F.col("node").alias("leaf"), "gid", "size")
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth < DEPTH:
            level = level.filter(F.col("size") > LEAF).select("gid", "node").join(groups.select("gid", "sketch"), "gid")
    return leaves


def _buckets(leaves: DataFrame) -> DataFrame:
    """``(task, side, leaf, gid)``: a bucket is a task of side 0; one above ``LEAF``
    is cut into blocks, and each pair of blocks is a task with two sides."""
    blocks = F.ceil(F.col("size") / LEAF).cast("int")
    block = F.pmod(F.xxhash64("gid", "leaf"), blocks).cast("int")
    rows = leaves.withColumn("blocks", blocks).withColumn("block", block)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(F.xxhash64("leaf", low, high).alias("task"),
                       (F.when(low == high, F.lit(0)).otherwise(F.when(F.col("block") == low, 1).otherwise(2))).alias("side"),
                       "leaf", "gid")


def _groups_of(batches):
    """Rows of equal ``task`` from sorted batches, as tables."""
    held = None
    for batch in batches:
        tasks = batch.column("task").to_numpy(zero_copy_only=False)
        bounds = np.r_[0, np.flatnonzero(tasks[1:] != tasks[:-1]) + 1, len(tasks)] if len(tasks) else [0]
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = batch.slice(a, b - a)
            if held is not None and held[0].column("task")[0].as_py() == tasks[a]:
                held.append(part)
            else:
                if held is not None:
                    yield pa.Table.from_batches(held)
                held = [part]
    if held is not None:
        yield pa.Table.from_batches(held)


def _first_meeting(leaf: int, before: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) share no bucket that comes before this one."""
    return np.fromiter((before[i].isdisjoint(before[j]) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))


def _earlier(table) -> tuple[int, list]:
    leaf = table.column("leaf")[0].as_py()
    return leaf, [frozenset(x for x in known if x < leaf) for known in table.column("leaves").to_pylist()]


def _pairs_apart(side: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.nonzero(np.triu(near, 1))
    ok = (side[a] == 0) | (side[a] != side[b])
    return a[ok], b[ok]


def likely(batches, cutoff: float):
    """Sets of a bucket that have a likely partner to be searched there."""
    for table in _groups_of(batches):
        n = table.num_rows
        if n < 2:
            continue
        values = np.vstack(_lists(table.column("sketch").combine_chunks()))
        near = np.zeros((n, n), bool)
        step = max(1, (1 << 22) // (n * T))
        for s in range(0, n, step):
            near[s:s + step] = (values[s:s + step, None, :] == values[None, :, :]).sum(2) >= cutoff * T
        a, b = _pairs_apart(table.column("side").to_numpy(), near)
        if not len(a):
            continue
        leaf, before = _earlier(table)
        first = _first_meeting(leaf, before, a, b)
        keep = np.unique(np.concatenate([a[first], b[first]]))
        if len(keep):
            yield table.select(["task", "side", "leaf", "gid"]).take(pa.array(keep)).combine_chunks().to_batches()[0]


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through the tokens that several sets have."""
    lengths = [len(s) for s in sets]
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    shared = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [s, s + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - s] = 1
        total += m @ m.T
    return total


def verified(batches, threshold: float):
    """For each set of a bucket: the copies linked to it there, and a parent."""
    for table in _groups_of(batches):
        if table.num_rows < 2:
            continue
        sets = [np.frombuffer(t, np.uint32) for t in table.column("tokens").to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        inter = intersections(sets).astype(np.float64)
        near = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
        a, b = _pairs_apart(table.column("side").to_numpy(), near)
        if not len(a):
            continue
        leaf, before = _earlier(table)
        first = _first_meeting(leaf, before, a, b)
        a, b = a[first], b[first]
        if not len(a):
            continue
        gid, mult = table.column("gid").to_numpy(), table.column("copies").to_numpy()
        n = len(gid)
        links = np.bincount(a, mult[b], n) + np.bincount(b, mult[a], n)
        parent = np.arange(n)

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = root(i), root(j)
            if i != j:
                parent[max(i, j)] = min(i, j)
        up = np.array([root(i) for i in range(n)])
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(gid[at]), pa.array(links[at].astype(np.int64)), pa.array(gid[up[at]])],
                                         ["gid", "links", "parent"])


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """``(key, doc_id, class_id, class_key, n_links, copies)`` per document:
    ``class_id`` is the smallest id of its class, ``n_links`` the number of other
    documents whose similarity reaches the threshold, its ``copies - 1`` included."""
    rows = cut(sketched(docs))
    groups = cut(rows.groupBy("set_key").agg(F.min("key").alias("gid"), F.count(F.lit(1)).alias("copies"),
                                             F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch")))
    leaves = cut(grow(groups, threshold, target))
    known = leaves.groupBy("gid").agg(F.sort_array(F.collect_list("leaf")).alias("leaves"))      # a few per run
    about = cut(known.join(groups.select("gid", "sketch", "copies"), "gid"))
    buckets = cut(_buckets(leaves))
    sketches = buckets.join(about.select("gid", "sketch", "leaves"), "gid")
    sketches = sketches.repartition("task").sortWithinPartitions("task", "gid")
    cutoff = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / T)
    wanted = cut(sketches.mapInArrow(lambda b: likely(b, cutoff), "task long, side int, leaf long, gid long"))

    text = F.coalesce(F.col("text"), F.lit(""))
    again = docs.select(row_key().alias("key"), text.alias("text"))
    again = again.join(wanted.select(F.col("gid").alias("key")).distinct(), "key", "left_semi")
    tokens = again.select("key", word_hashes(F.col("text")).alias("words")).mapInArrow(_set_task, "key long, tokens binary")
    tokens = cut(tokens.groupBy("key").agg(F.max("tokens").alias("tokens")).withColumnRenamed("key", "gid"))
    full = wanted.join(about.select("gid", "leaves", "copies"), "gid").join(tokens, "gid")
    full = full.repartition("task").sortWithinPartitions("task", "gid")
    found = cut(full.mapInArrow(lambda b: verified(b, threshold), "gid long, links long, parent long"))

    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("gid").alias("a"), F.col("parent").alias("b")).distinct())
    labels = labels.select(F.col("v").alias("gid"), "label")
    linked = groups.select("set_key", "gid", "copies", "least_id").join(links, "gid", "left").join(labels, "gid", "left")
    linked = cut(linked.withColumn("class_key", F.coalesce("label", "gid")))
    least = linked.groupBy("class_key").agg(F.min("least_id").alias("class_id"))
    classes = cut(linked.join(least, "class_key").select(
        "set_key", "class_id", "class_key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies"))
    return rows.select("key", "doc_id", "set_key").join(classes, "set_key").select(
        "key", "doc_id", "class_id", "class_key", "n_links", "copies")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when of each class the row with the largest
    id does (of rows alike in id and text one)."""
    names = {c.lower() for c in docs.columns}
    key = next(n for n in ("key", "row_key", "near_row_key") if n not in names)
    classes = near_duplicates(docs)
    best = classes.groupBy("class_key").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "key"))["key"].alias(key))
    kept = docs.withColumn(key, row_key()).join(best.select(key), key, "left_semi")
    return kept.dropDuplicates([key]).drop(key)
