import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quire.llm import hard_negatives, line_dedup, token_alignment
from quire.llm.queries import PIECES, TOKENIZER

# -- lines ------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\v\f\r").translate(LOWER)


def frequent(rows, min_docs):
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if key(line):
                where[key(line)].add((i, text or ""))
    return {k for k, found in where.items() if len(found) >= min_docs}


def kept_by_brute_force(rows, min_docs):
    gone = frequent(rows, min_docs)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def line_rows():
    rng = random.Random(3)
    lines = [f"line {k}" for k in range(60)] + ["", " ", "\t", "\x0b\x0c", "ÄÖ É", "Äö é", "\x85x", "HOT line "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)) + ["hot LINE"] * (i % 3 == 0))) for i in range(400)]
    rows += [(7, "one\ntwo\n one"), (7, "one\ntwo\n one"), (7, "another\ntwo"), (None, "hot line\nx"), (None, None), (-1, "")]
    rows += [(1000 + i, "\n" * i) for i in range(3)] + [(2000, "\n".join(f"long {k}" for k in range(50_000)) + "\nhot line")]
    return rows


@pytest.mark.parametrize("min_docs", [1, 2, 10, 40, 1000])
def test_frequent_lines_go(spark, make_docs, min_docs):
    rows = line_rows()
    got = line_dedup.line_digests(make_docs(rows).repartition(5), min_docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == kept_by_brute_force(rows, min_docs)


def test_first_occurrences_stay(spark, make_docs):
    rows = [r for r in line_rows() if r[0] != 2000]
    docs = make_docs(rows)
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs=1, keep_first=True)
    got = line_dedup.apply_bitmaps(docs, bitmaps).collect()
    # documents in the order of the operator: id (null as 0), then the hashes that tell documents apart
    order = {(r.doc_id, bytes(r.text).decode()): (r.doc, r.t1, r.t2) for r in line_dedup._documents(docs).collect()}
    seen, kept = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=order.__getitem__):
        lines = []
        for line in text.split("\n"):
            if not key(line) or key(line) not in seen:
                lines.append(line)
            seen.add(key(line))
        kept[i, text] = "\n".join(lines)
    assert Counter((r.doc_id, r.kept) for r in got) == Counter((i, kept[i, t or ""]) for i, t in rows)
    assert all((r.keep_bitmap is None) == (r.n_dropped == 0) for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(0, 3)), max_size=60), st.integers(1, 4), st.booleans(),
       st.integers(1, 5), st.integers(1, 7))
def test_stream_does_not_depend_on_partitions_and_batches(records, min_docs, keep_first, parts, batch):
    """Records of (line, document, position), cut into ordered partitions and batches."""
    rows = np.array(sorted((h, 0, d, 0, 0, p) for h, d, p in records), np.int64).reshape(-1, 6)
    groups = rows[:, :5]
    # a document's records of a line lie in one partition, as the range partitioning sees to
    heads = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, int)
    cuts = sorted({int(h) for h in heads[::max(1, len(heads) // parts)]} | {0, len(rows)})
    found = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        stream = line_dedup.LineStream(min_docs, keep_first)
        for s in range(a, b, batch):
            found += stream.feed(rows[s:min(b, s + batch)])
        found += stream.close()
    total, head = Counter(), {}
    for kind, got, n in found:
        if kind == line_dedup.TOTAL:
            line = tuple(got[0, :2])
            total[line] += n
            head[line] = min(head.get(line, (9, 9, 9, 9)), tuple(got[0, 2:]))
    dropped = Counter()
    for kind, got, n in found:
        for r in map(tuple, got.tolist()):
            if kind == line_dedup.DROPPED or kind == line_dedup.OPEN and total[r[:2]] >= min_docs and not (keep_first and head[r[:2]] == r[2:]):
                dropped[r] += 1
    want = Counter()
    for h in {r[0] for r in rows.tolist()}:
        own = sorted({tuple(r) for r in rows.tolist() if r[0] == h})
        if len({r[2] for r in own}) >= min_docs:
            want.update(own[1:] if keep_first else own)
    assert dropped == want


def test_line_edges(spark, make_docs, edge_rows):
    got = line_dedup.line_digests(make_docs(edge_rows), 2).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == kept_by_brute_force([r[:2] for r in edge_rows], 2)
    assert line_dedup.line_digests(make_docs([])).count() == 0


@given(st.sets(st.integers(0, 100), min_size=1))
def test_bitmaps(positions):
    keep = line_dedup.unpack_bits(line_dedup.pack_bits(np.array(sorted(positions))), 120)
    assert set(np.flatnonzero(~keep).tolist()) == positions


# -- spans ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def aligner():
    with open(TOKENIZER, encoding="utf-8") as a, open(PIECES, "rb") as b:
        return token_alignment.Aligner(a.read(), b.read())


def align_by_brute_force(aligner, text):
    """Sums, digest and links from the ids of whole texts and the decoded bytes alone."""
    data = (" " + (text or "")).encode()
    if not text:
        return (0, 0, 0, 0), "", Counter()
    a = aligner.a.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.encode(text, out_type=int)
    a_bytes, b_bytes = [aligner.a_bytes[i] for i in a], [aligner.b_bytes[i] for i in b]
    if b"".join(a_bytes) != data or b"".join(b_bytes) != data:
        return (0, 0, 0, 0), "", Counter()
    a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    groups, i, j = [], 0, 0
    for end in sorted(set(a_end) & set(b_end)):
        left, right = [], []
        while i < len(a) and a_end[i] <= end:
            left.append(str(a[i]))
            i += 1
        while j < len(b) and b_end[j] <= end:
            right.append(str(b[j]))
            j += 1
        groups.append(",".join(left) + "|" + ",".join(right))
    links, first = Counter(), 0
    for i in range(len(a)):
        start = a_end[i] - len(a_bytes[i])
        while b_end[first] <= start:
            first += 1
        j = first
        while j < len(b) and b_end[j] - len(b_bytes[j]) < a_end[i]:
            links[a[i], b[j]] += 1
            j += 1
    return (len(a), len(b), len(groups), sum(links.values())), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


HARD = ["a", "b", " ", "  ", "é", "世", "🙂", "\n", "\n\n", "\t", "▁", "the", " the", "<s>", "<|endoftext|>", "'s", "1", "12", "　",
        "\xa0", "ｆ", "\x00", "\x1c", "\x85", "!", "?!", "́", "ß", " .", ",", ".", "(x)", "-", "\r\n", " \n", "x\ny", "\U0010ffff"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(HARD), max_size=14).map("".join) | st.text(max_size=20), min_size=1, max_size=6))
def test_units_give_the_alignment_of_whole_texts(aligner, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    sums, digests, pairs = token_alignment._chunk(aligner, texts)
    for text, s, digest, found in zip(texts, sums.tolist(), digests, pairs.to_pylist()):
        want = align_by_brute_force(aligner, text)
        assert (tuple(s), digest, {(x["a"], x["b"]): x["n"] for x in found}) == (want[0], want[1], dict(want[2]))


def test_cache_starts_anew(aligner, monkeypatch):
    monkeypatch.setattr(token_alignment, "MAX_UNITS", 3)
    for text in ("one two three four", "five one six", "one two"):
        sums, digests, _ = token_alignment._chunk(aligner, [text])
        want = align_by_brute_force(aligner, text)
        assert (tuple(sums[0]), digests[0]) == want[:2]


@pytest.mark.parametrize("hot", [1, 40, 1 << 18])
def test_alignment_of_documents(spark, make_docs, edge_rows, random_rows, aligner, monkeypatch, hot):
    """Counts are the same whether pairs are looked up or joined."""
    monkeypatch.setattr(token_alignment, "HOT", hot)
    rows = [*edge_rows, *random_rows[::3], (50, "a▁b"), (51, "ﬁne <|endoftext|> <s>"), (51, "ﬁne <|endoftext|> <s>")]
    want = [(r[0], *align_by_brute_force(aligner, r[1])) for r in rows]
    docs = Counter(pair for w in want for pair in w[3])
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    expected = Counter((i, *sums, sum(n for p, n in links.items() if docs[p] == most[p[0]]),
                        sum(n * docs[p] for p, n in links.items()), digest) for i, sums, digest, links in want)
    got = token_alignment.align_documents(make_docs(rows).repartition(3), TOKENIZER, PIECES).drop("pairs").collect()
    assert Counter(map(tuple, got)) == expected


def test_alignment_of_nothing(spark, make_docs):
    assert token_alignment.align_documents(make_docs([]), TOKENIZER, PIECES).count() == 0
    only = token_alignment.align_documents(make_docs([(1, None), (2, "")]), TOKENIZER, PIECES).drop("pairs").collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


# -- hard negatives -------------------------------------------------------------------


def negatives_by_brute_force(rows, positives=5, negatives=10, low=30, high=90):
    good = []
    for i, label, x in rows:
        if label is None or x is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        good.append((i, label, [int(np.floor(256 * np.float64(v))) for v in x]))
    after = lambda s, i: (-s, i is None, i or 0)
    out = Counter()
    for i, label, x in good:
        if i is None or i % 100:
            continue
        scored = [(min(max(sum(a * b for a, b in zip(x, y)), -2**63), 2**63 - 1), j, other) for j, other, y in good]
        best = sorted((after(s, j), s, j) for s, j, other in scored if other == label and j != i)[:positives]
        for _, p, j in best:
            found = sorted((after(s, k), s, k) for s, k, other in scored if other != label and low * p <= 100 * s <= high * p)
            out.update((i, j, rank, k, p, s) for rank, (_, s, k) in enumerate(found[:negatives], 1))
    return out


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows],
                                  "vec_id long, label int, embedding array<double>, anchor string, score int, cell double")
    got = hard_negatives.mine_hard_negatives(table, **more).collect()
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def vectors(n, dims, seed, labels=4, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    label = rng.integers(0, labels, n)
    x = centres[label] * 0.6 + rng.normal(size=(n, dims))
    x *= rng.lognormal(0, spread, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, int(c), [float(v) for v in row]) for i, c, row in zip(range(n), label, x)]


def test_negatives_equal_brute_force(spark):
    rows = vectors(900, 16, 1)
    assert mined(spark, rows) == negatives_by_brute_force(rows)


def test_negatives_over_many_cells(spark, monkeypatch):
    for name, value in (("SHARD_ROWS", 90), ("BLOCK_ANCHORS", 3), ("BUCKET", 16), ("OWN_BUCKETS", 20), ("LABEL_GROUPS", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(700, 8, 2, labels=30)
    assert mined(spark, rows) == negatives_by_brute_force(rows)


def test_negatives_edge_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i % 3), [float(v) for v in rng.normal(size=4)]) for i in range(0, 400, 5)]
    rows += [(100, 1, [0.1, 0.2, 0.3, 0.4])] * 2 + [(3, 1, [0.1, 0.2, 0.3, 0.4])] * 30 + [(4, 2, [0.08, 0.2, 0.2, 0.3])] * 30
    rows += [(None, 1, [1.0, 1.0, 1.0, 1.0]), (None, 2, [0.5, 0.5, 0.5, 0.5]), (1, None, [1.0] * 4), (2, 1, None),
             (6, 1, [1.0, None, 1.0, 1.0]), (8, 1, [1.0, float("nan"), 0.0, 0.0]), (9, 1, [float("inf"), 0.0, 0.0, 0.0]),
             (200, 2, []), (11, 2, []), (300, 0, [5e8, -3e9, 2.5e8, 1e7]), (12, 0, [4e8, -2e9, 3e8, 0.0]), (13, 1, [1e8, -1e9, 0.0, 0.0]),
             (500, 7, [1.0] * 4), (600, 0, [0.0] * 4), (14, 0, [0.5, 0.1]), (15, 2, [0.3, 0.1, 0.0, 0.0, 9.0])]
    assert mined(spark, rows) == negatives_by_brute_force(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(100, 1, [1.0])]) == Counter()
    assert mined(spark, [(100, None, None)]) == Counter()


def test_pruning_scores_few_rows_and_loses_none():
    """On clustered vectors most rows lie outside the feasible ranges."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    matrix = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + 0.05 * rng.normal(size=(8000, 12))))
    label = np.zeros(len(matrix), np.int64)
    ids = np.arange(len(matrix))
    cell = hard_negatives.Cell(ids, label, matrix)
    for i in range(0, 8000, 200):
        best = hard_negatives.Best(5, -(1 << 63), (1 << 63) - 1)
        cell.search(i, 0, matrix[i], True, [best])
        score = (matrix @ matrix[i]).astype(np.int64)
        want = sorted((-int(s), int(j)) for s, j in zip(score, ids) if j != i)[:5]
        assert list(zip((-best.score).tolist(), best.vec_id.tolist())) == want
    assert cell.visited < 0.4 * 40 * len(matrix)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-300, 300), min_size=3, max_size=3), st.lists(st.integers(-300, 300), min_size=3, max_size=3))
def test_feasible_ranges_hold_every_row(x, y):
    x, y = np.array(x, float), np.array(y, float)
    a, b = np.linalg.norm(x), np.linalg.norm(y)
    if a and b:
        low, high = hard_negatives.feasible(x / a, float(x @ y / (a * b)) - hard_negatives.MARGIN)
        assert ((low <= y / b) & (y / b <= high)).all()


def test_queries_leave_the_session_as_it_was(spark):
    import __spark_entry__
    before = dict(spark.conf.getAll)
    for name in ("op11_line_bitmaps", "op13_coordinate_pruning", "op5_feistel", "op9_naive_bayes"):
        __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").agg(F.count(F.lit(1))).collect()
    assert dict(spark.conf.getAll) == before
