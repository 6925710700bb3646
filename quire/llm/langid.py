"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character 1- to 3-grams of the lower-cased text (digits dropped, each white
space a blank) are hashed into ``BUCKETS`` columns.  Training counts them per
language inside the scan tasks; only the summed counts (languages x buckets)
reach the driver, which turns them into a log-probability matrix.  The matrix,
whose size is fixed by the parameters, is broadcast; every task scores its
batches in numpy by gathering matrix rows and summing them per text.

A text that is null or has no letter is ``und`` with score 0, and so is every
text when there is nothing to learn from.  Null languages are not learned.  The
score is the posterior of the predicted language; ties go to the language first
in alphabetical order.  Whole texts count, long ones in chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import codepoints, id_remainder, slices, text_chunks

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_TRAIN_DOCS = 5_000      # bound of the labelled sample of each language the model is fitted on
MAX_LANGUAGES = 200         # the matrix (buckets x languages: 52 MB) is broadcast
UNDETERMINED = "und"


def _clean(text: str) -> str:
    return text.lower()


def _grams(points: np.ndarray, last: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that starts at each position, and which positions
    have one: the n-gram may not run past ``last``, the end of its text."""
    n = len(points)
    h = np.zeros(n, np.uint32)
    for k in range(order):
        h[:n - k] = h[:n - k] * np.uint32(0x01000193) + points[k:] + np.uint32(order)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return h & np.uint32(BUCKETS - 1), np.arange(n) + order <= last


def hashed_grams(chunk: list[tuple[int, str, int]], orders=ORDERS):
    """For each order: (buckets, piece numbers) of all n-grams that start in a
    piece's own part.  Digits are dropped and white space is one character."""
    arrays, owns, piece = [], [], []
    for j, (_, text, own) in enumerate(chunk):
        points = codepoints(text).copy()
        points[(points <= 32) | (points == 160)] = 32
        keep = (points < 48) | (points > 57)
        owns.append(int(keep[:own].sum()))
        arrays.append(points[keep])
        piece.append(j)
    lengths = np.array([len(a) for a in arrays])
    if not lengths.sum():
        return
    points = np.concatenate(arrays)
    starts = np.cumsum(lengths) - lengths
    which = np.repeat(np.arange(len(arrays)), lengths)
    last = np.repeat(starts + lengths, lengths)
    mine = np.arange(len(points)) < np.repeat(starts + np.array(owns), lengths)
    for order in orders:
        bucket, valid = _grams(points, last, order)
        valid &= mine
        yield bucket[valid], which[valid]


def _count_task(batches):
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        texts = batch.column("text").to_pylist()
        langs = batch.column("lang").to_pylist()
        for chunk in text_chunks([_clean(t) for t in texts], overlap=max(ORDERS) - 1):
            of = np.array([hash_lang for hash_lang in (langs[i] for i, _, _ in chunk)], dtype=object)
            for bucket, piece in hashed_grams(chunk):
                for lang in set(of):
                    own = bucket[(of == lang)[piece]]
                    counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    counts[lang] += np.bincount(own, minlength=BUCKETS)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                          pa.array(c[at])], ["lang", "bucket", "n"])


def fit(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS):
    """``(languages, matrix)`` learned from ``(doc_id, text, lang)`` rows.  At most
    about ``max_docs`` rows of each language are used, chosen by the hash of the id, so a
    rare language is learned from all its rows; the matrix is float32, buckets x
    languages, the log of add-one smoothed shares.  Priors are uniform."""
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages, to which the model is bounded")
    large = [r for r in sizes if r["n"] > max_docs]
    if large:
        # places of 2**20 that a language's sample takes; all of them where it has few rows
        most = F.create_map(*[F.lit(x) for r in large for x in (r["lang"], int((1 << 20) * max_docs / r["n"]))])
        share = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 20))
        labelled = labelled.filter(share < F.coalesce(most[F.col("lang")], F.lit(1 << 20)))
    counted = (labelled.select("text", "lang")
               .mapInArrow(_count_task, "lang string, bucket int, n long")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    table = counted.toPandas()           # languages x buckets rows at most
    languages = sorted(table["lang"].unique())
    matrix = np.ones((BUCKETS, max(1, len(languages))), np.float64)
    col = table["lang"].map({lang: k for k, lang in enumerate(languages)}).to_numpy()
    if len(table):
        matrix[table["bucket"].to_numpy(), col.astype(np.int64)] += table["n"].to_numpy()
    return languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32)


def score_texts(texts: list[str | None], languages: list[str], matrix: np.ndarray):
    """Predicted language and posterior of each text."""
    n = len(texts)
    sums = np.zeros((n, matrix.shape[1]))
    for chunk in text_chunks([_clean(t or "") for t in texts], overlap=max(ORDERS) - 1):
        rows = np.array([i for i, _, _ in chunk])
        for bucket, piece in hashed_grams(chunk):
            if len(bucket):
                heads = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
                part = np.add.reduceat(matrix[bucket], heads, axis=0, dtype=np.float64)
                np.add.at(sums, rows[piece[heads]], part)
    lang, score = [], []
    for i, text in enumerate(texts):
        if not languages or text is None or not any(map(str.isalpha, text)):
            lang.append(UNDETERMINED)
            score.append(0.0)
            continue
        s = sums[i] - sums[i].max()
        p = np.exp(s) / np.exp(s).sum()
        k = int(p.argmax())
        lang.append(languages[k])
        score.append(float(p[k]))
    return lang, score


def predict(docs: DataFrame, model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text."""
    languages, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix))

    def task(batches):
        langs, m = shared.value
        for batch in slices(batches):
            pred, score = score_texts(batch.column("text").to_pylist(), langs, m)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()),
                                              pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(task, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, hold_out: int = 2, folds: int = 4) -> DataFrame:
    """Learns from the documents outside the held-out fold and predicts all."""
    rest = F.coalesce(id_remainder(F.col("doc_id"), folds) != hold_out, F.lit(False))
    model = fit(docs.filter(rest).select("doc_id", "text", "lang"))
    held = F.coalesce(id_remainder(F.col("doc_id"), folds) == hold_out, F.lit(False))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is identified, that is not
    ``und``; a posterior that is split between languages is no reason to go.  Learns
    from all labelled rows of ``docs``; without any, texts with a letter stay."""
    languages, matrix = fit(docs.select("doc_id", "text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast((languages, matrix))
    at = docs.columns.index("text")

    def task(batches):
        langs, m = shared.value
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            if langs:
                keep = [p != UNDETERMINED for p in score_texts(texts, langs, m)[0]]
            else:
                keep = [t is not None and any(map(str.isalpha, t)) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)
