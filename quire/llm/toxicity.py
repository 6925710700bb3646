"""Toxicity: a support vector machine on a subsequence string kernel.

The kernel of two words is the inner product of their gap-weighted character
subsequences: three characters, in order, within ``SPAN`` positions, weighted by
``DECAY`` to the power of the stretch they cover, and divided by the norm of the
word's weights.  Letters lost or put in between only lower some weights, so gapped
and padded insults stay near their clean form.  Words are read case-folded,
between boundary marks, without marks and punctuation inside; runs of single
letters ("i d i o t") are read as one word as well; a word longer than ``WINDOW``
characters is read in overlapping windows.

Landmark words span the model: Nyström features are the kernels with the
landmarks, whitened by their own kernel matrix; a squared-hinge linear machine
is fitted on them.  Only texts are labelled, so a toxic text is a bag whose
witnesses, the words of its sentences that the machine puts on the toxic side,
are found in turns with the machine, starting from words that several toxic
texts share and few others have.  Because the score is linear in the subsequences, the fitted
machine folds into one weight per subsequence, and scoring a word is a sum of
table entries, the same as the kernel expansion over the landmarks.

A text's score is a logistic function of its ``TOP`` largest distinct word
scores, in (0, 1); a null or empty text has the score of an empty word.  Without labelled rows of both
classes all texts score 0.  Null labels are not learned; rows with equal texts
are learned once.  Fitting uses at most ``MAX_TOXIC`` toxic and ``MAX_OTHER`` other
texts, chosen by hash; scoring reads all texts whole.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quire import worker_state

from .common import id_remainder, slices

MAX_TOXIC, MAX_OTHER = 2_500, 4_000
ALPHABET = 40               # boundary, a-z, other letters folded into 13 classes
SPAN = 6
DECAY = 0.6
WINDOW, STRIDE = 24, 16
TOP = 3                     # a text's largest word scores that its own score is made of
LANDMARKS = 320
TRAIN_WORDS = 9_000        # negatives of a fit
C = 1.0
TURNS = 3
LIFT = np.log(5.0)          # a witness is this much likelier in toxic texts
MARGIN = 1.5                # log-odds below a text's best word, in the first turn
MAX_CACHE = 500_000

#: look-alike characters read as letters (fixed values)
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_STEPS = [(a, b) for a in range(1, SPAN) for b in range(a + 1, SPAN)]


def fold(text: str) -> str:
    return text.casefold()


def words_of(sentence: str) -> list[str]:
    """Words of a folded sentence, with runs of three or more single characters
    as one more word."""
    words = sentence.split()
    run, extra = [], []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) >= 3:
            extra.append("".join(run))
        run = []
    return words + extra if extra else words


def codes(word: str) -> list[int]:
    """Letter classes of a word; what is no letter is left out, except that
    look-alikes between letters count as letters."""
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word)
    if not word.isalpha():
        core = word.strip(".,;:!?\"'()[]{}")
        word = core.translate(LOOK_ALIKES) if any(map(str.isalpha, core)) else ""
    out = []
    for c in word:
        if "a" <= c <= "z":
            out.append(ord(c) - 96)
        elif c.isalpha():
            out.append(27 + ord(c) % 13)
    return out


def subsequences(words: list[str]):
    """The weighted subsequences of all words or their windows, divided by each
    one's norm: ``(cells, weights, window of each, word of each window)``."""
    pieces, owner = [], []
    for i, word in enumerate(words):
        letters = codes(word)
        for a in range(0, max(1, len(letters) - (WINDOW - STRIDE)), STRIDE) if len(letters) > WINDOW else (0,):
            pieces.append([0, *(letters[a:a + WINDOW] if len(letters) > WINDOW else letters), 0])
            owner.append(i)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((c for p in pieces for c in p), np.int64, int(lengths.sum()))
    which = np.repeat(np.arange(len(pieces)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))       # characters to the piece's end
    cells, weights, of = [], [], []
    for a, b in _STEPS:
        at = np.flatnonzero(left > b)
        cells.append((flat[at] * ALPHABET + flat[at + a]) * ALPHABET + flat[at + b])
        weights.append(np.full(len(at), DECAY ** (b + 1)))
        of.append(which[at])
    cells, weights, of = map(np.concatenate, (cells, weights, of))
    norm = np.sqrt(np.bincount(of, weights ** 2, minlength=len(pieces)))
    weights = (weights / np.maximum(norm, 1e-12)[of]).astype(np.float32)
    return cells, weights, of, np.array(owner, np.int64)


def kernel_with(table: np.ndarray, words: list[str], batch: int = 250) -> np.ndarray:
    """Sums of ``table`` (a row per cell) over each word's subsequences; of a word
    read in windows, the window of the largest first column counts."""
    out = np.full((len(words), table.shape[1]), -np.inf)
    for s in range(0, len(words), batch):
        cells, weights, of, owner = subsequences(words[s:s + batch])
        n = len(owner)
        if table.shape[1] == 1:
            sums = np.bincount(of, weights * table[cells, 0], minlength=n)[:, None]
        else:
            order = np.argsort(of, kind="stable")
            cells, weights, of = cells[order], weights[order], of[order]
            sums = np.zeros((n, table.shape[1]))
            if len(of):
                heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                sums[of[heads]] = np.add.reduceat(table[cells] * weights[:, None], heads, axis=0)
        np.maximum.at(out, s + owner, sums)
    return out


@dataclass
class Model:
    weights: np.ndarray                     # one per subsequence cell
    bias: float
    slope: np.ndarray = field(default_factory=lambda: np.zeros(TOP))
    offset: float = -30.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        return kernel_with(self.weights[:, None], words, 20_000)[:, 0] + self.bias

    def probability(self, top: np.ndarray) -> np.ndarray:
        """From the ``TOP`` largest word scores of each text."""
        return 1 / (1 + np.exp(-np.clip(top @ self.slope + self.offset, -30, 30)))


def largest(scores, empty: float) -> list[float]:
    """The ``TOP`` largest scores of a text's words; where there are fewer, and
    below the score of an empty word, that score."""
    return heapq.nlargest(TOP, [max(s, empty) for s in scores] + [empty] * TOP)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = C, steps: int = 30):
    """Newton's method on the primal of a linear machine; ``(w, bias)``."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.ones(x.shape[1] - 1), 1e-6]
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        a = margin > 0
        xa = x[a] * weight[a, None]
        grad = ridge * w - 2 * c * xa.T @ (y[a] * margin[a])
        hess = np.diag(ridge) + 2 * c * xa.T @ x[a]
        step = np.linalg.solve(hess, grad)
        value = lambda v: (ridge * v * v).sum() / 2 + c * (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum()
        now, size = value(w), 1.0
        while value(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def landmark_table(landmarks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(cells x landmarks, whitening)`` of the landmark words."""
    table = np.zeros((ALPHABET ** 3, len(landmarks)), np.float32)
    cells, weights, of, owner = subsequences(landmarks)
    np.add.at(table, (cells, owner[of]), weights)
    gram = (table.T @ table).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    good = values > values.max() * 1e-6
    return table, vectors[:, good] / np.sqrt(values[good])


def gapped(word: str, rng: np.random.Generator) -> list[str]:
    """A word with a foreign letter put in at two places, and with a letter doubled."""
    if len(word) < 4:
        return []
    i, j, k = rng.integers(1, len(word), 3)
    letters = [chr(97 + int(c)) for c in rng.integers(0, 26, 2)]
    return [word[:i] + letters[0] + word[i:], word[:j] + letters[1] + word[j:], word[:k] + word[k - 1] + word[k:]]


def fit_machine(positive: list[str], weight: np.ndarray, negative: list[str], seen: np.ndarray, rng) -> Model:
    """One machine: landmarks from both classes, Nyström features, Newton fit."""
    half = LANDMARKS // 2
    order = np.argsort(-weight, kind="stable")
    marks = [positive[i] for i in order[:half]] + [negative[i] for i in rng.permutation(len(negative))[:half]]
    marks = list(dict.fromkeys(marks))
    table, whitening = landmark_table(marks)
    more = [(v, weight[i]) for i in order[:500] for v in gapped(positive[i], rng)]
    words = positive + [v for v, _ in more] + negative
    y = np.r_[np.ones(len(positive) + len(more)), -np.ones(len(negative))]
    gain = np.r_[weight, [w for _, w in more], np.log2(1 + seen)]
    gain[y > 0] *= gain[y < 0].sum() / gain[y > 0].sum()         # both classes weigh the same
    x = kernel_with(table, words) @ whitening
    scale = np.sqrt((x ** 2).sum(1).mean())
    w, bias = squared_hinge(x / scale, y, gain)
    return Model(table @ (whitening @ (w / scale)), bias)


SENTENCE = re.compile(r"[.!?\n]+\s")


def _bags(texts: list[str], known: dict[str, str]) -> list[list[list[str]]]:
    """Distinct words of each sentence of each text; ``known`` keeps one object
    per distinct word of all texts."""
    one = known.setdefault
    return [[[one(w, w) for w in dict.fromkeys(words_of(s))] for s in SENTENCE.split(fold(t)) if s.strip()] for t in texts]


def _counts(bags) -> dict[str, int]:
    counts: dict[str, int] = {}
    for text in bags:
        for w in {w for sentence in text for w in sentence}:
            counts[w] = counts.get(w, 0) + 1
    return counts


def _negatives(counts: dict[str, int], model: Model | None, rng) -> list[str]:
    """Words of clean texts to learn from: at random, the most usual, and those
    that look most toxic so far."""
    every = sorted(w for w in counts if codes(w))
    chosen = {every[i] for i in rng.permutation(len(every))[:TRAIN_WORDS // 2]}
    chosen |= set(sorted(every, key=lambda w: (-counts[w], w))[:TRAIN_WORDS // 4])
    if model is not None:
        chosen |= {every[i] for i in np.argsort(-model.word_scores(every), kind="stable")[:TRAIN_WORDS // 4]}
    return sorted(chosen)


def fit_texts(toxic: list[str], other: list[str], seed: int = 7) -> Model:
    """Multiple-instance fit on whole labelled texts.  Texts are in two halves;
    each half's witnesses are chosen, and its calibration scores are given, by the
    machine of the other half, so no word speaks for itself."""
    rng = np.random.default_rng(seed)
    known: dict[str, str] = {}
    bags, clean = _bags(toxic, known), _bags(other, known)
    in_toxic, in_other = _counts(bags), _counts(clean)
    # a word as usual in other texts is no witness, whatever its score
    share = lambda counts, w, n: (counts.get(w, 0) + 0.1) / (n + 1)
    lift = {w: np.log(share(in_toxic, w, len(toxic)) / share(in_other, w, len(other))) for w in in_toxic}
    likely = [sorted(w for w in {w for s in text for w in s} if lift[w] >= LIFT and codes(w)) for text in bags]
    # to start with: words that the most toxic texts share and few others have
    odds = {w: lift[w] + np.log(n) for w, n in in_toxic.items()}
    halves = (slice(0, None, 2), slice(1, None, 2))
    background = [_counts(clean[h]) for h in halves]
    models: list[Model | None] = [None, None]

    def witnesses(half: int) -> dict[str, int]:
        judge = models[1 - half]
        found: dict[str, int] = {}
        own = likely[halves[half]]
        words = sorted({w for bag in own for w in bag})
        score = odds if judge is None else dict(zip(words, judge.word_scores(words)))
        for bag in own:
            if judge is None:       # words that another toxic text shares
                bag = [w for w in bag if in_toxic[w] > 1]
                floor = max(map(score.__getitem__, bag), default=0.0) - MARGIN
            else:                   # a bag may have none: labels are not always right
                floor = 0.0
            for w in bag:
                if score[w] >= floor:
                    found[w] = found.get(w, 0) + 1
        return found

    def machine(found: dict[str, int], counts: dict[str, int], before: Model | None) -> Model | None:
        negative = _negatives(counts, before, rng)
        if not found or not negative:
            return None
        positive = sorted(found)
        return fit_machine(positive, np.array([float(found[w]) for w in positive]), negative,
                           np.array([counts[w] for w in negative], float), rng)

    for _ in range(TURNS):
        found = [witnesses(h) for h in (0, 1)]
        models = [machine(found[h], background[h], models[h]) or models[h] for h in (0, 1)]
    found = [witnesses(h) for h in (0, 1)]
    both = {w: found[0].get(w, 0) + found[1].get(w, 0) for w in {**found[0], **found[1]}}
    model = machine(both, in_other, models[0])
    if model is None:
        return Model(np.zeros(ALPHABET ** 3), 0.0)
    x, y = [], []
    for h in (0, 1):
        judge = models[1 - h] or model
        empty = float(judge.word_scores([""])[0])
        for text in bags[halves[h]] + clean[halves[h]]:
            x.append(largest(judge.word_scores(sorted({w for s in text for w in s})).tolist(), empty))
        y += [1] * len(bags[halves[h]]) + [0] * len(clean[halves[h]])
    model.slope, model.offset = calibrate(np.array(x), np.array(y))
    return model


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic slopes and offset of the texts' largest word scores.  Both
    classes weigh the same."""
    n, m = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n + 1) / (n + 2), 1 / (m + 2))
    gain = np.where(y == 1, m / n, 1.0)
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, 0.1), 1e-6]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (gain * (p - target)) + ridge * w
        hess = (x * (gain * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, hold_out: int = 0, folds: int = 5) -> Model:
    """Learns from ``labels.toxic`` of documents outside the held-out fold."""
    known = (labels.filter((id_remainder(F.col("doc_id"), folds) != hold_out) & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = (docs.select("doc_id", "text").filter(F.col("text").isNotNull())
            .withColumn("h", F.xxhash64(F.lit("toxicity"), "text")))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = {}
    for toxic, most in ((1, MAX_TOXIC), (0, MAX_OTHER)):
        if not totals.get(toxic):
            return Model(np.zeros(ALPHABET ** 3), 0.0)
        share = min(1.0, 1.3 * most / totals[toxic])
        draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20))
        ids = known.filter((F.col("toxic") == toxic) & (draw < int((1 << 20) * share))).select("doc_id").orderBy(draw, "doc_id")
        # at most twice the sample's bound of ids, so they go to the texts, not the texts to them
        chosen = rows.join(F.broadcast(ids.limit(2 * most)), "doc_id")
        chosen = chosen.groupBy("h").agg(F.first("text").alias("text")).orderBy("h").limit(most)
        texts[toxic] = chosen.select("text").toPandas()["text"].tolist()       # MAX_TOXIC or MAX_OTHER rows at most
    if not texts[0] or not texts[1]:
        return Model(np.zeros(ALPHABET ** 3), 0.0)
    return fit_texts(texts[1], texts[0])


class _Scorer:
    """Scores of the distinct words that a task has met."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.empty = float(model.word_scores([""])[0])

    def texts(self, texts: list[str | None]) -> np.ndarray:
        if len(self.seen) > MAX_CACHE:
            self.seen = {}
        bags = [set(words_of(fold(t))) if t else set() for t in texts]
        fresh = list(set().union(*bags).difference(self.seen)) if bags else []
        self.seen.update(zip(fresh, self.model.word_scores(fresh).tolist()))
        get = self.seen.__getitem__
        top = np.array([largest(map(get, b), self.empty) for b in bags]).reshape(-1, TOP)
        return self.model.probability(top)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        scorer = _Scorer(shared.value)
        for batch in slices(batches):
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id")
            for a in range(0, len(texts), 256):
                yield pa.RecordBatch.from_arrays([ids[a:a + 256], pa.array(scorer.texts(texts[a:a + 256]), pa.float64())],
                                                 ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, hold_out: int = 0, folds: int = 5) -> DataFrame:
    held = F.coalesce(id_remainder(F.col("doc_id"), folds) == hold_out, F.lit(False))
    return score(docs, fit(docs, labels, hold_out, folds)).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
