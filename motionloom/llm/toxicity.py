"""Operator 2: toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two words is the normalised string subsequence kernel of order three:
common subsequences of three characters, each weighted by LAMBDA for every character it
leaves out (up to GAPS), so an insult with characters inserted, doubled or left out
keeps most of its value. A word begins with a mark, and what is not a letter is taken
out before, which closes up "i.d.i.o.t".

A text is the bag of its words. Against a landmark it has the sum and the largest of its
words' kernel values, raised to POWER (a power of a kernel is one too). Landmarks are
words and beginnings of words that stand out in toxic training texts; the kernel matrix
of the landmarks whitens both (Nystroem), and a linear SVM with squared hinge loss, made
a probability by a logistic fit, scores the text.

The model is fitted on a sample of the labelled rows, SAMPLE of each label at most; the
rows are weighted by how many labelled rows they stand for, so the odds of the labels are
the table's at every size. Strings are counted and features computed where the rows are:
the driver gets counts of strings and 2 * LANDMARKS numbers for each row of the sample. The
model is some hundred kilobytes; scoring is one pass over the texts, without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LAMBDA, GAPS, POWER = 0.6, 2, 4
#: Kernel values below this count as none; before the power is taken.
CUT = 0.5
#: Landmarks, and the training rows of each label that are used at most.
LANDMARKS, SAMPLE = 64, 4000
#: A landmark stands in so many toxic texts at least, has so many characters at most, and is one of the first so many by rank.
MIN_TEXTS, LONGEST, POOL = 3, 24, 16 * LANDMARKS
THRESHOLD = 0.3

_PATTERNS = [(a + 1, a + b + 2, LAMBDA ** (a + b)) for a in range(GAPS + 1) for b in range(GAPS + 1 - a)]
_CODE = 21  # bits of a character; 0 ends a word, 1 begins one
_SLOTS, _SPREAD = 18, np.int64(0x1E3779B97F4A7C15)
_NO_LETTER = re.compile(r"[^\w\s]+|[\d_]+")
_ASCII_ODD = bytes(b for b in range(33, 127) if not chr(b).isalpha())


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space, without what is no letter."""
    text = (text or "").encode().translate(None, _ASCII_ODD).decode().lower()
    if not text.isascii() and _NO_LETTER.search(text):
        text = _NO_LETTER.sub("", text)
    return text.split()


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each with its mark and an end, and the word at each place."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer(("\x01" + "\x00\x01".join(words) + "\x00").encode("utf-32-le"), "<u4").astype(np.int64)
    return flat, np.repeat(np.arange(len(words)), size)


def _grams(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Subsequences of three characters, as one number each, the words that they are from, and their weight."""
    for second, third, weight in _PATTERNS:
        n = len(codes) - third
        if n > 0:
            places = np.flatnonzero((owner[third:] == owner[:n]) & (codes[third:] > 0))
            yield (codes[places] << 2 * _CODE) | (codes[places + second] << _CODE) | codes[places + third], owner[places], weight


def _summed(rows: np.ndarray, grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (row, gram) put together, their weights added; in order of rows."""
    if not len(rows):
        return rows, grams, weights
    order = np.lexsort((grams, rows))
    rows, grams, weights = rows[order], grams[order], weights[order]
    cut = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])]))
    return rows[cut], grams[cut], np.add.reduceat(weights, cut)


def _subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight) of all words."""
    found = list(_grams(*_codes(words))) if words else []
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return _summed(np.concatenate([r for _, r, _ in found]), np.concatenate([g for g, _, _ in found]), np.concatenate([np.full(len(g), w) for g, _, w in found]))


@dataclass
class Kernel:
    """Kernel values of words against fixed landmarks, by way of the landmarks' subsequences."""

    landmarks: list[str]

    def __post_init__(self) -> None:
        word, gram, weight = _subsequences(self.landmarks)
        self.known, place = np.unique(gram, return_inverse=True)
        self.weights = np.zeros((len(self.known), len(self.landmarks)), np.float32)
        self.weights[place, word] = weight
        self.weights /= np.maximum(1e-9, np.linalg.norm(self.weights, axis=0))
        self.slots = np.zeros(1 << _SLOTS, bool)  # tells most unknown subsequences before they are looked up
        self.slots[self._slot(self.known)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return ((grams * _SPREAD).view(np.uint64) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def __call__(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each landmark; values from 0 to 1, those below CUT as 0."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not words or not len(self.known):
            return out
        norm, hits = np.zeros(len(words)), []
        for grams, rows, weight in _grams(*_codes(words)):
            norm += np.bincount(rows, minlength=len(words)) * weight**2
            maybe = np.flatnonzero(self.slots[self._slot(grams)])
            place = np.minimum(np.searchsorted(self.known, grams[maybe]), len(self.known) - 1)
            on = self.known[place] == grams[maybe]
            hits.append((rows[maybe[on]], place[on], np.full(int(on.sum()), weight)))
        if not hits:
            return out
        rows, place, weight = _summed(*(np.concatenate(x) for x in zip(*hits, strict=True)))
        # By Cauchy and Schwarz no value exceeds the root of the share of known subsequences;
        # `norm` counts equal subsequences apart, so it is never above the word's square norm.
        share = np.bincount(rows, weight**2, len(words))
        near = np.flatnonzero((share > 0) & (share >= CUT**2 * norm))
        at = np.full(len(words), -1, np.int64)
        at[near] = np.arange(len(near))
        keep = at[rows] >= 0
        rows, place, weight = at[rows[keep]], place[keep], weight[keep].astype(np.float32)
        found = np.zeros((len(near), len(self.landmarks)), np.float32)
        for k in range(0, len(rows), 16_000):  # bounds the matrix of hits
            some = rows[k : k + 16_000]
            cut = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
            found[some[cut]] += np.add.reduceat(self.weights[place[k : k + 16_000]] * weight[k : k + 16_000, None], cut, axis=0)
        word, _, own = _subsequences([words[k] for k in near.tolist()])
        found /= np.sqrt(np.maximum(np.bincount(word, own**2, len(near)), 1e-9))[:, None].astype(np.float32)
        found[found < CUT] = 0
        out[near] = found
        return out


@dataclass
class Model:
    kernel: Kernel
    whiten: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def features(self, texts: list[str | None]) -> np.ndarray:
        return _features(self.kernel, self.whiten, texts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (self.features(texts) - self.mean) / self.scale
        f = x @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.offset, -30, 30)))


def _features(kernel: Kernel, whiten: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Whitened sums and largest values of the words' kernel values, a row for each text."""
    m = len(kernel.landmarks)
    out = np.zeros((len(texts), 2 * m))
    step, size = [], 0
    for k, text in enumerate(texts):
        step.append(k)
        size += len(text or "")
        if size > 4_000_000 or k + 1 == len(texts):
            bags = [Counter(words_of(texts[j])) for j in step]
            distinct = list(dict.fromkeys(chain.from_iterable(bags)))
            place = {w: i for i, w in enumerate(distinct)}
            value = np.concatenate([kernel(distinct[a : a + 50_000]) for a in range(0, max(1, len(distinct)), 50_000)]) ** POWER
            near = np.flatnonzero(value.max(axis=1) > 1e-3) if len(distinct) else np.zeros(0, np.int64)
            small = np.full(len(distinct) + 1, -1, np.int64)
            small[near] = np.arange(len(near))
            value = value[near]
            for j, bag in zip(step, bags, strict=True):
                rows = small[np.fromiter((place[w] for w in bag), np.int64, len(bag))]
                counts = np.fromiter(bag.values(), np.float64, len(bag))[rows >= 0]
                v = value[rows[rows >= 0]]
                if len(v):
                    out[j, :m] = np.log1p(4 * (counts @ v)) @ whiten
                    out[j, m:] = v.max(axis=0) @ whiten
            step, size = [], 0
    return out


def _strings(text: str | None) -> set[str]:
    """Words and beginnings of words that can be landmarks."""
    found = set(words_of(text))
    return {w for w in found if len(w) <= LONGEST} | {w[:k] for w in found for k in range(4, min(9, len(w)))}


def choose_landmarks(bad: dict[str, int], good: dict[str, int], rows: tuple[int, int], odds: float, most: int = LANDMARKS) -> list[str]:
    """Strings that stand out in toxic texts, none too near another.

    bad and good count the texts of either label that hold a string, rows are the texts
    counted, not toxic ones first, and odds the share of toxic texts among all labelled ones.
    """
    n0, n1 = max(1, rows[0]), max(1, rows[1])

    def stands_out(w: str) -> float:
        a, b = bad[w] / n1, good.get(w, 0) / n0
        p = odds * a + (1 - odds) * b
        return (a - b) / math.sqrt(max(1e-12, p * (1 - p)) * (1 / n1 + 1 / n0))

    value = {w: stands_out(w) for w, n in bad.items() if n >= MIN_TEXTS}
    chosen: list[str] = []
    for w in sorted(value, key=lambda w: (-value[w], w))[:POOL]:
        if len(chosen) < most and (not chosen or Kernel([w])(chosen).max() < 0.8):
            chosen.append(w)
    return chosen or ["none"]


def _space(landmarks: list[str]) -> tuple[Kernel, np.ndarray]:
    """The kernel against the landmarks, and what whitens it (Nystroem)."""
    kernel = Kernel(landmarks)
    gram = kernel(kernel.landmarks).astype(np.float64)
    gram = ((gram + gram.T) / 2) ** POWER
    value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)))
    return kernel, vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T


def _machine(kernel: Kernel, whiten: np.ndarray, x: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """The SVM and its logistic fit from features, labels and the rows' weights."""
    total = max(weight.sum(), 1e-9)
    mean = (weight @ x) / total
    scale = np.sqrt((weight @ (x - mean) ** 2) / total) + 1e-3
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    y = np.where(toxic == 1, 1.0, -1.0)
    share = float(np.clip(weight @ (y > 0) / total, 1e-3, 1 - 1e-3)) if len(y) else 0.01
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(kernel, whiten, mean, scale, np.zeros(z.shape[1]), 0.0, math.log(share / (1 - share)))
    theta, ridge = np.zeros(z.shape[1]), 1e-2 * total
    for _ in range(30):  # Newton steps of the squared hinge
        on = 1 - y * (z @ theta) > 0
        zw = z[on] * weight[on, None]
        new = np.linalg.solve(zw.T @ z[on] + ridge * np.eye(len(theta)), zw.T @ y[on])
        if np.abs(new - theta).max() < 1e-8:
            break
        theta = new
    f, t = z @ theta, (y > 0).astype(float)
    slope, offset = 1.0, 0.0
    for _ in range(50):  # logistic fit of the margin
        p = 1 / (1 + np.exp(-(slope * f + offset)))
        h = weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(weight * (p - t) * f).sum(), (weight * (p - t)).sum()])
        hess = np.array([[(h * f * f).sum() + 1.0, (h * f).sum()], [(h * f).sum(), h.sum() + 1.0]])
        move = np.linalg.solve(hess, g + np.array([1e-3 * slope, 0]))
        slope, offset = slope - move[0], offset - move[1]
    return Model(kernel, whiten, mean, scale, theta, float(slope), float(offset))


def fit(texts: list[str | None], toxic: np.ndarray, weight: np.ndarray | None = None) -> Model:
    """A model of texts in memory and their labels 0 or 1; without both labels it scores the share of label 1."""
    weight = np.ones(len(texts)) if weight is None else weight
    counts = [Counter(chain.from_iterable(_strings(t) for t, y in zip(texts, toxic.tolist(), strict=True) if y == k)) for k in (0, 1)]
    odds = float(weight[toxic == 1].sum() / max(weight.sum(), 1e-9))
    kernel, whiten = _space(choose_landmarks(counts[1], counts[0], (int((toxic == 0).sum()), int((toxic == 1).sum())), odds))
    return _machine(kernel, whiten, _features(kernel, whiten, texts), toxic, weight)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic, weight) of up to `sample` rows of each label, chosen by a hash of doc_id, written.

    weight is the number of labelled rows of that label for each one taken. Held-out rows
    (crc32 of doc_id as text, modulo 4, is 2) are never taken, nor other labels than 0
    and 1; a document labelled twice is toxic if one label says so, of several texts with
    one doc_id the least is taken.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    parts = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    weight = F.coalesce(*[F.when(F.col("toxic") == y, F.lit(max(1.0, n / sample))) for y, n in counts.items()], F.lit(1.0))
    chosen = F.broadcast(parts[0].union(parts[1]).withColumn("weight", weight))  # at most twice `sample` rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, "doc_id")
    return written(rows.groupBy("doc_id").agg(F.min(F.struct("text", "toxic", "weight")).alias("r")).select("doc_id", "r.*"), "training")


def _string_counts(rows: DataFrame, only: frozenset[str] | None) -> dict[str, int]:
    """How many of the sample's texts hold each string; of those in `only`, or else of those in MIN_TEXTS texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            for text in batch.column(0).to_pylist():
                found.update(_strings(text) if only is None else _strings(text) & only)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["string", "n"])

    counts = rows.select("text").mapInArrow(run, "string string, n long").groupBy("string").agg(F.sum("n").alias("n"))
    found = (counts.filter(F.col("n") >= MIN_TEXTS) if only is None else counts).toArrow()
    return dict(zip(found.column("string").to_pylist(), found.column("n").to_pylist(), strict=True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of documents (doc_id, text) and labels (doc_id, toxic); see training_rows and fit."""
    rows = training_rows(docs, labels, sample)
    taken = {r.toxic: (r.n, r.weight) for r in rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).collect()}  # two rows
    (n0, w0), (n1, w1) = (taken.get(y, (0, 0.0)) for y in (0, 1))
    bad = _string_counts(rows.filter("toxic = 1"), None)
    good = _string_counts(rows.filter("toxic = 0"), frozenset(bad)) if bad else {}
    kernel, whiten = _space(choose_landmarks(bad, good, (n0, n1), w1 / max(w0 + w1, 1e-9)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _features(kernel, whiten, batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "weight", "x"])

    found = rows.select("doc_id", "toxic", "weight", "text").mapInArrow(run, "doc_id long, toxic int, weight double, x array<double>").orderBy("doc_id").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, 2 * len(kernel.landmarks))
    return _machine(kernel, whiten, x, found.column("toxic").to_numpy(), found.column("weight").to_numpy())


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from the threshold on) for every row of docs (doc_id, text).

    Only the text is an input. A null or empty text, or one without letters, has no words
    and gets the score of a text unlike all landmarks. A very long text is read whole, its
    distinct words 50,000 at a time. Repeated rows give repeated rows,
    a null doc_id stays null, an empty table gives an empty result; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.scores(batch.column(1).to_pylist()) if batch.num_rows else np.zeros(0)
            columns = [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
