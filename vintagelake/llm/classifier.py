"""A quality classifier: vectors of hashed words and character n-grams, averaged over a document, under a softmax."""

from __future__ import annotations

import uuid
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.llm.common import bounded_ids, hash_part, held, map_texts

#: Bounds of the fit: labelled documents, chosen by a hash of doc_id, and their characters in all, in that order.
MAX_TRAIN = 2_500
MAX_TRAIN_CHARS = 40_000_000
BUCKETS = 1 << 17
DIM = 8
EPOCHS = 6
RATE = 0.5
#: A feature's share of a document is small, so its vector learns by larger steps than the output layer.
SPEED = 20.0
SIZES = (3, 4)
#: Events beside words; no word has a blank.
AGAIN, SEEN_LINE = "word again", "line again"
#: Words that a worker remembers the sums of, before it starts anew: bounds memory, not results.
MEMO = 400_000


def features(word: str) -> list[int]:
    """Buckets of a word and of the n-grams inside its borders."""
    w = f"<{word}>"
    return [crc32(w.encode()) & (BUCKETS - 1), *(crc32(b"%d" % k + w[i : i + k].encode()) & (BUCKETS - 1) for k in SIZES for i in range(len(w) - k + 1))]


def bag(text: str) -> Counter:
    """Counts of the text's words, and of two events that have a vector too: a word like the one before, a word in a line seen before."""
    words = text.split()
    counts = Counter(words)
    if same := sum(map(str.__eq__, words, words[1:])):
        counts[AGAIN] = same
    lines = Counter(text.split("\n"))
    if again := sum((n - 1) * len(line.split()) for line, n in lines.items() if n > 1):
        counts[SEEN_LINE] = again
    return counts


class Model:
    """Trained by stochastic gradient descent, a document at a time; float64 and a fixed seed make it repeatable."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        self.out = np.zeros((DIM, 2))
        share = (sum(labels) + 1) / (len(labels) + 2)
        self.bias = np.log([1 - share, share])
        of: dict[str, list[int]] = {}
        docs = []
        for t in texts:
            counts: Counter = Counter()
            for w, n in bag(t).items():
                if w not in of:
                    of[w] = features(w)
                for f in of[w]:
                    counts[f] += n
            ids = np.fromiter(counts, np.int64, len(counts))
            weights = np.fromiter(counts.values(), np.float64, len(counts))
            docs.append((ids, weights / max(weights.sum(), 1)))
        for epoch in range(EPOCHS if len(set(labels)) == 2 else 0):
            rate = RATE * (1 - epoch / EPOCHS)
            for i in rng.permutation(len(docs)):
                ids, weights = docs[i]
                vectors, out, bias = gradients(weights, self.vectors[ids], self.out, self.bias, labels[i])
                self.vectors[ids] -= SPEED * rate * vectors  # a document's ids are distinct
                self.out -= rate * out
                self.bias -= 0.1 * rate * bias
        #: One number for each bucket is all that a score needs of a vector: its part in the difference of the two logits.
        self.margin = (self.vectors @ (self.out[:, 1] - self.out[:, 0])).tolist()
        self.shift = float(self.bias[1] - self.bias[0])


def gradients(weights: np.ndarray, vectors: np.ndarray, out: np.ndarray, bias: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's loss, minus the log of its label's softmax, by its features' vectors, the output layer and the bias."""
    hidden = weights @ vectors
    error = softmax(hidden @ out + bias)
    error[label] -= 1
    return np.outer(weights, out @ error), np.outer(hidden, error), error


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """(doc_id, text, quality) of at most `bound` labelled documents outside the held-out part, one row for each doc_id.

    Of rows that repeat a doc_id the text with the smallest hash is taken. In the order of the ids' hashes the documents
    are taken as long as those before them hold less than `chars` characters.
    """
    ids = bounded_ids(labels.where((hash_part("doc_id", 5) != 0) & F.col("quality").isin(0, 1)), bound, "quality")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("quality").alias("quality"))
    before = F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # at most `bound` rows
    return one.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < chars).drop("before")


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN, chars: int = MAX_TRAIN_CHARS) -> Model:
    rows = sorted(training_rows(docs, labels, bound, chars).collect(), key=lambda r: r.doc_id)
    return Model([r.text for r in rows], [r.quality for r in rows])


class Sums:
    """What a worker knows of words: the sum of their features' margins and the number of their features."""

    def __init__(self, margin: np.ndarray):
        self.margin = margin.tolist()
        self.known: dict[str, tuple[float, int]] = {}

    def logit(self, text: str, shift: float) -> float:
        total = size = 0
        known, margin = self.known, self.margin
        for w, n in bag(text).items():
            sums = known.get(w)
            if sums is None:
                ids = features(w)
                sums = known[w] = sum([margin[i] for i in ids]), len(ids)
            total += n * sums[0]
            size += n * sums[1]
        if len(known) > MEMO:
            known.clear()
        return shift + (total / size if size else 0.0)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """Rows with `keep`, score (of label 1) and predicted (1 if score >= threshold, else 0).

    A text without words, or null, gets the score of the fitted bias, about the share of label 1. With labels of one
    class only, or none, every score is that share. Whole texts count; labels and other columns are not read. Equal rows
    stay, an empty table gives an empty one, and columns named like the new ones give way.
    """
    shared, name, shift = docs.sparkSession.sparkContext.broadcast(np.array(model.margin)), f"quality-{uuid.uuid4().hex}", model.shift

    def run(texts: list[str]) -> dict:
        sums = held(name, lambda: Sums(shared.value))
        scores = [float(1 / (1 + np.exp(-sums.logit(t, shift)))) for t in texts]
        return {"score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_texts(docs, keep or ["doc_id"], run, "score double, predicted int", text, holds=name)
