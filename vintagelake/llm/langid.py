"""Language identification: log frequencies of known words, and shorter and shorter character n-grams for unseen ones."""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.llm.common import hash_part, held, map_texts, steps, written

#: Runs of word characters but digits; and those in them that are no letters, such as fractions and Roman numbers.
RUNS = re.compile(r"[^\W\d_]+")
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isdecimal() and unicodedata.category(c)[0] != "L")
#: Bounds of the fit for one language: labelled documents, and characters in those before the last one taken.
MAX_TRAIN_PER_LANG = 2_000
MAX_TRAIN_CHARS = 16_000_000
#: What occurs less often in the training documents tells nothing yet.
MIN_COUNT = 3
LONGEST = 5
#: A shorter n-gram tells less: each step back multiplies its log frequencies' weight.
BACKOFF = 0.6
#: Words that a worker remembers the scores of, before it starts anew: bounds memory, not results.
MEMO = 200_000


def word_counts(text: str) -> Counter:
    """The text's words in lower case: runs of letters of any script."""
    counts = Counter(RUNS.findall(text.lower()))
    for run in [w for w in counts if not w.isascii() and not NUMBERS.isdisjoint(w)]:
        n = counts.pop(run)
        for w in "".join(" " if c in NUMBERS else c for c in run).split():
            counts[w] += n
    return counts


def gram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, size, gram, n): words (size 0) and the n-grams inside their borders, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "text"):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, t in zip(part.column("lang").to_pylist(), texts, strict=True):
                words[lang].update(word_counts(t))
            for lang, counted in words.items():
                grams: Counter = Counter()
                for w, n in counted.items():
                    grams[0, w] += n
                    w = f"_{w}_"
                    for size in range(1, LONGEST + 1):
                        for i in range(len(w) - size + 1):
                            grams[size, w[i : i + size]] += n
                keys = list(grams)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(grams.values()), pa.int64())], names=["lang", "size", "gram", "n"])

    return docs.select("lang", F.col(text).alias("text")).mapInArrow(run, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def training_rows(docs: DataFrame, per_lang: int = MAX_TRAIN_PER_LANG, chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """(lang, text) of at most `per_lang` documents of each language outside the held-out part; rows alike count once.

    A hash of doc_id and text draws about that many, whatever the number of rows with one doc_id. In the order of their
    hashes the drawn ones are taken as long as those before them number less than `per_lang` and hold less than `chars` characters.
    """
    key = F.xxhash64("doc_id", "text", F.lit("langid"))
    usable = docs.where((hash_part("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", key.alias("key"))
    shares = written(usable.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share")), "languages")
    drawn = usable.join(F.broadcast(shares), "lang").where(F.pmod("key", F.lit(1_000_003)) < F.col("share") * 1_000_003)
    one = drawn.groupBy("lang", "key").agg(F.max(F.length("text")).alias("n"))
    before = Window.partitionBy("lang").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)  # about `per_lang` rows
    ranked = one.withColumn("rows", F.count("*").over(before)).withColumn("chars", F.coalesce(F.sum("n").over(before), F.lit(0)))
    taken = written(ranked.where((F.col("rows") < per_lang) & (F.col("chars") < chars)).select("lang", "key"), "taken")
    return usable.join(F.broadcast(taken), ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "text")


class LanguageModel:
    """Log frequencies: a row of a matrix for each known word and n-gram, a column for each language."""

    def __init__(self, rows: list[tuple[str, int, str, int]]):
        self.langs = sorted({r[0] for r in rows})
        lang_at = {x: i for i, x in enumerate(self.langs)}
        #: Row of (size, gram); size 0 stands for a word.
        self.at: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        counts = np.zeros((len({(r[1], r[2]) for r in rows}), len(self.langs)), np.float32)
        totals = np.zeros((LONGEST + 1, len(self.langs)))
        n_rows = 0
        for lang, size, gram, n in rows:
            row = self.at[size].setdefault(gram, n_rows)
            n_rows += row == n_rows
            counts[row, lang_at[lang]] += n
            totals[size, lang_at[lang]] += n
        self.logs = np.zeros_like(counts)
        for size, known in enumerate(self.at):
            at = np.fromiter(known.values(), np.int64, len(known))
            self.logs[at] = np.log((counts[at] + 0.5) / (totals[size] + 0.5 * (len(known) + 1)))

    def words(self, new: list[str]) -> np.ndarray:
        """Scores of words in each language: a word's own, or the mean of the longest n-grams of it that are known. All words at once, size by size."""
        out = np.zeros((len(new), len(self.langs)), np.float32)
        own = self.at[0].get
        rows = [own(w, -1) for w in new]
        known = [i for i, r in enumerate(rows) if r >= 0]
        if known:
            out[known] = self.logs[[rows[i] for i in known]]
        open_ = [(i, f"_{w}_") for i, (w, r) in enumerate(zip(new, rows, strict=True)) if r < 0]
        for size in range(LONGEST, 0, -1):
            get = self.at[size].get
            left, found, flat, sizes, steps = [], [], [], [], []
            for i, w in open_:
                n = len(w)
                at = [r for k in range(n - size + 1) if (r := get(w[k : k + size], -1)) >= 0 and (size > 1 or w[k] != "_")]
                if at:
                    found.append(i)
                    flat += at
                    sizes.append(len(at))
                    steps.append(min(LONGEST, n) - size + 1)
                else:
                    left.append((i, w))
            if found:
                n = np.array(sizes)
                sums = np.add.reduceat(self.logs[flat], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0)
                out[found] = sums * (BACKOFF ** np.array(steps) / n)[:, None]
            open_ = left
        return out

    def word(self, w: str) -> np.ndarray:
        return self.words([w])[0]


class Memo:
    """Scores of the words that a worker has met."""

    def __init__(self, langs: int):
        self.rows: dict[str, int] = {}
        self.vectors = np.zeros((0, langs), np.float32)

    def add(self, words: set[str], model: LanguageModel) -> None:
        new = [w for w in words if w not in self.rows]
        if new and len(self.rows) + len(new) > MEMO:  # keep what these texts use
            kept = [w for w in words if w in self.rows]
            self.vectors = self.vectors[[self.rows[w] for w in kept]] if kept else self.vectors[:0]
            self.rows = {w: i for i, w in enumerate(kept)}
        if new:
            start = len(self.rows)
            self.vectors = np.concatenate([self.vectors, model.words(new)])
            self.rows.update(zip(new, range(start, start + len(new)), strict=True))


def fit(docs: DataFrame, per_lang: int = MAX_TRAIN_PER_LANG, chars: int = MAX_TRAIN_CHARS) -> LanguageModel:
    """Counts of all words and n-grams of the training rows that occur MIN_COUNT times or more. Their number is bounded by
    those documents, whatever the size of the corpus."""
    counts = gram_counts(training_rows(docs, per_lang, chars))
    frequent = counts.groupBy("size", "gram").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang")).where(F.col("total") >= MIN_COUNT)
    rows = frequent.select(F.explode("by_lang").alias("x"), "size", "gram").select("x.lang", "size", "gram", "x.n").toArrow()
    columns = [rows.column(c).to_pylist() for c in ("lang", "size", "gram", "n")]
    return LanguageModel(sorted(zip(*columns, strict=True)))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with `keep`, lang_pred and score, the posterior of the predicted language.

    `und` with score 0 for a null text or one without a letter; so too if no language was learned. Equal scores go to
    the language first in order. Whole texts count; the language column is not read. Equal rows stay, an empty table
    gives an empty one, and columns named like the new ones give way.
    """
    shared, name = docs.sparkSession.sparkContext.broadcast(model), f"languages-{uuid.uuid4().hex}"

    def run(texts: list[str]) -> dict:
        m = shared.value
        memo = held(name, lambda: Memo(len(m.langs)))
        langs, scores = [], []
        counted = [word_counts(t) for t in texts]
        memo.add(set().union(*counted), m)
        for c in counted:
            if not c or not m.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            at = np.fromiter(map(memo.rows.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), np.float64, len(c)) @ memo.vectors[at].astype(np.float64)
            best = int(np.argmax(total))
            langs.append(m.langs[best])
            scores.append(1 / math.fsum(np.exp(np.maximum(total - total[best], -700.0))))
        return {"lang_pred": langs, "score": pa.array(scores, pa.float64())}

    return map_texts(docs, keep or ["doc_id"], run, "lang_pred string, score double", text, holds=name)
