"""Mixing documents to target weights, in DataFrame functions only.

A naive Bayes classifier, learned from the labelled table, gives each document its posterior of each domain. Each
document gets a rate: how often it is used. The rates are a least-squares fit of the domains' expected token totals
to their targets, found by projected gradient steps: a step moves every rate along its posteriors and cuts it at 0.
A step needs of the corpus only a few sums, so the driver holds one small vector for each step, and a rate is a fold
over those vectors. Steps are scaled by the moments of the documents whose rates are above 0, which makes few suffice.
"""

from __future__ import annotations

import json
import logging
import math
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.llm.common import bounded_ids, written

#: Domains by the two labels, and the shares of tokens they are to have.
DOMAINS = ("clean", "toxic", "low")
TARGETS = {"clean": 0.93, "toxic": 0.05, "low": 0.02}
#: Bound of the fit: labelled documents, chosen by a hash of doc_id.
MAX_TRAIN = 6_000
#: A word counts if it is surely, by so many standard errors, in so many times as large a share of a domain's documents as of the others.
TYPICAL, SURE = 4.0, 2.5
#: Steps at most, how near the totals must come, as a share of all tokens, and after how many steps rates are written.
MAX_STEPS = 100
CLOSE = 1e-7
WRITE_EVERY = 8
#: Smallest share of a step that is tried, least gain of a step, and what keeps steps small along what no document differs in.
LEAST_SHARE, ENOUGH, RIDGE = 1 / 32, 1e-9, 1e-6
LOG = logging.getLogger(__name__)
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(quality: Column, toxic: Column) -> Column:
    """The index in DOMAINS; null where no label is given."""
    return F.when(toxic == 1, 1).when(quality == 0, 2).when(quality == 1, 0)


def share_bin(n: Column, size: Column) -> Column:
    """0 for none, 1 for up to one in 200, 2 for up to one in 20, 3 for more."""
    return F.when(n == 0, 0).when(n * 200 <= size, 1).when(n * 20 <= size, 2).otherwise(3)


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


#: Number of binned features.
FEATURES = 6


def words_of(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def binned(text: Column, n_tokens: Column, words: Column) -> list[Column]:
    """Features with the values 0 to 3: shares of symbols, bars, digits and capitals, how long words are, and how often they return."""
    size = F.length(text)
    mean = size / F.greatest(n_tokens, F.lit(1))
    counts = [F.regexp_count(text, F.lit(chars)) for chars in ("[#*$%&<>!]", "[|]", "[0-9]", r"\p{Lu}")]
    found, different = F.size(words), F.size(F.array_distinct(words))
    again = F.when(different * 8 < found, 3).when(different * 4 < found, 2).when(different * 2 < found, 1).otherwise(0)
    return [*(share_bin(n, size) for n in counts), F.when(mean < 5, 0).when(mean < 7, 1).when(mean < 12, 2).otherwise(3), again]


def distinct_words(words: Column) -> Column:
    return F.array_distinct(F.array_remove(words, ""))


def telling_words(train: DataFrame) -> list[tuple[str, list[int]]]:
    """(word, documents with it by domain) of all words of the labelled texts that tell a domain, by a test of the share of its documents
    that hold the word against the others'."""
    sizes = {r.domain: r["count"] for r in train.groupBy("domain").count().collect()}
    held = train.select("domain", F.explode(distinct_words(words_of(F.col("text")))).alias("word"))
    sums = held.groupBy("word").agg(*(F.count_if(F.col("domain") == d).alias(f"n{d}") for d in range(len(DOMAINS))))
    tells = F.lit(False)
    for d, size in sizes.items():
        others = sum(n for e, n in sizes.items() if e != d)
        rest = reduce(Column.__add__, (F.col(f"n{e}") for e in range(len(DOMAINS)) if e != d))
        own = F.col(f"n{d}") + 0.5
        ratio = F.log(own / (size + 1)) - F.log((rest + 0.5) / (others + 1))
        tells = tells | (ratio - math.log(TYPICAL) >= SURE * F.sqrt(1 / own + 1 / (rest + 0.5)))
    return sorted((r.word, [r[f"n{d}"] for d in range(len(DOMAINS))]) for r in sums.where(tells).collect())


@dataclass(frozen=True)
class Classifier:
    """Log shares: prior by domain, bins[feature][value][domain], and words[word] for a present and an absent word."""

    prior: list[float]
    bins: list[list[list[float]]]
    words: dict[str, tuple[list[float], list[float]]]

    def gains(self) -> Column:
        """What each word adds to each domain, as one value of the plan: a list of small maps, a word's map being found by its hash."""
        table: list[dict[str, list[float]]] = [{} for _ in range(max(1, len(self.words)))]
        for word, (yes, no) in self.words.items():
            table[crc32(word.encode()) % len(table)][word] = [round(a - b, 9) for a, b in zip(yes, no, strict=True)]
        return F.from_json(F.lit(json.dumps(table)), "array<map<string,array<double>>>")

    def hits(self, words: Column) -> Column:
        """What the words that a text has add, each word once."""
        table, n = self.gains(), max(1, len(self.words))
        found = F.transform(distinct_words(words), lambda w: F.element_at(F.get(table, F.pmod(F.crc32(w.cast("binary")), F.lit(n)).cast("int")), w))
        return F.filter(found, lambda g: g.isNotNull())

    def add_posteriors(self, df: DataFrame, text: str) -> DataFrame:
        """df, which has mix_tokens, with mix_posteriors, in the order of DOMAINS. One step for each column that is used twice, so that it is computed once."""
        logs, odds = [f"mix_log{d}" for d in range(len(DOMAINS))], [f"mix_odds{d}" for d in range(len(DOMAINS))]
        df = df.withColumn("mix_words", words_of(F.col(text)))
        df = df.withColumns({"mix_hits": self.hits(F.col("mix_words"))} | {f"mix_bin{i}": c for i, c in enumerate(binned(F.col(text), F.col("mix_tokens"), F.col("mix_words")))})
        made = {}
        for d, name in enumerate(logs):
            x = F.lit(self.prior[d] + sum(absent[d] for _, absent in self.words.values()))
            for i, table in enumerate(self.bins):
                x = x + reduce(lambda c, v, i=i, d=d, table=table: c.when(F.col(f"mix_bin{i}") == v, table[v][d]), range(1, 4), F.when(F.col(f"mix_bin{i}") == 0, table[0][d]))
            made[name] = added(F.col("mix_hits"), d, x)
        df = df.withColumns(made).withColumn("mix_top", F.greatest(*logs))
        df = df.withColumns({o: F.exp(F.col(x) - F.col("mix_top")) for o, x in zip(odds, logs, strict=True)})
        total = reduce(Column.__add__, map(F.col, odds))
        df = df.withColumn("mix_posteriors", F.array(*(F.col(o) / total for o in odds)))
        return df.drop("mix_words", "mix_hits", "mix_top", *(f"mix_bin{i}" for i in range(len(self.bins))), *logs, *odds)


def added(hits: Column, domain: int, start: Column) -> Column:
    """start and what each hit adds to the domain."""
    return F.aggregate(hits, start, lambda a, g: a + F.get(g, F.lit(domain)))


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAIN) -> Classifier:
    """Counts over at most `bound` labelled documents, one added to each count; without labels all domains are alike."""
    k = len(DOMAINS)
    usable = labels.withColumn("domain", domain_of(F.col("quality"), F.col("toxic"))).where("domain is not null")
    ids = bounded_ids(usable, bound, "domain")
    train = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("domain", "text"), "mixing-train")
    found = telling_words(train)
    cut = train.withColumn("words", words_of(F.col("text")))
    made = cut.select("domain", F.array(*binned(F.col("text"), tokens(F.col("text")), F.col("words"))).alias("bins"))
    rows = {r.domain: r for r in made.groupBy("domain").agg(F.count("*").alias("n"), F.array(*(F.count_if(F.col("bins")[i] == v) for i in range(FEATURES) for v in range(4))).alias("in_bin")).collect()}
    n = np.array([rows[d].n if d in rows else 0 for d in range(k)], float)
    in_bin = np.array([rows[d].in_bin if d in rows else [0] * (4 * FEATURES) for d in range(k)], float).reshape(k, FEATURES, 4)
    with_word = np.array([counts for _, counts in found], float).reshape(len(found), k).T
    prior = np.log((n + 1) / (n.sum() + k))
    bins = np.log((in_bin + 1) / (n[:, None, None] + 4))
    share = (with_word + 0.5) / (n[:, None] + 1)
    return Classifier(prior.tolist(), bins.transpose(1, 2, 0).tolist(), {w: (np.log(share[:, i]).tolist(), np.log1p(-share[:, i]).tolist()) for i, (w, _) in enumerate(found)})


def rate(posteriors: Column, steps: list[list[float]], start: Column | None = None) -> Column:
    """The rate after the steps from `start` (1): each adds its vector's product with the posteriors, and cuts below 0."""
    start = F.lit(1.0) if start is None else start
    if not steps:
        return start
    moves = F.array(*(F.array(*map(F.lit, w)) for w in steps))
    return F.aggregate(moves, start, lambda x, w: F.greatest(F.lit(0.0), x + reduce(Column.__add__, (posteriors[d] * w[d] for d in range(len(DOMAINS))))))


@dataclass(frozen=True)
class Fit:
    """Steps, and by how much the expected totals miss the targets after them, as a share of all tokens."""

    steps: list[list[float]]
    miss: float


def fit(members: DataFrame, targets: dict[str, float]) -> Fit:
    """Steps for a table of (n_tokens, posteriors). Each costs a pass that returns a few sums; one that brings the totals no nearer is halved.

    Where no rates from 0 on meet the targets, as with documents that are all alike, the steps end at the nearest totals;
    `miss` says how near, and a warning tells where that is not CLOSE.
    """
    k = len(DOMAINS)
    p, n = [F.col("posteriors")[d] for d in range(k)], F.col("n_tokens").cast("double")
    steps: list[list[float]] = []
    kept = 0  # steps whose rates are in the table already
    at = members.withColumn("start", F.lit(1.0))
    best, share, move, miss_share = np.inf, 1.0, np.zeros(k), 0.0
    for _ in range(MAX_STEPS):
        x = at.withColumn("x", rate(F.col("posteriors"), steps[kept:], F.col("start")))
        free = F.when(F.col("x") > 0, n).otherwise(0.0)
        row = x.agg(F.sum(n), *(F.sum(n * p[d] * F.col("x")) for d in range(k)), *(F.sum(free * p[d] * p[e]) for d in range(k) for e in range(k))).first()
        total = row[0] or 0.0
        if not total:
            return Fit([], 0.0)
        miss = np.array([targets[d] for d in DOMAINS]) * total - np.array(row[1 : k + 1])
        if miss @ miss >= best:  # the step went too far: half of it
            share /= 2
            if share < LEAST_SHARE:
                steps.pop()
                break
            steps[-1] = (share * move).tolist()
            continue
        best, share, miss_share = miss @ miss * (1 - ENOUGH), 1.0, float(np.abs(miss).max() / total)
        if miss_share <= CLOSE:
            return Fit(steps, miss_share)
        if len(steps) >= kept + WRITE_EVERY:
            at, kept = written(x.select("n_tokens", "posteriors", F.col("x").alias("start")), "rates"), len(steps)
        moments = np.array(row[k + 1 :]).reshape(k, k)
        move = np.linalg.solve(moments + RIDGE * total * np.eye(k), miss)
        steps.append(move.tolist())
    else:
        steps.pop()  # the last one was not looked at
    LOG.warning("expected totals miss the targets by up to %.2g of all tokens", miss_share)
    return Fit(steps, miss_share)


NEW = ("mix_tokens", "mix_posteriors", "mix_rate", "mix_miss")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, bound: int = MAX_TRAIN, keep: list[str] | None = None) -> DataFrame:
    """All rows of docs with the columns `keep` (default all), mix_tokens, mix_posteriors, mix_rate (at least 0) and mix_miss.

    Posteriors are made in one pass and written with `keep` to the shared folder; the steps read only their columns.
    Targets are shares of the corpus's tokens and need not add to 1; mix_miss, one number for all rows, is the share of
    all tokens by which an expected total misses its target at most. A null or empty text has no tokens, so it moves
    no total and its rate is 1. Repeated rows count each. Without labels the posteriors are alike
    for all domains; an empty table gives an empty one. A column of docs that is named like a new one gives way.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    model = learn(docs, labels, bound)
    made = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("mix_text"))
    scored = written(model.add_posteriors(made.withColumn("mix_tokens", tokens(F.col("mix_text"))), "mix_text").drop("mix_text"), "members")
    found = fit(scored.select(F.col("mix_tokens").alias("n_tokens"), F.col("mix_posteriors").alias("posteriors")), targets or TARGETS)
    rated = scored.withColumn("mix_rate", F.when(F.col("mix_tokens") == 0, 1.0).otherwise(F.round(rate(F.col("mix_posteriors"), found.steps), 6))).withColumn("mix_miss", F.lit(found.miss))
    return rated.select(*(F.col(f"row.`{c}`") for c in keep), *NEW)


def drawn(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The mixture itself: each row as often as its rate says, the fraction decided by a hash of doc_id; columns as in docs.

    Nulls, repeated rows and empty tables as in `mixed`: a row with an empty text stays once.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), F.col("text"))
    out = mixed(rows, labels, targets, keep=["row", "doc_id"])
    part = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    times = F.floor(F.col("mix_rate") + part).cast("int")
    return out.where(times >= 1).withColumn("mix_copy", F.explode(F.sequence(F.lit(1), times))).select("row.*")
