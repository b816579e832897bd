"""Rates meet the targets; the mixture has each row as often as its rate says."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from vintagelake.llm import mixing
from vintagelake.llm.common import hash_part


def corpus(spark, n=300):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        kind = i % 3
        words = {0: ["river", "field", "stone", "music"], 1: ["idiot", "trash", "loser", "river"], 2: ["zz", "##", "|", "9"]}[kind]
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(20, 90))), "x"))
        if i < n // 2:
            labels.append((i, 0 if kind == 2 else 1, int(kind == 1)))
    rows += [(None, None, "x"), (n, "", "x"), (0, rows[0][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, rate string"), spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def totals(out):
    n = F.col("mix_tokens") * F.col("mix_rate")
    row = out.agg(F.sum("mix_tokens").alias("t"), *(F.sum(n * F.col("mix_posteriors")[d]).alias(k) for d, k in enumerate(mixing.DOMAINS))).first()
    return {k: row[k] / row.t for k in mixing.DOMAINS}


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"clean": 0.2, "toxic": 0.1, "low": 0.7}])
def test_targets_are_met(spark, targets):
    docs, labels = corpus(spark)
    out = mixing.mixed(docs, labels, targets)
    assert out.count() == docs.count() and set(docs.columns) < set(out.columns)
    assert out.where("mix_rate < 0 or mix_rate is null").count() == 0
    assert totals(out) == pytest.approx(targets, abs=1e-4) and out.first().mix_miss <= mixing.CLOSE
    sums = out.select(F.aggregate("mix_posteriors", F.lit(0.0), lambda a, x: a + x).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)


def test_posteriors_tell_domains_apart(spark):
    docs, labels = corpus(spark)
    out = mixing.mixed(docs, labels).where("doc_id >= 150 and doc_id < 300").select("doc_id", F.expr("array_position(mix_posteriors, array_max(mix_posteriors)) - 1").alias("d")).collect()
    right = sum(r.d == {0: 0, 1: 1, 2: 2}[r.doc_id % 3] for r in out)
    assert right > 0.95 * len(out)


def test_drawn(spark):
    docs, labels = corpus(spark)
    out = mixing.drawn(docs, labels)
    assert out.columns == docs.columns
    rates = {r.doc_id: r.mix_rate for r in mixing.mixed(docs, labels).collect() if r.doc_id is not None and 0 < r.doc_id < 300}
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert all(abs(counts.get(i, 0) - x) < 1 for i, x in rates.items())


def test_no_labels_and_empty(spark):
    docs, labels = corpus(spark, 12)
    out = mixing.mixed(docs, labels.limit(0)).collect()
    assert len(out) == docs.count() and {tuple(round(p, 6) for p in r.mix_posteriors) for r in out} == {(0.333333,) * 3}
    assert mixing.mixed(docs.limit(0), labels).count() == 0


def test_plan_has_no_python(spark):
    docs, labels = corpus(spark, 12)
    plan = mixing.drawn(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_targets_out_of_reach(spark):
    """Documents that are all alike: the rates end at the nearest totals and stay small."""
    docs = spark.createDataFrame([(i, "river field stone music") for i in range(6)], "doc_id long, text string")
    _, labels = corpus(spark, 12)
    out = mixing.mixed(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r.mix_rate < 10 for r in out) and out[0].mix_miss > 0.01


def test_posteriors_held_out(spark):
    """Of the labelled documents that the classifier has not seen, most of each domain and 19 in 20 of all are given theirs.

    (A document that is both low and toxic counts as toxic.)"""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = hash_part("doc_id", 5) == 0
    model = mixing.learn(docs, labels.where(~held))
    rows = docs.select("doc_id", "text").join(labels.where(held).select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("d")), "doc_id")
    out = model.add_posteriors(rows.withColumn("mix_tokens", mixing.tokens(F.col("text"))), "text")
    got = out.select("d", (F.array_position("mix_posteriors", F.array_max("mix_posteriors")) - 1).alias("p")).groupBy("d").agg(F.avg((F.col("d") == F.col("p")).cast("double")).alias("right"), F.count("*").alias("n")).collect()
    assert len(got) == 3 and all(r.right >= 0.8 for r in got) and sum(r.right * r.n for r in got) >= 0.95 * sum(r.n for r in got), got


def test_posteriors_against_plain_bayes(spark):
    """Posteriors again from plain counts over the labelled documents."""
    docs, labels = corpus(spark)
    model = mixing.learn(docs, labels)
    rows, marks = [r for r in docs.collect() if r.doc_id is not None], {r.doc_id: 1 if r.toxic == 1 else 2 if r.quality == 0 else 0 for r in labels.collect() if r.doc_id is not None and r.quality is not None}
    train = [(marks[r.doc_id], r.text or "") for r in rows if r.doc_id in marks]
    split = lambda t: set(re.split(r"[^a-z]+", t.lower()))
    sizes = [sum(d == k for d, _ in train) for k in range(3)]
    words = {w: [sum(d == k and w in split(t) for d, t in train) for k in range(3)] for w in model.words}

    def bins(t):
        n, share = len(t.split()), lambda k: 0 if not k else 1 if k * 200 <= len(t) else 2 if k * 20 <= len(t) else 3
        mean = len(t) / max(n, 1)
        found = re.split(r"[^a-z]+", t.lower())
        again = len(found) / len(set(found))
        return [share(sum(t.count(c) for c in "#*$%&<>!")), share(t.count("|")), share(sum(t.count(c) for c in "0123456789")), share(sum(c.isupper() for c in t)), 0 if mean < 5 else 1 if mean < 7 else 2 if mean < 12 else 3, 3 if again > 8 else 2 if again > 4 else 1 if again > 2 else 0]

    binned = [(d, bins(t)) for d, t in train]
    got = {r.doc_id: r.mix_posteriors for r in mixing.mixed(docs, labels).collect()}
    for r in rows[::9]:
        t = r.text or ""
        logs = []
        for k in range(3):
            x = math.log((sizes[k] + 1) / (len(train) + 3))
            x += sum(math.log((sum(d == k and b[i] == v for d, b in binned) + 1) / (sizes[k] + 4)) for i, v in enumerate(bins(t)))
            x += sum(math.log((n[k] + 0.5) / (sizes[k] + 1)) if w in split(t) else math.log(1 - (n[k] + 0.5) / (sizes[k] + 1)) for w, n in words.items())
            logs.append(x)
        odds = [math.exp(x - max(logs)) for x in logs]
        assert got[r.doc_id] == pytest.approx([x / sum(odds) for x in odds], abs=1e-9)


def test_columns_named_like_internal_ones_stay(spark):
    docs, labels = corpus(spark, 12)
    out = mixing.mixed(docs.withColumn("mix_log0", F.lit(7)).withColumn("mix_rate", F.lit(9)), labels)
    assert out.columns == ["doc_id", "text", "rate", "mix_log0", *mixing.NEW] and {r.mix_log0 for r in out.collect()} == {7}
