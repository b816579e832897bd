"""Language identification and the quality classifier on held-out rows of the given tables, and their edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vintagelake.llm import classifier, langid
from vintagelake.llm import queries as q

SF = "/root/testdata/sf0.01"


def part(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_language_held_out(spark, documents):
    rows = q.op7_language_id(spark, SF).collect()
    assert len(rows) == len(documents)
    assert all(r.held_out == (part(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, documents[r.doc_id].lang) for r in rows if r.held_out and documents[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_language_edge_cases(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("der hund und die katze", "de"), ("the dog and the cat", "en")] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 !?", 0.5), (4, "THE CAT", 0.5), (4, "THE CAT", 0.5), (None, "die katze", 0.5), (6, "katzenhund", 0.5)], "doc_id long, text string, score double")
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (6, "de")], key=str)
    assert langid.predict(odd.limit(0), model).count() == 0
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}


def test_language_of_texts_without_letters(spark):
    """Fractions, raised digits, Roman and circled numbers are no letters; letters of any script are."""
    docs = spark.createDataFrame([(i, "dog cat" if i % 2 else "\u732b \u72ac", "en" if i % 2 else "zh") for i in range(60)], "doc_id long, text string, lang string")
    odd = spark.createDataFrame([(1, "\u00bd \u00b2 5"), (2, "\u2167 \u2460 \u0663"), (3, "\u732b 5"), (4, "a\u00bd")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.predict(odd, langid.fit(docs)).collect()}
    assert got[1] == got[2] == ("und", False) and got[3] == ("zh", True) and got[4][1]


def test_language_against_plain_scores(spark):
    """Every prediction of the small table again, from plain counters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    counts = defaultdict(Counter)
    for r in rows:
        if part(r.doc_id, 4) != 2 and r.lang and r.text:
            for w in re.findall(r"[^\W\d_]+", r.text.lower()):
                counts[0, w][r.lang] += 1
                w = f"_{w}_"
                for size in range(1, langid.LONGEST + 1):
                    for i in range(len(w) - size + 1):
                        counts[size, w[i : i + size]][r.lang] += 1
    counts = {k: c for k, c in counts.items() if c.total() >= langid.MIN_COUNT}
    langs = sorted({x for c in counts.values() for x in c})
    totals, kinds = Counter(), Counter(size for size, _ in counts)
    for (size, _), c in counts.items():
        for x, n in c.items():
            totals[size, x] += n

    def log(size, g, x):
        return math.log((counts[size, g][x] + 0.5) / (totals[size, x] + 0.5 * (kinds[size] + 1)))

    def word(w, x):
        if (0, w) in counts:
            return log(0, w, x)
        w = f"_{w}_"
        for step, size in enumerate(range(min(langid.LONGEST, len(w)), 0, -1), 1):
            found = [log(size, w[i : i + size], x) for i in range(len(w) - size + 1) if (size, w[i : i + size]) in counts and w[i : i + size] != "_"]
            if found:
                return langid.BACKOFF**step * sum(found) / len(found)
        return 0.0

    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    for r in rows[::7]:
        words = re.findall(r"[^\W\d_]+", (r.text or "").lower())
        scores = {x: sum(word(w, x) for w in words) for x in langs}
        if words:
            top = max(scores.values())
            assert got[r.doc_id].lang_pred == max(langs, key=scores.get)
            assert got[r.doc_id].score == pytest.approx(1 / sum(math.exp(v - top) for v in scores.values()), abs=1e-3)


def test_language_backs_off_to_shorter_grams():
    model = langid.LanguageModel([("a", 0, "abc", 9), ("a", 3, "abc", 9), ("b", 2, "xy", 9), ("b", 0, "xy", 9)])
    assert model.langs == ["a", "b"] and np.argmax(model.word("abc")) == 0
    assert np.argmax(model.word("zabcz")) == 0 and np.argmax(model.word("qxyq")) == 1
    assert not model.word("ööö").any()


def test_quality_held_out(spark, documents):
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        labels[r.doc_id] = max(labels.get(r.doc_id, 0), r.quality)
    rows = q.op8_quality_classifier(spark, SF).collect()
    assert len(rows) == len(documents) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (part(r.doc_id, 5) == 0) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.85, auc


def test_quality_edge_cases(spark):
    rows = [(i, "fine words here " * 5 if i % 2 else "junk ## junk " * 5) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (1, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "fine words", 1), (4, "junk ##", 1), (4, "junk ##", 1), (None, "x" * 100_000, 1)], "doc_id long, text string, predicted int")
    got = [(r.doc_id, r.score) for r in classifier.predict(odd, model).collect()]
    by = dict(got)
    assert len(got) == 6 and by[1] == by[2] and by[3] > by[4]
    one_class = classifier.fit(docs, labels.where("quality = 1"))
    assert len({r.score for r in classifier.predict(odd, one_class).collect()}) == 1
    assert classifier.fit(docs, labels).margin == model.margin  # repeatable
    assert classifier.predict(odd.limit(0), model).count() == 0


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    weights, vectors, out, bias = rng.random(5), rng.normal(size=(5, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    loss = lambda v, o, b: -np.log(classifier.softmax(weights @ v @ o + b)[1])
    for at, grad in enumerate(classifier.gradients(weights, vectors, out, bias, 1)):
        for place in np.ndindex(grad.shape):
            up, down = ([x.copy() for x in (vectors, out, bias)] for _ in range(2))
            up[at][place] += 1e-6
            down[at][place] -= 1e-6
            assert grad[place] == pytest.approx((loss(*up) - loss(*down)) / 2e-6, abs=1e-6)


def test_quality_scores_against_the_whole_network(spark):
    """Scores from sums of margins are those of averaged vectors under the softmax."""
    docs = spark.createDataFrame([(i, f"fine words here {i} " * 5 if i % 2 else f"junk ## junk {i} " * 5) for i in range(60)], "doc_id long, text string")
    model = classifier.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in classifier.predict(docs, model).collect()}
    for r in docs.collect():
        ids = [f for w, n in classifier.bag(r.text).items() for f in classifier.features(w) * n]
        assert got[r.doc_id] == pytest.approx(classifier.softmax(model.vectors[ids].mean(0) @ model.out + model.bias)[1])


def test_training_rows_are_bounded(spark):
    """One row for each id however often it repeats, and no more documents than their characters allow."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "x" * 100) for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    ids = [r.doc_id for r in classifier.training_rows(docs, labels).collect()]
    assert len(ids) == len(set(ids)) == sum(part(i, 5) != 0 for i in range(1, 60))
    assert 10 <= classifier.training_rows(docs, labels, chars=1_000).count() <= 12 and classifier.training_rows(docs, labels, bound=7).count() <= 7


def test_rows_of_the_language_fit_are_bounded(spark):
    """A doc_id on a third of the rows, equal rows in great number, and long texts: no more rows or characters than the bounds say."""
    odd = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2)
    rows = [(odd, f"one id with text {i}", "en") for i in range(1_000)] + [(odd, "alike", "en")] * 1_000 + [(i, f"another text {i}", "en") for i in range(1_000)] + [(i, "x" * 500, "de") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    usable = {r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    got = [(r.lang, r.text) for r in langid.training_rows(docs, 50, 5_000).collect()]
    assert len([x for x in got if x[0] == "en"]) <= 50 and len([x for x in got if x[0] == "de"]) == 10
    assert len([x for x in got if x == ("en", "alike")]) <= 1 and {(lang, t) for _, t, lang in usable} >= set(got)
    assert 20 <= len([x for x in got if x[0] == "en"])
    everything = langid.training_rows(docs, 10_000).collect()  # more than there are rows, so all are drawn
    assert len(everything) == len(usable)
    assert langid.training_rows(docs.limit(0)).count() == 0
