"""Near-duplicates against all pairs compared in full."""

import random
from collections import Counter

import numpy as np
import pytest

from vintagelake.llm import minhash

SCHEMA = "doc_id long, text string"


def weighted(text):
    words = text.split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(x, y):
    """Probability Jaccard of counted shingles by its definition."""
    both, every = x.keys() & y.keys(), x.keys() | y.keys()
    if len(both) < 0.3 * min(len(x), len(y)) and max(x.values()) == max(y.values()) == 1:
        return 0.0
    if len(set(x.values()) | set(y.values())) == 1:
        return len(both) / len(every)
    return sum(1 / sum(max(x[k] / x[i], y[k] / y[i]) for k in every) for i in both)


def brute(rows):
    """doc_id to the smallest doc_id of its class, by every pair."""
    sets = [(i, t, weighted(t)) for i, t in rows if i is not None and t and t.split()]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a, x) in enumerate(sets):
        for j, b, y in sets[:k]:
            if root(i) != root(j) and (a == b or not x.keys().isdisjoint(y) and jaccard(x, y) >= minhash.SIMILAR):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def corpus(seed, n_base=25, copies=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for _ in range(n_base):
        base = rng.choices(words, k=rng.randint(30, 200))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, " ".join(text)))
            i += 1
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_one_large_group_of_edited_copies(spark):
    """Many texts edited from one: hubs leave some apart, and the blocks must find their links."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def edited(n, edits, seed, length=60):
    """Texts edited from one, with doc_ids."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(length)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(length)] = f"x{rng.random()}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_large_group_sends_each_text_once(spark, monkeypatch):
    """What hubs leave apart goes to tasks once for each bucket, however large the bucket is: not once for each other block."""
    made, keep = {}, minhash.written

    def counted(df, name):
        out = keep(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    rows = edited(300, 5, 2)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert 0 < made["blocks"] <= made["apart"] and made.get("large-blocks", 0) == 0


@pytest.mark.parametrize("weigh", [False, True])
def test_buckets_of_several_chunks(spark, monkeypatch, weigh):
    """Buckets larger than a chunk lose no link between chunks, with equal weights or others; texts that can have none are left out."""
    monkeypatch.setattr(minhash, "CHUNK_TEXTS", 8)
    rows = edited(90, 5, 3)
    if weigh:
        rows = [(i, t + " again" * (9 + i % 2)) for i, t in rows]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_links_of_a_chunk():
    """Links of a task connect what all pairs connect, for few and many common shingles, equal weights and others."""
    rng = random.Random(5)
    for n, weigh in ((2, False), (40, False), (40, True), (700, False)):
        rows = []
        for i, text in edited(n, 5, n):
            items, weights = minhash.shingles(text + " again" * rng.choice([6, 20]) * weigh)
            rows.append({"node": i, "root": rng.choice([i, 0]) if i % 9 == 0 else i, "items": items.tobytes(), "weights": weights.astype(np.float32).tobytes() if weigh else None})
        sets = [minhash.read_set(r["items"], r["weights"]) for r in rows]
        same = [(r["node"], r["root"]) for r in rows]
        want = same + [(i, j) for i in range(n) for j in range(i) if minhash.similarity(sets[i], sets[j]) >= minhash.SIMILAR]
        found = minhash.linked(rows, minhash.SIMILAR)
        assert set(found) <= set(want) | {(j, i) for i, j in want} and connected(n, same + found) == connected(n, want)


def connected(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in edges:
        low, high = sorted((root(i), root(j)))
        parent[high] = low
    return [root(i) for i in range(n)]


def test_edge_cases(spark):
    text = " ".join(f"t{k}" for k in range(60))
    rows = [(5, text), (3, text), (3, text), (None, text), (7, None), (8, ""), (9, "  "), (10, "one"), (11, "one"), (12, "one two"), (None, "lone words"), (None, "lone words"), (None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = [(3, 3, 4), (3, 3, 4), (5, 3, 4), (None, 3, 4), (7, 7, 1), (8, 8, 1), (9, 9, 1), (10, 10, 2), (11, 10, 2), (12, 12, 1), (None, None, 2), (None, None, 2), (None, None, 1)]
    assert got == sorted(want, key=str)


def test_every_row_and_repeated_ids(spark):
    """No row is lost, and rows of one doc_id with different texts are one class."""
    t, u, v = (" ".join(f"{x}{k}" for k in range(40)) for x in "tuv")
    got = sorted(tuple(r)[:2] for r in minhash.near_duplicates(spark.createDataFrame([(1, t), (3, t), (3, u), (7, u), (9, v), (9, None)], SCHEMA)).collect())
    assert got == [(1, 1), (3, 1), (3, 1), (7, 1), (9, 9), (9, 9)]
    # Many repeated rows make no product of rows.
    near = t.replace("t39", "x")
    out = minhash.near_duplicates(spark.createDataFrame([(1, t)] * 20 + [(2, near)] * 30, SCHEMA)).collect()
    assert len(out) == 50 and {tuple(r)[1:] for r in out} == {(1, 50)}
    kept = minhash.first_of_each(spark.createDataFrame([(None, t, 1), (None, t, 2), (4, u, 3), (4, u, 3), (None, None, 4), (None, None, 5), (9, v, 6), (9, "", 7)], SCHEMA + ", n int"))
    assert sorted(r.n for r in kept.collect()) == [1, 3, 4, 5, 6]


def test_repeated_words_weigh(spark):
    """Similarity is that of the weighted shingles: the same words many times over make another text."""
    base = [f"b{k}" for k in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base + base[:10] * 100)), (3, " ".join(base + base[:6]))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) == {1: 1, 2: 2, 3: 1}


def test_recall_of_edited_copies(spark):
    """Of the pairs at 0.8 or more that brute force finds, all are found; of copies with one word in forty changed, nine in ten."""
    rng = random.Random(9)
    rows = []
    for i in range(0, 200, 2):
        base = [f"w{rng.randrange(5000)}" for _ in range(160)]
        copy = list(base)
        for at in rng.sample(range(160), 2):
            copy[at] = "changed"
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and sum(got[i + 1] == i for i in range(0, 200, 2)) >= 90


def test_very_long_text(spark):
    long = " ".join(f"w{k % 70_000}" for k in range(300_000))
    got = minhash.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "w1 w2")], SCHEMA)).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_empty_and_clashing_columns(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e f", 9, "x"), (2, "a b c d e f", 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, node string")
    kept = minhash.first_of_each(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_probability_jaccard():
    """The weighted similarity is that of the definition, and sketches agree about that often."""
    rng = np.random.default_rng(0)
    items = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    items.sort()
    a, b = rng.integers(1, 6, 399).astype(float), rng.integers(1, 6, 399).astype(float)
    both = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in range(399))
    assert minhash.similarity((items, a), (items, b)) == pytest.approx(both)
    many = [minhash.sketches([(items ^ np.uint64(s), a), (items ^ np.uint64(s), b)]) for s in range(1, 30)]
    # Order of a set does not matter to its sketch.
    assert np.mean([(m[0] == m[1]).mean() for m in many]) == pytest.approx(both, abs=0.03)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
