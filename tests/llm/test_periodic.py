"""Periodic runs against a comparison of words at every distance."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vintagelake.llm import periodic
from vintagelake.llm import queries as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, periods=3):
    out, n = {}, len(words)
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, periods * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def expected(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 0
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{k},{p}\n" for s, k, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_overlap_that_masks():
    assert periodic.least_overlap(24, 3) == 16
    assert periodic.least_overlap(10, 3) == min(max(10 - q, 2 * q) for q in range(1, 40))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(b"abc"), min_size=1, max_size=30), st.integers(1, 9), st.integers(0, 29)), max_size=8), st.sampled_from([(24, 3), (6, 3), (10, 4)]))
def test_random_words(blocks, limits):
    words = [bytes([w]) for block, times, more in blocks for w in (block * times + block[:more])]
    assert periodic.find_runs(words, *limits) == brute(words, *limits)


def test_nested_and_long_periods():
    rng = random.Random(5)
    for _ in range(40):
        inner = [str(rng.randrange(4)) for _ in range(rng.randrange(1, 6))] * rng.randrange(4, 40)
        outer = (inner + [str(rng.randrange(50)) for _ in range(rng.randrange(60))]) * rng.randrange(1, 5)
        words = [w.encode() for w in [str(rng.randrange(9)) for _ in range(30)] + outer + [str(rng.randrange(9)) for _ in range(30)]]
        assert periodic.find_runs(words) == brute(words)


def test_long_texts_take_no_square_of_their_length():
    rng = np.random.default_rng(1)
    page = [str(x).encode() for x in rng.integers(0, 40_000, 70_000)]
    began = time.time()
    assert periodic.find_runs([b"a"] * 400_000) == [(0, 400_000, 1)]
    assert periodic.find_runs([b"a", b"b"] * 200_000) == [(0, 400_000, 2)]
    assert periodic.find_runs(page * 4 + page[:9]) == [(0, 280_009, 70_000)]
    assert periodic.find_runs(([b"x", b"y"] * 20 + page[:50]) * 2000) != []
    assert time.time() - began < 30


def test_query_on_all_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in q.op12_periodic_runs(spark, folder).collect()}
    assert len(got) == len(rows) and any(r[0] for r in got.values())
    for r in rows:
        if len(r.text) < 30_000:
            assert got[r.doc_id] == expected(r.doc_id, r.text), r.doc_id


def test_edge_cases(spark):
    again = "to be or not " * 12
    rows = [(1, None), (2, ""), (3, " \n "), (4, again), (4, again), (None, again), (5, "é\u0085\x1c " * 30), (6, "a " * 23), (7, "a " * 24)]
    rows += [(i, " ".join(f"w{k % 41}" for k in range(90))) for i in range(20, 60)]
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, runs string")
    out = periodic.run_digests(periodic.periodic_runs(docs, plant=periodic.plant_number()), ["doc_id"])
    assert out.columns[1:] == ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(((i, *expected(i, t)) for i, t in rows), key=repr)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    plain = {r.doc_id: r for r in periodic.periodic_runs(docs, keep=["doc_id", "runs"]).collect()}
    assert plain[4].collapsed == "to be or not" and [tuple(x) for x in plain[4].runs] == [(0, 48, 4)]
