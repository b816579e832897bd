"""Shards against the heap alone, group by group, and against SQL."""

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import difference
from vintagelake.llm import queries as q
from vintagelake.llm import sharding


def plain(weights, shards):
    heap, out = [(0, k) for k in range(shards)], []
    for w in weights:
        load, k = heapq.heappop(heap)
        out.append(k)
        heapq.heappush(heap, (load + w, k))
    return out


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 70), max_size=12), st.integers(1, 9))
def test_schedule_is_the_heap(sizes, shards):
    down = sorted(sizes.items(), reverse=True)
    made = []
    for size, phases in sharding.schedule(iter(down), shards):
        assert len(phases) <= shards
        for r in range(sizes[size]):
            start, turn = [p for p in phases if p[0] <= r][-1]
            made.append(turn[(r - start) % len(turn)])
    assert made == plain([s for s, n in down for _ in range(n)], shards)


def test_schedule_of_very_many_groups():
    made = list(sharding.schedule([(10**12, 1), (100, 10**10), (9, 10**11)], 24))
    assert all(len(p) <= 2 for _, p in made) and made[1][1] == [(0, list(range(1, 24)))]


def expected(rows, shards):
    groups = defaultdict(int)
    for _, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    down = sorted(groups, key=lambda k: (-groups[k], k))
    return dict(zip(down, plain([groups[k] for k in down], shards), strict=True))


def test_all_documents_against_the_heap(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(900), rng.choice(["one text", "zwei Texte ä", "", None, f"text {rng.randrange(150)}" * rng.randrange(1, 9)])) for _ in range(1500)]
    rows += [(i, "copy of a third") for i in range(800)] + [(None, "x"), (None, "x"), (5, "same row"), (5, "same row")]
    docs = spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, shard string").repartition(7)
    out = sharding.shard_documents(docs, 5, keep=["doc_id", "text", "shard"]).collect()
    where = expected(rows, 5)
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    for r in out:
        raw = (r.text or "").encode()
        assert (r.size, r.text_crc32, r.shard) == (len(raw) + 8, zlib.crc32(raw), where[hashlib.sha256(raw).hexdigest()])
    for k in range(5):
        own = sorted((r for r in out if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids)


def test_equals_sql(spark):
    assert difference(q.op11_sharding(spark, "/root/testdata/sf0.001"), sharding.SQL) == ""


def test_sizes_are_near_equal(spark):
    out = q.op11_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 24 and max(sizes) - min(sizes) < 0.001 * sum(sizes)


def test_edge_cases(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(empty).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [tuple(r) for r in sharding.shard_documents(one, 3).collect()] == [(1, 9, zlib.crc32(b"a"), 0, 0)]
    docs = spark.createDataFrame([(i, f"text {i % 20}", i % 3 if i % 7 else None) for i in range(60)], "doc_id long, text string, site int")
    by_site = sharding.shard_documents(docs, 2, group=docs.site, keep=["doc_id", "site", "text"])
    assert all(len(x) == 1 for x in [{r.shard for r in by_site.collect() if r.site == s} for s in (0, 1, 2, None)])
    sharding.write_shards(by_site, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in by_site.collect())
