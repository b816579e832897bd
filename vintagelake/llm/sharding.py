"""Shards of near equal bytes: groups that must stay together, sorted by size, go to the least-loaded shard through a heap.

Two groups of one size are alike to the heap, so the schedule is made for sizes and how many groups have each. Distinct
sizes add up to no more than all bytes, so there are at most the square root of twice the bytes; groups, rows and texts stay
on the executors, where a group finds its shard by its rank within its size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.llm.common import written

#: Bytes that a document has besides its text.
OVERHEAD = 8
#: A group with more than one in so many of all rows is joined by broadcast; there are fewer such groups than that.
HEAVY = 1000
SCHEDULE = "weight bigint, phases array<struct<start:bigint,turn:array<int>>>"


def schedule(sizes: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[tuple[int, list[int]]]]]:
    """For (size, number of groups) by falling size: (size, [(rank, shards in turn)]), as the heap would deal group by group.

    From a rank on, the groups of that size go to the listed shards in turn. The shards that are less than one size above the
    least loaded take one group each, in the heap's order, until they reach the next shard; then that one joins them. So a
    size takes at most one entry a shard, whatever the number of its groups. Of equal loads the lower shard comes first.
    """
    heap = [(0, k) for k in range(shards)]
    for size, count in sizes:
        phases, rank = [], 0
        while rank < count:
            low, front = heap[0][0], []
            while heap and heap[0][0] < low + size:
                front.append(heappop(heap))
            left = count - rank
            rounds, rest = divmod(left, len(front))
            if heap and (most := (heap[0][0] - low) // size) <= rounds:
                rounds, rest = most, 0
            phases.append((rank, [k for _, k in front]))
            for i, (load, k) in enumerate(front):
                heappush(heap, (load + size * (rounds + (i < rest)), k))
            rank += rounds * len(front) + rest
        yield size, phases


def ranked(df: DataFrame, groups: list[str], order: list[str | Column], name: str) -> tuple[DataFrame, DataFrame]:
    """df with `part` and `at`, a row's number from 1 within its group and part; and (groups, part, before, n) of the parts.

    Rows are dealt by ranges of (groups, order, a row number) and stored, so a group that holds a third of all rows lies in many
    parts and equal rows are dealt too. before + at is the rank in the group: exact, and the same for any number of parts.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    dealt = written(rows.repartitionByRange(*groups, *order, "_row").withColumn("part", F.spark_partition_id()), name)
    parts = dealt.groupBy(*groups, "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("part", *groups).orderBy(*order, "_row"))).drop("_row")
    return numbered, parts


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """(key, n, weight) with its shard. Equal weights are dealt in the order of the key."""
    spark = groups.sparkSession
    numbered, parts = ranked(groups.withColumn("_down", -F.col("weight")), ["_down", "weight"], ["key"], "shard-groups")
    sizes = parts.groupBy("weight").agg(F.sum("n").alias("n")).orderBy(F.desc("weight"))
    made = list(schedule(((r.weight, r.n) for r in sizes.toLocalIterator()), shards))
    table = pa.table([pa.array([w for w, _ in made], pa.int64()), pa.array([[{"start": s, "turn": t} for s, t in p] for _, p in made], pa.list_(pa.struct([("start", pa.int64()), ("turn", pa.list_(pa.int32()))])))], names=["weight", "phases"])
    plan = spark.createDataFrame(table, SCHEDULE)
    # the schedule goes to a size's parts first, so a size that many groups have is joined part by part
    placed = parts.join(plan, "weight").select("part", "weight", "before", "phases")
    rank = F.col("before") + F.col("at") - 1
    phase = F.element_at(F.filter("phases", lambda p: p.start <= F.col("_rank")), -1)
    out = numbered.join(placed, ["part", "weight"]).withColumn("_rank", rank).withColumn("_phase", phase)
    turn = ((F.col("_rank") - F.col("_phase.start")) % F.size("_phase.turn")).cast("int")
    return out.select("key", "n", "weight", F.get(F.col("_phase.turn"), turn).alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", group: Column | None = None, order: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Rows with `keep` (default doc_id), size, text_crc32, shard and slot, a number from 0 without gaps within the shard by `order`.

    size: bytes of the text in UTF-8 and OVERHEAD. group: what stays together, by default equal texts. A null text is an empty one,
    so both are one group; a group of null is one group too. A group larger than an even share makes its shard as large as it has
    to be, and the others share the rest. Repeated rows and null ids are rows like others (nulls come first in a shard); an
    empty table gives no rows. Columns of docs that are named like the new ones give way.
    """
    new = ["size", "text_crc32", "shard", "slot"]
    keep = [c for c in dict.fromkeys(keep or ["doc_id"]) if c not in new]
    if shards < 1:
        raise ValueError("there must be a shard")
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.sha2(value if group is None else F.coalesce(group.cast("string"), F.lit("null")), 256)
    row = F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row")
    rows = written(docs.select(row, F.col(f"`{order}`").alias("by"), key.alias("key"), (F.octet_length(value) + OVERHEAD).cast("bigint").alias("size"), F.crc32(value.cast("binary")).alias("text_crc32")), "shard-rows")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    placed = written(group_shards(groups, shards).select("key", "n", "shard"), "shard-places")

    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    heavy = placed.where(F.col("n") * HEAVY > total).select("key", F.col("shard").alias("_heavy"))
    marked = rows.join(F.broadcast(heavy), "key", "left")
    rest = marked.where(F.col("_heavy").isNull()).join(placed.where(F.col("n") * HEAVY <= total).select("key", "shard"), "key")
    columns = ["row", "by", "size", "text_crc32"]
    dealt = marked.where(F.col("_heavy").isNotNull()).select(*columns, F.col("_heavy").alias("shard")).unionByName(rest.select(*columns, "shard"))

    numbered, parts = ranked(dealt, ["shard"], ["by"], "shard-slots")
    out = numbered.join(parts.select("shard", "part", "before"), ["shard", "part"])
    return out.select(*(F.col(f"row.`{c}`") for c in keep), "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """The rows of shard_documents (with the columns to keep) as one folder a shard, whose files follow each other in slots."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


SQL = r"""
WITH RECURSIVE bits AS (
    SELECT b, 0 AS k, b::BIGINT AS c FROM range(256) t(b) UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY b) AS steps FROM bits WHERE k = 8
), texts AS (
    SELECT t, sha256(t) AS key, len(pairs) + 8 AS size, xor(list_reduce([4294967295::BIGINT] || list_transform(pairs, lambda x: ('0x' || x)::BIGINT), lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32
    FROM (SELECT t, regexp_extract_all(hex(encode(t)), '..') AS pairs FROM (SELECT DISTINCT coalesce(text, '') AS t FROM documents)), crc
), groups AS (
    SELECT key, any_value(text_crc32) AS text_crc32, any_value(size) AS size, row_number() OVER (ORDER BY sum(size) DESC, key) AS k, sum(size)::BIGINT AS weight
    FROM documents JOIN texts ON t = coalesce(text, '') GROUP BY key
), heap AS (
    SELECT 0::BIGINT AS k, -1 AS shard, list_resize([0::BIGINT], 24, 0::BIGINT) AS loads
    UNION ALL
    SELECT g.k, (list_position(h.loads, list_min(h.loads)) - 1)::INT, list_transform(h.loads, lambda x, i: CASE WHEN i = list_position(h.loads, list_min(h.loads)) THEN x + g.weight ELSE x END)
    FROM heap h JOIN groups g ON g.k = h.k + 1
)
SELECT doc_id, g.size::BIGINT AS size, g.text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM documents JOIN groups g ON g.key = sha256(coalesce(text, '')) JOIN heap h ON h.k = g.k
"""
