"""How filters interact: what each order of five filters keeps, removes and removes twice, from one cube over their failure flags."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.llm.common import written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORDS = r"[\x20\x09-\x0D]+"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 3


def text_flags(text: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides; a null text is an empty one.

    A: too few words. B: too few distinct ones. C: too many capitals A to Z. D: holds a symbol. Words are what white space
    (codes 32 and 9 to 13) leaves, in their case.
    """
    value = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(value, WORDS), "")
    n, capitals = F.size(words), F.length(F.regexp_replace(value, "[^A-Z]+", ""))
    return {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.length(value),
        "D": value.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, A to E, good, toxic, n): documents counted by their failures and labels.

    E: the text equals that of a row with a smaller doc_id. Equal rows are counted together before any shuffle, and the first of
    each text is joined by text and doc_id, so a text that a third of the rows share is dealt by their ids. A null doc_id is
    smaller than none and has none smaller, so it does not fail E, and it has no label. A document that labels hold twice
    has a label if one of its rows has it.
    """
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.sha2(value, 256).alias("key"), "doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), *(c.alias(k) for k, c in text_flags(F.col(f"`{text}`")).items()))
    rows = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "audit-rows")
    first = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("(quality = 1 or toxic = 1) and doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = rows.join(first, ["key", "doc_id"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull()).join(marks, "doc_id", "left")
    no = F.lit(False)
    return out.select("part", *FILTERS, F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n").groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))


def survivors(counts: DataFrame) -> DataFrame:
    """(part, chosen, n, good, toxic): for each set of filters, as letters, the documents that fail none of it. Sets that leave none are absent.

    They are the rows of a cube over the flags and the part whose chosen flags are all false.
    """
    cube = counts.cube("part", *FILTERS).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("n_good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("n_toxic"), F.grouping("part").alias("_all"), *(F.grouping(f).alias(f"_{f}") for f in FILTERS))
    chosen = F.concat(*(F.when(F.col(f"_{f}") == 0, F.lit(f)).otherwise("") for f in FILTERS))
    passed = F.lit(True)
    for f in FILTERS:
        passed = passed & ((F.col(f"_{f}") == 1) | ~F.col(f))
    return cube.where(passed & (F.col("_all") == 0)).select("part", chosen.alias("chosen"), "n", F.col("n_good").alias("good"), F.col("n_toxic").alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, filter_order and step, with what the step keeps, removes, would have removed, alone removes and loses.

    part: a value of `part`, null and empty being one. Counts are zero where there is nothing; an empty table has no parts and gives
    no rows. shapley is the sum over all orders of what the step's filter removes.
    """
    left = written(survivors(written(flagged(docs, labels, text, part), "audit-counts")), "audit-survivors")
    every, named = set(FILTERS), lambda s: "".join(sorted(s))
    sql = ", ".join(f"named_struct('filter_order', '{o}', 'step', {i + 1}, 'f', '{o[i]}', 'prior', '{named(o[:i])}', 'after', '{named(o[: i + 1])}', 'others', '{named(every - {o[i]})}')" for o in ORDERS for i in range(len(FILTERS)))
    steps = left.where("chosen = ''").select("part", F.explode(F.expr(f"array({sql})")).alias("s")).select("part", "s.*")

    def of(name: str, chosen: str) -> DataFrame:
        return left.select("part", F.col("chosen").alias(chosen), *(F.col(c).alias(f"{name}_{c}") for c in ("n", "good", "toxic")))

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    for name, chosen in (("prior", "prior"), ("after", "after"), ("alone", "f"), ("others", "others")):
        steps = steps.join(of(name, chosen), ["part", chosen], "left")
    whole = left.where("chosen = ''").select("part", F.col("n").alias("total_n"))
    clean = left.where(F.col("chosen") == FILTERS).select("part", F.col("n").alias("clean_n"))
    removed = count("prior_n") - count("after_n")
    out = steps.join(whole, "part").join(clean, "part", "left").select("part", "filter_order", "step", "f", count("after_n").alias("kept"), removed.alias("removed"), (F.col("total_n") - count("alone_n") - removed).alias("redundant"), (count("others_n") - count("clean_n")).alias("unique_fails"), (count("prior_good") - count("after_good")).alias("good_lost"), (count("prior_toxic") - count("after_toxic")).alias("toxic_lost"))
    out = written(out, "audit-steps")
    return out.join(out.groupBy("part", "f").agg(F.sum("removed").alias("shapley")), ["part", "f"]).drop("f")


SQL = r"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), seen AS (
    SELECT t, min(doc_id) AS first FROM words GROUP BY t
), marks AS (
    SELECT doc_id, bool_or(coalesce(quality, 0) = 1) AS good, bool_or(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), d AS (
    SELECT part, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS fc,
           regexp_matches(t, '[#$%&*|]') AS fd, coalesce(doc_id > first, FALSE) AS fe, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic
    FROM words JOIN seen USING (t) LEFT JOIN marks USING (doc_id)
), c AS (
    SELECT part, (fa::INT + 2 * fb::INT + 4 * fc::INT + 8 * fd::INT + 16 * fe::INT) AS fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY ALL
), letters AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior FROM orders, range(1, 6) r(step)
), counted AS (
    SELECT part, filter_order, step::INT AS step, bit,
           coalesce(sum(n) FILTER (fails & (prior | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails & prior = 0 AND fails & bit > 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (fails & prior > 0 AND fails & bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
           coalesce(sum(g) FILTER (fails & prior = 0 AND fails & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (fails & prior = 0 AND fails & bit > 0), 0)::BIGINT AS toxic_lost
    FROM c, steps GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counted
"""
