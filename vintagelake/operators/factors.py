"""Factor scores: each input's place among its own past, from 0 to 100, and their mean."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.operators import windows
from vintagelake.operators.joins import composed

#: Fewest figures of a series that is scored.
MIN_FIGURES = 24


def score_series(values: DataFrame, directions: dict[str, int]) -> DataFrame:
    """series_id, obs_date, value, score: the expanding z-score's mid-rank among earlier ones, turned round for direction -1."""
    known = values.where(F.col("value").isNotNull()).select("series_id", "obs_date", "value")
    enough = known.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_FIGURES).select("series_id")
    w = windows.ordered(["series_id"], "obs_date")
    z = F.coalesce(windows.expanding_z(F.col("value"), w, 2, False, 3.0), F.lit(0.0))
    scored = known.join(enough, "series_id", "left_semi").withColumn("z", F.round(z, 9))
    ranked = windows.expanding_midrank(scored, "series_id", "obs_date", "z", "pct")
    down = reduce(lambda c, kv: c.when(F.col("series_id") == kv[0], kv[1] < 0), directions.items(), F.when(F.lit(False), False)).otherwise(False)
    score = 100 * F.when(down, 1 - F.col("pct")).otherwise(F.col("pct"))
    return scored.join(ranked.drop("z"), ["series_id", "obs_date"]).select("series_id", "obs_date", "value", score.alias("score"))


def compute(scores: DataFrame, spec: DataFrame) -> DataFrame:
    """For each factor of spec (factor, series_id): the mean of its inputs' newest scores, how many there are, and the parts."""
    last = scores.groupBy("series_id").agg(F.max_by(F.struct("score", "value"), "obs_date").alias("l")).select("series_id", "l.*")
    joined = spec.join(last, "series_id", "left")
    part = F.when(F.col("score").isNotNull(), F.struct("series_id", F.round("score", 6).alias("score")))
    return joined.groupBy("factor").agg(F.round(F.avg("score"), 4).alias("score"), F.count("score").alias("inputs_used"), F.count("*").alias("inputs_configured"), F.map_from_entries(F.array_sort(F.collect_list(part))).alias("components"))


#: Derived series by name: the inputs in order, the first gives the dates; how they combine; which first values are left out.
RECIPES: dict[str, tuple[list[str], Callable[..., Column], Callable[[Column], Column]]] = {
    "excess_cape_yield": (["cape", "nominal", "breakeven"], lambda cape, nominal, breakeven: 100 / cape - (nominal - breakeven), lambda v: v > 0),
    "credit_quality_spread": (["high_yield", "investment_grade"], lambda high, good: high - good, lambda v: v.isNotNull()),
}


def derived(name: str, inputs: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """A recipe's series from its inputs as they stood on the driving one's dates."""
    order, combine, keep = RECIPES[name]
    drive, *legs = order
    return composed(inputs[drive].where(keep(F.col("value"))), {n: inputs[n] for n in legs}, keys, combine)
