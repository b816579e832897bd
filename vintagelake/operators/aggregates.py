"""Aggregates of series: robust, weighted, by state, by episode, and of forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.operators.windows import islands


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean by weights, renormalized over the rows that have a value."""
    known = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(known, weight * value)) / F.nullif(F.sum(F.when(known, weight)), F.lit(0.0))


def row_mean(values: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted mean over columns, renormalized over those that are not null; null where all are."""
    top = reduce(Column.__add__, (F.coalesce(v * weights[k], F.lit(0.0)) for k, v in values.items()))
    held = reduce(Column.__add__, (F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in values.items()))
    return top / F.nullif(held, F.lit(0.0))


def geometric_mean(terms: list[Column]) -> Column:
    """0 where a term is 0, null where one is missing."""
    known = reduce(Column.__and__, (t.isNotNull() for t in terms))
    logs = reduce(Column.__add__, (F.log(t) for t in terms))
    lowest = F.least(*terms) if len(terms) > 1 else terms[0]
    return F.when(known, F.when(lowest <= 0, 0.0).otherwise(F.exp(logs / len(terms))))


def robust_z(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Distance from the median in scaled median absolute deviations; 0 where these are 0. Two small aggregates joined back, no whole-partition window."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("_med"))
    near = df.join(med, keys)
    mad = near.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("_med")), F.lit(0.5)).alias("_mad"))
    z = F.when(F.col("_mad") == 0, 0.0).otherwise((F.col(value) - F.col("_med")) / (1.4826 * F.col("_mad")))
    return near.join(mad, keys).withColumn(out, z).drop("_med", "_mad")


def at_index(df: DataFrame, keys: list[str], value: Column, share: float, out: str) -> DataFrame:
    """The value at place floor(share * n), from 0, of each key's sorted values: by rank, so no group is gathered in one row."""
    w = Window.partitionBy(*keys)
    ranked = df.select(*keys, value.alias(out)).where(F.col(out).isNotNull()).withColumns({"_i": F.row_number().over(w.orderBy(out)) - 1, "_n": F.count("*").over(w)})
    return ranked.where(F.col("_i") == F.least(F.floor(share * F.col("_n")), F.col("_n") - 1)).select(*keys, out)


def state_statistics(df: DataFrame, keys: list[str], by: str, state: str, value: str, per_year: int) -> DataFrame:
    """Each state's share of rows, annual mean and volatility of value, and mean length of its runs."""
    runs = islands(df, keys, by, state)
    out = runs.groupBy(*keys, state).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count_distinct("island").alias("_runs"))
    total = Window.partitionBy(*keys)
    return out.select(*keys, state, F.round(F.col("_n") / F.sum("_n").over(total), 6).alias("share"), F.round(F.col("_m") * per_year, 6).alias("mean"), F.round(F.col("_s") * F.sqrt(F.lit(float(per_year))), 6).alias("vol"), F.round(F.col("_n") / F.col("_runs"), 6).alias("persistence"))


def episodes(df: DataFrame, keys: list[str], by: str, depth: str, threshold: float) -> DataFrame:
    """One row for each run of rows deeper than the threshold: first day, number of rows, greatest depth."""
    runs = islands(df.withColumn("_deep", F.col(depth) > threshold), keys, by, "_deep").where("_deep")
    return runs.groupBy(*keys, "island").agg(F.min(by).alias("start"), F.count("*").alias("days"), F.max(depth).alias(depth)).drop("island")


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Forecasts in equal bins, 1 in the last one: how many, their mean, and how often it came true."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))


def fan(df: DataFrame, value: str, quantiles: list[float]) -> DataFrame:
    """A row for each quantile, interpolated between neighbours."""
    qs = F.array(*map(F.lit, quantiles))
    return df.agg(F.percentile(value, qs).alias("_v")).select(F.explode(F.arrays_zip(qs.alias("q"), F.col("_v").alias("level"))).alias("_r")).select("_r.*")


def exceedance(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Share of values above each threshold, all in one pass."""
    shares = df.agg(*(F.avg((F.col(value) > t).cast("int")).alias(f"_{i}") for i, t in enumerate(thresholds)))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(t).alias("x"), F.col(f"_{i}").alias("p")) for i, t in enumerate(thresholds)))).alias("_r")).select("_r.*")


def within(df: DataFrame, day: str, spans: list[tuple[str, str, str]]) -> DataFrame:
    """Rows in each named span of days, with its name; spans may overlap. They are a handful, so they are part of the plan."""
    hits = F.array_compact(F.array(*(F.when(F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date")), n) for n, a, b in spans)))
    return df.select("*", F.explode(hits).alias("name"))


def first_largest(options: dict) -> Column:
    """The first option, in the order given, with the largest value."""
    top = F.greatest(*options.values())
    return reduce(lambda c, kv: c.when(kv[1] == top, kv[0]), options.items(), F.when(F.lit(False), next(iter(options))))
