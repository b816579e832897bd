"""Filters, spines and changes of shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def between(df: DataFrame, day: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Rows from first to last, both included; an open end where one is None."""
    if first is not None:
        df = df.where(F.col(day) >= F.lit(first).cast("date"))
    return df if last is None else df.where(F.col(day) <= F.lit(last).cast("date"))


def finite(col: Column) -> Column:
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def positive(df: DataFrame, value: str) -> DataFrame:
    return df.where(finite(F.col(value)) & (F.col(value) > 0))


def trailing(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows of the last `days` days before the newest day."""
    last = df.agg(F.date_sub(F.max(day), days).alias("_from"))
    return df.join(F.broadcast(last), F.col(day) >= F.col("_from")).drop("_from")


def tall(df: DataFrame, keys: list[str], metrics: list[str], digits: int = 6) -> DataFrame:
    """One row for each metric with a finite value."""
    return df.unpivot(keys, metrics, "metric", "value").where(finite(F.col("value"))).withColumn("value", F.round("value", digits))


def month_end(df: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """The last known value of every month from a series' first to its last one; null for a month without any."""
    months = df.where(F.col(value).isNotNull()).groupBy(*keys, F.last_day(day).alias("month")).agg(F.max_by(value, day).alias(value))
    ends = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    firsts = F.explode(F.expr("sequence(trunc(_a, 'MM'), trunc(_b, 'MM'), interval 1 month)"))
    return ends.select(*keys, firsts.alias("_first")).select(*keys, F.last_day("_first").alias("month")).join(months, [*keys, "month"], "left")


def spine(spark: SparkSession, first: str, last: str, step: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', {step})")).alias("day"))


def spine_of(df: DataFrame, keys: list[str], day: str, step: str) -> DataFrame:
    """(keys, day): each key's days from its first to its last one by a step such as "interval 7 days"."""
    ends = df.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b")).where("_a is not null")
    return ends.select(*keys, F.explode(F.expr(f"sequence(_a, _b, {step})")).alias("day"))


def limited(df: DataFrame, day: str, n: int) -> DataFrame:
    """The n oldest rows, each with the number of all and whether some are missing."""
    total = df.agg(F.count("*").alias("available"))
    return df.orderBy(day).limit(n).join(F.broadcast(total)).withColumn("truncated", F.col("available") > n)


def newest_by(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def by_role(roles: dict[str, str], optional: set[str], present: set[str]) -> tuple[dict[str, str], list[str]]:
    """The roles whose series are there, and the optional ones without; a required one without its series raises."""
    lacking = [r for r, s in roles.items() if s not in present]
    if required := [r for r in lacking if r not in optional]:
        raise ValueError(f"no series for required roles: {required}")
    return {r: s for r, s in roles.items() if s in present}, lacking
