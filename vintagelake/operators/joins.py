"""Joins of time series: as of a date, by precedence, spliced, nearest, and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(probes: DataFrame, points: DataFrame, keys: list[str], probe_day: str, point_day: str, values: list[str]) -> DataFrame:
    """Each probe with the values of the newest point at or before its day; null where there is none. One shuffle, no range join.

    Points and probes are put in one order, points first on equal days, and the last point is carried along. Both sides
    must have at most one point for a key and day; the probes may repeat.
    """
    extra = [c for c in probes.columns if c not in keys and c != probe_day]
    pts = points.select(*keys, F.col(point_day).alias("_day"), F.lit(0).alias("_tag"), F.struct(point_day, *values).alias("_point"))
    tagged = probes.select(*keys, F.col(probe_day).alias("_day"), F.lit(1).alias("_tag"), F.struct(*extra, F.lit(1).alias("_")).alias("_probe"))
    w = Window.partitionBy(*keys).orderBy("_day", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.unionByName(pts, allowMissingColumns=True).withColumn("_found", F.last("_point", ignorenulls=True).over(w)).where("_tag = 1")
    return out.select(*keys, F.col("_day").alias(probe_day), *(F.col(f"_probe.{c}") for c in extra), F.col(f"_found.{point_day}").alias(f"as_of_{point_day}"), *(F.col(f"_found.{v}") for v in values))


def composed(drive: DataFrame, legs: dict[str, DataFrame], keys: list[str], combine) -> DataFrame:
    """A series derived from several: the driving one gives the dates, the others stand as of them; without a leg no row.

    All inputs have obs_date, release_date, value. What is derived is released when its last input was.
    """
    out = drive.select(*keys, "obs_date", F.col("release_date").alias("release_drive"), F.col("value").alias("value_drive"))
    for name, leg in legs.items():
        points = leg.select(*keys, F.col("obs_date").alias(f"day_{name}"), F.col("release_date").alias(f"release_{name}"), F.col("value").alias(f"value_{name}"))
        out = as_of_join(out, points, keys, "obs_date", f"day_{name}", [f"release_{name}", f"value_{name}"])
    out = out.na.drop(subset=[f"value_{n}" for n in ["drive", *legs]])
    names = ["drive", *legs]
    release = F.greatest(*(F.col(f"release_{n}") for n in names)) if len(names) > 1 else F.col("release_drive")
    return out.select(*keys, "obs_date", release.alias("release_date"), combine(*(F.col(f"value_{n}") for n in names)).alias("value"))


def within_spans(points: DataFrame, day: str, spans: DataFrame, first: str, end: str, bin_days: int = 32) -> DataFrame:
    """Each span with every point whose day lies in it: first included, end excluded, null for a span that stands.

    A range join by bins: a span meets the bins that it reaches up to the last point's, a point its own, and days are compared
    inside a bin. So rows are made for the bins of a span, not for all pairs, and a bin's rows are dealt by an equi-join.
    """
    number = lambda c: F.floor(F.unix_date(c) / bin_days)
    pts = points.withColumn("_bin", number(F.col(day)))
    last = points.agg(F.min(number(F.col(day))).alias("_a"), F.max(number(F.col(day))).alias("_b"))
    reach = F.explode(F.sequence(F.greatest(number(F.col(first)), "_a"), F.least(F.coalesce(number(F.date_sub(F.col(end), 1)), F.col("_b")), F.col("_b"))))
    ok = (F.greatest(number(F.col(first)), "_a") <= F.least(F.coalesce(number(F.date_sub(F.col(end), 1)), F.col("_b")), F.col("_b")))
    binned = spans.join(F.broadcast(last)).where(ok).withColumn("_bin", reach).drop("_a", "_b")  # one row
    return binned.join(pts, "_bin").where((F.col(day) >= F.col(first)) & (F.col(end).isNull() | (F.col(day) < F.col(end)))).drop("_bin")


def standing(rows: DataFrame, day: str, versions: DataFrame, since: str) -> DataFrame:
    """rows with the columns of the version that stood on their day: the newest whose `since` is at or before it; null where there was none.

    Versions are few and far between (refits), rows many: no window goes over the rows.
    """
    spans = versions.withColumn("_end", F.lead(since).over(Window.partitionBy(F.lit(0)).orderBy(since)))  # over the versions alone
    days = rows.select(day).distinct()
    held = within_spans(days, day, spans, since, "_end", 366)
    return rows.join(held.drop("_end"), day, "left")


def precedence(parts: dict[str, DataFrame], key: str | list[str], value: str) -> DataFrame:
    """By key, the value of the first part that has one, and that part's name as `source`."""
    key = [key] if isinstance(key, str) else key
    frames = [df.select(*key, F.col(value).alias(name)) for name, df in parts.items()]
    wide = reduce(lambda a, b: a.join(b, key, "full_outer"), frames)
    names = list(parts)
    source = reduce(lambda c, n: c.when(F.col(n).isNotNull(), n), names[1:], F.when(F.col(names[0]).isNotNull(), names[0]))
    return wide.select(*key, F.coalesce(*map(F.col, names)).alias(value), source.alias("source")).where(F.col(value).isNotNull())


def splice_check(base: DataFrame, older: DataFrame) -> DataFrame:
    """One row on the days that both have: their number and the median relative gap."""
    gap = F.abs(F.col("older_value") / F.col("value") - 1)
    both = base.select("obs_date", "value").join(older.select("obs_date", F.col("value").alias("older_value")), "obs_date")
    return both.agg(F.count("*").alias("overlap"), F.percentile(gap, F.lit(0.5)).alias("median_gap"))


def prefix_splice(base: DataFrame, older: DataFrame, min_overlap: int, max_gap: float) -> DataFrame:
    """base, led by the older series' rows from before its first day if they agree well enough; `source` tells them apart.

    The check is one row joined to the older rows, so the plan stays lazy.
    """
    ok = splice_check(base, older).crossJoin(base.agg(F.min("obs_date").alias("first_day"))).where((F.col("overlap") >= min_overlap) & (F.col("median_gap") <= max_gap))
    head = older.join(F.broadcast(ok), F.col("obs_date") < F.col("first_day")).select("obs_date", "value", F.lit("older").alias("source"))
    return head.unionByName(base.select("obs_date", "value", F.lit("base").alias("source")))


def nearest(points: DataFrame, day: str, target: str) -> DataFrame:
    """The row nearest to a day, the earlier one of two."""
    return points.orderBy(F.abs(F.datediff(F.col(day), F.lit(target).cast("date"))), day).limit(1)


def differences(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Keys and fields where two tables differ by more than the tolerance, or where only one has the key or the value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("field"), F.col(f"a.{v}").cast("double").alias("left"), F.col(f"b.{v}").cast("double").alias("right")) for v in values))).alias("d")
    both = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    out = both.select(*(F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys), pairs).select(*keys, "d.*")
    return out.where(~(F.col("left").isNull() & F.col("right").isNull()) & (F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > tolerance)))

