"""Data-quality checks: each one gives findings as rows (series_id, code, severity, n). Errors block a series, warnings do not, anomalies flag single figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.operators.aggregates import at_index, robust_z
from vintagelake.operators.pit import knowable_at, newest
from vintagelake.sources.shared import stored

#: Days between figures, the longest gap that is normal, by frequency; limits of the checks.
SPACING = {"daily": 1, "weekly": 7, "monthly": 31, "quarterly": 92}
NORMAL_GAP = {"daily": 5, "weekly": 10, "monthly": 45, "quarterly": 130}
POSITIVE_UNITS = ("index", "usd", "usd_billions", "ratio")
GAP_FACTOR, COVERAGE, JUMP_RELATIVE, JUMP_SCALE, OUTLIER_Z, OUTLIER_MIN = 3, 0.8, 2.0, 3.0, 12.0, 30


def by_frequency(table: dict[str, int], frequency: Column) -> Column:
    return reduce(lambda c, kv: c.when(frequency == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0))


def finding(df: DataFrame, code: str, severity: str, n: Column | str = "n") -> DataFrame:
    n = F.col(n) if isinstance(n, str) else n
    return df.select("series_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), n.cast("bigint").alias("n"))


def empty(obs: DataFrame, specs: DataFrame) -> DataFrame:
    return finding(specs.join(obs.select("series_id").distinct(), "series_id", "left_anti"), "empty", "error", F.lit(0))


def mismatch(obs: DataFrame, specs: DataFrame, column: str) -> DataFrame:
    """Figures whose unit or frequency is not the one that the series is described with."""
    both = obs.select("series_id", column).join(specs.select("series_id", F.col(column).alias("_told")), "series_id")
    return finding(both.where(F.col(column) != F.col("_told")).groupBy("series_id").agg(F.count("*").alias("n")), f"{column}_mismatch", "error")


def vintage() -> Column:
    """The date that tells a period's vintages apart: of its revision, or of its release where it was not revised."""
    return F.coalesce("revision_date", "release_date").alias("vintage")


def condensed(obs: DataFrame) -> DataFrame:
    """One row for each series, period, release and revision, of which all checks of a report can be made.

    value is the largest one, as that stands; low and high are the ends of the values at ten digits after the point, n_rows
    and n_bad count rows and values not over 0. All are sums or extremes, so tasks send a row for a key. What is condensed stays.
    """
    if "n_rows" in obs.columns:
        return obs
    at = F.round("value", 10)
    sums = [F.max("value").alias("value"), F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n_rows"), F.count_if(F.col("value") <= 0).alias("n_bad")]
    return obs.groupBy("series_id", "obs_date", "release_date", "revision_date").agg(*sums)


def duplicates(obs: DataFrame) -> DataFrame:
    """Periods with the same vintage twice."""
    twice = condensed(obs).groupBy("series_id", "obs_date", vintage()).agg(F.sum("n_rows").alias("k")).where("k > 1")
    return finding(twice.groupBy("series_id").agg(F.count("*").alias("n")), "duplicate_timestamp", "error")


def conflicts(obs: DataFrame) -> DataFrame:
    """Vintages that state different values, compared at ten digits after the point."""
    keys = condensed(obs).groupBy("series_id", "obs_date", vintage()).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    return finding(keys.groupBy("series_id").agg(F.count("*").alias("n")), "revision_conflict", "error")


def stored_conflicts(obs: DataFrame, stored: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Vintages whose value is not the stored one."""
    keys = ["series_id", "obs_date", vintage()]
    both = obs.select(*keys, "value").join(stored.select(*keys, F.col("value").alias("_was")), ["series_id", "obs_date", "vintage"])
    return finding(both.where(F.abs(F.col("value") - F.col("_was")) > tolerance).groupBy("series_id").agg(F.count("*").alias("n")), "revision_conflict_stored", "error")


def periods(obs: DataFrame) -> DataFrame:
    """Each series' different periods, with the days since the one before."""
    days = obs.select("series_id", "obs_date").distinct()
    return days.withColumn("gap", F.datediff("obs_date", F.lag("obs_date").over(Window.partitionBy("series_id").orderBy("obs_date"))))


def invalid_frequency(obs: DataFrame, specs: DataFrame) -> DataFrame:
    """Series whose median spacing is far from the nominal one; three periods at least."""
    mid = periods(obs).groupBy("series_id").agg(F.percentile("gap", F.lit(0.5)).alias("gap"), F.count("*").alias("n")).where("n >= 3")
    nominal = by_frequency(SPACING, F.col("frequency"))
    return finding(mid.join(specs, "series_id").where((F.col("gap") < 0.4 * nominal) | (F.col("gap") > 2.0 * nominal)), "invalid_frequency", "error")


def all_gaps(obs: DataFrame, specs: DataFrame) -> DataFrame:
    """Every gap that is too long: series_id, obs_date (the gap's end), gap."""
    return periods(obs).join(specs, "series_id").where(F.col("gap") > GAP_FACTOR * by_frequency(NORMAL_GAP, F.col("frequency"))).select("series_id", "obs_date", "gap")


def gaps(obs: DataFrame, specs: DataFrame, most: int = 5) -> DataFrame:
    """The longest gaps of each series that are too long, for a listing."""
    w = Window.partitionBy("series_id").orderBy(F.desc("gap"), "obs_date")
    return all_gaps(obs, specs).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def coverage(obs: DataFrame, specs: DataFrame) -> DataFrame:
    """Present and expected periods of each series; days count without weekends and about nine holidays a year."""
    got = obs.groupBy("series_id").agg(F.count_distinct("obs_date").alias("present"), F.datediff(F.max("obs_date"), F.min("obs_date")).alias("span"))
    span = F.col("span").cast("double")
    expected = F.when(F.col("frequency") == "daily", span * 5 / 7 - span / 365 * 9).otherwise(span / by_frequency(SPACING, F.col("frequency"))) + 1
    return got.join(specs, "series_id").select("series_id", "present", expected.alias("expected"))


def sparse(obs: DataFrame, specs: DataFrame) -> DataFrame:
    return finding(coverage(obs, specs).where(F.col("present") < COVERAGE * F.col("expected")), "sparse_coverage", "warning", "present")


def moves(obs: DataFrame) -> DataFrame:
    """Newest vintage of each period, with the move since the period before, relative to that one's size."""
    latest = newest(obs.withColumn("knowable_at", knowable_at()), ["series_id", "obs_date"], F.desc("knowable_at"), F.desc("value"))
    w = Window.partitionBy("series_id").orderBy("obs_date")
    df = latest.withColumn("before", F.lag("value").over(w)).withColumn("move", F.col("value") - F.col("before"))
    return df.withColumn("relative", F.col("move") / F.nullif(F.abs("before"), F.lit(0.0)))


def jumps(obs: DataFrame) -> DataFrame:
    """Figures that jump: series that cross zero by the absolute move against the size that most figures have, others by the relative one."""
    df = moves(obs)
    sign = df.groupBy("series_id").agg(((F.min("value") < 0) & (F.max("value") > 0)).alias("crosses"))
    scale = at_index(df, ["series_id"], F.abs("value"), 0.75, "scale")
    df = df.join(sign, "series_id").join(scale, "series_id")
    hit = F.when(F.col("crosses"), F.abs("move") > JUMP_SCALE * F.col("scale")).otherwise(F.abs("relative") > JUMP_RELATIVE)
    return df.where(hit).select("series_id", "obs_date", "value", "before")


def outliers(obs: DataFrame) -> DataFrame:
    """Moves that are no jumps but far from the series' usual ones; thirty moves at least."""
    df = moves(obs).where("relative is not null").select("series_id", "obs_date", "relative")
    z = robust_z(df, ["series_id"], "relative", "z").join(df.groupBy("series_id").agg(F.count("*").alias("n")), "series_id")
    return z.where((F.col("n") >= OUTLIER_MIN) & (F.abs("z") > OUTLIER_Z) & (F.abs("relative") <= JUMP_RELATIVE)).select("series_id", "obs_date", "relative", "z")


def non_positive(obs: DataFrame, specs: DataFrame) -> DataFrame:
    bad = condensed(obs).where("n_bad > 0").join(specs.where(F.col("unit").isin(*POSITIVE_UNITS)).select("series_id"), "series_id", "left_semi")
    return finding(bad.groupBy("series_id").agg(F.sum("n_bad").alias("n")), "non_positive_value", "warning")


def release_inversions(obs: DataFrame) -> DataFrame:
    """Periods whose first release is before that of the period before."""
    first = obs.groupBy("series_id", "obs_date").agg(F.min("release_date").alias("first"))
    before = F.lag("first").over(Window.partitionBy("series_id").orderBy("obs_date"))
    bad = first.withColumn("before", before).where(F.col("first") < F.col("before"))
    return finding(bad.groupBy("series_id").agg(F.count("*").alias("n")), "release_date_inversion", "warning")


def report(obs: DataFrame, specs: DataFrame) -> DataFrame:
    """All checks' findings, one row for each series and code. Figures are read once and condensed to a table, which the checks read."""
    obs, specs = stored(condensed(obs), "condensed"), stored(specs, "specs")
    count = lambda df: df.groupBy("series_id").agg(F.count("*").alias("n"))
    parts = [
        empty(obs, specs), duplicates(obs), conflicts(obs), invalid_frequency(obs, specs), finding(count(all_gaps(obs, specs)), "missing_observations", "warning"),
        sparse(obs, specs), finding(count(jumps(obs)), "abnormal_jump", "anomaly"), finding(count(outliers(obs)), "outlier_move", "warning"), non_positive(obs, specs), release_inversions(obs),
    ]
    return reduce(DataFrame.unionByName, parts)


def status(findings: DataFrame, specs: DataFrame) -> DataFrame:
    """error, warning or ok for each described series."""
    worst = findings.groupBy("series_id").agg(F.max((F.col("severity") == "error").cast("int")).alias("e"), F.count("*").alias("n"))
    return specs.join(worst, "series_id", "left").select("series_id", F.when(F.col("e") == 1, "error").when(F.col("n") > 0, "warning").otherwise("ok").alias("status"))


def flagged(obs: DataFrame) -> DataFrame:
    """obs with quality_flag on the figures that jump."""
    marks = jumps(obs).select("series_id", "obs_date", F.lit("abnormal_jump").alias("quality_flag"))
    return obs.join(marks, ["series_id", "obs_date"], "left")
