"""The read side as functions: catalogues, snapshots, histories, states. Each returns a lazy DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.operators import pit, reshape
from vintagelake.operators.decimate import lttb_with_extremes
from vintagelake.operators.pit import newest

#: Most rows of one answer, days until a state is stale, hours until a run is; freshness limits in days by frequency.
MOST_ROWS, STALE_DAYS, STALE_HOURS = 60_000, 5, 36
FRESH = {"daily": (4, 10), "weekly": (10, 21), "monthly": (45, 75), "quarterly": (120, 200)}


def catalogue(obs: DataFrame, metadata: DataFrame, today: str) -> DataFrame:
    """Every described series with its newest value, dates, number of rows and days since; 0 rows where it has none."""
    by = obs.groupBy("series_id").agg(F.count("*").alias("n"), F.min("obs_date").alias("first"), F.max_by(F.struct("obs_date", "value"), F.struct("obs_date", "revision_date")).alias("l"))
    out = metadata.join(by, "series_id", "left")
    return out.select("series_id", "title", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "first", F.col("l.obs_date").alias("last"), F.col("l.value").alias("value"), F.datediff(F.lit(today).cast("date"), "l.obs_date").alias("age_days"))


def freshness(age: Column, frequency: Column) -> Column:
    """fresh, aging or stale by how long figures of this frequency may take."""
    tiers = lambda f: F.when(age <= FRESH[f][0], "fresh").when(age <= FRESH[f][1], "aging").otherwise("stale")
    return reduce(lambda c, f: c.when(frequency == f, tiers(f)), FRESH, F.when(age.isNull(), "stale"))


def series_history(obs: DataFrame, series_id: str, first: str | None = None, last: str | None = None, limit: int = MOST_ROWS, points: int | None = None) -> DataFrame:
    """A series' newest vintages in a range of days, oldest first, up to the limit or thinned to so many points."""
    rows = newest(reshape.between(obs.where(F.col("series_id") == series_id), "obs_date", first, last), ["series_id", "obs_date"], F.desc("revision_date"), F.desc("value"))
    if points is not None:
        return lttb_with_extremes(rows, "series_id", "obs_date", "value", points)
    return reshape.limited(rows.select("series_id", "obs_date", "value"), "obs_date", max(1, min(limit, MOST_ROWS)))


def snapshot(obs: DataFrame, metadata: DataFrame, as_of: str) -> DataFrame:
    """What was available at a cutoff and what was withheld, in one frame, and how many series there are."""
    have = pit.available(obs, metadata, as_of).select("series_id", F.lit("available").alias("kind"), "obs_date", "release_date", "value", F.lit(None).cast("int").alias("published_days_later"))
    lack = pit.withheld(obs, metadata, as_of).select("series_id", F.lit("withheld").alias("kind"), "obs_date", "release_date", "value", "published_days_later")
    return have.unionByName(lack).crossJoin(F.broadcast(metadata.agg(F.count("*").alias("total"))))


def asset_states(states: DataFrame, vocabulary: list[str], today: str) -> DataFrame:
    """The newest state of each asset of the vocabulary; an asset without one is there and awaits its first run."""
    latest = newest(states, ["asset"], F.desc("as_of"), F.desc("model_version"))
    names = states.sparkSession.createDataFrame([(a,) for a in vocabulary], "asset string")
    age = F.datediff(F.lit(today).cast("date"), "as_of")
    return names.join(latest, "asset", "left").withColumns({"stale": F.coalesce(age > STALE_DAYS, F.lit(True)), "awaiting_first_run": F.col("as_of").isNull()})


def asset_state(states: DataFrame, asset: str) -> DataFrame:
    return states.where(F.col("asset") == asset).orderBy(F.desc("as_of"), F.desc("model_version")).limit(1)


def metric_history(outputs: DataFrame, asset: str, metric: str, first: str | None = None, last: str | None = None, limit: int = MOST_ROWS) -> DataFrame:
    rows = reshape.between(outputs.where((F.col("asset") == asset) & (F.col("metric") == metric)), "as_of", first, last)
    return reshape.limited(rows, "as_of", max(1, min(limit, MOST_ROWS)))


def metrics(outputs: DataFrame, asset: str) -> DataFrame:
    return outputs.where(F.col("asset") == asset).select("metric").distinct()


def newest_features(features: DataFrame) -> DataFrame:
    """All features of the newest (day, model version)."""
    top = features.agg(F.max(F.struct("as_of", "model_version")).alias("t")).select("t.*")
    return features.join(F.broadcast(top), ["as_of", "model_version"], "left_semi")


def force_history(forces: DataFrame, force: str, n: int) -> DataFrame:
    """The newest n days of a force, one row for each day by the newest model version, oldest first."""
    rows = newest(forces.where(F.col("force") == force), ["as_of"], F.desc("model_version"))
    return rows.orderBy(F.desc("as_of")).limit(n).orderBy("as_of")


def regime_history(legs: DataFrame, names: list[str]) -> DataFrame:
    """Posteriors of the newest model version as maps, with the first largest regime in the order of names and its probability."""
    from vintagelake.operators.aggregates import first_largest

    top = legs.agg(F.max("model_version").alias("model_version"))
    wide = legs.join(F.broadcast(top), "model_version", "left_semi").groupBy("as_of").pivot("regime", names).agg(F.first("probability"))
    options = {n: F.coalesce(F.col(f"`{n}`"), F.lit(-1.0)) for n in names}
    return wide.select("as_of", F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"`{n}`")))).alias("posterior"), first_largest(options).alias("label"), F.greatest(*options.values()).alias("confidence"))


def metric_pivot(outputs: DataFrame, asset: str, names: list[str]) -> DataFrame:
    """A column for each metric; absent is null, never 0."""
    return outputs.where(F.col("asset") == asset).groupBy("as_of").pivot("metric", names).agg(F.first("value"))


def forecast(bands: DataFrame) -> DataFrame:
    """The newest (day, model version)'s quantiles of each horizon as a map."""
    top = bands.agg(F.max(F.struct("as_of", "model_version")).alias("t")).select("t.*")
    rows = bands.join(F.broadcast(top), ["as_of", "model_version"], "left_semi")
    return rows.groupBy("horizon").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("quantile", "value")))).alias("quantiles"))


def simulation_summary(states: DataFrame) -> DataFrame:
    """The components of a state that come from simulated paths."""
    return states.select("asset", "as_of", F.map_filter("components", lambda k, v: k.startswith("mc_")).alias("summary"))


def health(log: DataFrame, now: str) -> DataFrame:
    """One row: whether no source's newest run failed, the newest run, and whether it is too old."""
    last = log.groupBy("source").agg(F.max_by("status", "run_at").alias("status"), F.max("run_at").alias("run_at"))
    out = last.agg(F.every(F.col("status") != "failed").alias("ok"), F.max("run_at").alias("newest"))
    return out.withColumn("stale", (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) > STALE_HOURS * 3600)


def tier(score: Column, names: tuple[str, str, str], low: float, high: float) -> Column:
    return F.when(score >= high, names[2]).when(score >= low, names[1]).when(score.isNotNull(), names[0])


def coverage_probe(outputs: DataFrame) -> DataFrame:
    return outputs.groupBy("asset", "metric").agg(F.min("as_of").alias("first"), F.max("as_of").alias("last"), F.count("value").alias("n"))


def by_date(rows: DataFrame, order: list[str], dates: int, rows_per_date: int) -> DataFrame:
    """The oldest rows up to a limit that is given in dates, with the number of all rows and whether some are missing."""
    n = max(1, min(dates, MOST_ROWS)) * rows_per_date
    total = rows.agg(F.count("*").alias("available"))
    return rows.orderBy(*order).limit(n).join(F.broadcast(total)).withColumn("truncated", F.col("available") > n)
