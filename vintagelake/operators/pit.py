"""Point-in-time core: what was known at a cutoff. A figure is visible from the day it became knowable, never from the day it describes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBS_COLUMNS = ["series_id", "obs_date", "release_date", "revision_date", "value"]


def knowable_at() -> Column:
    """The revision's date where it is not before the release, else the release's."""
    return F.greatest("release_date", F.coalesce("revision_date", "release_date"))


def rejects(obs: DataFrame) -> DataFrame:
    """Rows released before the period that they describe."""
    return obs.where(F.col("release_date") < F.col("obs_date"))


def require_valid(obs: DataFrame, sample: int = 5) -> DataFrame:
    """obs, or ValueError with the first offenders of `rejects`."""
    bad = rejects(obs).orderBy(*OBS_COLUMNS[:3]).limit(sample).collect()
    if bad:
        raise ValueError(f"released before the observed period: {[r.asDict() for r in bad]}")
    return obs


def knowable(obs: DataFrame, as_of: date | str, series_ids: list[str] | None = None) -> DataFrame:
    """Rows knowable at the cutoff, which is inclusive; the filters stand before any window so that they reach the scan."""
    out = obs.where(F.col("release_date") <= F.lit(as_of).cast("date")).withColumn("knowable_at", knowable_at())
    if series_ids is not None:
        out = out.where(F.col("series_id").isin(series_ids))
    return out.where(F.col("knowable_at") <= F.lit(as_of).cast("date"))


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the largest `by`. Each task sends one row for a key, so a key with many rows meets in no task."""
    rest = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return out.select(*(c if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns))


def pit_join(obs: DataFrame, as_of: date | str, series_ids: list[str] | None = None) -> DataFrame:
    """The latest period of each series at the cutoff, at its newest vintage, and how stale it is. A series without one is absent."""
    out = latest(knowable(obs, as_of, series_ids), ["series_id"], ["obs_date", "knowable_at"])
    return out.withColumn("staleness_days", F.datediff(F.lit(as_of).cast("date"), "obs_date"))


def pit_history(obs: DataFrame, as_of: date | str, series_ids: list[str] | None = None, start: date | str | None = None) -> DataFrame:
    """Every period at its newest knowable vintage."""
    out = knowable(obs, as_of, series_ids)
    if start is not None:
        out = out.where(F.col("obs_date") >= F.lit(start).cast("date"))
    return latest(out, ["series_id", "obs_date"], ["knowable_at"])


def lookahead(frame: DataFrame, as_of: date | str) -> DataFrame:
    """Rows that were not known at the cutoff, by the day they became knowable."""
    return frame.where(knowable_at() > F.lit(as_of).cast("date"))


def assert_no_lookahead(frame: DataFrame, as_of: date | str) -> DataFrame:
    bad = lookahead(frame, as_of).limit(5).collect()
    if bad:
        raise ValueError(f"not known at {as_of}: {[r.asDict() for r in bad]}")
    return frame


def period_end(obs_date: Column, frequency: Column) -> Column:
    """The last day of the period that begins on obs_date."""
    return (
        F.when(frequency == "monthly", F.last_day(obs_date))
        .when(frequency == "quarterly", F.last_day(F.add_months(F.trunc(obs_date, "quarter"), 2)))
        .when(frequency == "weekly", F.date_add(obs_date, 6))
        .otherwise(obs_date)
    )


def synthesized_release(obs_date: Column, frequency: Column, lag_days: Column | int) -> Column:
    return F.date_add(period_end(obs_date, frequency), lag_days)


def repair_pre_archive_releases(obs: DataFrame, frequency: Column, lag_days: int) -> DataFrame:
    """Release dates that an archive stamped when it began, exchanged for those the series' rhythm implies.

    A stamp is the archive's if several rows share the series' first one and the period lies before it, or if a later
    period was released earlier. The new date is no later than any release of this or a later period. A revision date
    at or before the old release moves with it.
    """
    # The epoch and how many rows bear it are sums by date; the floor runs over periods, which are fewer than vintages.
    by_date = obs.groupBy("series_id", "release_date").agg(F.count("*").alias("n"))
    epochs = by_date.groupBy("series_id").agg(F.min("release_date").alias("_epoch"), (F.min_by("n", "release_date") > 1).alias("_seeded"))
    later = Window.partitionBy("series_id").orderBy(F.desc("obs_date")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floors = obs.groupBy("series_id", "obs_date").agg(F.min("release_date").alias("_first")).select("series_id", "obs_date", F.min("_first").over(later).alias("_floor"))
    df = obs.join(epochs, "series_id").join(floors, ["series_id", "obs_date"])
    stamped = (F.col("_seeded") & (F.col("release_date") == F.col("_epoch")) & (F.col("obs_date") < F.col("_epoch"))) | (F.col("_floor") < F.col("release_date"))
    fixed = F.when(stamped, F.least(synthesized_release(F.col("obs_date"), frequency, lag_days), F.col("_floor"))).otherwise(F.col("release_date"))
    moved = F.when(F.col("revision_date") <= F.col("release_date"), fixed).otherwise(F.col("revision_date"))
    return df.withColumn("_fixed", fixed).withColumn("revision_date", moved).withColumn("release_date", F.col("_fixed")).select(*obs.columns)


def available(obs: DataFrame, metadata: DataFrame, as_of: date | str) -> DataFrame:
    """The newest row of each series known at the cutoff, with its description."""
    return pit_join(obs, as_of).join(metadata, "series_id")


def withheld(obs: DataFrame, metadata: DataFrame, as_of: date | str) -> DataFrame:
    """The earliest row of each series not yet released at the cutoff, and how many days later it was published."""
    hidden = obs.where(F.col("release_date") > F.lit(as_of).cast("date"))
    out = newest(hidden, ["series_id"], F.asc("obs_date"), F.asc("release_date"), F.asc("revision_date"))
    return out.join(metadata, "series_id").withColumn("published_days_later", F.datediff("release_date", F.lit(as_of).cast("date")))


def observation_counts(obs: DataFrame, as_of: date | str, ids: DataFrame) -> DataFrame:
    """Periods of each id known at the cutoff; 0 for an id without any."""
    counts = pit_history(obs, as_of).groupBy("series_id").agg(F.count("value").alias("n"))
    return ids.join(counts, "series_id", "left").select("series_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


class PitView:
    """A read-only view of observations clamped to a cutoff; every method returns a lazy DataFrame, but for `value`."""

    def __init__(self, obs: DataFrame, as_of: date | str):
        self.obs, self.as_of = obs, as_of

    def latest(self, ids: list[str] | None = None) -> DataFrame:
        return pit_join(self.obs, self.as_of, ids)

    def history(self, ids: list[str] | None = None, start: date | str | None = None) -> DataFrame:
        return pit_history(self.obs, self.as_of, ids, start)

    def wide(self, ids: list[str], start: date | str | None = None) -> DataFrame:
        """One column for each id asked for, null where it has no figure."""
        return self.history(ids, start).groupBy("obs_date").pivot("series_id", ids).agg(F.first("value"))

    def paths(self, ids: list[str] | None = None) -> DataFrame:
        """(world, series_id, obs_date, known, value), as of Worlds: one world, named by its cutoff."""
        return self.history(ids).select(F.lit(str(self.as_of)).alias("world"), "series_id", "obs_date", F.col("knowable_at").alias("known"), "value")

    def value(self, series_id: str) -> float | None:
        rows = self.latest([series_id]).where(F.col("value").isNotNull() & ~F.isnan("value")).select("value").collect()
        return rows[0].value if rows else None


def validity(obs: DataFrame, series_ids: list[str] | None = None) -> DataFrame:
    """Vintages with `known` and `superseded`, the days from which and up to which (excluded) each is what is known of its period; null while it stands.

    Of vintages of one day the last in order of value stands. The window holds the vintages of one period.
    """
    rows = obs if series_ids is None else obs.where(F.col("series_id").isin(series_ids))
    rows = rows.withColumn("known", knowable_at())
    w = Window.partitionBy("series_id", "obs_date").orderBy("known", "value")
    return rows.withColumn("superseded", F.lead("known").over(w)).where("superseded is null or superseded > known")


class Worlds:
    """What was known at each of many cutoffs, as one plan whatever their number: `world` is the cutoff's day as text.

    A vintage is valid for a span of cutoffs, so the cutoffs are joined to spans by `joins.within_spans`; nothing is planned or
    read once for each cutoff.
    """

    def __init__(self, obs: DataFrame, cutoffs: list[str] | DataFrame, bin_days: int = 32):
        self.obs, self.bin_days = obs, bin_days
        if isinstance(cutoffs, DataFrame):
            self.cutoffs = cutoffs.select(F.col("cutoff").cast("date").alias("cutoff")).distinct()
        else:
            self.cutoffs = obs.sparkSession.createDataFrame([(str(c),) for c in dict.fromkeys(map(str, cutoffs))], "cutoff string").select(F.col("cutoff").cast("date").alias("cutoff"))

    def paths(self, ids: list[str] | None = None) -> DataFrame:
        from vintagelake.operators.joins import within_spans

        out = within_spans(self.cutoffs, "cutoff", validity(self.obs, ids).select("series_id", "obs_date", "known", "superseded", "value"), "known", "superseded", self.bin_days)
        return out.select(F.col("cutoff").cast("string").alias("world"), "series_id", "obs_date", "known", "value")
