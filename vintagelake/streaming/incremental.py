"""Structured Streaming over the same tables: ingestion by files, newest figures, windows of events, replays left out.

Late figures are no late data here: each is a vintage with its own date of publication, and the fact table keeps them
all. Watermarks bound the state of windows and of replays only.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vintagelake.operators.pit import knowable_at, newest
from vintagelake.sources.sinks import upsert


def files(spark: SparkSession, folder: str, schema, per_trigger: int = 1_000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def run_available(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs on what is there now into Parquet under folder, and ends."""
    q = df.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def ingest(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Micro-batches appended to a keyed table; a batch that runs twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(batch.sparkSession, folder, batch, keys, order)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def newest_figures(stream: DataFrame, folder: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Keeps the newest known period of each series up to date: each batch's newest rows, few for a series, are appended to those held."""
    order = F.struct("obs_date", "knowable_at")

    def write(batch: DataFrame, _: int) -> None:
        known = batch.withColumn("knowable_at", knowable_at()).where(F.col("knowable_at") <= F.lit(as_of).cast("date"))
        latest = newest(known, ["series_id"], F.desc("obs_date"), F.desc("knowable_at")).withColumn("place", order)
        if not latest.isEmpty():
            upsert(batch.sparkSession, folder, latest, ["series_id"], "place")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class NewestFigure(StatefulProcessor):
    """A key's newest figure, held as state: the latest period, of one period the vintage that was known last, of one day the larger value.

    A row goes out when the figure changes, so replays and late figures of earlier periods send nothing. A key without a newer
    figure for `keep_ms` is told once as stale by a timer and forgotten.
    """

    KIND = "obs_date date, knowable_at date, value double"

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.KIND)
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues):
        held = tuple(self.newest.get()) if self.newest.exists() else None
        best = held
        for pdf in rows:
            pdf = pdf.dropna(subset=["value"])
            for row in zip(pdf["obs_date"], pdf["knowable_at"], pdf["value"], strict=True):
                if best is None or row > best:
                    best = row
        if best is None or best == held:
            return iter(())
        self.newest.update(best)
        if self.keep_ms:
            at = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
            if self.until.exists():
                self.handle.deleteTimer(self.until.get()[0])
            self.handle.registerTimer(at)
            self.until.update((at,))
        return iter([told(key[0], best, False)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last = tuple(self.newest.get())
        self.newest.clear()
        self.until.clear()
        return iter([told(key[0], last, True)])

    def close(self) -> None:
        pass


def told(series_id: str, figure: tuple, stale: bool):
    import pandas as pd

    return pd.DataFrame({"series_id": [series_id], "obs_date": [figure[0]], "knowable_at": [figure[1]], "value": [figure[2]], "stale": [stale]})


def newest_in_state(stream: DataFrame, keep_ms: int = 0) -> DataFrame:
    """(series_id, obs_date, knowable_at, value, stale): a row whenever a series' newest figure changes, from state keyed by series.

    Nothing that was written before is read again: a batch costs its own rows and the keys that it touches. keep_ms: how long a
    figure stands without a newer one before it is told as stale; 0 for ever. The session's state store must be RocksDB
    (`with_rocksdb`), which holds more keys than fit in memory.
    """
    rows = stream.withColumn("knowable_at", knowable_at()).select("series_id", "obs_date", "knowable_at", F.col("value").cast("double").alias("value"))
    kind = "series_id string, obs_date date, knowable_at date, value double, stale boolean"
    return rows.groupBy("series_id").transformWithStateInPandas(NewestFigure(keep_ms), kind, "Append", "ProcessingTime" if keep_ms else "None")


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, and run only for rows: a batch without any would follow the other as long as
    timers of processing time are set, so a run over what is there would not end. Timers go off with the next rows. The session's own
    settings are put back.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def windowed(stream: DataFrame, ts: str, key: str, value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum in tumbling or sliding windows of event time; a window is given out once it cannot change."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def without_replays(stream: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


__all__ = ["files", "ingest", "newest_figures", "newest_in_state", "run_available", "sessions", "windowed", "with_rocksdb", "without_replays"]
