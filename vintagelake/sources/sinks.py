"""Writers: keyed upserts, appended logs, chunks for transport, write-once artifacts."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagelake.operators.reshape import finite


#: Partition columns of a keyed table: the name of the batch that wrote a row, and the part that its key falls in.
BATCH, PART = "_batch", "_part"
#: Parts of a key's hash. A fixed value: tables that are written with it are read with it.
PARTS = 16


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = filesystem(spark, path)
    return fs.exists(p)


def numbers(spark: SparkSession, folder: str, column: str) -> list[int]:
    """Values of a numbered partition column, from the folder's listing."""
    fs, p = filesystem(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{column}="))


def one_for_each(rows: DataFrame, keys: list[str], order: str, *then: str) -> DataFrame:
    """One row for each key: the one with the largest `order`, of equal ones by `then`, then by a hash of the row. Combined in each task first."""
    columns = rows.columns
    rank = F.struct(F.col(order), *map(F.col, then), F.xxhash64(*columns))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_row"))
    return best.select(*(F.col(f"_row.`{c}`") for c in columns))


def batches(spark: SparkSession, folder: str) -> list[str]:
    """Names of the table's batches, oldest first: a number, and what tells apart those that were written at one time."""
    fs, p = filesystem(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(n.partition("=")[2] for n in names if n.startswith(f"{BATCH}="))


def part_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")


def add_batch(spark: SparkSession, folder: str, rows: DataFrame, keys: list[str], number: int) -> None:
    """Writes rows aside and moves them into the table in one step, under a name that no other writer has. No rows make no batch."""
    aside = f"{folder}/_aside-{uuid.uuid4().hex}"  # names that begin so are not read
    rows.withColumn(PART, part_of(keys)).write.partitionBy(PART).parquet(aside)
    fs, source = filesystem(spark, aside)
    if any(f.getPath().getName().startswith(f"{PART}=") for f in fs.listStatus(source)):
        _, target = filesystem(spark, f"{folder}/{BATCH}=b{number:012d}-{uuid.uuid4().hex}")
        if not fs.rename(source, target):
            raise OSError(f"could not move {aside} into {folder}")
    else:
        fs.delete(source, True)


def upsert(spark: SparkSession, folder: str, new: DataFrame, keys: list[str], order: str) -> DataFrame | None:
    """Adds rows to the keyed table under folder and returns the table as it is read then.

    The table is a log of batches: a batch is reduced to a row for each of its keys, written aside and moved in whole, so a batch that
    fails is not seen, nothing is rewritten, and writers that overlap neither share a folder nor lose anything. Reading takes
    each key's row with the largest `order`, of equal ones the one of the latest batch. The same rows once more change nothing.
    """
    add_batch(spark, folder, one_for_each(new, keys, order), keys, number_of(batches(spark, folder)) + 1)
    return current(spark, folder, keys, order)


def number_of(names: list[str]) -> int:
    return int(names[-1][1:13]) if names else 0


def current(spark: SparkSession, folder: str, keys: list[str], order: str, only: DataFrame | None = None) -> DataFrame | None:
    """The keyed table's rows, one for each key; None where nothing was written. only: keys to look up; the parts of the table without them are not read.

    `only` gives at most PARTS part numbers to the driver; a key's rows of all batches lie in one part.
    """
    names = batches(spark, folder)
    if not names:
        return None
    rows = spark.read.option("basePath", folder).parquet(*(f"{folder}/{BATCH}={n}" for n in names))
    if only is not None:
        rows = rows.where(F.col(PART).isin([r[0] for r in only.select(part_of(keys)).distinct().collect()])).join(only.select(*keys).distinct(), keys, "left_semi")
    return one_for_each(rows, keys, order, BATCH).drop(BATCH, PART)


def compacted(spark: SparkSession, folder: str, keys: list[str], order: str) -> int:
    """Writes the rows of the batches there are as one and removes these batches, no others. Returns how many they were.

    A batch that comes in meanwhile stays. A reader that has listed a batch before it goes must read again.
    """
    held = batches(spark, folder)
    if len(held) < 2:
        return 0
    rows = spark.read.option("basePath", folder).parquet(*(f"{folder}/{BATCH}={n}" for n in held))
    add_batch(spark, folder, one_for_each(rows, keys, order, BATCH).drop(BATCH, PART), keys, number_of(held))
    for n in held:
        fs, p = filesystem(spark, f"{folder}/{BATCH}={n}")
        fs.delete(p, True)
    return len(held)


#: What a payload row must be, by table: a name and a test for each rule.
RULES: dict[str, dict[str, Callable[[], Column]]] = {
    "observations": {
        "series_id": lambda: F.length(F.trim("series_id")) > 0,
        "value": lambda: finite(F.col("value")),
        "release_after_obs": lambda: F.col("release_date") >= F.col("obs_date"),
        "revision_after_release": lambda: F.coalesce("revision_date", "release_date") >= F.col("release_date"),
    },
    "factors": {"name": lambda: F.length(F.trim("name")) > 0, "score": lambda: F.col("score").between(0, 100)},
    "outputs": {"metric": lambda: F.length(F.trim("metric")) > 0, "value": lambda: finite(F.col("value"))},
    "regimes": {"probability": lambda: F.col("probability").between(0, 1)},
}


def validated(df: DataFrame, table: str) -> DataFrame:
    """df with `broken`: the names of the rules that a row does not meet; a rule that cannot be told is not met."""
    marks = [F.when(~F.coalesce(test(), F.lit(False)), name) for name, test in RULES[table].items()]
    return df.withColumn("broken", F.array_compact(F.array(*marks)))


def chunks(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """df with `chunk`: each key's rows in order, `size` to a chunk."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def payloads(heads: DataFrame, rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """keys, chunk, rows (an array of `size` at most) and the head's columns, which ride with chunk 0 alone; a head without rows has chunk 0 too."""
    rest = [c for c in rows.columns if c not in keys]
    parts = chunks(rows, keys, order, size).groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in rest if c not in order)))).alias("rows"))
    head = [c for c in heads.columns if c not in keys]
    both = parts.join(heads.withColumn("_known", F.lit(True)), keys, "full").withColumn("chunk", F.coalesce("chunk", F.lit(0)))
    return both.select(*keys, "chunk", "rows", *(F.when(F.col("chunk") == 0, F.col(c)).alias(c) for c in head))


def batched(df: DataFrame, folder: str, rows: int = 900) -> None:
    """Files of at most so many rows."""
    df.write.option("maxRecordsPerFile", rows).mode("append").parquet(folder)


def append_log(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


class ArtifactStore:
    """Fitted parameters as JSON, one row for each (name, version, fit_date), written once; the latest is by version, then date."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame | None:
        if not exists(self.spark, self.folder):
            return None
        return self.spark.read.schema("name string, version string, fit_date date, sha256 string, body string").json(self.folder)

    def put(self, name: str, version: str, fit_date: str, document: dict) -> str:
        """The digest. The same document once more is nothing new; another one under the same key raises."""
        body = json.dumps(document, sort_keys=True, separators=(",", ":"))
        digest = hashlib.sha256(body.encode()).hexdigest()
        rows = self.rows()
        held = [] if rows is None else rows.where((F.col("name") == name) & (F.col("version") == version) & (F.col("fit_date") == fit_date)).limit(1).collect()
        if held and held[0].sha256 != digest:
            raise ValueError(f"{name} {version} {fit_date} is already written with another content")
        if not held:
            row = self.spark.createDataFrame([(name, version, fit_date, digest, body)], "name string, version string, fit_date string, sha256 string, body string")
            row.withColumn("fit_date", F.to_date("fit_date")).coalesce(1).write.mode("append").json(self.folder)
        return digest

    def latest(self, name: str, as_of: str | None = None) -> dict | None:
        """The latest document under a name; of those fitted at or before as_of, if given."""
        rows = self.rows()
        if rows is not None and as_of is not None:
            rows = rows.where(F.col("fit_date") <= F.lit(as_of).cast("date"))
        found = [] if rows is None else latest_artifacts(rows.where(F.col("name") == name)).collect()
        return json.loads(found[0].body) if found else None


def latest_artifacts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.max_by(F.struct("version", "fit_date", "body"), F.struct("version", "fit_date")).alias("a")).select("name", "a.*")


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small result as a table for reports; beyond `most` rows it raises rather than cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: aggregate first")
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.4g}" if isinstance(c, float) else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def archive_paths(paths: DataFrame, folder: str, asset: str, as_of: str, version: str) -> DataFrame:
    """Simulated paths under a key that is written once: the same key again keeps what is there. Returns what is stored.

    Rows are written aside and moved to the key's place in one step; where another writer was first, its rows stay.
    """
    spark, at = paths.sparkSession, f"{folder}/asset={asset}/as_of={as_of}/version={version}"
    if not exists(spark, at):
        aside = f"{folder}/_aside-{uuid.uuid4().hex}"
        paths.write.parquet(aside)
        fs, target = filesystem(spark, at)
        _, source = filesystem(spark, aside)
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(source, target):
            fs.delete(source, True)
    return spark.read.schema(paths.schema).parquet(at)


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the archive, in order."""
    return spark.read.parquet(folder).select("asset", F.col("as_of").cast("date").alias("as_of"), "version").distinct().orderBy("asset", "as_of", "version")


def staged(spark: SparkSession, folder: str, read: Callable[[], DataFrame], ttl_hours: float) -> DataFrame:
    """What read() gives, staged as Parquet: within the time to live from the stage, and from it too where reading fails.

    A stage is a folder named by the second it was begun; one without Spark's mark of success is not looked at.
    """
    done = [n for n in numbers(spark, folder, "at") if exists(spark, f"{folder}/at={n}/_SUCCESS")]
    newest = lambda n: spark.read.parquet(f"{folder}/at={n}")
    now = int(time.time())
    if done and now - done[-1] < ttl_hours * 3600:
        return newest(done[-1])
    try:
        read().write.parquet(f"{folder}/at={max(now, done[-1] + 1 if done else 0)}")
    except Exception:
        if not done:
            raise
        return newest(done[-1])
    return newest(numbers(spark, folder, "at")[-1])


def report_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line_no, line): a result as the lines of a Markdown table, in order; doubles with four digits after the point."""
    shown = [F.when(F.col(c).isNull(), "").otherwise(F.format_string("%.4f", c) if kind in ("double", "float") else F.col(c).cast("string")) for c, kind in df.dtypes]
    body = df.select(F.row_number().over(Window.orderBy(*order)).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *shown), F.lit(" |")).alias("line"))
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join(["---"] * len(df.columns)) + " |"]
    top = df.sparkSession.createDataFrame(list(enumerate(head)), "line_no int, line string")
    return top.union(body.select((F.col("n") + 1).alias("line_no"), "line"))
