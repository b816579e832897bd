"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that one step of a Python operator holds at a time.
STEP_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new one on a local master; on a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """The folder of the application's tables inside the shared one."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Removes the tables that operators have written for this application; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts stay near STEP_CHARS, with those texts; a null text is empty."""
    for batch in batches:
        column = batch.column(text)
        start, held = 0, 0
        sizes = [x or 0 for x in pc.binary_length(column).to_pylist()]
        for i, n in enumerate(sizes):
            if held and held + n > STEP_CHARS:
                part = batch.slice(start, i - start)
                yield part, [x or "" for x in part.column(text).to_pylist()]
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            part = batch.slice(start)
            yield part, [x or "" for x in part.column(text).to_pylist()]


_HELD: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What a worker keeps from task to task under a key. It keeps one thing at a time, so that stages do not add up in it."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go(but: str | None) -> None:
    """Drops what is held under another key, and gives the memory back to the machine: a worker lives on through other stages."""
    if but not in _HELD and _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # no glibc
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(docs: DataFrame, keep: list[str], fn: Callable[[list[str]], dict], schema: str, text: str = "text", holds: str | None = None) -> DataFrame:
    """Adds the columns that fn makes of each slice of texts; only `keep` and the text are read. Order and count of rows stay.

    A column of `keep` that is named like a new one gives way to it. What a worker holds under another key than `holds` is let go.
    """
    new = StructType.fromDDL(schema)
    keep = [c for c in dict.fromkeys(keep) if c not in new.names]
    out = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])))
    full = StructType([*(out.schema[c] for c in keep), *new.fields])
    made_types = {f.name: f.type for f in to_arrow_schema(new)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)
        for part, texts in steps(batches, text):
            made = fn(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(x, made_types[c]) for c, x in made.items())], names=[*keep, *made])

    return out.mapInArrow(run, full)


def hash_part(column: str, modulus: int):
    """crc32 of an id's decimal text modulo `modulus`; a null id falls in part 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def bounded_ids(ids: DataFrame, bound: int, *columns: str) -> DataFrame:
    """At most `bound` rows, one for each doc_id, chosen by a hash of the id: the documented bound of a fit on labelled rows."""
    one = ids.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
