"""Recursions along a long series as associative scans: blocks of days side by side, then a prefix over the blocks' few products.

A step of a filter is an element of a semigroup: what it does to any state before it. The product of a block's elements
does not need what came before, so all blocks of all series run at once; the products of a series, one for each block, are
put in order, and each block then gets the state that it starts from. Blocks are spans of the calendar, so no series is ever
sorted or numbered as a whole. Many sets of parameters (cutoffs, places of a grid) share the blocks in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Days that a block spans.
SPAN = 256
#: Blocks that a task works on at a time.
AT_ONCE = 64


def blocks(df: DataFrame, by: str, values: list[str], span: int = SPAN) -> DataFrame:
    """(series_id, block, at, first, day, z) of rows with all values: the days of a block in order and their values, row by row.

    at: the series' rows before the block; first marks the block that has none before it. A series has one row a day at most.
    """
    rows = df.na.drop(subset=values).select("series_id", F.floor(F.unix_date(by) / span).alias("block"), F.struct(F.col(by).alias("day"), F.array(*(F.col(v).cast("double") for v in values)).alias("z")).alias("row"))
    made = rows.groupBy("series_id", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    sizes = made.select("series_id", "block", F.size("rows").alias("n"))  # a row a block, so this window is short
    at = F.coalesce(F.sum("n").over(Window.partitionBy("series_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = made.join(sizes.select("series_id", "block", at.alias("at")), ["series_id", "block"])
    return out.select("series_id", "block", "at", (F.col("at") == 0).alias("first"), F.col("rows.day").alias("day"), F.flatten(F.col("rows.z")).alias("z"))


def with_parameters(cut: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each block and set of parameters that reads it. parameters: keys (series_id among them), until, theta."""
    return cut.join(parameters.select(*keys, "until", "theta"), "series_id").where(F.col("until") >= F.get("day", F.lit(0)))


class Batch:
    """Blocks as padded arrays: z (blocks, rows, d), used (blocks, rows): rows up to the block's `until`; theta (blocks, n), first, day."""

    def __init__(self, part: pa.RecordBatch, d: int):
        col = lambda c: part.column(part.schema.names.index(c))
        flat, ends = np.asarray(col("z").flatten(), float), np.asarray(col("z").offsets) // d
        days = np.asarray(col("day").flatten().cast(pa.int32()))
        flat, base = flat.reshape(-1, d), ends[0]
        sizes = np.diff(ends)
        self.n, rows = len(sizes), int(sizes.max(initial=0))
        at = np.arange(rows)
        inside = at[None] < sizes[:, None]
        pick = np.where(inside, (ends[:-1] - base)[:, None] + at[None], 0)
        self.z, self.day = flat[pick], days[pick]
        until = np.asarray(col("until").cast(pa.int32()))
        self.used = inside & (self.day <= until[:, None])
        self.z = np.where(self.used[..., None], self.z, 0.0)
        self.theta = np.asarray(col("theta").flatten(), float).reshape(self.n, -1)
        self.first = np.asarray(col("first").to_numpy(zero_copy_only=False), bool)
        self.at = np.asarray(col("at").to_numpy(zero_copy_only=False))
        self.part = part

    def extra(self, name: str) -> np.ndarray:
        """An array column of the same length in all blocks."""
        return np.asarray(self.part.column(self.part.schema.names.index(name)).flatten(), float).reshape(self.n, -1)


def map_blocks(df: DataFrame, keep: list[str], d: int, fn: Callable[[Batch], dict[str, list]], schema: str) -> DataFrame:
    """`keep` and the columns that fn makes of the blocks, a row for each block."""
    new = StructType.fromDDL(schema)
    full = StructType([*(df.schema[c] for c in keep), *new.fields])
    kinds = {f.name: f.type for f in to_arrow_schema(new)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.slice(at, AT_ONCE).columns], names=batch.schema.names)
                made = fn(Batch(part, d))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(list(x), kinds[c]) for c, x in made.items())], names=[*keep, *made])

    return df.mapInArrow(run, full)


def map_keys(df: DataFrame, keep: list[str], fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """`keep` and what fn makes of each row, a small one for each key."""
    new = StructType.fromDDL(schema)
    full = StructType([*(df.schema[c] for c in keep), *new.fields])
    kinds = {f.name: f.type for f in to_arrow_schema(new)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array([m[c] for m in made], kinds[c]) for c in kinds)], names=[*keep, *kinds])

    return df.mapInArrow(run, full)


def prefixes(products: DataFrame, parameters: DataFrame, keys: list[str], element: list[str], fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """(keys, block, ...) what each block starts from: fn gets a key's products in order (`items`) and its theta, and gives arrays with an entry a block.

    A key has one product for each SPAN days, so its row is small however long the days' own rows are.
    """
    gathered = products.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", *element))).alias("items")).join(parameters.select(*keys, "theta"), keys)
    columns = [f.split()[0] for f in schema.split(", ")]
    made = map_keys(gathered, keys, fn, ", ".join(f"{f.split()[0]} array<{f.split(' ', 1)[1]}>" for f in ["block bigint", *schema.split(", ")]))
    return made.select(*keys, F.explode(F.arrays_zip("block", *columns)).alias("_e")).select(*keys, "_e.*")
