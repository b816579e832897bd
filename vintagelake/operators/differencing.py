"""Fractional differencing of long series, and the unit-root test for all orders at once.

A convolution needs a bounded number of earlier rows, so a series is cut into blocks by row number and each row is sent to its
own block and, near its end, to the next. Blocks of all series are differenced side by side, for all orders in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vintagelake.operators import scan
from vintagelake.operators.windows import ffd_weights

#: Rows of a block besides the earlier ones that it is given.
ROWS = 1024
ORDERS = [round(0.05 * i, 2) for i in range(21)]
#: Coefficients of the response surface for the p-value of a unit-root test with a constant, below and above its break.
SURFACE_LOW, SURFACE_HIGH, SURFACE_BREAK = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61
#: Where the surface ends, and the polynomial of the normal law's upper tail.
SURFACE_MOST, SURFACE_LEAST = 2.74, -18.83
TAIL, TAIL_STEP = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429), 0.2316419


def numbered(df: DataFrame, by: str, value: str, span: int = scan.SPAN) -> DataFrame:
    """(series_id, pos, day, y): rows with a value, numbered from 0. Numbers come from the sizes of blocks of days, so no series is sorted whole."""
    cut = scan.blocks(df, by, [value], span)
    rows = cut.select("series_id", "at", F.posexplode(F.arrays_zip("day", "z")).alias("_i", "_r"))
    return rows.select("series_id", (F.col("at") + F.col("_i")).alias("pos"), F.col("_r.day").alias("day"), F.col("_r.z").alias("y"))


def overlapped(rows: DataFrame, need: int, size: int = ROWS) -> DataFrame:
    """(series_id, block, own, day, y): blocks of rows in order, led by up to `need` rows before them; own: where the block's rows begin."""
    size = max(size, need)
    block = F.floor(F.col("pos") / size)
    to = F.when(F.col("pos") % size >= size - need, F.array(block, block + 1)).otherwise(F.array(block))
    made = rows.withColumn("block", F.explode(to)).groupBy("series_id", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "day", "y"))).alias("rows"))
    own = F.size(F.filter("rows", lambda r: r.pos < F.col("block") * size))
    return made.select("series_id", "block", own.alias("own"), F.get("rows.pos", F.lit(0)).alias("first"), F.col("rows.day").alias("day"), F.col("rows.y").alias("y")).where(own < F.size("rows"))


def per_block(blocks: DataFrame, fn: Callable[[int, np.ndarray], list], kind: str) -> DataFrame:
    """(series_id, day, made): fn's list for each block from the number of rows before it and all its rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    full = StructType([blocks.schema["series_id"], blocks.schema["day"], *StructType.fromDDL(f"made {kind}").fields])
    made_type = to_arrow_schema(StructType.fromDDL(f"made {kind}")).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                own, y = part.column("own")[0].as_py(), part.column("y").flatten().to_numpy(zero_copy_only=False)
                days = pa.ListArray.from_arrays([0, len(y) - own], part.column("day").flatten().slice(own))
                yield pa.RecordBatch.from_arrays([part.column("series_id"), days, pa.array([fn(own, y)], made_type)], names=["series_id", "day", "made"])

    return blocks.select("series_id", "own", "day", "y").mapInArrow(run, full)


def differenced(own: int, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums of the last rows times the weights (newest first) for the block's rows; not a number where too few lie before."""
    out = np.full(len(y), np.nan)
    if len(y) >= len(w):
        out[len(w) - 1 :] = np.convolve(y, w, "valid")
    return out[own:]


def fractional(df: DataFrame, by: str, value: str, weights: list[float], size: int = ROWS) -> DataFrame:
    """(series_id, `by`, ffd): each row's differenced value, null before as many rows as weights are there."""
    w = np.asarray(weights)

    def fn(own: int, y: np.ndarray) -> list:
        return [None if np.isnan(v) else float(v) for v in differenced(own, y, w)]

    made = per_block(overlapped(numbered(df, by, value), len(w) - 1, size), fn, "array<double>")
    return made.select("series_id", F.explode(F.arrays_zip("day", "made")).alias("_r")).select("series_id", F.col("_r.day").alias(by), F.col("_r.made").alias("ffd"))


def normal_below(x: Column) -> Column:
    """The standard normal law's probability below x, to seven digits."""
    z = F.abs(x)
    t = 1 / (1 + TAIL_STEP * z)
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    upper = F.exp(-z * z / 2) / (2 * np.pi) ** 0.5 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def unit_root_p(t: Column) -> Column:
    """p-value of the augmented Dickey-Fuller statistic of a regression with a constant."""
    low, high = (sum((F.pow(t, F.lit(k)) * c for k, c in enumerate(s)), F.lit(0.0)) for s in (SURFACE_LOW, SURFACE_HIGH))
    return F.when(t > SURFACE_MOST, 1.0).when(t < SURFACE_LEAST, 0.0).otherwise(normal_below(F.when(t <= SURFACE_BREAK, low).otherwise(high)))


SUMS = ["n", "a", "b", "aa", "ab", "bb", "y", "ay", "by", "yy"]


def unit_roots(prices: DataFrame, threshold: float = 1e-3, longest: int = 252, orders: list[float] | None = None, size: int = ROWS) -> DataFrame:
    """(series_id, d, n, t, p) of the log price's fractional differences of each order: augmented Dickey-Fuller with a constant and one lag.

    A block gives the lagged products of all orders; their sums are normal equations, solved as columns.
    """
    grid = [(d, np.asarray(ffd_weights(d, threshold, longest))) for d in (orders or ORDERS)]

    def fn(own: int, y: np.ndarray) -> list:
        out = []
        for d, w in grid:
            x = differenced(0, y, w)
            now, before, two = x[2:], x[1:-1], x[:-2]
            keep = ~np.isnan(two)
            keep[: max(own - 2, 0)] = False
            a, b, v = before[keep], (before - two)[keep], (now - before)[keep]
            out.append({"d": float(d), **dict(zip(SUMS, map(float, (len(a), a.sum(), b.sum(), a @ a, a @ b, b @ b, v.sum(), a @ v, b @ v, v @ v)), strict=True))})
        return out

    rows = numbered(prices.where("value > 0").select("series_id", "obs_date", F.log("value").alias("_y")), "obs_date", "_y")
    made = per_block(overlapped(rows, max(len(w) for _, w in grid) + 1, size), fn, "array<struct<d:double," + ",".join(f"{s}:double" for s in SUMS) + ">>")
    sums = made.select("series_id", F.explode("made").alias("_m")).select("series_id", "_m.*").groupBy("series_id", "d").agg(*(F.sum(s).alias(s) for s in SUMS))
    n = F.col("n")
    centred = lambda p, x, y: F.col(p) - F.col(x) * F.col(y) / n
    aa, ab, bb, ay, by, yy = (centred(*x) for x in (("aa", "a", "a"), ("ab", "a", "b"), ("bb", "b", "b"), ("ay", "a", "y"), ("by", "b", "y"), ("yy", "y", "y")))
    sums = sums.where("n > 30").select("series_id", "d", F.col("n").cast("bigint").alias("n"), *(c.alias(f"_{k}") for k, c in zip(("aa", "ab", "bb", "ay", "by", "yy"), (aa, ab, bb, ay, by, yy), strict=True)))
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    slope = (F.col("_ay") * F.col("_bb") - F.col("_by") * F.col("_ab")) / det
    lagged = (F.col("_by") * F.col("_aa") - F.col("_ay") * F.col("_ab")) / det
    left = F.col("_yy") - slope * F.col("_ay") - lagged * F.col("_by")
    t = slope / F.sqrt(left / (F.col("n") - 3) * F.col("_bb") / det)
    return sums.withColumn("t", t).select("series_id", "d", "n", "t", unit_root_p(F.col("t")).alias("p"))


def least_differencing(prices: DataFrame, threshold: float = 1e-3, longest: int = 252, level: float = 0.05, orders: list[float] | None = None) -> DataFrame:
    """series_id, d, p, stationary: the smallest order whose fractional difference of the log price has no unit root; else the largest, marked."""
    rows = unit_roots(prices, threshold, longest, orders).withColumn("stationary", F.col("p") < level)
    rank = F.struct(F.col("stationary"), F.when(F.col("stationary"), -F.col("d")).otherwise(F.col("d")))
    return rows.groupBy("series_id").agg(F.max_by(F.struct("d", "p", "stationary"), rank).alias("_b")).select("series_id", "_b.*")
