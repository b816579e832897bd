"""Windows over the rows of a series, causal unless the name says forward. Null means missing; a window without enough values gives null."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EVER = Window.unboundedPreceding


def ordered(keys: list[str], by: str):
    return Window.partitionBy(*keys).orderBy(by)


def rolling(agg, col: Column, w, n: int, at_least: int | None = None) -> Column:
    """agg over the last n rows, this one included, where at least `at_least` (default n) of them hold a value."""
    over = w.rowsBetween(1 - n, 0)
    return F.when(F.count(col).over(over) >= (n if at_least is None else at_least), agg(col).over(over))


def expanding(agg, col: Column, w, at_least: int = 1) -> Column:
    over = w.rowsBetween(EVER, 0)
    return F.when(F.count(col).over(over) >= at_least, agg(col).over(over))


def ffill(col: Column, w) -> Column:
    return F.last(col, ignorenulls=True).over(w.rowsBetween(EVER, 0))


def expanding_z(col: Column, w, at_least: int, sample: bool, limit: float | None) -> Column:
    """Distance from the running mean in running standard deviations, cut at the limit; null for no spread."""
    sd = expanding(F.stddev_samp if sample else F.stddev_pop, col, w, at_least)
    z = (col - expanding(F.avg, col, w, at_least)) / F.nullif(sd, F.lit(0.0))
    return z if limit is None else F.when(z.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))


def log_return(col: Column, w, n: int = 1) -> Column:
    return F.log(col / F.lag(col, n).over(w))


def change(col: Column, w, n: int = 1) -> Column:
    return col - F.lag(col, n).over(w)


def rolling_corr(x: Column, y: Column, w, n: int, at_least: int) -> Column:
    """Correlation of the pairs in the last n rows where both sides are known."""
    over = w.rowsBetween(1 - n, 0)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    flat = (F.max(x).over(over) == F.min(x).over(over)) | (F.max(y).over(over) == F.min(y).over(over))
    return F.when((F.count(x).over(over) >= at_least) & ~flat, F.corr(x, y).over(over))


def rolling_median(col: Column, w, n: int, at_least: int) -> Column:
    over = w.rowsBetween(1 - n, 0)
    return F.when(F.count(col).over(over) >= at_least, F.percentile(col, F.lit(0.5)).over(over))


def drawdown(col: Column, w, n: int | None = None) -> Column:
    """Relative distance below the highest value so far, or of the last n rows."""
    return col / F.max(col).over(w.rowsBetween(EVER if n is None else 1 - n, 0)) - 1


def seen_before(flag: Column, keys: list[str], day: str, days: int) -> Column:
    """Whether the flag was set in the `days` days before, this day excluded."""
    w = Window.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    return F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1


def edge(flag: Column, w) -> Column:
    """Where the flag turns on; before the first row it is off."""
    return flag & ~F.lag(flag, 1, False).over(w)


def forward_max(col: Column, w, n: int) -> Column:
    """Largest of the next n rows, this one excluded, where all n exist. For labels only: it looks ahead."""
    over = w.rowsBetween(1, n)
    return F.when(F.count(F.lit(1)).over(over) == n, F.max(col).over(over))


def forward_min(col: Column, w, n: int) -> Column:
    """Smallest of the next rows, up to n. For evaluation only: it looks ahead."""
    return F.min(col).over(w.rowsBetween(1, n))


def bipower_variation(r: Column, w, n: int) -> Column:
    """Mean product of neighbouring absolute returns over the window: variance without jumps."""
    return rolling(F.sum, F.abs(r) * F.abs(F.lag(r).over(w)), w, n, n - 2) / F.lit(float(n - 2))


def running_ols(x: Column, y: Column, w, at_least: int) -> dict[str, Column]:
    """beta, alpha, r2 and sigma of y on x over all rows so far with both."""
    over = w.rowsBetween(EVER, 0)
    both = x.isNotNull() & y.isNotNull()
    n = F.count(F.when(both, 1)).over(over)
    beta, alpha = F.regr_slope(y, x).over(over), F.regr_intercept(y, x).over(over)
    sxx, syy, sxy = (f.over(over) for f in (F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)))
    enough = (n >= at_least) & (sxx > 0)
    r2 = F.when(syy > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sxy * sxy / (sxx * syy))))
    sigma = F.sqrt(F.greatest(F.lit(0.0), syy - beta * sxy) / F.nullif(n - 2, F.lit(0)))
    return {k: F.when(enough, v) for k, v in (("beta", beta), ("alpha", alpha), ("r2", r2), ("sigma", sigma))}


def ffd_weights(d: float, least: float, longest: int) -> list[float]:
    """Weights of fractional differencing of order d, newest first, until they are small or as many as allowed."""
    out = [1.0]
    while len(out) < longest and abs(nxt := -out[-1] * (d - len(out) + 1) / len(out)) >= least:
        out.append(nxt)
    return out


def ffd_weight_rows(orders: DataFrame, d: str, least: float, longest: int) -> DataFrame:
    """orders with a row (k, w) for each weight of its order in column d, up to the first small one."""
    step = lambda acc, j: F.concat(acc, F.array(-F.element_at(acc, -1) * (F.col(d) - j + 1) / j))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(longest - 1)), F.array(F.lit(1.0)), step)
    rows = orders.select(*orders.columns, F.posexplode(made).alias("k", "w"))
    w = Window.partitionBy(d).orderBy("k").rowsBetween(EVER, 0)
    return rows.withColumn("_least", F.min(F.abs("w")).over(w)).where(F.col("_least") >= least).drop("_least")


def islands(df: DataFrame, keys: list[str], by: str, flag: str) -> DataFrame:
    """Numbers the runs of rows with the same flag: column `island`."""
    w = ordered(keys, by)
    start = F.when(F.col(flag).eqNullSafe(F.lag(flag).over(w)), 0).otherwise(1)
    return df.withColumn("_start", start).withColumn("island", F.sum("_start").over(w.rowsBetween(EVER, 0))).drop("_start")


def segmented_index(df: DataFrame, keys: list[str], by: str, growth: Column, restart: Column, out: str) -> DataFrame:
    """exp of the running sum of growth, begun anew at 1 where restart holds or on the first row."""
    w = ordered(keys, by)
    df = df.withColumn("_restart", F.coalesce(restart, F.lit(True)).cast("int")).withColumn("_growth", F.when(F.col("_restart") == 1, 0.0).otherwise(growth))
    df = df.withColumn("segment", F.sum("_restart").over(w.rowsBetween(EVER, 0)))
    inner = Window.partitionBy(*keys, "segment").orderBy(by).rowsBetween(EVER, 0)
    # Figures made of wealth fall on ties of their last digit, so it is right to its own last one: what is above 2**-40 adds up without rounding, and one Newton step mends exp.
    grid, g = 2.0**40, F.col("_growth")
    df = df.withColumn("_high", F.rint(g * grid) / grid).withColumn("_low", F.when(F.abs(g) < 4096, g - F.col("_high")).otherwise(0.0))
    df = df.withColumn("_total", F.sum("_high").over(inner) + F.sum("_low").over(inner)).withColumn(out, F.exp("_total"))
    step = F.when(F.abs("_total") < 1, F.col(out) * (F.col("_total") - F.log(out))).otherwise(0.0)
    return df.withColumn(out, F.col(out) + step).drop("_restart", "_growth", "_high", "_low", "_total")


def midranks(values: np.ndarray) -> np.ndarray:
    """Share of strictly earlier values below each one, ties counting half; 0.5 for the first.

    Counted for halves of blocks of doubling size: what the left half holds below a value of the right one, by one
    binary search over all blocks. So the work is n log(n)**2 and the memory linear.
    """
    n = len(values)
    _, rank = np.unique(values, return_inverse=True)
    at, twice, size = np.arange(n), np.zeros(n, np.int64), 1
    while size < n:
        block, right = at // (2 * size), at // size % 2 == 1
        keys = block * (n + 1) + rank
        left = np.sort(keys[~right])
        begin = np.searchsorted(left, block[right] * (n + 1))
        twice[right] += np.searchsorted(left, keys[right]) + np.searchsorted(left, keys[right], "right") - 2 * begin
        size *= 2
    return np.where(at > 0, twice / 2 / np.maximum(at, 1), 0.5)


def expanding_midrank(df: DataFrame, key: str, by: str, value: str, out: str) -> DataFrame:
    """`midranks` of each series in order of `by`. Series lie side by side in their tasks; a task holds one series' numbers. Null values have no rank."""
    kind = df.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, kind="stable")
        return pd.DataFrame({key: pdf[key], by: pdf[by], value: pdf[value], out: midranks(pdf[value].to_numpy(float))})

    return df.where(F.col(value).isNotNull()).select(key, by, value).groupBy(key).applyInPandas(run, f"{key} {kind}, {by} date, {value} double, {out} double")


def nested(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns in order of horizon, each at least as large as those before."""
    return df.withColumns({c: F.greatest(*columns[: i + 1]) for i, c in enumerate(columns) if i})
