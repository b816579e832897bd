"""Local linear trend of a log price: the Kalman filter as a scan of affine Gaussian elements, its variances from a grid.

A stretch of days maps any Gaussian state before it to one after it; such maps form a semigroup of five small arrays
(A, b, C, eta, J). Variances are shares of one scale that drops out of the filtered path, so the grid has two dimensions:
the noise's share of what a day adds besides the slope, and the slope's variance. All places of the grid are rows of one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.operators import scan
from vintagelake.operators.scan import Batch

#: Variance of the state before the first day, in units of the scale, and the days that the likelihood leaves out.
DIFFUSE, BURN = 1e6, 2
MOVE = np.array([[1.0, 1.0], [0.0, 1.0]])
#: Places of the coarse search: the noise's share, and the slope's variance by its decimal logarithm; steps of the fine one around the best.
SHARES, SLOPES = [0.01, *(round(0.1 * i, 1) for i in range(1, 10)), 0.99], [-8.0, -7.0, -6.0, -5.0, -4.0, -3.0, -2.0, -1.0]
FINE_SHARE, FINE_SLOPE, SIDE = 0.02, 0.25, 3


def spreads(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Noise (blocks), the state's own variances (blocks, 2, 2), and the state's mean before the first day."""
    noise, slope, begin = b.theta[:, 0], b.theta[:, 1], b.theta[:, 2]
    q = np.zeros((b.n, 2, 2))
    q[:, 0, 0], q[:, 1, 1] = 1 - noise, slope
    return noise, q, begin


def block_elements(b: Batch) -> dict:
    """A block's (A, b, C, eta, J): each day's own element joined on the right of those before it."""
    noise, q, _ = spreads(b)
    s = q[:, 0, 0] + noise
    gain = q[:, :, 0] / s[:, None]
    keep = np.eye(2) - gain[:, :, None] * np.array([1.0, 0.0])
    a1, c1 = keep @ MOVE, keep @ q
    toward = np.repeat(MOVE[0][None], b.n, 0) / s[:, None]
    j1 = toward[:, :, None] * MOVE[0]
    eye = np.eye(2)
    a, m, c, e, j = np.repeat(eye[None], b.n, 0), np.zeros((b.n, 2)), np.zeros((b.n, 2, 2)), np.zeros((b.n, 2)), np.zeros((b.n, 2, 2))
    for r in range(b.used.shape[1]):
        y, used = b.z[:, r, 0], b.used[:, r]
        m1, e1 = gain * y[:, None], toward * y[:, None]
        left = a1 @ np.linalg.inv(eye + c @ j1)
        right = np.swapaxes(a, 1, 2) @ np.linalg.inv(eye + j1 @ c)
        new = (
            left @ a,
            np.einsum("bij,bj->bi", left, m + np.einsum("bij,bj->bi", c, e1)) + m1,
            left @ c @ np.swapaxes(a1, 1, 2) + c1,
            np.einsum("bij,bj->bi", right, e1 - np.einsum("bij,bj->bi", j1, m)) + e,
            right @ j1 @ a + j,
        )
        a, m, c, e, j = (np.where(used.reshape(-1, *[1] * (x.ndim - 1)), x, old) for x, old in zip(new, (a, m, c, e, j), strict=True))
    return {"element": np.concatenate([x.reshape(b.n, -1) for x in (a, m, c, e, j)], 1)}


def block_starts(row: dict) -> dict:
    """The state's mean and variance before each block."""
    m, p, out = np.array([row["theta"][2], 0.0]), DIFFUSE * np.eye(2), []
    for x in row["items"]:
        out.append([*m, *p.ravel()])
        v = np.asarray(x["element"], float)
        a, b, c, e, j = v[:4].reshape(2, 2), v[4:6], v[6:10].reshape(2, 2), v[10:12], v[12:].reshape(2, 2)
        g = a @ np.linalg.inv(np.eye(2) + p @ j)
        m, p = g @ (m + p @ e) + b, g @ p @ a.T + c
        p = (p + p.T) / 2
    return {"block": [x["block"] for x in row["items"]], "before": out}


def filtered(b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Level and slope of each day, and the squared surprise and the log of its variance (0 for the days left out), from each block's start."""
    noise, q, _ = spreads(b)
    start = b.extra("before")
    m, p = start[:, :2], start[:, 2:].reshape(-1, 2, 2)
    rows = b.used.shape[1]
    state, squares, logs, counted = np.zeros((b.n, rows, 2)), np.zeros((b.n, rows)), np.zeros((b.n, rows)), np.zeros((b.n, rows), bool)
    for r in range(rows):
        used = b.used[:, r]
        m1, p1 = m @ MOVE.T, MOVE @ p @ MOVE.T + q
        v, f = b.z[:, r, 0] - m1[:, 0], p1[:, 0, 0] + noise
        gain = p1[:, :, 0] / f[:, None]
        m = np.where(used[:, None], m1 + gain * v[:, None], m)
        p = np.where(used[:, None, None], p1 - gain[:, :, None] * p1[:, :1, :], p)
        state[:, r] = m
        counted[:, r] = used & (b.at + r >= BURN)
        squares[:, r], logs[:, r] = np.where(counted[:, r], v * v / f, 0), np.where(counted[:, r], np.log(f), 0)
    return state, squares, logs, counted


def starts(cut: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks with parameters and the state before each: `before`."""
    rows = scan.with_parameters(cut, parameters, keys)
    made = scan.map_blocks(rows, [*keys, "block"], 1, block_elements, "element array<double>")
    return rows.join(scan.prefixes(made, parameters, keys, ["element"], block_starts, "before array<double>"), [*keys, "block"])


def likelihood(cut: DataFrame, parameters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loglik, scale) of the days up to each key's `until`, the scale being the likeliest one."""

    def fn(b: Batch) -> dict:
        _, squares, logs, counted = filtered(b)
        return {"s": squares.sum(1), "l": logs.sum(1), "n": counted.sum(1)}

    parts = scan.map_blocks(starts(cut, parameters, keys), [*keys, "block"], 1, fn, "s double, l double, n bigint")
    sums = parts.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("l").alias("l"), F.sum("n").alias("n"))
    scale = F.col("s") / F.col("n")
    return sums.select(*keys, (-0.5 * (F.col("n") * (F.log(2 * F.pi() * scale) + 1) + F.col("l"))).alias("loglik"), scale.alias("scale"))


def places(known: DataFrame, pairs: Column) -> DataFrame:
    """known (series_id, until, begin) with a row (share, slope, theta) for each place of the grid."""
    at = known.select("series_id", "until", "begin", F.explode(pairs).alias("_p")).select("series_id", "until", "begin", F.col("_p.share").alias("share"), F.col("_p.slope").alias("slope"))
    return at.withColumn("theta", F.array("share", F.pow(F.lit(10.0), "slope"), "begin"))


def best(cut: DataFrame, grid: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(series_id, share, slope, loglik, scale) of the likeliest place of each series; of equal ones to six digits the smallest."""
    keys = ["series_id", "share", "slope"]
    grid = store(grid, "trend-grid")
    made = likelihood(cut, grid, keys)
    row = F.struct("share", "slope", "loglik", "scale")
    top = made.groupBy("series_id").agg(F.max_by(row, F.struct(F.round("loglik", 6), -F.col("share"), -F.col("slope"))).alias("_b"))
    return store(top.select("series_id", "_b.*"), "trend-best")


def fit(cut: DataFrame, known: DataFrame, store: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(series_id, share, slope, loglik, scale): a coarse grid, then a fine one around its best place. known: series_id, until, begin."""
    pairs = F.array(*(F.struct(F.lit(a).alias("share"), F.lit(s).alias("slope")) for a, s in product(SHARES, SLOPES)))
    near = best(cut, places(known, pairs), store)
    steps = range(-SIDE, SIDE + 1)
    share = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(F.col("share") + i * FINE_SHARE, 4))) for i in steps]
    around = F.array_distinct(F.array(*(F.struct(a.alias("share"), (F.col("slope") + j * FINE_SLOPE).alias("slope")) for a in share for j in steps)))
    return best(cut, places(known.join(near.select("series_id", "share", "slope"), "series_id").select("*"), around), store)


def cut_prices(prices: DataFrame, store: Callable[[DataFrame, str], DataFrame], span: int) -> DataFrame:
    return store(scan.blocks(prices.where("value > 0").select("series_id", "obs_date", F.log("value").alias("y")), "obs_date", ["y"], span), "trend-blocks")


def known_starts(cut: DataFrame, fit_rows: int) -> DataFrame:
    """(series_id, begin, until): the first log price, and the day of the last row to fit on, for series that have it."""
    begin = cut.where("first").select("series_id", F.col("z")[0].alias("begin"))
    last = F.get("day", (F.lit(fit_rows - 1) - F.col("at")).cast("int"))
    until = cut.where((F.col("at") < fit_rows) & (F.col("at") + F.size("day") >= fit_rows)).select("series_id", last.alias("until"))
    return begin.join(until, "series_id")


def fitted(prices: DataFrame, store: Callable[[DataFrame, str], DataFrame], fit_rows: int = 504, span: int = scan.SPAN) -> DataFrame:
    """(series_id, share, slope, loglik, scale) from the first fit_rows rows of each series; a series with fewer gives none."""
    cut = cut_prices(prices, store, span)
    return fit(cut, store(known_starts(cut, fit_rows), "trend-known"), store)


def filtered_trend(prices: DataFrame, store: Callable[[DataFrame, str], DataFrame], fit_rows: int = 504, span: int = scan.SPAN, frozen: tuple[float, float] | None = None) -> DataFrame:
    """series_id, obs_date, level, slope of the log price, filtered under variances from the first fit_rows rows, so the rest sees no later figure.

    frozen: share and slope that were fitted before, in place of a fit. A series with fewer rows gives none. Prices that are not positive
    are left out.
    """
    cut = cut_prices(prices, store, span)
    known = store(known_starts(cut, fit_rows), "trend-known")
    places_ = known.select("series_id", F.lit(frozen[0]).alias("share"), F.lit(frozen[1]).alias("slope")) if frozen else fit(cut, known, store)
    chosen = places_.join(known.select("series_id", "begin"), "series_id")
    parameters = chosen.select("series_id", F.lit("9999-12-31").cast("date").alias("until"), F.array("share", F.pow(F.lit(10.0), "slope"), "begin").alias("theta"))

    def fn(b: Batch) -> dict:
        state = filtered(b)[0]
        return {"made": [[{"day": int(d), "level": float(m[0]), "slope": float(m[1])} for d, m in zip(b.day[i][b.used[i]], state[i][b.used[i]], strict=True)] for i in range(b.n)]}

    out = scan.map_blocks(starts(cut, store(parameters, "trend-frozen"), ["series_id"]), ["series_id"], 1, fn, "made array<struct<day:int,level:double,slope:double>>")
    return out.select("series_id", F.explode("made").alias("_m")).select("series_id", F.date_from_unix_date("_m.day").alias("obs_date"), "_m.level", "_m.slope")
