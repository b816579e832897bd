"""First passages of a chain of regimes, and simulated paths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def first_passage(move: np.ndarray, adverse: list[int], steps: int) -> np.ndarray:
    """For each state, the probability to be in an adverse one within so many steps; adverse states count as entered."""
    held = move.copy()
    for a in adverse:
        held[a] = np.eye(len(move))[a]
    return np.linalg.matrix_power(held, steps)[:, adverse].sum(1)


def simulate(spark: SparkSession, means: list[float], vols: list[float], move: np.ndarray, start: list[float], horizons: list[float], paths: int, seed: int, shock: dict | None = None, per_year: int = 252) -> DataFrame:
    """(horizon, path, terminal, max_drawdown, under_water): paths of log returns whose regime switches, with rare shocks on top.

    A path's numbers depend on seed, horizon and path only, so they are the same however the paths are partitioned.
    A shock of severity 1 - exp(-x), x from a generalized Pareto law, falls over `onset` days and comes back over `recovery`.
    """
    cumulative, first = np.cumsum(move, 1), np.cumsum(start)

    def run(batches):
        for pdf in batches:
            rows = []
            for horizon, path in zip(pdf["horizon"], pdf["path"], strict=True):
                rng = np.random.default_rng([seed, int(horizon * 1000), int(path)])
                n = max(1, round(horizon * per_year))
                u, z = rng.random(n), rng.standard_normal(n)
                s = int(np.searchsorted(first, u[0]))
                states = np.empty(n, int)
                for t in range(n):
                    s = s if t == 0 else min(int(np.searchsorted(cumulative[s], u[t])), len(means) - 1)
                    states[t] = min(s, len(means) - 1)
                r = np.take(means, states) / per_year + np.take(vols, states) / per_year**0.5 * z
                if shock:
                    for at in np.flatnonzero(rng.random(n) < shock["rate"] / per_year):
                        v = rng.random()
                        x = shock["threshold"] + shock["scale"] / shock["shape"] * ((1 - v) ** -shock["shape"] - 1)
                        fall = math.log1p(-min(x, 0.95))
                        r[at : at + shock["onset"]] += fall / shock["onset"]
                        r[at + shock["onset"] : at + shock["onset"] + shock["recovery"]] -= fall / shock["recovery"]
                level = np.exp(np.cumsum(r))
                peak = np.maximum.accumulate(np.maximum(level, 1.0))
                rows.append((horizon, path, float(level[-1]), float((1 - level / peak).max()), float((level < peak).mean())))
            yield pd.DataFrame(rows, columns=["horizon", "path", "terminal", "max_drawdown", "under_water"])

    todo = spark.range(paths).withColumnRenamed("id", "path").select(F.explode(F.array(*map(F.lit, map(float, horizons)))).alias("horizon"), "path")
    return todo.mapInPandas(run, "horizon double, path bigint, terminal double, max_drawdown double, under_water double")
