"""Hidden Markov chains: filtered posteriors, and fits by expectation and maximization, as scans over blocks of days.

A step of the filter multiplies a row of state weights by the moves and by the day's likelihoods, so a block is a small matrix.
Many fits (a series up to each of many cutoffs) are rows of one table of parameters and go through a round together.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.operators import scan
from vintagelake.operators.scan import Batch

TINY = 1e-300
#: Rows with the whole sample's moments that each state's first estimate is shrunk with.
SHRINK = 10.0
REGIMES = ["strong_bull", "bull", "neutral", "bear", "crisis"]


class Chain:
    """k states whose days are told apart by an emission over the columns of z. theta: start (k), moves (k, k), then the emission's own."""

    def __init__(self, states: int, width: int, stay: float = 1000.0):
        self.k, self.d, self.stay = states, width, stay

    def chain(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = self.k
        return theta[..., :k], theta[..., k : k + k * k].reshape(*theta.shape[:-1], k, k), theta[..., k + k * k :]

    def moves(self, counts: np.ndarray) -> np.ndarray:
        """Most likely moves under a prior by which states last."""
        m = counts + 1 + self.stay * np.eye(self.k)
        return m / m.sum(1, keepdims=True)

    def first_moves(self) -> tuple[np.ndarray, np.ndarray]:
        k = self.k
        return np.full(k, 1 / k), np.full((k, k), 0.02 / max(1, k - 1)) + np.eye(k) * (0.98 - 0.02 / max(1, k - 1))

    def log_like(self, rest: np.ndarray, z: np.ndarray) -> np.ndarray:
        """(blocks, rows, states) from the emission's parameters (blocks, n) and z (blocks, rows, d)."""
        raise NotImplementedError

    def maximized(self, sums: np.ndarray, old: np.ndarray | None) -> np.ndarray:
        """The emission's parameters from each state's weighted moments of (1, z), as (k, 1 + d, 1 + d)."""
        raise NotImplementedError

    def unit(self, rest: np.ndarray, z: np.ndarray) -> np.ndarray:
        """z as the emission measures it."""
        return z

    def reordered(self, rest: np.ndarray, order: list[int]) -> np.ndarray:
        """The emission's parameters with its states in another order."""
        raise NotImplementedError


class Gaussian(Chain):
    """Full covariances of the columns in each fit's own units: its parameters begin with their shift and scale. A ridge keeps covariances regular."""

    def parts(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        k, d = self.k, self.d
        lead = rest.shape[:-1]
        return rest[..., :d], rest[..., d : 2 * d], rest[..., 2 * d : 2 * d + k * d].reshape(*lead, k, d), rest[..., 2 * d + k * d :].reshape(*lead, k, d, d)

    def unit(self, rest, z):
        shift, scale, _, _ = self.parts(rest)
        return (z - shift[:, None]) / scale[:, None]

    def log_like(self, rest, z):
        _, _, mean, cov = self.parts(rest)
        off = self.unit(rest, z)[:, :, None, :] - mean[:, None]
        inner = np.einsum("brki,bkij,brkj->brk", off, np.linalg.inv(cov), off)
        return -0.5 * (inner + np.linalg.slogdet(cov)[1][:, None] + self.d * math.log(2 * math.pi))

    def maximized(self, sums, old):
        weight = sums[:, 0, 0] + 1e-9
        mean = sums[:, 0, 1:] / weight[:, None]
        cov = sums[:, 1:, 1:] / weight[:, None, None] - mean[:, :, None] * mean[:, None]
        return np.concatenate([old[: 2 * self.d], mean.ravel(), (cov + 1e-3 * np.eye(self.d)).ravel()])

    def reordered(self, rest, order):
        shift, scale, mean, cov = self.parts(rest)
        return np.concatenate([shift, scale, mean[order].ravel(), cov[order].ravel()])


class Regression(Chain):
    """The first column on the others: intercept and variance switch with the state, slopes do not."""

    def log_like(self, rest, z):
        k = self.k
        alpha, var, slopes = rest[:, :k], rest[:, k : 2 * k], rest[:, 2 * k :]
        left = z[:, :, 0] - np.einsum("brj,bj->br", z[:, :, 1:], slopes)
        return -0.5 * ((left[:, :, None] - alpha[:, None]) ** 2 / var[:, None] + np.log(2 * math.pi * var)[:, None])

    def moves(self, counts):
        m = counts + 0.1
        return m / m.sum(1, keepdims=True)

    def first_moves(self):
        k = self.k
        return np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1)) + np.eye(k) * (0.9 - 0.1 / max(1, k - 1))

    def spread(self, sums: np.ndarray, alpha: np.ndarray, slopes: np.ndarray) -> np.ndarray:
        n, y, x, yy, xy, xx = sums[:, 0, 0] + 1e-9, sums[:, 0, 1], sums[:, 0, 2:], sums[:, 1, 1], sums[:, 1, 2:], sums[:, 2:, 2:]
        total = yy + alpha**2 * n + np.einsum("i,kij,j->k", slopes, xx, slopes) - 2 * alpha * y - 2 * xy @ slopes + 2 * alpha * (x @ slopes)
        return np.maximum(total / n, 1e-9)

    def maximized(self, sums, old):
        """Intercepts, slopes by weighted normal equations, and variances, each with the newest of the others."""
        k = self.k
        w, slopes = 1 / old[k : 2 * k], old[2 * k :]
        alpha = (sums[:, 0, 1] - sums[:, 0, 2:] @ slopes) / (sums[:, 0, 0] + 1e-9)
        left = np.einsum("k,kij->ij", w, sums[:, 2:, 2:]) + 1e-9 * np.eye(len(slopes))
        slopes = np.linalg.solve(left, w @ sums[:, 1, 2:] - (w * alpha) @ sums[:, 0, 2:])
        return np.concatenate([alpha, self.spread(sums, alpha, slopes), slopes])

    def first(self, sums: np.ndarray) -> np.ndarray:
        """One line through all rows, and the variance of each band around it."""
        t = sums.sum(0)
        mean = t[0, 1:] / t[0, 0]
        inner = t[1:, 1:] - t[0, 0] * np.outer(mean, mean)
        slopes = np.linalg.solve(inner[1:, 1:] + 1e-9 * np.eye(len(mean) - 1), inner[0, 1:])
        alpha = np.full(self.k, mean[0] - mean[1:] @ slopes)
        return np.concatenate([alpha, self.spread(sums, alpha, slopes), slopes])

    def reordered(self, rest, order):
        k = self.k
        return np.concatenate([rest[:k][order], rest[k : 2 * k][order], rest[2 * k :]])


def likelihoods(batch: Batch, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, move, rest = chain.chain(batch.theta)
    logs = chain.log_like(rest, batch.z)
    top = logs.max(2, keepdims=True)
    return start, move, np.exp(logs - top), np.where(batch.used, top[..., 0], 0.0)


def block_products(chain: Chain) -> Callable[[Batch], dict]:
    """A block's matrix, scaled, and the log of the scale."""

    def fn(b: Batch) -> dict:
        _, move, like, top = likelihoods(b, chain)
        eye = np.eye(chain.k)
        out, scale = np.repeat(eye[None], b.n, 0), top.sum(1)
        begun = ~b.first
        for r in range(b.used.shape[1]):
            step = np.where(begun[:, None, None], move, eye) * like[:, r, None]
            out = np.where(b.used[:, r, None, None], out @ step, out)
            begun |= b.used[:, r]
            size = np.maximum(out.max((1, 2)), TINY)
            out, scale = out / size[:, None, None], scale + np.log(size)
        return {"product": out.reshape(b.n, -1), "scale": scale}

    return fn


def block_starts(chain: Chain) -> Callable[[dict], dict]:
    """State weights before each block, from the blocks before it, and after it, from those behind it."""

    def fn(row: dict) -> dict:
        start, _, _ = chain.chain(np.asarray(row["theta"], float))
        items = row["items"]
        mats = [np.asarray(x["product"], float).reshape(chain.k, chain.k) for x in items]
        ahead, p = [], start
        for m in mats:
            ahead.append(p)
            p = p @ m
            p = p / max(p.sum(), TINY)
        behind, q = [], np.ones(chain.k)
        for m in reversed(mats):
            behind.append(q)
            q = m @ q
            q = q / max(q.sum(), TINY)
        return {"block": [x["block"] for x in items], "ahead": [x.tolist() for x in ahead], "behind": [x.tolist() for x in reversed(behind)]}

    return fn


def forward(b: Batch, start: np.ndarray, move: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered weights of each row from those before the block, and the logs of what each row had to be divided by."""
    p, begun = start, ~b.first
    out, logs = np.empty(like.shape), np.zeros(like.shape[:2])
    for r in range(like.shape[1]):
        q = np.where(begun[:, None], np.einsum("bi,bij->bj", p, move), p) * like[:, r]
        size = np.maximum(q.sum(1), TINY)
        p = np.where(b.used[:, r, None], q / size[:, None], p)
        logs[:, r] = np.where(b.used[:, r], np.log(size), 0.0)
        begun = begun | b.used[:, r]
        out[:, r] = p
    return out, logs


def block_sums(chain: Chain) -> Callable[[Batch], dict]:
    """A block's part of the expected moments, moves and first state, and of the log likelihood."""

    def fn(b: Batch) -> dict:
        _, move, like, top = likelihoods(b, chain)
        ahead, back = b.extra("ahead"), b.extra("behind")
        filtered, logs = forward(b, ahead, move, like)
        begun = np.cumsum(b.used, 1) - b.used > 0  # a row before it in the block
        k, rows = chain.k, like.shape[1]
        gamma, moves, first = np.zeros(like.shape), np.zeros((b.n, k, k)), np.zeros((b.n, k))
        for r in range(rows - 1, -1, -1):
            used = b.used[:, r]
            g = filtered[:, r] * back
            g = g / np.maximum(g.sum(1, keepdims=True), TINY)
            gamma[:, r] = np.where(used[:, None], g, 0)
            moved = used & (begun[:, r] | ~b.first)
            first += np.where((used & ~moved)[:, None], g, 0)
            tail = like[:, r] * back
            before = filtered[:, r - 1] if r else ahead
            pair = before[:, :, None] * move * tail[:, None]
            pair = pair / np.maximum(pair.sum((1, 2), keepdims=True), TINY)
            moves += np.where(moved[:, None, None], pair, 0)
            new = np.einsum("bij,bj->bi", move, tail)
            back = np.where(moved[:, None], new / np.maximum(new.sum(1, keepdims=True), TINY), back)
        z = chain.unit(chain.chain(b.theta)[2], b.z)
        one = np.concatenate([np.ones((*z.shape[:2], 1)), z], 2)
        sums = np.einsum("brk,bri,brj->bkij", gamma, one, one)
        return {"sums": np.concatenate([sums.reshape(b.n, -1), moves.reshape(b.n, -1), first], 1), "loglik": logs.sum(1) + top.sum(1)}

    return fn


def starts_of(cut: DataFrame, parameters: DataFrame, keys: list[str], chain: Chain) -> DataFrame:
    """(keys, block, ahead, behind) for every set of parameters; behind holds what the days up to its `until` tell."""
    made = scan.map_blocks(scan.with_parameters(cut, parameters, keys), [*keys, "block"], chain.d, block_products(chain), "product array<double>, scale double")
    return scan.prefixes(made, parameters, keys, ["product"], block_starts(chain), "ahead array<double>, behind array<double>")


def em_round(cut: DataFrame, parameters: DataFrame, keys: list[str], chain: Chain) -> DataFrame:
    """parameters after one round of expectation and maximization, with the log likelihood that they had before."""
    rows = scan.with_parameters(cut, parameters, keys).join(starts_of(cut, parameters, keys, chain), [*keys, "block"])
    parts = scan.map_blocks(rows, [*keys, "block"], chain.d, block_sums(chain), "sums array<double>, loglik double")
    gathered = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block", "sums"))).alias("items"), F.sum("loglik").alias("loglik")).join(parameters.drop("loglik"), keys)
    k, size = chain.k, 1 + chain.d

    def fn(row: dict) -> dict:
        total = np.sum([x["sums"] for x in row["items"]], 0)
        sums, moves, first = total[: k * size * size].reshape(k, size, size), total[k * size * size : -k].reshape(k, k), total[-k:]
        _, _, rest = chain.chain(np.asarray(row["theta"], float))
        return {"theta": np.concatenate([first / max(first.sum(), TINY), chain.moves(moves).ravel(), chain.maximized(sums, rest)]).tolist()}

    kept = [c for c in parameters.columns if c not in ("theta", "loglik")]
    return scan.map_keys(gathered, [*kept, "loglik"], fn, "theta array<double>")


def first_parameters(rows: DataFrame, keys: list[str], values: list[str], state: Column, chain: Chain, start: Callable[[np.ndarray, dict], np.ndarray], more: list[str] | None = None) -> DataFrame:
    """keys, until and theta from the moments of bands of the rows (`state`), shrunk towards those of all rows.

    rows: keys, until, values and columns of `more`, which are the same for all rows of a key. start makes the emission's parameters.
    """
    one = [F.lit(1.0), *map(F.col, values)]
    pairs = [(i, j) for i in range(len(one)) for j in range(i, len(one))]
    own = [*keys, "until", *(more or [])]
    by_state = rows.withColumn("_s", state).groupBy(*own, "_s").agg(F.array(*(F.sum(one[i] * one[j]) for i, j in pairs)).alias("m"))
    gathered = by_state.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_s", "m"))).alias("items"))
    k, size = chain.k, len(one)

    def fn(row: dict) -> dict:
        sums = np.zeros((k, size, size))
        for x in row["items"]:
            for (i, j), v in zip(pairs, x["m"], strict=True):
                sums[x["_s"], i, j] = sums[x["_s"], j, i] = v
        total = sums.sum(0)
        p, move = chain.first_moves()
        return {"theta": np.concatenate([p, move.ravel(), start(sums + SHRINK * total / total[0, 0], row)]).tolist()}

    return scan.map_keys(gathered, [*keys, "until"], fn, "theta array<double>")


def fitted(cut: DataFrame, parameters: DataFrame, keys: list[str], chain: Chain, store: Callable[[DataFrame, str], DataFrame], rounds: int | None = 200, gain: float = 0.01) -> DataFrame:
    """parameters after so many rounds, or fewer: none is needed when no key's log likelihood gained more than `gain`. rounds None: until then.

    A round's parameters are stored, so plans stay as short as the first; the driver sees one number of a round. Variances have a
    floor, so the likelihood has a bound and rounds that all gain more than `gain` come to an end.
    """
    if rounds is None and gain <= 0:
        raise ValueError("rounds without end need a gain to stop at")
    now = store(parameters, "chain-0")
    for i in count() if rounds is None else range(rounds):
        after = store(em_round(cut, now, keys, chain), f"chain-{i + 1}")
        if "loglik" in now.columns and gain > 0:
            best = after.alias("a").join(now.select(*keys, F.col("loglik").alias("_before")), keys).agg(F.max(F.nanvl(F.col("loglik") - F.col("_before"), F.lit(None)))).first()[0]
            if best is None or best <= gain:  # none: no key has a likelihood that could gain
                return after
        now = after
    return now


def filtered(cut: DataFrame, parameters: DataFrame, keys: list[str], chain: Chain) -> DataFrame:
    """(keys, obs_date, p): each day's state probabilities given the days up to it, for the days up to each key's `until`."""
    rows = scan.with_parameters(cut, parameters, keys).join(starts_of(cut, parameters, keys, chain).drop("behind"), [*keys, "block"])

    def fn(b: Batch) -> dict:
        _, move, like, _ = likelihoods(b, chain)
        out, _ = forward(b, b.extra("ahead"), move, like)
        return {"made": [[{"obs_date": int(day), "p": p.tolist()} for day, p in zip(b.day[i][b.used[i]], out[i][b.used[i]], strict=True)] for i in range(b.n)]}

    made = scan.map_blocks(rows, [*keys, "block"], chain.d, fn, "made array<struct<obs_date:int,p:array<double>>>")
    return made.select(*keys, F.explode("made").alias("_m")).select(*keys, F.date_from_unix_date("_m.obs_date").alias("obs_date"), F.col("_m.p").alias("p"))


def permuted(parameters: DataFrame, order: DataFrame, keys: list[str], chain: Chain) -> DataFrame:
    """parameters with their states in another order. order: keys and `order`, the old numbers in their new places."""

    def fn(row: dict) -> dict:
        o = list(row["order"])
        start, move, rest = chain.chain(np.asarray(row["theta"], float))
        return {"theta": np.concatenate([start[o], move[np.ix_(o, o)].ravel(), chain.reordered(rest, o)]).tolist()}

    return scan.map_keys(parameters.join(order, keys), [c for c in parameters.columns if c != "theta"], fn, "theta array<double>").select(*parameters.columns)


def banded(column: Column, states: int) -> Column:
    """Bands of a standardized column, 0.8 wide, the outer ones open."""
    return F.greatest(F.lit(0), F.least(F.lit(states - 1), F.floor(column / 0.8 + states / 2))).cast("int")


def first_gaussian(design: DataFrame, features: list[str], cutoffs: DataFrame, chain: Gaussian, at_least: int) -> DataFrame:
    """(series_id, cutoff, until, theta): a first estimate on the rows up to each cutoff that has enough of them before it, in units of those rows."""
    at = design.join(F.broadcast(cutoffs.select("cutoff")), F.col("obs_date") <= F.col("cutoff"))  # a list of days that the caller writes down
    own = at.groupBy("series_id", "cutoff").agg(F.count("*").alias("_n"), F.array(*(F.avg(f) for f in features)).alias("shift"), F.array(*(F.stddev_pop(f) + 1e-9 for f in features)).alias("scale")).where(F.col("_n") >= at_least)
    unit = [((F.col(f) - F.col("shift")[i]) / F.col("scale")[i]).alias(f) for i, f in enumerate(features)]
    rows = at.join(own, ["series_id", "cutoff"]).select("series_id", "cutoff", F.col("cutoff").alias("until"), "shift", "scale", *unit)

    def start(sums: np.ndarray, row: dict) -> np.ndarray:
        return chain.maximized(sums, np.array([*row["shift"], *row["scale"]]))

    return first_parameters(rows, ["series_id", "cutoff"], features, banded(F.col(features[0]), chain.k), chain, start, ["shift", "scale"])


def state_order(posteriors: DataFrame, returns: DataFrame, keys: list[str], parameters: DataFrame, chain: Gaussian) -> DataFrame:
    """(keys, order): states by mean return, then by the trace of their covariance, from best and calmest on."""
    k, d = chain.k, chain.d
    weighted = posteriors.join(returns.select("series_id", "obs_date", F.coalesce("r", F.lit(0.0)).alias("_r")), ["series_id", "obs_date"])
    sums = weighted.groupBy(*keys).agg(*(F.sum(F.col("p")[s] * F.col("_r")).alias(f"r{s}") for s in range(k)), *(F.sum(F.col("p")[s]).alias(f"w{s}") for s in range(k)))
    base = k + k * k + 2 * d + k * d
    trace = [reduce(Column.__add__, (F.col("theta")[base + s * d * d + i * (d + 1)] for i in range(d))) for s in range(k)]
    items = [F.struct((-F.round(F.col(f"r{s}") / F.greatest(F.col(f"w{s}"), F.lit(1e-9)), 12)).alias("m"), trace[s].alias("t"), F.lit(s).alias("s")) for s in range(k)]
    return sums.join(parameters.select(*keys, "theta"), keys).select(*keys, F.transform(F.sort_array(F.array(*items)), lambda x: x.s).alias("order"))


def labelled(posteriors: DataFrame, names: list[str]) -> DataFrame:
    """posteriors with the label of the likeliest state, the first of equal ones, and the entropy."""
    top = F.array_position("p", F.array_max("p")).cast("int")
    terms = F.transform("p", lambda x: F.greatest(x, F.lit(1e-12)) * F.log(F.greatest(x, F.lit(1e-12))))
    return posteriors.withColumns({"label": F.element_at(F.array(*map(F.lit, names)), top), "entropy": -F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)})


def walk_forward(design: DataFrame, features: list[str], cutoffs: DataFrame, store: Callable[[DataFrame, str], DataFrame], names: list[str] | None = None, stay: float = 1000.0, rounds: int = 200, at_least: int | None = None, span: int = scan.SPAN) -> DataFrame:
    """Posteriors out of sample: for each (cutoff, until), a model fitted on the rows up to cutoff filters on to `until`.

    series_id, obs_date, cutoff, p (in the names' order), label, entropy; all cutoffs go through one plan and share the blocks of days. States
    are named by mean return `r`, then calm, from best to worst. A cutoff with fewer than at_least rows (50 for each state) before it gives none.
    """
    names = names or REGIMES
    chain, keys = Gaussian(len(names), len(features), stay), ["series_id", "cutoff"]
    design = design.na.drop(subset=features)
    cut = store(scan.blocks(design, "obs_date", features, span), "chain-blocks")
    first = first_gaussian(design, features, cutoffs, chain, 50 * len(names) if at_least is None else at_least)
    fit = fitted(cut, first, keys, chain, store, rounds)
    order = state_order(filtered(cut, fit, keys, chain), design, keys, fit, chain)
    named = permuted(fit.select(*keys, "theta"), order, keys, chain).join(F.broadcast(cutoffs.select("cutoff", "until")), "cutoff")
    out = filtered(cut, store(named, "chain-named"), keys, chain).where("obs_date > cutoff")
    return labelled(out, names).select("series_id", "obs_date", "cutoff", "p", "label", "entropy")


def violent_probability(panel: DataFrame, drivers: list[str], store: Callable[[DataFrame, str], DataFrame], fit_rows: int = 240, states: int = 3, rounds: int | None = 60, span: int = 8192) -> DataFrame:
    """series_id, obs_date, violent: filtered probability of the state of largest variance of a regression whose intercept and variance switch.

    Parameters are frozen from the first fit_rows months of a series; a shorter one gives none. A missing driver is 0.
    """
    chain, keys = Regression(states, 1 + len(drivers)), ["series_id"]
    rows = panel.where("ret is not null").select("series_id", "obs_date", F.col("ret").alias("y"), *(F.coalesce(F.col(d), F.lit(0.0)).alias(d) for d in drivers))
    months = rows.groupBy("series_id").agg(F.sort_array(F.collect_list("obs_date")).alias("_d"))  # a hundred years have 1,200
    until = months.select("series_id", F.get("_d", F.lit(fit_rows - 1)).alias("until")).where("until is not null")
    early = rows.join(until, "series_id").where("obs_date <= until")
    own = early.groupBy("series_id").agg(F.avg("y").alias("_m"), (F.stddev_pop("y") + 1e-9).alias("_sd"))
    far = F.least(F.lit(states - 1), F.floor(F.abs((F.col("y") - F.col("_m")) / F.col("_sd")) / 0.8)).cast("int")
    first = first_parameters(early.join(own, "series_id"), keys, ["y", *drivers], far, chain, lambda sums, _: chain.first(sums))
    cut = store(scan.blocks(rows, "obs_date", ["y", *drivers], span), "switch-blocks")
    fit = fitted(cut, first, keys, chain, store, rounds)
    spread = F.slice("theta", states + states**2 + states + 1, states)
    order = F.transform(F.sort_array(F.arrays_zip(spread.alias("v"), F.sequence(F.lit(0), F.lit(states - 1)).alias("s"))), lambda x: x["s"])
    named = permuted(fit.select(*keys, "theta"), fit.select(*keys, order.alias("order")), keys, chain).withColumn("until", F.lit("9999-12-31").cast("date"))
    return filtered(cut, store(named, "switch-named"), keys, chain).select("series_id", "obs_date", F.col("p")[states - 1].alias("violent"))
