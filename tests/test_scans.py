"""Scans over blocks against plain recursions."""

from datetime import date, timedelta

import numpy as np
import pytest

from vintagelake.operators import regimes, scan, trend
from vintagelake.sources.shared import stored


def days(n, first=date(2000, 1, 1)):
    return [first + timedelta(days=int(i) + int(i) // 5 * 2) for i in range(n)]


def plain_filter(start, move, like):
    out, p = [], start
    for t, x in enumerate(like):
        p = (p if t == 0 else p @ move) * x
        p = p / p.sum()
        out.append(p)
    return np.array(out)


def gaussian(x, means, covs):
    logs = np.array([[-0.5 * ((v - m) @ np.linalg.inv(c) @ (v - m) + np.log(np.linalg.det(c)) + len(m) * np.log(2 * np.pi)) for m, c in zip(means, covs, strict=True)] for v in x])
    return np.exp(logs)


def plain_em(x, start, move, means, covs, stay, rounds):
    k = len(start)
    for _ in range(rounds):
        like = gaussian(x, means, covs)
        like = like / like.max(1, keepdims=True)
        f = plain_filter(start, move, like)
        n = len(x)
        gamma, moves, back = np.empty_like(f), np.zeros((k, k)), np.ones(k)
        gamma[-1] = f[-1]
        for t in range(n - 2, -1, -1):
            tail = like[t + 1] * back
            pair = f[t][:, None] * move * tail
            moves += pair / pair.sum()
            back = move @ tail
            back /= back.sum()
            gamma[t] = f[t] * back / (f[t] * back).sum()
        w = gamma.sum(0) + 1e-9
        means = gamma.T @ x / w[:, None]
        covs = [np.einsum("t,ti,tj->ij", gamma[:, s], x, x) / w[s] - np.outer(means[s], means[s]) + 1e-3 * np.eye(x.shape[1]) for s in range(k)]
        start, move = gamma[0], moves + 1 + stay * np.eye(k)
        move = move / move.sum(1, keepdims=True)
    return start, move, means, covs


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    state = np.repeat([0, 1, 0, 1, 0], 200)
    x = np.where(state[:, None] == 1, rng.normal(-2, 2, (1000, 2)), rng.normal(1, 0.5, (1000, 2)))
    d = days(1000)
    rows = [("S", d[i], float(x[i, 0]), float(x[i, 1]), float(x[i, 0])) for i in range(1000)] + [("T", d[i], float(x[i, 0]) * 3, float(x[i, 1]), 0.0) for i in range(300)]
    return spark.createDataFrame(rows, "series_id string, obs_date date, a double, b double, r double").cache(), x, state, d


def theta(start, move, means, covs):
    return [*map(float, start), *map(float, np.ravel(move)), 0.0, 0.0, 1.0, 1.0, *map(float, np.ravel(means)), *map(float, np.ravel(covs))]


START, MOVE = np.array([0.3, 0.7]), np.array([[0.97, 0.03], [0.05, 0.95]])
MEANS, COVS = np.array([[0.8, 1.1], [-1.0, -1.5]]), np.array([[[0.5, 0.1], [0.1, 0.4]], [[3.0, -0.2], [-0.2, 2.5]]])


@pytest.mark.parametrize("span", [7, 100, 5000])
def test_filter_equals_the_recursion(spark, world, span):
    df, x, _, d = world
    chain = regimes.Gaussian(2, 2)
    cut = scan.blocks(df, "obs_date", ["a", "b"], span)
    parameters = spark.createDataFrame([("S", 1, d[700], theta(START, MOVE, MEANS, COVS)), ("S", 2, d[999], theta(MOVE[0], MOVE.T / MOVE.T.sum(1, keepdims=True), MEANS * 2, COVS)), ("T", 1, d[10], theta(START, MOVE, MEANS, COVS))], "series_id string, k int, until date, theta array<double>")
    got = {(r.series_id, r.k, r.obs_date): r.p for r in regimes.filtered(cut, parameters, ["series_id", "k"], chain).collect()}
    assert len(got) == 701 + 1000 + 11
    for k, n, p0, move, means in ((1, 701, START, MOVE, MEANS), (2, 1000, MOVE[0], MOVE.T / MOVE.T.sum(1, keepdims=True), MEANS * 2)):
        want = plain_filter(p0, move, gaussian(x[:n], means, COVS))
        assert np.allclose([got["S", k, d[i]] for i in range(n)], want, atol=1e-9)


def test_rounds_equal_plain_ones(spark, world):
    df, x, _, d = world
    chain = regimes.Gaussian(2, 2, stay=50.0)
    cut = scan.blocks(df, "obs_date", ["a", "b"], 90)
    parameters = spark.createDataFrame([("S", d[799], theta(START, MOVE, MEANS, COVS))], "series_id string, until date, theta array<double>")
    got = regimes.fitted(cut, parameters, ["series_id"], chain, stored, rounds=3, gain=0.0).collect()
    start, move, rest = chain.chain(np.array(got[0].theta))
    _, _, means, covs = chain.parts(rest)
    want = plain_em(x[:800], START, MOVE, MEANS, COVS, 50.0, 3)
    for a, b in zip((start, move, means, covs), want, strict=True):
        assert np.allclose(a, b, atol=1e-8)


def test_walk_forward_finds_the_regimes_and_looks_at_no_later_day(spark, world):
    df, _, state, d = world
    cutoffs = spark.createDataFrame([(d[499], d[799]), (d[799], d[999]), (d[20], d[90])], "cutoff date, until date")
    got = regimes.walk_forward(df, ["a", "b"], cutoffs, stored, ["calm", "wild"], stay=100.0, rounds=30, at_least=200, span=120).where("series_id = 'S'").collect()
    assert {r.cutoff for r in got} == {d[499], d[799]} and len(got) == 500
    at = {r.obs_date: r.label for r in got}
    assert np.mean([at[d[i]] == ("wild" if state[i] else "calm") for i in range(500, 1000)]) > 0.97
    early = regimes.walk_forward(df.where(f"obs_date <= date'{d[700]}'"), ["a", "b"], cutoffs, stored, ["calm", "wild"], stay=100.0, rounds=30, at_least=200, span=120).where("series_id = 'S'").collect()
    late = {(r.cutoff, r.obs_date): r.p for r in got}
    assert len(early) == 201 and all(np.allclose(r.p, late[r.cutoff, r.obs_date], atol=1e-9) for r in early)


def test_switching_regression_recovers_states_and_slopes(spark):
    rng = np.random.default_rng(4)
    state = np.repeat([0, 1, 0, 1, 0], 120)
    x = rng.normal(0, 1, 600)
    y = 0.5 + 2.0 * x + np.where(state == 1, rng.normal(0, 4, 600), rng.normal(0, 0.5, 600))
    d = [date(1960 + i // 12, i % 12 + 1, 28) for i in range(600)]
    panel = spark.createDataFrame([("G", d[i], float(y[i]), float(x[i])) for i in range(600)] + [("short", d[i], 1.0, 0.0) for i in range(20)], "series_id string, obs_date date, ret double, x double")
    got = {r.obs_date: r.violent for r in regimes.violent_probability(panel, ["x"], stored, fit_rows=400, states=2, rounds=40, span=900).collect()}
    assert len(got) == 600 and np.mean([(got[d[i]] > 0.5) == (state[i] == 1) for i in range(600)]) > 0.9
    chain = regimes.Regression(2, 2)
    sums = np.array([np.einsum("t,ti,tj->ij", g, one, one) for one in [np.column_stack([np.ones(600), y, x])] for g in ((state == 0).astype(float), (state == 1).astype(float))])
    rest = chain.first(sums)
    for _ in range(30):
        rest = chain.maximized(sums, rest)
    assert rest[4:] == pytest.approx([2.0], abs=0.05) and np.sqrt(rest[2:4]) == pytest.approx([0.5, 4.0], rel=0.1)
    assert rest[:2] == pytest.approx([0.5, 0.5], abs=0.5)


def plain_trend(y, noise, slope):
    m, p = np.array([y[0], 0.0]), trend.DIFFUSE * np.eye(2)
    out, ll, n, s = [], 0.0, 0, 0.0
    for t, v in enumerate(y):
        m, p = trend.MOVE @ m, trend.MOVE @ p @ trend.MOVE.T + np.diag([1 - noise, slope])
        e, f = v - m[0], p[0, 0] + noise
        g = p[:, 0] / f
        m, p = m + g * e, p - np.outer(g, p[0])
        out.append(m)
        if t >= trend.BURN:
            ll, s, n = ll + np.log(f), s + e * e / f, n + 1
    return np.array(out), -0.5 * (n * (np.log(2 * np.pi * s / n) + 1) + ll)


@pytest.mark.parametrize("span", [9, 300])
def test_trend_equals_the_recursion(spark, span):
    rng = np.random.default_rng(0)
    y = 0.01 * np.arange(800) + rng.normal(0, 0.05, 800)
    d = days(800)
    df = spark.createDataFrame([("S", d[i], float(np.exp(y[i]))) for i in range(800)] + [("short", d[i], 2.0) for i in range(30)] + [("S", date(1990, 1, 1), -1.0)], "series_id string, obs_date date, value double")
    cut = scan.blocks(df.where("value > 0").selectExpr("series_id", "obs_date", "ln(value) as y"), "obs_date", ["y"], span)
    known = spark.createDataFrame([("S", d[503], float(y[0]))], "series_id string, until date, begin double")
    best = trend.fit(cut, known, stored).first()
    grid = [(plain_trend(y[:504], w, 10**s)[1], w, s) for w in trend.SHARES for s in trend.SLOPES]
    assert best.loglik >= max(grid)[0] - 1e-6 and best.loglik == pytest.approx(plain_trend(y[:504], best.share, 10**best.slope)[1], abs=1e-6)
    got = {r.obs_date: (r.level, r.slope) for r in trend.filtered_trend(df, stored, 504, span).collect()}
    want, _ = plain_trend(y, best.share, 10**best.slope)
    assert len(got) == 800 and np.allclose([got[x] for x in d], want, atol=1e-7)
    assert got[d[-1]][1] == pytest.approx(0.01, abs=0.004)
