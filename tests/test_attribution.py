"""Shapley values against all subsets, differences against convolution, the unit-root test against least squares."""

import math
from datetime import date, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vintagelake.operators import attribution, differencing, equity
from vintagelake.operators.windows import ffd_weights

TREES = [
    ([(0, 0.5, 1, 2, 0.0, 10.0), (1, 0.0, 3, 4, 0.0, 6.0), (0, 2.0, 5, 6, 0.0, 4.0), (-1, 0, 0, 0, 1.0, 2.0), (-1, 0, 0, 0, -2.0, 4.0), (2, 1.0, 7, 8, 0.0, 3.0), (-1, 0, 0, 0, 5.0, 1.0), (-1, 0, 0, 0, 0.5, 1.0), (-1, 0, 0, 0, 3.0, 2.0)], 1.0),
    ([(2, -1.0, 1, 2, 0.0, 10.0), (-1, 0, 0, 0, 4.0, 3.0), (1, 0.3, 3, 4, 0.0, 7.0), (-1, 0, 0, 0, -1.0, 5.0), (-1, 0, 0, 0, 2.0, 2.0)], 0.1),
    ([(-1, 0, 0, 0, 0.7, 10.0)], 0.1),
]


def expectation(nodes, x, known, at=0):
    f, threshold, left, right, value, cover = nodes[at]
    if f < 0:
        return value
    if f in known:
        return expectation(nodes, x, known, left if x[f] <= threshold else right)
    return sum(nodes[c][5] / cover * expectation(nodes, x, known, c) for c in (left, right))


def brute(trees, x, m):
    worth = lambda s: sum(w * expectation(n, x, s) for n, w in trees)
    out = []
    for i in range(m):
        others = [k for k in range(m) if k != i]
        out.append(sum(math.factorial(len(s)) * math.factorial(m - len(s) - 1) / math.factorial(m) * (worth({*s, i}) - worth(set(s))) for k in range(m) for s in combinations(others, k)))
    return out, worth(set())


def test_shapley_values_equal_all_subsets(spark):
    rng = np.random.default_rng(1)
    xs = [[float(v) for v in row] for row in rng.normal(0.3, 1.2, (60, 4))] + [[0.5, 0.0, 1.0, 9.0], [2.0, 0.3, -1.0, 0.0]]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "id int, a double, b double, c double, d double")
    leaves, base = attribution.leaf_table(spark, TREES)
    got = {r.id: (r.a, r.b, r.c, r.d) for r in attribution.shapley_values(df, ["id"], ["a", "b", "c", "d"], leaves).collect()}
    for i, x in enumerate(xs):
        want, mean = brute(TREES, x, 4)
        assert got[i] == pytest.approx(want, abs=1e-12) and base == pytest.approx(mean)
        assert sum(got[i]) + base == pytest.approx(sum(w * attribution.score(n, x) for n, w in TREES))
    assert got[0][3] == 0.0 and attribution.shapley_values(df.limit(0), ["id"], ["a"], leaves).count() == 0


def test_fitted_trees_add_up(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 3))
    rows = [(date(2020, 1, 1) + timedelta(days=i), *map(float, v), int(v[0] + v[1] * v[2] > 0.3)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "obs_date date, a double, b double, c double, label int")
    model = equity.trees(df, ["a", "b", "c"], "label", 4)
    trees = attribution.gbt_nodes(model)
    assert all(nodes[0][5] == pytest.approx(sum(n[5] for n in nodes if n[0] < 0)) for nodes, _ in trees)
    _, base = attribution.leaf_table(spark, trees)
    for r in equity.contributions(df, ["a", "b", "c"], "label", 4).where("day(obs_date) < 4").collect():
        v = x[(r.obs_date - date(2020, 1, 1)).days]
        assert sum(r.contributions.values()) + base == pytest.approx(sum(w * attribution.score(n, v) for n, w in trees), abs=1e-9)


def least_squares(x):
    d = np.diff(x)
    y = d[1:]
    design = np.column_stack([x[1:-1], np.ones(len(y)), d[:-1]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    left = y - design @ beta
    t = beta[0] / math.sqrt(left @ left / (len(y) - 3) * np.linalg.inv(design.T @ design)[0, 0])
    c = differencing.SURFACE_LOW if t <= differencing.SURFACE_BREAK else differencing.SURFACE_HIGH
    return len(y), t, 0.5 * math.erfc(-sum(v * t**k for k, v in enumerate(c)) / math.sqrt(2))


@pytest.mark.parametrize("size", [90, 5000])
def test_blocks_give_the_whole_convolution_and_test(spark, size):
    rng = np.random.default_rng(7)
    walk, calm = np.cumsum(rng.normal(0, 0.02, 900)), rng.normal(0, 0.02, 400)
    d = [date(2001, 1, 1) + timedelta(days=i + i // 5 * 2) for i in range(900)]
    df = spark.createDataFrame([("walk", d[i], float(np.exp(v))) for i, v in enumerate(walk)] + [("calm", d[i], float(np.exp(v))) for i, v in enumerate(calm)] + [("short", d[i], 1.5) for i in range(12)] + [("walk", date(1990, 1, 1), -1.0)], "series_id string, obs_date date, value double")
    w = ffd_weights(0.4, 1e-3, 80)
    got = {(r.series_id, r.obs_date): r.ffd for r in differencing.fractional(df.where("value > 0").withColumn("l", F.log("value")), "obs_date", "l", w, size).collect()}
    assert len(got) == 1312 and all(got["walk", d[i]] is None for i in range(len(w) - 1))
    assert [got["walk", d[i]] for i in range(len(w) - 1, 900)] == pytest.approx(np.convolve(walk, w, "valid"), abs=1e-12)
    roots = {(r.series_id, r.d): r for r in differencing.unit_roots(df, 1e-3, 80, [0.0, 0.3, 1.0], size).collect()}
    assert {k[0] for k in roots} == {"walk", "calm"}
    for name, y in (("walk", walk), ("calm", calm)):
        for order in (0.0, 0.3, 1.0):
            n, t, p = least_squares(np.convolve(y, ffd_weights(order, 1e-3, 80), "valid"))
            r = roots[name, order]
            assert (r.n, r.t, r.p) == (n, pytest.approx(t, abs=1e-6), pytest.approx(p, abs=2e-7))
    best = {r.series_id: r for r in differencing.least_differencing(df, 1e-3, 80).collect()}
    assert best["calm"].d == 0.0 and best["calm"].stationary and 0 < best["walk"].d <= 1 and best["walk"].stationary
