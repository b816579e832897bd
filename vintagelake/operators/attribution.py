"""Exact Shapley values of boosted trees, by leaves.

A leaf's value is given out when every split on its path goes its way. For a set of known features the others go their way by
the share of training rows that did, so the value of a set is a sum over leaves of products, and a leaf's Shapley values depend
only on which of its path's few features agree with the row. They are worked out once for each leaf and pattern of agreement;
a row needs its patterns, a look-up and sums.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial, inf

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A node: (feature or -1, threshold, left, right, value, cover); the left child takes values up to the threshold.
Node = tuple[int, float, int, int, float, float]
LEAVES = "leaf int, value double, path array<struct<f:int,low:double,high:double>>, gains array<array<double>>"


def leaf_paths(nodes: list[Node]) -> list[tuple[float, dict[int, tuple[float, float, float]]]]:
    """(value, {feature: (low, high, share)}) of each leaf: the interval that its path leaves of a feature, and the share of rows its splits send on."""
    out, todo = [], [(0, {})]
    while todo:
        at, held = todo.pop()
        f, threshold, left, right, value, cover = nodes[at]
        if f < 0:
            out.append((value, held))
            continue
        low, high, share = held.get(f, (-inf, inf, 1.0))
        for child, interval in ((left, (low, min(high, threshold))), (right, (max(low, threshold), high))):
            todo.append((child, held | {f: (*interval, share * nodes[child][5] / cover)}))
    return out


def pattern_gains(value: float, shares: list[float]) -> list[list[float]]:
    """For each pattern of agreement (bit i: feature i agrees) the Shapley value of each feature of a leaf's path."""
    m, out = len(shares), []
    for pattern in range(2**m):
        agrees = [float(pattern >> i & 1) for i in range(m)]
        gains = []
        for i in range(m):
            others = [k for k in range(m) if k != i]
            total = 0.0
            for size in range(m):
                weight = factorial(size) * factorial(m - size - 1) / factorial(m)
                for chosen in combinations(others, size):
                    product = 1.0
                    for k in others:
                        product *= agrees[k] if k in chosen else shares[k]
                    total += weight * product
            gains.append(value * (agrees[i] - shares[i]) * total)
        out.append(gains)
    return out


def leaf_table(spark: SparkSession, trees: list[tuple[list[Node], float]]) -> tuple[DataFrame, float]:
    """The leaves of all trees (each with its weight), and the trees' mean value. As many rows as leaves: trees times two to the depth at most."""
    rows, base = [], 0.0
    for nodes, weight in trees:
        for value, path in leaf_paths(nodes):
            shares = [s for _, _, s in path.values()]
            mean = value * weight
            for s in shares:
                mean *= s
            base += mean
            rows.append((len(rows), value * weight, [(f, low, high) for f, (low, high, _) in path.items()], pattern_gains(value * weight, shares)))
    return spark.createDataFrame(rows, LEAVES), base


def shapley_values(rows: DataFrame, keys: list[str], features: list[str], leaves: DataFrame) -> DataFrame:
    """keys and a column for each feature: its part in the trees' score. With the trees' mean the parts add up to the score.

    The leaves are broadcast: their number is that of the model's, which is bounded by rounds and depth. A row meets each of them
    in its own task and is summed there, so rows are not shuffled by more than one record each. A null feature goes to the right.
    """
    values = F.array(*(F.coalesce(F.col(f).cast("double"), F.lit(inf)) for f in features))
    met = rows.select(*keys, values.alias("_x")).join(F.broadcast(leaves))
    x = F.col("_x")
    bits = F.transform("path", lambda c, i: F.when((F.get(x, c.f) > c.low) & (F.get(x, c.f) <= c.high), F.pow(F.lit(2.0), i)).otherwise(F.lit(0.0)))
    pattern = F.aggregate(bits, F.lit(0.0), lambda a, b: a + b).cast("int")
    met = met.select(*keys, F.col("path.f").alias("_f"), F.get("gains", pattern).alias("_g"))
    part = lambda i: F.get(F.col("_g"), F.array_position("_f", i).cast("int") - 1)
    return met.groupBy(*keys).agg(*(F.coalesce(F.sum(part(i)), F.lit(0.0)).alias(f) for i, f in enumerate(features)))


def gbt_nodes(model) -> list[tuple[list[Node], float]]:
    """A fitted pyspark.ml model's trees as nodes, with their weights."""

    def walk(node, out: list) -> int:
        at = len(out)
        out.append(None)
        cover = float(node.impurityStats().count())
        if node.subtreeDepth() == 0:
            out[at] = (-1, 0.0, 0, 0, node.prediction(), cover)
        else:
            split = node.split()
            out[at] = (split.featureIndex(), split.threshold(), walk(node.leftChild(), out), walk(node.rightChild(), out), node.prediction(), cover)
        return at

    trees = []
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        nodes: list = []
        walk(tree._call_java("rootNode"), nodes)
        trees.append((nodes, weight))
    return trees


def score(nodes: list[Node], x: list[float]) -> float:
    """One row's value by one tree."""
    at = 0
    while nodes[at][0] >= 0:
        at = nodes[at][2] if x[nodes[at][0]] <= nodes[at][1] else nodes[at][3]
    return nodes[at][4]
