"""Equities: kinematics, regime features, instability, crash risk, folds, forecasts, and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.operators import attribution, factors, windows
from vintagelake.operators.aggregates import within


def W():
    """Rows of a series in order of days. A function, as a window can only be made where a session is."""
    return windows.ordered(["series_id"], "obs_date")



def resolve_role(counts: DataFrame, role: str, order: list[tuple[str, int]]) -> DataFrame:
    """The first series in order with as many figures as it needs; null if none has. counts: series_id, n."""
    met = reduce(lambda c, kv: c.when((F.col("series_id") == kv[1][0]) & (F.col("n") >= kv[1][1]), kv[0]), enumerate(order), F.when(F.lit(False), 0))
    best = counts.withColumn("_i", met).where("_i is not null").agg(F.min_by("series_id", "_i").alias("series_id"))
    return best.select(F.lit(role).alias("role"), "series_id")


def kinematics(df: DataFrame, slope: str, momentum: str, per_year: int, burn_in: int, baseline: int, months: tuple[int, ...] = (1, 3, 12)) -> DataFrame:
    """velocity, acceleration and jerk_z of a filtered slope after its start-up rows, and sums of a differenced price over months."""
    df = df.withColumn("velocity", F.when(F.row_number().over(W()) > burn_in, F.col(slope) * per_year))
    df = df.withColumn("acceleration", windows.change(F.col("velocity"), W()) * per_year)
    df = df.withColumn("_jerk", windows.change(F.col("acceleration"), W()))
    sums = {f"momentum_{m}m": windows.rolling(F.sum, F.col(momentum), W(), max(round(m * per_year / 12), 1)) for m in months}
    return df.withColumns({"jerk_z": windows.expanding_z(F.col("_jerk"), W(), baseline, True, None), **sums}).drop("_jerk")


def design(df: DataFrame, per_year: int, fast: int = 3, slow: int = 12, baseline: int | None = None) -> DataFrame:
    """Rows with all four features of the regime model: trends, volatility against its median, drawdown, each in units of volatility."""
    logged, month = F.log("value"), max(round(per_year / 12), 5)
    base = baseline or round(3 * per_year)
    df = df.withColumn("realized_vol", windows.rolling(F.stddev_samp, F.col("r"), W(), month) * per_year**0.5)
    vol = F.nullif(F.col("realized_vol"), F.lit(0.0))
    trend = lambda m: (logged - F.lag(logged, round(m * per_year / 12)).over(W())) * (per_year / round(m * per_year / 12)) / vol
    peak = windows.rolling(F.max, logged, W(), per_year, per_year // 2)
    made = {"trend_fast": trend(fast), "trend_slow": trend(slow), "vol_ratio": F.log(F.col("realized_vol") / F.nullif(windows.rolling_median(F.col("realized_vol"), W(), base, base // 2), F.lit(0.0))), "drawdown_sigma": (logged - peak) / vol}
    return df.withColumns(made).na.drop(subset=list(made))


def purged_folds(days: DataFrame, folds: int, horizon_months: int, embargo_months: int) -> DataFrame:
    """(fold, obs_date, role): contiguous test blocks; a row trains unless its horizon meets the block or it lies in the embargo after it. Fold borders are a few rows, so they are broadcast."""
    blocks = days.select("series_id", "obs_date").withColumn("fold", F.ntile(folds).over(W()) - 1)
    borders = blocks.groupBy("fold").agg(F.min("obs_date").alias("a"), F.max("obs_date").alias("b"))
    df = days.select("obs_date").join(F.broadcast(borders))
    d = F.col("obs_date")
    met = (F.add_months(d, horizon_months) >= F.col("a")) & (d <= F.col("b"))
    after = (d > F.col("b")) & (d <= F.add_months("b", embargo_months))
    role = F.when(d.between(F.col("a"), F.col("b")), "test").when(~met & ~after, "train")
    return df.select("fold", "obs_date", role.alias("role")).where("role is not null")


def trees(train: DataFrame, features: list[str], label: str, rounds: int):
    """Boosted trees of depth 3 with the rarer class weighted up."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="features").transform(train)
    sums = rows.agg(F.sum(label).alias("up"), F.count("*").alias("n")).first()
    weight = (sums.n - sums.up) / max(sums.up, 1)
    weighted = rows.withColumn("weight", F.when(F.col(label) == 1, float(max(weight, 1e-3))).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))
    return GBTClassifier(labelCol=label, weightCol="weight", maxDepth=3, maxIter=rounds, stepSize=0.05, seed=7).fit(weighted)


def scored(model, rows: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    made = model.transform(VectorAssembler(inputCols=features, outputCol="features").transform(rows))
    return made.withColumn("raw", vector_to_array("probability")[1])


def calibrated_forecast(rows: DataFrame, features: list[str], label: str, rounds: int = 300, folds: int = 3, horizon_months: int = 3) -> DataFrame:
    """obs_date, raw and p: out-of-fold scores under purged folds, and what isotonic regression makes of them."""
    from pyspark.ml.regression import IsotonicRegression

    plan = purged_folds(rows, folds, horizon_months, horizon_months)
    parts = []
    for k in range(folds):
        fold = rows.join(plan.where(F.col("fold") == k).select("obs_date", "role"), "obs_date")
        train = fold.where("role = 'train'")
        if train.where(F.col(label) == 1).limit(1).count():
            parts.append(scored(trees(train, features, label, rounds), fold.where("role = 'test'"), features).select("obs_date", "raw", F.col(label).cast("double").alias(label)))
    if not parts:
        return rows.select("obs_date", F.lit(None).cast("double").alias("raw"), F.lit(None).cast("double").alias("p")).limit(0)
    out = reduce(DataFrame.union, parts)
    model = IsotonicRegression(featuresCol="raw", labelCol=label, predictionCol="p").fit(out)
    return model.transform(out).select("obs_date", "raw", "p")


def contributions(rows: DataFrame, features: list[str], label: str, rounds: int = 300) -> DataFrame:
    """obs_date and a map from feature to its exact Shapley value in the trees' score; with the trees' mean the parts add up to the score."""
    leaves, _ = attribution.leaf_table(rows.sparkSession, attribution.gbt_nodes(trees(rows, features, label, rounds)))
    made = attribution.shapley_values(rows, ["obs_date"], features, leaves)
    return made.select("obs_date", F.create_map(*(x for f in features for x in (F.lit(f), F.col(f)))).alias("contributions"))


def instability(wide: DataFrame, parts: list[str], at_least: int = 60, keys: list[str] | None = None) -> DataFrame:
    """keys, obs_date, rii, parts: each part's score among its own past, averaged over those a day has; a part with few scores is left out."""
    keys = keys or []
    long = wide.unpivot([*keys, "obs_date"], parts, "_part", "value").withColumn("value", F.round("value", 9)).withColumn("series_id", F.concat_ws("|", *keys, "_part"))
    scores = factors.score_series(long, dict.fromkeys(parts, 1))
    enough = scores.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("series_id")
    whose = long.select("series_id", *(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    kept = scores.join(enough, "series_id", "left_semi")
    kept = kept.join(whose, "series_id").select(*(F.col(f"_k_{k}").alias(k) for k in keys), "obs_date", "score") if keys else kept
    return kept.groupBy(*keys, "obs_date").agg(F.avg("score").alias("rii"), F.count("*").alias("parts"))


#: Places of the coarse search of a tail's fit (none is 0), the step of the fine one, and its steps to both sides.
COARSE = [round(-6 + 0.1 * i + 0.0313, 4) for i in range(121)]
FINE, SIDE = 0.005, 20


def tail_profile(excess: DataFrame, places: Column) -> DataFrame:
    """(series_id, s, k, l): shape and log-likelihood of a generalized Pareto law whose shape over scale is (e**s - 1) / max, the best for that ratio."""
    at = excess.select("series_id", "x", "most", F.explode(places).alias("s")).withColumn("ratio", (F.exp("s") - 1) / F.col("most"))
    k = at.groupBy("series_id", "s").agg(F.avg(F.log1p(F.col("ratio") * F.col("x"))).alias("k"), F.max("ratio").alias("ratio"))
    return k.select("series_id", "s", "k", (-(F.log(F.col("k") / F.col("ratio")) + F.col("k") + 1)).alias("l")).where("k > -0.5")


def tail(episodes: DataFrame, depth: str, threshold: float, at_least: int = 25) -> DataFrame:
    """series_id, n, shape, scale of the depths beyond the threshold by most likelihood; null for fewer episodes.

    For a given ratio of shape and scale the best shape is a mean of logs, so the search has one dimension: sums over a
    coarse grid of ratios, then a fine one, then the top of the parabola through the best place and its neighbours.
    Shapes of -0.5 or less, where most likelihood is no estimate, are left out.
    """
    x = episodes.select("series_id", (F.col(depth) - threshold).alias("x")).where("x > 0")
    sizes = x.groupBy("series_id").agg(F.count("*").alias("n"), F.max("x").alias("most"))
    excess = x.join(sizes.where(F.col("n") >= at_least), "series_id")
    coarse = tail_profile(excess, F.array(*map(F.lit, COARSE))).groupBy("series_id").agg(F.max_by("s", F.struct("l", "s")).alias("near"))
    fine = tail_profile(excess.join(coarse, "series_id"), F.transform(F.sequence(F.lit(-SIDE), F.lit(SIDE)), lambda i: F.col("near") + i * FINE))
    w = windows.ordered(["series_id"], "s")  # as many rows as places
    around = fine.withColumns({"low": F.lag("l").over(w), "high": F.lead("l").over(w)})
    best = around.groupBy("series_id").agg(F.max_by(F.struct("s", "low", "l", "high"), F.struct("l", "s")).alias("b")).select("series_id", "b.*")
    top = F.col("s") + F.coalesce(FINE / 2 * (F.col("low") - F.col("high")) / (F.col("low") - 2 * F.col("l") + F.col("high")), F.lit(0.0))
    placed = excess.join(best.select("series_id", top.alias("s")), "series_id").withColumn("ratio", (F.exp("s") - 1) / F.col("most"))
    fits = placed.groupBy("series_id").agg(F.avg(F.log1p(F.col("ratio") * F.col("x"))).alias("shape"), F.max("ratio").alias("ratio"))
    return sizes.join(fits, "series_id", "left").select("series_id", "n", "shape", (F.col("shape") / F.col("ratio")).alias("scale"))


def crash_risk(transition: Column, shock: Column, transmission: Column) -> Column:
    return 100 * transition * shock * transmission


def path_summary(paths: DataFrame, quantiles: tuple[float, ...] = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)) -> DataFrame:
    """For each horizon the fan of terminal levels, mean drawdown and time under water, and how often a path falls by so much."""
    falls = [F.avg((F.col("max_drawdown") > x).cast("int")).alias(f"p_fall_{round(100 * x)}") for x in (0.2, 0.3, 0.5)]
    return paths.groupBy("horizon").agg(F.percentile("terminal", F.array(*map(F.lit, quantiles))).alias("fan"), F.avg("max_drawdown").alias("max_drawdown"), F.avg("under_water").alias("under_water"), *falls)


def episode_evaluation(df: DataFrame, spans: list[tuple[str, str, str]], adverse: list[str]) -> DataFrame:
    """For each named span its days, the share called adverse, and the days until the first such call."""
    hit = F.col("state").isin(adverse)
    return within(df, "obs_date", spans).groupBy("name").agg(F.count("*").alias("days"), F.round(F.avg(hit.cast("int")), 6).alias("coverage"), F.datediff(F.min(F.when(hit, F.col("obs_date"))), F.min("obs_date")).alias("lead_days"))
