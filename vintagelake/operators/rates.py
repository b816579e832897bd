"""Yield curves and money markets: fits, wealth, carry. A day's tenors are few, so a curve is one row with an array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.functions.finance import ns_loadings, ns_yield
from vintagelake.operators import windows
from vintagelake.operators.joins import as_of_join

#: The fewest tenors of a fit, the decays tried, and the decay without a better one.
MIN_TENORS = 5
LAMBDAS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5]
LAMBDA_DEFAULT = 0.609


def curves(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each day: points (maturity, yield) in order of maturity, where there are enough."""
    keys = keys or ["obs_date"]
    rows = points.where(F.col("yield").isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("maturity", "yield"))).alias("points"))
    return rows.where(F.size("points") >= MIN_TENORS)


def total(points: Column, f) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + f(p))


def fit_curves(rows: DataFrame, lam: Column | float) -> DataFrame:
    """b0, b1, b2 by least squares of every row's points, and rmse. Normal equations of three unknowns, solved by determinants; nothing is shuffled."""
    pts = F.col("points")
    loaded = F.transform(pts, lambda p: F.struct(*(c.alias(n) for c, n in zip(ns_loadings(p["maturity"], lam), ("s", "c"), strict=True)), p["yield"].alias("y"), p["maturity"].alias("m")))
    df = rows.withColumn("_p", loaded)
    p = F.col("_p")
    sums = {"n": F.size("_p").cast("double"), "s": total(p, lambda x: x["s"]), "c": total(p, lambda x: x["c"]), "ss": total(p, lambda x: x["s"] * x["s"]), "sc": total(p, lambda x: x["s"] * x["c"]), "cc": total(p, lambda x: x["c"] * x["c"]), "y": total(p, lambda x: x["y"]), "sy": total(p, lambda x: x["s"] * x["y"]), "cy": total(p, lambda x: x["c"] * x["y"])}
    df = df.withColumn("_m", F.struct(*(v.alias(k) for k, v in sums.items())))
    n, s, c, ss, sc, cc, y, sy, cy = (F.col(f"_m.{k}") for k in sums)
    det = n * (ss * cc - sc * sc) - s * (s * cc - sc * c) + c * (s * sc - ss * c)
    d0 = y * (ss * cc - sc * sc) - s * (sy * cc - sc * cy) + c * (sy * sc - ss * cy)
    d1 = n * (sy * cc - sc * cy) - y * (s * cc - sc * c) + c * (s * cy - sy * c)
    d2 = n * (ss * cy - sy * sc) - s * (s * cy - sy * c) + y * (s * sc - ss * c)
    df = df.withColumns({f"b{i}": d / F.nullif(det, F.lit(0.0)) for i, d in enumerate((d0, d1, d2))})
    b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
    sse = total(p, lambda x: F.pow(x["y"] - b0 - b1 * x["s"] - b2 * x["c"], 2))
    return df.withColumn("rmse", F.sqrt(sse / n)).drop("_p", "_m")


def best_lambda(rows: DataFrame, grid: list[float] | None = None) -> DataFrame:
    """One row: the decay with the smallest mean rmse over all curves, the first of equal ones."""
    grid = grid or LAMBDAS
    tried = rows.select("obs_date", "points", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(x).alias("lam")) for i, x in enumerate(grid)))).alias("g"))
    fits = fit_curves(tried.withColumn("lam", F.col("g.lam")), F.col("lam"))
    return fits.groupBy("g.i", "lam").agg(F.round(F.avg("rmse"), 12).alias("rmse")).agg(F.min(F.struct("rmse", "i", "lam")).alias("best")).select(F.coalesce("best.lam", F.lit(LAMBDA_DEFAULT)).alias("lam"), "best.rmse")


def factor_history(rows: DataFrame, lam: float) -> DataFrame:
    """level, slope, curvature, rmse and the fitted spread of ten years over three months."""
    df = fit_curves(rows, lam)
    y = lambda m: ns_yield(F.col("b0"), F.col("b1"), F.col("b2"), F.lit(float(m)), lam)
    return df.select("obs_date", F.col("b0").alias("level"), (-F.col("b1")).alias("slope"), F.col("b2").alias("curvature"), "rmse", (y(10) - y(0.25)).alias("spread"), F.size("points").alias("tenors"))


def wealth(rates: DataFrame, keys: list[str], max_gap: int = 40, basis: int = 360) -> DataFrame:
    """The rate's rows with `segment` and the wealth that the rate of the day before earns; anew at 1 after a long gap."""
    w = windows.ordered(keys, "obs_date")
    df = rates.withColumns({"_gap": F.datediff("obs_date", F.lag("obs_date").over(w)), "_before": F.lag("value").over(w)})
    out = windows.segmented_index(df, keys, "obs_date", F.col("_before") / 100 * F.col("_gap") / basis, F.col("_gap") > max_gap, "wealth")
    return out.drop("_gap", "_before")


def realized_carry(path: DataFrame, keys: list[str], span: int, basis: int = 360) -> DataFrame:
    """Annual growth in percent of wealth over about `span` days, from the newest day at or before the span's start.

    Null where that day is too far off, and where wealth fell below its start inside the span, as after a restart.
    """
    # Between the start, the newest day at or before the span's first, and that first day lies no other day.
    frame = Window.partitionBy(*keys).orderBy(F.datediff("obs_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-span, 0)
    points = path.select(*keys, "obs_date", "wealth")
    probes = points.select(*keys, F.date_sub("obs_date", span).alias("probe"), F.col("obs_date").alias("day"), F.col("wealth").alias("end"), F.min("wealth").over(frame).alias("low"))
    df = as_of_join(probes, points, keys, "probe", "obs_date", ["wealth"])
    took = F.datediff("day", "as_of_obs_date")
    ok = (F.abs(took - span) <= max(10, 0.1 * span)) & (F.col("low") >= F.col("wealth"))
    return df.select(*keys, F.col("day").alias("obs_date"), F.when(ok, 100 * F.log(F.col("end") / F.col("wealth")) * basis / took).alias("carry"))
