"""Gold: its drivers, the jumps in its price, and how well it hedges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vintagelake.functions.finance import clip, hedge_score
from vintagelake.operators import windows
from vintagelake.operators.joins import as_of_join


def W():
    """Rows of a series in order of days. A function, as a window can only be made where a session is."""
    return windows.ordered(["series_id"], "obs_date")



def real_rate(df: DataFrame, cpi: DataFrame, months: int = 12) -> DataFrame:
    """df with real_rate: nominal less the breakeven rate as last known, else less the inflation of the last months with a price index; is_ex_post tells which.

    cpi has series_id, month (its end) and cpi; months without a figure are left out before the ratio is taken.
    """
    yoy = cpi.where("cpi is not null").withColumn("yoy", (F.col("cpi") / F.lag("cpi", months).over(Window.partitionBy("series_id").orderBy("month")) - 1) * 100)
    held = df.withColumn("_held", windows.ffill(F.col("breakeven"), W()))
    out = as_of_join(held, yoy.where("yoy is not null").select("series_id", "month", "yoy"), ["series_id"], "obs_date", "month", ["yoy"])
    ante, post = F.col("nominal") - F.col("_held"), F.col("nominal") - F.col("yoy")
    return out.withColumns({"real_rate": F.coalesce(ante, post), "is_ex_post": ante.isNull() & post.isNotNull()}).drop("_held", "as_of_month")


def usd_trend(broad: Column, legacy: Column, w, n: int = 252) -> Column:
    """Log change over n rows of the broad index, before it of the legacy one: spliced as changes, never as levels."""
    return F.coalesce(windows.log_return(broad, w, n), windows.log_return(legacy, w, n))


def monthly_panel(df: DataFrame, drivers: list[str], baseline: int = 756) -> DataFrame:
    """Month ends with ret, 100 times the log return, and each driver's expanding z-score as of the month's last day."""
    z = {f"z_{d}": windows.expanding_z(F.col(d), W(), baseline, True, 4.0) for d in drivers}
    rows = df.where("value > 0").withColumns(z).groupBy("series_id", F.last_day("obs_date").alias("obs_date"))
    ends = rows.agg(F.max_by("value", "obs_date").alias("value"), *(F.max_by(c, "obs_date").alias(c) for c in z))
    return ends.withColumn("ret", 100 * windows.log_return(F.col("value"), W())).where("ret is not null")


SCALE = math.sqrt(2 / math.pi)


def jump_limit(n: Column, alpha: float = 0.01) -> Column:
    """What the largest of n standardized returns passes with probability alpha if there is no jump; null for fewer than 3."""
    root = F.sqrt(2 * F.log(n))
    limit = root / SCALE - (math.log(math.pi) + F.log(F.log(n))) / (2 * SCALE * root) - math.log(-math.log(1 - alpha)) / (SCALE * root)
    return F.when(n >= 3, limit)


def jumps(df: DataFrame, window: int = 63, intensity_rows: int = 252, per_year: int = 252) -> DataFrame:
    """Rows with a return r, with statistic, is_jump and intensity (jumps a year over the last rows). The limit grows with the rows so far."""
    rows = df.where("r is not null").withColumn("_sigma", F.sqrt(windows.bipower_variation(F.col("r"), W(), window)))
    rows = rows.withColumn("statistic", F.col("r") / (SCALE * F.nullif(F.col("_sigma"), F.lit(0.0))))
    rows = rows.withColumn("_limit", jump_limit(F.count("statistic").over(W().rowsBetween(windows.EVER, 0))))
    rows = rows.withColumn("is_jump", F.coalesce(F.abs("statistic") > F.col("_limit"), F.lit(False)))
    return rows.withColumn("intensity", windows.rolling(F.avg, F.col("is_jump").cast("int"), W(), intensity_rows, window) * per_year).drop("_sigma", "_limit")


def hedge(df: DataFrame, own: str, equity: str, support: str, window: int = 504, least: int = 40, fall: float = 0.05) -> DataFrame:
    """df with the correlation with equity returns on days when equities are down from the year's peak, the days, and the score."""
    rows = df.withColumns({"_down": windows.drawdown(F.col(equity), W(), 252) <= -fall, "_e": windows.log_return(F.col(equity), W())})
    a, b = F.when(F.col("_down"), F.col(own)), F.when(F.col("_down"), F.col("_e"))
    rows = rows.withColumns({"correlation": windows.rolling_corr(a, b, W(), window, least), "days": F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(W().rowsBetween(1 - window, 0))})
    return rows.withColumn("score", hedge_score(F.col("correlation"), F.col(support))).drop("_down", "_e")


def state(vol: Column, intensity: Column) -> dict[str, Column]:
    """Risk from volatility and jumps, and confidence, lower by what is missing."""
    risk = 100 * clip(0.7 * F.coalesce(clip(vol / 30, 0, 1), F.lit(0.5)) + 0.3 * F.least(F.lit(1.0), F.coalesce(intensity, F.lit(0.0)) / 6), 0, 1)
    confidence = 0.7 - F.when(vol.isNull(), 0.1).otherwise(0.0) - F.when(intensity.isNull(), 0.05).otherwise(0.0)
    return {"risk": risk, "confidence": clip(confidence, 0, 0.7)}


def modal_state(df: DataFrame) -> DataFrame:
    """The most frequent state inside each named window, how often, and its share."""
    counts = df.groupBy("name", "state").agg(F.count("*").alias("n"))
    w = Window.partitionBy("name")
    ranked = counts.withColumns({"share": F.round(F.col("n") / F.sum("n").over(w), 6), "_rn": F.row_number().over(w.orderBy(F.desc("n"), "state"))})
    return ranked.where("_rn = 1").drop("_rn")
