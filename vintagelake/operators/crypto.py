"""Crypto: one price record from several, the supply schedule, regimes, and the tie to liquidity."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintagelake.functions.finance import crypto_regime
from vintagelake.operators import windows


def W():
    """Rows of a series in order of days. A function, as a window can only be made where a session is."""
    return windows.ordered(["series_id"], "obs_date")

#: Fixed values of the protocol: its first block and the halvings so far; blocks in an epoch, seconds a block, the first subsidy.
GENESIS = date(2009, 1, 3)
HALVINGS = [date(2012, 11, 28), date(2016, 7, 9), date(2020, 5, 11), date(2024, 4, 20)]
EPOCH_BLOCKS, BLOCK_SECONDS, FIRST_SUBSIDY = 210_000, 600, 50.0
BLOCKS_A_YEAR = 365.25 * 86_400 / BLOCK_SECONDS


def epochs() -> list[tuple[int, date, date, float, float]]:
    """(epoch, first day, day of its end, subsidy, supply at its start); the last one's end is projected at the nominal pace."""
    days = [GENESIS, *HALVINGS]
    days.append(days[-1] + timedelta(days=EPOCH_BLOCKS * BLOCK_SECONDS / 86_400))
    out, supply = [], 0.0
    for i, (a, b) in enumerate(zip(days, days[1:], strict=False)):
        subsidy = FIRST_SUBSIDY / 2**i
        out.append((i, a, b, subsidy, supply))
        supply += EPOCH_BLOCKS * subsidy
    return out


def schedule(days: DataFrame) -> DataFrame:
    """Supply, yearly issuance in percent of it, stock to flow and days to the next halving for each obs_date; days before the first block have no row.

    The epochs are five rows, so the range join is broadcast.
    """
    table = days.sparkSession.createDataFrame(epochs(), "epoch int, first date, last date, subsidy double, supply double")
    df = days.join(F.broadcast(table), (F.col("obs_date") >= F.col("first")) & (F.col("obs_date") < F.col("last")))
    issued = F.col("supply") + EPOCH_BLOCKS * F.col("subsidy") * F.datediff("obs_date", "first") / F.datediff("last", "first")
    flow = F.col("subsidy") * BLOCKS_A_YEAR
    df = df.withColumn("issued_supply", issued)
    return df.select(*days.columns, "issued_supply", F.try_divide(100 * flow, F.col("issued_supply")).alias("issuance_rate"), (F.col("issued_supply") / flow).alias("stock_to_flow"), "subsidy", F.datediff("last", "obs_date").alias("days_to_next"))


def price_record(base: DataFrame, older: DataFrame, min_overlap: int = 250, max_bias: float = 0.05, ratio: tuple[float, float] = (0.75, 1.35)) -> DataFrame:
    """base, led by older rows if on the common days the levels agree and both move by about as much; `source` tells them apart."""
    moved = lambda df, name: df.select("obs_date", F.col("value").alias(name), windows.log_return(F.col("value"), W()).alias(f"{name}_r"))
    both = moved(base, "a").join(moved(older, "b"), "obs_date")
    check = both.agg(F.count("*").alias("n"), F.percentile(F.abs(F.col("b") / F.col("a") - 1), F.lit(0.5)).alias("bias"), (F.stddev_samp("b_r") / F.stddev_samp("a_r")).alias("vol"))
    ok = check.where((F.col("n") >= min_overlap) & (F.col("bias") <= max_bias) & F.col("vol").between(*ratio)).crossJoin(base.agg(F.min("obs_date").alias("first_day")))
    head = older.join(F.broadcast(ok), F.col("obs_date") < F.col("first_day")).select("obs_date", "value", F.lit("older").alias("source"))
    return head.unionByName(base.select("obs_date", "value", F.lit("base").alias("source")))


def regime(df: DataFrame, window: int = 365) -> DataFrame:
    """df with the label of each day from the trailing price path alone; r is the log return."""
    vol = 100 * windows.rolling(F.stddev_samp, F.col("r"), W(), window) * 365**0.5
    inputs = {"drawdown": windows.drawdown(F.col("value"), W(), window), "year_return": windows.log_return(F.col("value"), W(), window), "vol": vol, "_row": F.row_number().over(W())}
    return df.withColumns(inputs).withColumn("regime", crypto_regime(F.col("drawdown"), F.col("year_return"), F.col("vol"), F.col("_row"))).drop("_row")


def composite_liquidity(series: DataFrame, money: str, assets: str, scale: float = 0.001) -> DataFrame:
    """Money plus scaled central-bank assets, each as last known; null while one of them is not known."""
    wide = series.groupBy("obs_date").pivot("series_id", [money, assets]).agg(F.first("value")).withColumn("series_id", F.lit("liquidity"))
    return wide.select("series_id", "obs_date", (windows.ffill(F.col(money), W()) + scale * windows.ffill(F.col(assets), W())).alias("level"))


def liquidity_beta(df: DataFrame, at_least: int = 36) -> DataFrame:
    """Running regression of the monthly return on the change of liquidity (in percent, by logs), with n and the month's residual."""
    rows = df.withColumns({"ret": 100 * windows.log_return(F.col("value"), W()), "dl": 100 * windows.log_return(F.col("level"), W())}).where("ret is not null and dl is not null")
    fit = windows.running_ols(F.col("dl"), F.col("ret"), W(), at_least)
    rows = rows.withColumns(fit | {"n": F.count("*").over(W().rowsBetween(windows.EVER, 0))})
    return rows.withColumn("residual", F.col("ret") - F.col("alpha") - F.col("beta") * F.col("dl"))


def band(df: DataFrame, sigmas: float = 2.0) -> DataFrame:
    """How far the level has drifted from the fit, the width of the random walk's band, and the distance above, in widths and not below 0."""
    rows = df.withColumns({"deviation": F.sum("residual").over(W().rowsBetween(windows.EVER, 0)), "width": F.when(F.col("beta").isNotNull(), sigmas * F.col("sigma") * F.sqrt("n"))})
    return rows.withColumn("excess", F.when(F.col("width").isNotNull(), F.greatest(F.lit(0.0), F.col("deviation") / F.nullif(F.col("width"), F.lit(0.0)))))


def volume_trend(volume: Column, w, recent: int = 90, baseline: int = 365) -> Column:
    return windows.rolling(F.avg, volume, w, recent, recent // 2) / F.nullif(windows.rolling(F.avg, volume, w, baseline, baseline // 2), F.lit(0.0))
