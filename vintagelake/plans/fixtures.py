"""Views over the driver's tables that stand for the engine's inputs, in Spark and, word for word in meaning, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUTOFF = "1998-06-30"
FIRST = "1995-01-01"
TENORS = [("1MO", 1 / 12), ("3MO", 0.25), ("6MO", 0.5), ("1Y", 1.0), ("2Y", 2.0), ("3Y", 3.0), ("5Y", 5.0), ("7Y", 7.0), ("10Y", 10.0), ("20Y", 20.0), ("30Y", 30.0)]
LAMBDA = 0.609


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dayno(day: Column | str) -> Column:
    return F.datediff(F.col(day) if isinstance(day, str) else day, F.lit(FIRST).cast("date"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of orders as vintages, of which obs keeps one for each series, period and revision."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship"), F.col("l_extendedprice").alias("value"))
    j = o.join(li, o.o_orderkey == li.l_orderkey).withColumn("release_date", F.expr("date_add(obs_date, cast(datediff(obs_date, date'1995-01-01') % 30 as int))"))
    return j.withColumn("revision_date", F.greatest("release_date", "ship"))


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Bitemporal figures: an order's day is the period, its lines are vintages."""
    w = Window.partitionBy("series_id", "obs_date", "revision_date").orderBy("l_orderkey", "l_linenumber", "value")
    return lines(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("series_id", "obs_date", "release_date", "revision_date", "value")


def obs_invalid(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of which about half are released before their period."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("obs_date"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("release_date"), F.col("l_extendedprice").alias("value"))
    return o.join(li, o.o_orderkey == li.l_orderkey).select("series_id", "obs_date", "release_date", F.col("release_date").alias("revision_date"), "value", "l_orderkey", "l_linenumber")


def obs_null_rev(spark: SparkSession, sf: str) -> DataFrame:
    return obs(spark, sf).withColumn("revision_date", F.when(dayno("obs_date") % 7 != 0, F.col("revision_date")))


def price(spark: SparkSession, sf: str) -> DataFrame:
    """A daily level: orders' totals by day, in hundreds of thousands."""
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("obs_date")).agg((F.floor(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")) / 1000) / F.lit(10000.0)).alias("value"))
    return o.select(F.lit("PX").alias("series_id"), "obs_date", "value")


def price_alt(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """The level with a small wobble, from earlier days only, for splices."""
    return (price(spark, sf) if days is None else days).where("obs_date <= date'1999-12-31'").withColumn("value", F.col("value") * (1 + F.lit(0.001) * (dayno("obs_date") % 7)))


def price_late(spark: SparkSession, sf: str) -> DataFrame:
    return price(spark, sf).where("obs_date >= date'1997-01-01'")


def curve(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """Eleven tenors for each day from Nelson-Siegel factors that move with the day; every fifth day lacks the short ones."""
    days = (price(spark, sf) if days is None else days).select("obs_date").withColumn("n", dayno("obs_date"))
    tenors = F.explode(F.array(*(F.struct(F.lit(t).alias("tenor"), F.lit(float(m)).alias("maturity")) for t, m in TENORS))).alias("t")
    x = F.lit(LAMBDA) * F.col("maturity")
    load = (1 - F.exp(-x)) / x
    y = (5 + F.sin(F.col("n") / 200.0)) + (-1.5 + 2 * F.cos(F.col("n") / 150.0)) * load + F.sin(F.col("n") / 90.0) * (load - F.exp(-x))
    out = days.select("obs_date", "n", tenors).select("obs_date", "n", "t.*").withColumn("yield", F.round(y, 6))
    return out.where(~((F.col("n") % 5 == 0) & (F.col("maturity") < 1))).select("obs_date", "tenor", "maturity", "yield")


def rates_short(spark: SparkSession, sf: str, days: DataFrame | None = None) -> DataFrame:
    """A short rate in percent with two long holes."""
    p = (price(spark, sf) if days is None else days).withColumn("n", dayno("obs_date"))
    return p.where("not (n between 300 and 360) and not (n between 900 and 960)").select(F.lit("SR").alias("series_id"), "obs_date", F.round(2 + F.sin(F.col("n") / 50.0), 6).alias("value"))


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Line items by return flag and month, known two weeks after the month's end; one month is missing."""
    li = table(spark, sf, "lineitem").select(F.last_day(F.to_date("l_shipdate")).alias("obs_date"), F.col("l_returnflag").alias("series_id"), "l_quantity")
    out = li.groupBy("series_id", "obs_date").agg((F.round(F.sum("l_quantity"), 2) / 10).alias("value")).where("obs_date <> date'1997-03-31'")
    return out.select("series_id", "obs_date", F.date_add("obs_date", 14).alias("release_date"), F.date_add("obs_date", 14).alias("revision_date"), F.round("value", 4).alias("value"))


def events_obs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("obs_date")).agg(F.round(F.sum("value"), 4).alias("value"))
    return e.select("series_id", "obs_date", F.date_add("obs_date", 1).alias("release_date"), F.date_add("obs_date", 1).alias("revision_date"), "value")


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """One description for each series of obs, and one for a series without figures."""
    ids = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("series_id")).distinct()
    extra = spark.createDataFrame([("NONE",)], "series_id string")
    return ids.union(extra).select("series_id", F.concat(F.lit("Series "), "series_id").alias("title"), F.lit("daily").alias("frequency"), F.when(F.col("series_id") < "3", "index").otherwise("percent").alias("unit"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """A tall metric store: level, change and a flag for two assets."""
    p = price(spark, sf).withColumn("n", dayno("obs_date"))
    m = F.explode(F.array(*(F.struct(F.lit(a).alias("asset"), F.lit(k).alias("metric"), v.alias("value")) for a, k, v in [
        ("equity", "rii", F.col("value") % 100), ("equity", "tail_probability", (F.col("n") % 11) / 11.0), ("equity", "shock_likelihood", (F.col("n") % 7) / 7.0),
        ("gold", "hedge_score", (F.col("n") % 13) / 13.0), ("gold", "rii", F.col("value") % 50)]))).alias("m")
    return p.select(F.col("obs_date").alias("as_of"), m).select("m.asset", "m.metric", "as_of", F.round("m.value", 6).alias("value")).where("not (metric = 'shock_likelihood' and as_of >= date'1998-01-01')")


#: The same views for the SQL engine. Each may use those before it.
SQL = {
    "obs": """SELECT series_id, obs_date, release_date, revision_date, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, obs_date, revision_date ORDER BY l_orderkey, l_linenumber, value) AS rn
  FROM (SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, CAST(o_orderdate AS DATE) + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INT) AS release_date,
    greatest(CAST(o_orderdate AS DATE) + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 30 AS INT), CAST(l_shipdate AS DATE)) AS revision_date, l_extendedprice AS value, l_orderkey, l_linenumber
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey)) WHERE rn = 1""",
    "obs_invalid": "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS obs_date, CAST(l_shipdate AS DATE) AS release_date, CAST(l_shipdate AS DATE) AS revision_date, l_extendedprice AS value, l_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "obs_null_rev": "SELECT series_id, obs_date, release_date, CASE WHEN date_diff('day', DATE '1995-01-01', obs_date) % 7 <> 0 THEN revision_date END AS revision_date, value FROM obs",
    "knowable": f"SELECT *, greatest(release_date, coalesce(revision_date, release_date)) AS knowable_at FROM obs WHERE greatest(release_date, coalesce(revision_date, release_date)) <= DATE '{CUTOFF}'",
    "pit_latest": f"SELECT *, date_diff('day', obs_date, DATE '{CUTOFF}') AS staleness_days FROM knowable QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC, knowable_at DESC) = 1",
    "pit_hist": "SELECT * FROM knowable QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY knowable_at DESC) = 1",
    "price": "SELECT 'PX' AS series_id, CAST(o_orderdate AS DATE) AS obs_date, floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1000) / 10000.0::DOUBLE AS value FROM orders GROUP BY 2",
    "price_alt": "SELECT series_id, obs_date, value * (1 + 0.001::DOUBLE * (date_diff('day', DATE '1995-01-01', obs_date) % 7)) AS value FROM price WHERE obs_date <= DATE '1999-12-31'",
    "price_late": "SELECT * FROM price WHERE obs_date >= DATE '1997-01-01'",
    "tenors": "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {m!r}::DOUBLE)" for t, m in TENORS) + ") AS t(tenor, maturity)",
    "curve": f"""SELECT obs_date, tenor, maturity, round((5 + sin(n / 200.0::DOUBLE)) + (-1.5::DOUBLE + 2 * cos(n / 150.0::DOUBLE)) * load + sin(n / 90.0::DOUBLE) * (load - exp(-x)), 6) AS yield FROM (SELECT *, (1 - exp(-x)) / x AS load FROM (SELECT obs_date, n, tenor, maturity, {LAMBDA}::DOUBLE * maturity AS x
  FROM (SELECT obs_date, date_diff('day', DATE '1995-01-01', obs_date) AS n FROM price), tenors)) WHERE NOT (n % 5 = 0 AND maturity < 1)""",
    "rates_short": "SELECT 'SR' AS series_id, obs_date, round(2 + sin(n / 50.0::DOUBLE), 6) AS value FROM (SELECT obs_date, date_diff('day', DATE '1995-01-01', obs_date) AS n FROM price) WHERE NOT (n BETWEEN 300 AND 360) AND NOT (n BETWEEN 900 AND 960)",
    "monthly": "SELECT series_id, obs_date, obs_date + 14 AS release_date, obs_date + 14 AS revision_date, round(value, 4) AS value FROM (SELECT l_returnflag AS series_id, last_day(CAST(l_shipdate AS DATE)) AS obs_date, round(sum(l_quantity), 2) / 10 AS value FROM lineitem GROUP BY 1, 2) WHERE obs_date <> DATE '1997-03-31'",
    "events_obs": "SELECT series_id, obs_date, obs_date + 1 AS release_date, obs_date + 1 AS revision_date, value FROM (SELECT event_type AS series_id, CAST(ts AS DATE) AS obs_date, round(sum(value), 4) AS value FROM events GROUP BY 1, 2)",
    "metadata": "SELECT series_id, 'Series ' || series_id AS title, 'daily' AS frequency, CASE WHEN series_id < '3' THEN 'index' ELSE 'percent' END AS unit FROM (SELECT DISTINCT o_orderpriority AS series_id FROM orders UNION ALL SELECT 'NONE')",
    "outputs": """SELECT asset, metric, as_of, round(value, 6) AS value FROM (SELECT obs_date AS as_of, unnest([{'asset': 'equity', 'metric': 'rii', 'value': value % 100}, {'asset': 'equity', 'metric': 'tail_probability', 'value': (n % 11) / 11.0::DOUBLE}, {'asset': 'equity', 'metric': 'shock_likelihood', 'value': (n % 7) / 7.0::DOUBLE},
  {'asset': 'gold', 'metric': 'hedge_score', 'value': (n % 13) / 13.0::DOUBLE}, {'asset': 'gold', 'metric': 'rii', 'value': value % 50}], recursive := true) FROM (SELECT *, date_diff('day', DATE '1995-01-01', obs_date) AS n FROM price)) WHERE NOT (metric = 'shock_likelihood' AND as_of >= DATE '1998-01-01')""",
}


def oracle(body: str, *more: tuple[str, str]) -> str:
    """The body over all views and `more` ones."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in [*SQL.items(), *more]) + "\n" + body
