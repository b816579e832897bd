"""Queries of the window functions and aggregates over series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from vintagelake.operators import aggregates, differencing, windows
from vintagelake.plans.fixtures import CUTOFF, curve, dayno, events_obs, metadata, monthly, obs, oracle, outputs, price, price_alt, rates_short, table
from vintagelake.plans.registry import query


def W():
    """Rows of a series in order of days. A function, as a window can only be made where a session is."""
    return windows.ordered(["series_id"], "obs_date")


def V():
    return F.col("value")

DAY = "date_diff('day', DATE '1995-01-01', obs_date)"
BY = "PARTITION BY series_id ORDER BY obs_date"
RETURNS = ("returns", f"SELECT series_id, obs_date, value, {DAY} AS n, ln(value / lag(value) OVER ({BY})) AS r, sin({DAY} / 40.0::DOUBLE) + {DAY} % 5 AS y FROM price")


def rnd(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def returns(spark, sf):
    """The price with its day's number, its log return and a second path."""
    p = price(spark, sf).withColumn("n", dayno("obs_date"))
    return p.withColumns({"r": windows.log_return(V(), W()), "y": F.sin(F.col("n") / 40.0) + F.col("n") % 5})


def over(n: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


EVER = f"OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("W01_row_number", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w01(spark, sf):
    from vintagelake.operators.pit import newest

    return newest(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("W02_count_over", oracle("SELECT series_id, obs_date, count(*) OVER (PARTITION BY series_id) AS n FROM events_obs"))
def w02(spark, sf):
    return events_obs(spark, sf).select("series_id", "obs_date", F.count("*").over(Window.partitionBy("series_id")).alias("n"))


@query("W03_expanding_z", oracle(f"""SELECT obs_date, CASE WHEN count(r) {EVER} >= 2 THEN round(coalesce(greatest(-3, least(3, (r - avg(r) {EVER}) / nullif(stddev_pop(r) {EVER}, 0))), 0), 6) END AS factor_z,
  CASE WHEN count(r) {EVER} >= 756 THEN round(greatest(-4, least(4, (r - avg(r) {EVER}) / nullif(stddev_samp(r) {EVER}, 0))), 6) END AS driver_z,
  CASE WHEN count(r) {EVER} >= 250 THEN round((r - avg(r) {EVER}) / nullif(stddev_samp(r) {EVER}, 0), 6) END AS jerk_z FROM returns""", RETURNS))
def w03(spark, sf):
    r = F.col("r")
    seen = F.count(r).over(W().rowsBetween(windows.EVER, 0))
    factor = F.when(seen >= 2, F.coalesce(windows.expanding_z(r, W(), 2, False, 3.0), F.lit(0.0)))
    return returns(spark, sf).select("obs_date", rnd(factor).alias("factor_z"), rnd(windows.expanding_z(r, W(), 756, True, 4.0)).alias("driver_z"), rnd(windows.expanding_z(r, W(), 250, True, None)).alias("jerk_z"))


MIDRANK = """SELECT a.series_id, a.obs_date, a.value, CASE WHEN count(b.value) = 0 THEN 0.5 ELSE (count(*) FILTER (WHERE b.value < a.value) + count(*) FILTER (WHERE b.value <= a.value)) / 2.0::DOUBLE / count(b.value) END AS pct
  FROM {0} a LEFT JOIN {0} b ON a.series_id = b.series_id AND b.obs_date < a.obs_date AND b.value IS NOT NULL WHERE a.value IS NOT NULL GROUP BY 1, 2, 3"""


@query("W04_expanding_midrank", oracle(f"SELECT series_id, obs_date, value, round(pct, 9) AS pct FROM ({MIDRANK.format('price')})"))
def w04(spark, sf):
    return windows.expanding_midrank(price(spark, sf), "series_id", "obs_date", "value", "pct").withColumn("pct", rnd("pct", 9))


@query("W05_rolling", oracle(f"""SELECT obs_date, CASE WHEN count(r) {over(21)} >= 21 THEN round(avg(r) {over(21)}, 8) END AS mean, CASE WHEN count(r) {over(21)} >= 10 THEN round(max(r) {over(21)}, 8) END AS high,
  CASE WHEN count(r) {over(21)} >= 10 THEN round(min(r) {over(21)}, 8) END AS low, CASE WHEN count(r) {over(21)} >= 21 THEN round(sum(r) {over(21)}, 8) END AS total, CASE WHEN count(r) {over(63)} >= 63 THEN round(stddev_samp(r) {over(63)}, 8) END AS sd FROM returns""", RETURNS))
def w05(spark, sf):
    r = F.col("r")
    made = {"mean": windows.rolling(F.avg, r, W(), 21), "high": windows.rolling(F.max, r, W(), 21, 10), "low": windows.rolling(F.min, r, W(), 21, 10), "total": windows.rolling(F.sum, r, W(), 21), "sd": windows.rolling(F.stddev_samp, r, W(), 63)}
    return returns(spark, sf).select("obs_date", *(rnd(c, 8).alias(n) for n, c in made.items()))


@query("W06_rolling_median", oracle(f"SELECT obs_date, CASE WHEN count(value) {over(90)} >= 45 THEN round(quantile_cont(value, 0.5) {over(90)}, 6) END AS median FROM price"))
def w06(spark, sf):
    return price(spark, sf).select("obs_date", rnd(windows.rolling_median(V(), W(), 90, 45)).alias("median"))


@query("W07_rolling_corr", oracle(f"""SELECT obs_date, CASE WHEN count(r) {over(126)} >= 126 THEN round(corr(r, y) {over(126)}, 6) END AS plain, CASE WHEN count(mr) {over(504)} >= 40 THEN round(corr(mr, my) {over(504)}, 6) END AS masked
  FROM (SELECT *, CASE WHEN r < 0 THEN r END AS mr, CASE WHEN r < 0 THEN y END AS my FROM returns)""", RETURNS))
def w07(spark, sf):
    r, y, falling = F.col("r"), F.col("y"), F.col("r") < 0
    return returns(spark, sf).select("obs_date", rnd(windows.rolling_corr(r, y, W(), 126, 126)).alias("plain"), rnd(windows.rolling_corr(F.when(falling, r), F.when(falling, y), W(), 504, 40)).alias("masked"))


@query("W08_corr_baseline", oracle(f"""SELECT obs_date, CASE WHEN count(c) {over(378)} >= 189 THEN round(abs(c - avg(c) {over(378)}), 6) END AS breakdown FROM (SELECT *, CASE WHEN count(r) {over(63)} >= 63 THEN corr(r, y) {over(63)} END AS c FROM returns)""", RETURNS))
def w08(spark, sf):
    c = F.col("c")
    return returns(spark, sf).withColumn("c", windows.rolling_corr(F.col("r"), F.col("y"), W(), 63, 63)).select("obs_date", rnd(F.abs(c - windows.rolling(F.avg, c, W(), 378, 189))).alias("breakdown"))


@query("W09_drawdown", oracle(f"SELECT obs_date, round(value / max(value) {EVER} - 1, 6) AS from_peak, round(value / max(value) {over(252)} - 1, 6) AS from_year_peak, round(ln(value) - max(ln(value)) {EVER}, 6) AS log_drawdown FROM price"))
def w09(spark, sf):
    logged = F.log(V())
    return price(spark, sf).select("obs_date", rnd(windows.drawdown(V(), W())).alias("from_peak"), rnd(windows.drawdown(V(), W(), 252)).alias("from_year_peak"), rnd(logged - F.max(logged).over(W().rowsBetween(windows.EVER, 0))).alias("log_drawdown"))


@query("W10_changes", oracle(f"SELECT obs_date, round(value - lag(value) OVER ({BY}), 6) AS d1, round(ln(value / lag(value, 20) OVER ({BY})), 6) AS r20, round(abs(value - lag(value, 5) OVER ({BY})), 6) AS a5 FROM price"))
def w10(spark, sf):
    return price(spark, sf).select("obs_date", rnd(windows.change(V(), W())).alias("d1"), rnd(windows.log_return(V(), W(), 20)).alias("r20"), rnd(F.abs(windows.change(V(), W(), 5))).alias("a5"))


@query("W11_seen_before", oracle(f"SELECT obs_date, coalesce(max(CAST(value < 1 AS INT)) OVER (PARTITION BY series_id ORDER BY {DAY} RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING), 0) = 1 AS seen FROM rates_short"))
def w11(spark, sf):
    return rates_short(spark, sf).select("obs_date", windows.seen_before(V() < 1, ["series_id"], "obs_date", 365).alias("seen"))


@query("W12_cumulative", oracle(f"SELECT obs_date, round(sum(value) {EVER}, 4) AS total, count(value) {EVER} AS n FROM price"))
def w12(spark, sf):
    return price(spark, sf).select("obs_date", rnd(windows.expanding(F.sum, V(), W()), 4).alias("total"), F.count(V()).over(W().rowsBetween(windows.EVER, 0)).alias("n"))


WEALTH = """SELECT obs_date, segment, round(exp(sum(growth) OVER (PARTITION BY segment ORDER BY obs_date)), 8) AS wealth FROM (SELECT *, sum(CAST(restart AS INT)) OVER (ORDER BY obs_date) AS segment FROM (
  SELECT *, gap IS NULL OR gap > 40 AS restart, CASE WHEN gap <= 40 THEN before / 100 * gap / 360 ELSE 0 END AS growth FROM (SELECT *, date_diff('day', lag(obs_date) OVER (ORDER BY obs_date), obs_date) AS gap, lag(value) OVER (ORDER BY obs_date) AS before FROM rates_short)))"""


@query("W13_segmented_index", oracle(WEALTH))
def w13(spark, sf):
    gap = F.datediff("obs_date", F.lag("obs_date").over(W()))
    df = rates_short(spark, sf).withColumns({"gap": gap, "before": F.lag("value").over(W())})
    out = windows.segmented_index(df, ["series_id"], "obs_date", F.col("before") / 100 * F.col("gap") / 360, F.col("gap") > 40, "wealth")
    return out.select("obs_date", "segment", rnd("wealth", 8).alias("wealth"))


@query("W14_running_ols", oracle(f"""SELECT obs_date, round(beta, 8) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r2, round(sqrt(greatest(0, syy - beta * sxy) / (n - 2)), 6) AS sigma FROM (SELECT obs_date, count(r) {EVER} AS n, regr_slope(y, r) {EVER} AS beta, regr_intercept(y, r) {EVER} AS alpha, regr_r2(y, r) {EVER} AS r2, regr_syy(y, r) {EVER} AS syy, regr_sxy(y, r) {EVER} AS sxy FROM returns)
  WHERE n >= 36 UNION ALL SELECT obs_date, NULL, NULL, NULL, NULL FROM returns QUALIFY count(r) {EVER} < 36""", RETURNS))
def w14(spark, sf):
    out = windows.running_ols(F.col("r"), F.col("y"), W(), 36)
    return returns(spark, sf).select("obs_date", *(rnd(c, 8 if k == "beta" else 6).alias(k) for k, c in out.items()))


@query("W15_forward", oracle(f"""SELECT obs_date, CASE WHEN count(*) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) = 60 THEN max(value) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) END AS highest,
  min(value) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING) AS lowest FROM price"""))
def w15(spark, sf):
    return price(spark, sf).select("obs_date", windows.forward_max(V(), W(), 60).alias("highest"), windows.forward_min(V(), W(), 60).alias("lowest"))


@query("W16_edge", oracle(f"SELECT obs_date FROM price QUALIFY value > 10 AND NOT coalesce(lag(value > 10) OVER ({BY}), false)"))
def w16(spark, sf):
    return price(spark, sf).withColumn("on", windows.edge(V() > 10, W())).where("on").select("obs_date")


@query("W17_bipower", oracle(f"SELECT obs_date, CASE WHEN count(p) {over(63)} >= 61 THEN round(sum(p) {over(63)} / 61, 8) END AS variance FROM (SELECT *, abs(r) * abs(lag(r) OVER ({BY})) AS p FROM returns)", RETURNS))
def w17(spark, sf):
    p = returns(spark, sf).withColumn("p", F.abs("r") * F.abs(F.lag("r").over(W())))
    return p.select("obs_date", rnd(windows.rolling(F.sum, F.col("p"), W(), 63, 61) / 61, 8).alias("variance"))


@query("W18_nested_horizons", oracle("SELECT obs_date, a AS m3, greatest(a, b) AS m6, greatest(a, b, c) AS m12 FROM (SELECT obs_date, (n % 7) / 10.0::DOUBLE AS a, (n % 5) / 10.0::DOUBLE AS b, (n % 11) / 10.0::DOUBLE AS c FROM returns)", RETURNS))
def w18(spark, sf):
    p = returns(spark, sf).select("obs_date", *((F.col("n") % m / 10.0).alias(c) for c, m in (("m3", 7), ("m6", 5), ("m12", 11))))
    return windows.nested(p, ["m3", "m6", "m12"])


FFD = windows.ffd_weights(0.4, 1e-3, 250)


@query("W19_ffd", oracle(f"""SELECT obs_date, CASE WHEN k = {len(FFD)} THEN round(s, 6) END AS ffd FROM (SELECT p.obs_date, count(*) AS k, sum(w.weight * ln(q.value)) AS s
  FROM (SELECT *, row_number() OVER (ORDER BY obs_date) AS i FROM price) p JOIN (SELECT * FROM (VALUES {', '.join(f'({i}, {x!r}::DOUBLE)' for i, x in enumerate(FFD))}) AS t(k, weight)) w ON true JOIN (SELECT *, row_number() OVER (ORDER BY obs_date) AS i FROM price) q ON q.i = p.i - w.k GROUP BY 1)"""))
def w19(spark, sf):
    return differencing.fractional(price(spark, sf).withColumn("l", F.log(V())), "obs_date", "l", FFD).select("obs_date", rnd("ffd").alias("ffd"))


@query("W20_release_floor", oracle("SELECT series_id, obs_date, min(release_date) OVER (PARTITION BY series_id ORDER BY obs_date DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS floor FROM monthly"))
def w20(spark, sf):
    w = Window.partitionBy("series_id").orderBy(F.desc("obs_date")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly(spark, sf).select("series_id", "obs_date", F.min("release_date").over(w).alias("floor"))


@query("A01_count", oracle(f"SELECT count(*) AS n FROM obs WHERE release_date <= DATE '{CUTOFF}'"))
def a01(spark, sf):
    return obs(spark, sf).where(F.col("release_date") <= F.lit(CUTOFF).cast("date")).agg(F.count("*").alias("n"))


@query("A02_ingestion_health", """SELECT source, status, max(run_at) AS last_run, sum("rows") AS "rows", max("rows") AS most FROM (SELECT event_type AS source, CASE WHEN value > 100 THEN 'failed' ELSE 'ok' END AS status, ts AS run_at, CAST(user_id % 50 AS BIGINT) AS "rows" FROM events) GROUP BY 1, 2""")
def a02(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") > 100, "failed").otherwise("ok").alias("status"), F.col("ts").alias("run_at"), (F.col("user_id") % 50).alias("rows"))
    return log.groupBy("source", "status").agg(F.max("run_at").alias("last_run"), F.sum("rows").alias("rows"), F.max("rows").alias("most"))


@query("A03_distinct", oracle("SELECT DISTINCT asset, metric FROM outputs"))
def a03(spark, sf):
    return outputs(spark, sf).select("asset", "metric").distinct()


@query("A04_equal_weight_mean", oracle("SELECT as_of, round(avg(value) + 1e-9, 6) AS score FROM outputs GROUP BY 1"))
def a04(spark, sf):
    return outputs(spark, sf).groupBy("as_of").agg(rnd(F.avg("value") + 1e-9).alias("score"))


WEIGHTS = {"rii": 1.0, "tail_probability": 2.0, "shock_likelihood": 0.5, "hedge_score": 1.5}


@query("A05_renormalized_mean", oracle(f"SELECT asset, as_of, round(sum(w * value) / sum(w), 6) AS score FROM outputs JOIN (VALUES {', '.join(f'({k!r}, {v!r}::DOUBLE)' for k, v in WEIGHTS.items())}) AS t(metric, w) USING (metric) GROUP BY 1, 2"))
def a05(spark, sf):
    w = reduce(lambda c, kv: c.when(F.col("metric") == kv[0], kv[1]), WEIGHTS.items(), F.when(F.lit(False), 0.0))
    return outputs(spark, sf).groupBy("asset", "as_of").agg(rnd(aggregates.weighted_mean(V(), w)).alias("score"))


@query("A06_geometric_mean", oracle("SELECT obs_date, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN NULL WHEN least(a, b, c) = 0 THEN 0 ELSE round(100 * exp((ln(a) + ln(b) + ln(c)) / 3), 6) END AS score FROM (SELECT obs_date, (n % 7) / 7.0::DOUBLE AS a, least(1, abs(r)) AS b, least(1, value / 20) AS c FROM returns)", RETURNS))
def a06(spark, sf):
    terms = [F.col("n") % 7 / 7.0, F.least(F.lit(1.0), F.abs("r")), F.least(F.lit(1.0), V() / 20)]
    return returns(spark, sf).select("obs_date", rnd(100 * aggregates.geometric_mean(terms)).alias("score"))


@query("A07_robust_z", oracle("SELECT series_id, obs_date, CASE WHEN mad = 0 THEN 0 ELSE round((value - med) / (1.4826 * mad), 6) END AS z FROM (SELECT *, quantile_cont(abs(value - med), 0.5) OVER (PARTITION BY series_id) AS mad FROM (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY series_id) AS med FROM monthly))"))
def a07(spark, sf):
    return aggregates.robust_z(monthly(spark, sf), ["series_id"], "value", "z").select("series_id", "obs_date", rnd("z").alias("z"))


@query("A08_quartile_by_index", oracle("SELECT series_id, list_sort(list(abs(value)))[CAST(floor(0.75 * count(*)) AS INT) + 1] AS p75 FROM monthly GROUP BY 1"))
def a08(spark, sf):
    return aggregates.at_index(monthly(spark, sf), ["series_id"], F.abs("value"), 0.75, "p75")


@query("A09_posterior_weighted", oracle("SELECT k AS regime, round(exp(sum(w * r) / sum(w) / 100 * 12) - 1, 6) AS annual FROM (SELECT r, k, CASE WHEN k = n % 3 THEN 0.6 ELSE 0.2 END AS w FROM returns, (VALUES (0), (1), (2)) AS t(k) WHERE r IS NOT NULL) GROUP BY 1", RETURNS))
def a09(spark, sf):
    legs = F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("regime")
    df = returns(spark, sf).where("r is not null").select("r", "n", legs).withColumn("w", F.when(F.col("regime") == F.col("n") % 3, 0.6).otherwise(0.2))
    return df.groupBy("regime").agg(rnd(F.expm1(aggregates.weighted_mean(F.col("r"), F.col("w")) / 100 * 12)).alias("annual"))


STATE = ("states", f"SELECT series_id, obs_date, r, CASE WHEN sin(n / 60.0::DOUBLE) > 0.5 THEN 'bull' WHEN sin(n / 60.0::DOUBLE) < -0.6 THEN 'bear' ELSE 'normal' END AS state FROM returns")


def states(spark, sf):
    wave = F.sin(F.col("n") / 60.0)
    return returns(spark, sf).withColumn("state", F.when(wave > 0.5, "bull").when(wave < -0.6, "bear").otherwise("normal"))


@query("A10_state_statistics", oracle(f"""SELECT state, round(count(*) / (SELECT count(*) FROM states)::DOUBLE, 6) AS share, round(avg(r) * 252, 6) AS mean, round(stddev_samp(r) * sqrt(252), 6) AS vol, round(count(*)::DOUBLE / count(DISTINCT island), 6) AS persistence
  FROM (SELECT *, sum(start) OVER (ORDER BY obs_date) AS island FROM (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER (ORDER BY obs_date) THEN 0 ELSE 1 END AS start FROM states)) GROUP BY 1""", RETURNS, STATE))
def a10(spark, sf):
    return aggregates.state_statistics(states(spark, sf), ["series_id"], "obs_date", "state", "r", 252).drop("series_id")


@query("A11_episodes", oracle("""SELECT min(obs_date) AS start, count(*) AS days, round(max(depth), 6) AS depth FROM (SELECT *, sum(start) OVER (ORDER BY obs_date) AS island FROM (SELECT *, CASE WHEN (depth > 0.8) IS NOT DISTINCT FROM lag(depth > 0.8) OVER (ORDER BY obs_date) THEN 0 ELSE 1 END AS start
  FROM (SELECT obs_date, 1 - value / max(value) OVER (ORDER BY obs_date) AS depth FROM price))) WHERE depth > 0.8 GROUP BY island"""))
def a11(spark, sf):
    d = price(spark, sf).withColumn("depth", -windows.drawdown(V(), W()))
    out = aggregates.episodes(d, ["series_id"], "obs_date", "depth", 0.8)
    return out.select("start", "days", rnd("depth").alias("depth"))


FORECASTS = ("forecasts", "SELECT obs_date, (n % 100) / 99.0::DOUBLE AS p, CAST(n * 7 % 100 < n % 100 AS INT) AS y FROM returns")


def forecasts(spark, sf):
    n = F.col("n")
    return returns(spark, sf).select("obs_date", (n % 100 / 99.0).alias("p"), (n * 7 % 100 < n % 100).cast("int").alias("y"))


@query("A12_brier", oracle("SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y), 6) AS base FROM forecasts", RETURNS, FORECASTS))
def a12(spark, sf):
    return forecasts(spark, sf).agg(rnd(F.avg(F.pow(F.col("p") - F.col("y"), 2))).alias("brier"), rnd(F.avg("y")).alias("base"))


@query("A13_reliability", oracle("SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS observed FROM forecasts GROUP BY 1", RETURNS, FORECASTS))
def a13(spark, sf):
    return aggregates.reliability(forecasts(spark, sf), "p", "y").select("bin", "n", rnd("mean_p").alias("mean_p"), rnd("observed").alias("observed"))


FAN = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


@query("A14_quantile_fan", oracle(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS q, round(quantile_cont(value, {q}), 6) AS level FROM price" for q in FAN)))
def a14(spark, sf):
    return aggregates.fan(price(spark, sf), "value", FAN).select("q", rnd("level").alias("level"))


@query("A15_exceedance", oracle("SELECT t.x, round(avg(CAST(value > t.x AS INT)), 6) AS p FROM price, (VALUES (5.0::DOUBLE), (10.0), (15.0)) AS t(x) GROUP BY 1"))
def a15(spark, sf):
    return aggregates.exceedance(price(spark, sf), "value", [5.0, 10.0, 15.0]).select("x", rnd("p").alias("p"))


@query("A16_false_alarms", oracle("""SELECT count(*) AS calls, round(avg(CAST(future / value - 1 > -0.8 AS INT)), 6) AS false_alarm_rate, round(avg(CAST(future / value - 1 <= -0.8 AS INT)), 6) AS hit_rate FROM (SELECT p.*, s.state, min(p.value) OVER (ORDER BY p.obs_date ROWS BETWEEN 1 FOLLOWING AND 252 FOLLOWING) AS future FROM price p JOIN states s USING (obs_date)) WHERE state = 'bear' AND future IS NOT NULL""", RETURNS, STATE))
def a16(spark, sf):
    df = states(spark, sf).withColumn("future", windows.forward_min(V(), W(), 252)).where("state = 'bear' and future is not null")
    hit = (F.col("future") / V() - 1 <= -0.8).cast("int")
    return df.agg(F.count("*").alias("calls"), rnd(F.avg(1 - hit)).alias("false_alarm_rate"), rnd(F.avg(hit)).alias("hit_rate"))


EPISODES = [("a", "1996-01-01", "1996-06-30"), ("b", "1998-03-01", "1999-02-28")]


@query("A17_window_coverage", oracle(f"SELECT name, count(*) AS days, round(avg(CAST(state IN ('bear') AS INT)), 6) AS coverage FROM states JOIN (VALUES {', '.join(f'({n!r}, DATE {a!r}, DATE {b!r})' for n, a, b in EPISODES)}) AS e(name, first, last) ON obs_date BETWEEN first AND last GROUP BY 1", RETURNS, STATE))
def a17(spark, sf):
    inside = aggregates.within(states(spark, sf), "obs_date", EPISODES)
    return inside.groupBy("name").agg(F.count("*").alias("days"), rnd(F.avg((F.col("state") == "bear").cast("int"))).alias("coverage"))


@query("A18_source_share", oracle("SELECT round(avg(CAST(a.value IS NOT NULL AS INT)), 6) AS share FROM price p LEFT JOIN price_alt a USING (obs_date)"))
def a18(spark, sf):
    a = price_alt(spark, sf).select("obs_date", F.col("value").alias("a"))
    return price(spark, sf).join(a, "obs_date", "left").agg(rnd(F.avg(F.col("a").isNotNull().cast("int"))).alias("share"))


@query("A19_duplicates", oracle("SELECT series_id, obs_date, count(*) AS n FROM obs GROUP BY 1, 2 HAVING count(*) > 1"))
def a19(spark, sf):
    return obs(spark, sf).groupBy("series_id", "obs_date").agg(F.count("*").alias("n")).where("n > 1")


@query("A20_conflicts", oracle("SELECT series_id, obs_date, count(DISTINCT round(value, 4)) AS n FROM obs_invalid GROUP BY 1, 2 HAVING count(DISTINCT round(value, 4)) > 1"))
def a20(spark, sf):
    from vintagelake.plans.fixtures import obs_invalid

    return obs_invalid(spark, sf).groupBy("series_id", "obs_date").agg(F.count_distinct(F.round("value", 4)).alias("n")).where("n > 1")


@query("A21_feature_summary", oracle("SELECT 'r' AS feature, round(stddev_samp(r), 6) AS sd, round(quantile_cont(r, 0.05), 6) AS q05, round(quantile_cont(r, 0.95), 6) AS q95 FROM returns UNION ALL SELECT 'y', round(stddev_samp(y), 6), round(quantile_cont(y, 0.05), 6), round(quantile_cont(y, 0.95), 6) FROM returns", RETURNS))
def a21(spark, sf):
    long = returns(spark, sf).select("obs_date", "r", "y").unpivot(["obs_date"], ["r", "y"], "feature", "value")
    return long.groupBy("feature").agg(rnd(F.stddev_samp("value")).alias("sd"), rnd(F.percentile("value", F.lit(0.05))).alias("q05"), rnd(F.percentile("value", F.lit(0.95))).alias("q95"))


@query("A22_calm_gap", oracle(f"""SELECT round(avg(peak), 6) AS episode_peak, any_value(calm) AS calm_mean, round(avg(peak) - any_value(calm), 6) AS gap FROM (SELECT name, max(value) AS peak FROM price JOIN (VALUES {', '.join(f'({n!r}, DATE {a!r}, DATE {b!r})' for n, a, b in EPISODES)}) AS e(name, first, last) ON obs_date BETWEEN first AND last GROUP BY 1),
  (SELECT round(avg(m), 6) AS calm FROM (SELECT avg(value) AS m FROM price WHERE year(obs_date) IN (1995, 1997) GROUP BY year(obs_date)))"""))
def a22(spark, sf):
    p = price(spark, sf)
    peaks = aggregates.within(p, "obs_date", EPISODES).groupBy("name").agg(F.max("value").alias("peak")).agg(F.avg("peak").alias("peak"))
    calm = p.where(F.year("obs_date").isin(1995, 1997)).groupBy(F.year("obs_date")).agg(F.avg("value").alias("m")).agg(rnd(F.avg("m")).alias("calm"))
    return peaks.crossJoin(calm).select(rnd("peak").alias("episode_peak"), F.col("calm").alias("calm_mean"), rnd(F.col("peak") - F.col("calm")).alias("gap"))


@query("A23_newest_date", oracle("SELECT max(obs_date) AS newest FROM monthly"))
def a23(spark, sf):
    return monthly(spark, sf).agg(F.max("obs_date").alias("newest"))


@query("L08_worst", oracle("SELECT obs_date, rank, value, round((SELECT count(*) FROM price) / rank::DOUBLE / 252, 6) AS return_years FROM (SELECT *, row_number() OVER (ORDER BY value, obs_date) AS rank FROM price) WHERE rank <= 10"))
def l08(spark, sf):
    worst = price(spark, sf).orderBy("value", "obs_date").limit(10).withColumn("rank", F.row_number().over(Window.partitionBy("series_id").orderBy("value", "obs_date")).cast("bigint"))
    total = price(spark, sf).agg(F.count("*").alias("total"))
    return worst.crossJoin(F.broadcast(total)).select("obs_date", "rank", "value", rnd(F.col("total") / F.col("rank") / 252).alias("return_years"))


@query("L09_newest_usable_curve", oracle("SELECT * FROM curve WHERE obs_date = (SELECT max(obs_date) FROM (SELECT obs_date FROM curve GROUP BY 1 HAVING count(*) >= 9))"))
def l09(spark, sf):
    c = curve(spark, sf)
    newest = c.groupBy("obs_date").agg(F.count("yield").alias("n")).where("n >= 9").agg(F.max("obs_date").alias("obs_date"))
    return c.join(F.broadcast(newest), "obs_date", "left_semi").select("obs_date", "tenor", "maturity", "yield")


@query("L10_newest_with_spread", oracle("SELECT CASE WHEN date_diff('day', with_spread, newest) <= 5 THEN with_spread ELSE newest END AS chosen FROM (SELECT max(obs_date) AS newest, max(obs_date) FILTER (WHERE value > 2.5) AS with_spread FROM rates_short)"))
def l10(spark, sf):
    found = rates_short(spark, sf).agg(F.max("obs_date").alias("newest"), F.max(F.when(V() > 2.5, F.col("obs_date"))).alias("with_spread"))
    return found.select(F.when(F.datediff("newest", "with_spread") <= 5, F.col("with_spread")).otherwise(F.col("newest")).alias("chosen"))


@query("R04_metric_pivot", oracle("SELECT as_of, " + ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in ("rii", "tail_probability", "shock_likelihood")) + " FROM outputs WHERE asset = 'equity' GROUP BY 1"))
def r04(spark, sf):
    return outputs(spark, sf).where("asset = 'equity'").groupBy("as_of").pivot("metric", ["rii", "tail_probability", "shock_likelihood"]).agg(F.first("value"))


LEGS = ("legs", "SELECT obs_date, k AS regime, (CASE WHEN (n % 5 = 0 AND k < 3) THEN 1 ELSE (n * (k + 3)) % 11 END)::DOUBLE AS probability FROM returns, (VALUES (0), (1), (2)) AS t(k)")


@query("R05_posterior_label", oracle("SELECT obs_date, min(regime) FILTER (WHERE probability = top) AS label, max(top) AS confidence FROM (SELECT *, max(probability) OVER (PARTITION BY obs_date) AS top FROM legs) GROUP BY 1", RETURNS, LEGS))
def r05(spark, sf):
    n = F.col("n")
    legs = returns(spark, sf).select("obs_date", "n", F.explode(F.array(*map(F.lit, range(3)))).alias("regime")).withColumn("probability", F.when(n % 5 == 0, 1).otherwise(n * (F.col("regime") + 3) % 11).cast("double"))
    wide = legs.groupBy("obs_date").pivot("regime", [0, 1, 2]).agg(F.first("probability"))
    return wide.select("obs_date", aggregates.first_largest({k: F.col(str(k)) for k in range(3)}).alias("label"), F.greatest("0", "1", "2").alias("confidence"))


@query("R08_daily_view", oracle("SELECT p.obs_date, m.value FROM (SELECT obs_date FROM price UNION SELECT obs_date FROM monthly WHERE series_id = 'A') p ASOF JOIN (SELECT * FROM monthly WHERE series_id = 'A') m ON p.obs_date >= m.obs_date"))
def r08(spark, sf):
    m = monthly(spark, sf).where("series_id = 'A'").select("obs_date", "value")
    days = price(spark, sf).select("obs_date").union(m.select("obs_date")).distinct()
    w = Window.partitionBy("series_id").orderBy("obs_date")
    out = days.join(m, "obs_date", "left").withColumn("series_id", F.lit("A"))
    return out.select("obs_date", windows.ffill(F.col("value"), w).alias("value")).where("value is not null")


@query("R09_vocabulary", oracle("SELECT v.asset, coalesce(n, 0) AS n, n IS NULL AS awaiting_first_run FROM (VALUES ('equity'), ('gold'), ('crypto'), ('rates'), ('money')) AS v(asset) LEFT JOIN (SELECT asset, count(*) AS n FROM outputs GROUP BY 1) USING (asset)"))
def r09(spark, sf):
    vocabulary = spark.createDataFrame([(a,) for a in ("equity", "gold", "crypto", "rates", "money")], "asset string")
    counts = outputs(spark, sf).groupBy("asset").agg(F.count("*").alias("n"))
    return vocabulary.join(counts, "asset", "left").select("asset", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), F.col("n").isNull().alias("awaiting_first_run"))


@query("J08_labels", oracle(f"SELECT obs_date, r, label FROM (SELECT obs_date, r, CASE WHEN count(*) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) = 63 THEN max(CAST(e AS INT)) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) END AS label FROM (SELECT *, state = 'bear' AND coalesce(lag(state) OVER ({BY}), '') <> 'bear' AS e FROM states)) WHERE label IS NOT NULL AND r IS NOT NULL", RETURNS, STATE))
def j08(spark, sf):
    s = states(spark, sf)
    entries = s.withColumn("entry", windows.edge(F.col("state") == "bear", W()).cast("int"))
    labels = entries.withColumn("label", windows.forward_max(F.col("entry"), W(), 63)).select("obs_date", "label")
    return s.select("obs_date", "r").join(labels, "obs_date").na.drop()


@query("P05_curve_rows", oracle("SELECT obs_date, " + ", ".join(f"max(yield) FILTER (WHERE tenor = '{t}') AS \"{t}\"" for t in ("3MO", "1Y", "10Y")) + " FROM curve GROUP BY 1 HAVING count(*) FILTER (WHERE tenor IN ('3MO', '1Y', '10Y')) > 0"))
def p05(spark, sf):
    wide = curve(spark, sf).groupBy("obs_date").pivot("tenor", ["10Y", "1Y", "3MO"]).agg(F.first("yield"))
    return wide.na.drop("all", subset=["3MO", "1Y", "10Y"]).select("obs_date", "3MO", "1Y", "10Y")


@query("P07_roles", oracle("SELECT CASE series_id WHEN '1-URGENT' THEN 'price' WHEN '5-LOW' THEN 'fallback' END AS role, count(*) AS n FROM obs WHERE series_id IN ('1-URGENT', '5-LOW') GROUP BY 1"))
def p07(spark, sf):
    from vintagelake.operators.reshape import by_role

    wanted = {"price": "1-URGENT", "fallback": "5-LOW", "extra": "NONE"}
    known = obs(spark, sf).where(F.col("series_id").isin(*wanted.values())).select("series_id").distinct()  # as many as roles
    roles, missing = by_role(wanted, optional={"extra"}, present={r.series_id for r in known.collect()})
    assert missing == ["extra"]
    return obs(spark, sf).join(F.broadcast(spark.createDataFrame(list(roles.items()), "role string, series_id string")), "series_id").groupBy("role").agg(F.count("*").alias("n"))


@query("P09_flagged", oracle("SELECT series_id, obs_date, flag FROM (SELECT *, CASE WHEN value > 20 THEN 'abnormal_jump' END AS flag FROM price) WHERE flag IS NOT NULL"))
def p09(spark, sf):
    return price(spark, sf).withColumn("flag", F.when(V() > 20, "abnormal_jump")).where("flag is not null").select("series_id", "obs_date", "flag")
