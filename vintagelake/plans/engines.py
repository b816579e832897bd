"""Queries of the factor, rates and money engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagelake.functions import finance
from vintagelake.operators import factors, joins, rates, reshape, windows
from vintagelake.plans.fixtures import LAMBDA, TENORS, curve, dayno, monthly, oracle, outputs, price, rates_short
from vintagelake.plans.registry import query
from vintagelake.plans.series import BY, EVER, W, over, rnd

DAY = "date_diff('day', DATE '1995-01-01', obs_date)"
SCORES = ("scores", f"""SELECT a.series_id, a.obs_date, a.value, 100 * (CASE WHEN a.series_id = 'N' THEN 1 - pct ELSE pct END) AS score FROM (SELECT a.series_id, a.obs_date, a.value, CASE WHEN count(b.z) = 0 THEN 0.5 ELSE (count(*) FILTER (WHERE b.z < a.z) + count(*) FILTER (WHERE b.z <= a.z)) / 2.0::DOUBLE / count(b.z) END AS pct
  FROM zs a LEFT JOIN zs b ON a.series_id = b.series_id AND b.obs_date < a.obs_date GROUP BY 1, 2, 3) a""")
ZS = ("zs", f"SELECT series_id, obs_date, value, CASE WHEN max(value) {EVER} = min(value) {EVER} THEN 0 ELSE round(coalesce(greatest(-3, least(3, (value - avg(value) {EVER}) / nullif(stddev_pop(value) {EVER}, 0))), 0), 9) END AS z FROM monthly WHERE series_id IN (SELECT series_id FROM monthly GROUP BY 1 HAVING count(value) >= 24)")
DIRECTIONS = {"A": 1, "N": -1, "R": 1}
SPEC = [("growth", "A"), ("growth", "N"), ("stress", "R"), ("stress", "MISSING")]


@query("F01_score_series", oracle("SELECT series_id, obs_date, round(score, 6) AS score FROM scores", ZS, SCORES))
def f01(spark, sf):
    return factors.score_series(monthly(spark, sf), DIRECTIONS).select("series_id", "obs_date", rnd("score").alias("score"))


FACTORS = ("factor_spec", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{s}')" for f, s in SPEC) + ") AS t(factor, series_id)")
LAST = ("last_scores", "SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC) = 1")


@query("F02_score_factor", oracle("SELECT round(avg(score), 4) AS score, count(score) AS inputs_used, count(*) AS inputs_configured FROM factor_spec LEFT JOIN last_scores USING (series_id) WHERE factor = 'growth'", ZS, SCORES, FACTORS, LAST))
def f02(spark, sf):
    spec = spark.createDataFrame(SPEC, "factor string, series_id string")
    return factors.compute(factors.score_series(monthly(spark, sf), DIRECTIONS), spec).where("factor = 'growth'").select("score", "inputs_used", "inputs_configured")


@query("F03_factors", oracle("SELECT factor, round(avg(score), 4) AS score, count(score) AS inputs_used, count(*) AS inputs_configured FROM factor_spec LEFT JOIN last_scores USING (series_id) GROUP BY 1", ZS, SCORES, FACTORS, LAST))
def f03(spark, sf):
    spec = spark.createDataFrame(SPEC, "factor string, series_id string")
    return factors.compute(factors.score_series(monthly(spark, sf), DIRECTIONS), spec).drop("components")


@query("F20_derived", oracle("""SELECT a.obs_date, greatest(a.release_date, b.release_date, c.release_date) AS release_date, round(100 / a.value - (b.value - c.value), 6) AS value FROM (SELECT * FROM monthly WHERE series_id = 'A' AND value > 0) a ASOF JOIN (SELECT * FROM monthly WHERE series_id = 'N') b ON a.obs_date >= b.obs_date ASOF JOIN (SELECT * FROM monthly WHERE series_id = 'R') c ON a.obs_date >= c.obs_date"""))
def f20(spark, sf):
    leg = {k: monthly(spark, sf).where(F.col("series_id") == k).withColumn("series_id", F.lit("X")) for k in "ANR"}
    return factors.derived("excess_cape_yield", {"cape": leg["A"], "nominal": leg["N"], "breakeven": leg["R"]}, ["series_id"]).select("obs_date", "release_date", rnd("value").alias("value"))


def fits(lam: str, source: str = "curve", extra: str = "") -> str:
    """Normal equations of the curve in SQL: obs_date (and extra keys), b0, b1, b2, n."""
    e = f", {extra}" if extra else ""
    x = f"({lam} * maturity)"
    return f"""SELECT *, (y*(ss*cc-sc*sc) - s*(sy*cc-sc*cy) + c*(sy*sc-ss*cy)) / det AS b0, (n*(sy*cc-sc*cy) - y*(s*cc-sc*c) + c*(s*cy-sy*c)) / det AS b1, (n*(ss*cy-sy*sc) - s*(s*cy-sy*c) + y*(s*sc-ss*c)) / det AS b2
  FROM (SELECT *, n*(ss*cc-sc*sc) - s*(s*cc-sc*c) + c*(s*sc-ss*c) AS det FROM (SELECT obs_date{e}, count(*)::DOUBLE AS n, sum(s) AS s, sum(c) AS c, sum(s*s) AS ss, sum(s*c) AS sc, sum(c*c) AS cc, sum(yield) AS y, sum(s*yield) AS sy, sum(c*yield) AS cy
  FROM (SELECT obs_date{e}, yield, (1-exp(-{x}))/{x} AS s, (1-exp(-{x}))/{x} - exp(-{x}) AS c FROM {source}) GROUP BY obs_date{e} HAVING count(*) >= 5))"""


def ns(m: float, lam: float) -> str:
    x = f"({lam!r}::DOUBLE * {m!r}::DOUBLE)"
    return f"(b0 + b1 * (1 - exp(-{x})) / {x} + b2 * ((1 - exp(-{x})) / {x} - exp(-{x})))"


FIT = ("fit", fits("0.5::DOUBLE"))
HISTORY = ("history", f"""SELECT f.obs_date, b0 AS level, -b1 AS slope, b2 AS curvature, rmse, {ns(10.0, 0.5)} - {ns(0.25, 0.5)} AS spread, b0, b1, b2, n FROM fit f JOIN (SELECT c.obs_date, sqrt(avg(power(yield - b0 - b1*(1-exp(-0.5*maturity))/(0.5*maturity) - b2*((1-exp(-0.5*maturity))/(0.5*maturity) - exp(-0.5*maturity)), 2))) AS rmse FROM curve c JOIN fit f ON c.obs_date = f.obs_date GROUP BY 1) r ON f.obs_date = r.obs_date""")


@query("E01_curve_assembly", oracle("SELECT obs_date, count(*) AS tenors, round(sum(maturity * yield), 6) AS checksum FROM curve GROUP BY 1 HAVING count(*) >= 5"))
def e01(spark, sf):
    c = rates.curves(curve(spark, sf))
    return c.select("obs_date", F.size("points").cast("bigint").alias("tenors"), rnd(rates.total(F.col("points"), lambda p: p["maturity"] * p["yield"])).alias("checksum"))


@query("E02_loadings", oracle("SELECT obs_date, tenor, round((1-exp(-0.609*maturity))/(0.609*maturity), 8) AS slope, round((1-exp(-0.609*maturity))/(0.609*maturity) - exp(-0.609*maturity), 8) AS curvature FROM curve"))
def e02(spark, sf):
    s, c = finance.ns_loadings(F.col("maturity"), LAMBDA)
    return curve(spark, sf).select("obs_date", "tenor", rnd(s, 8).alias("slope"), rnd(c, 8).alias("curvature"))


@query("E03_curve_fit", oracle("SELECT obs_date, round(b0, 5) AS b0, round(b1, 5) AS b1, round(b2, 5) AS b2, round(rmse, 6) AS rmse FROM history", FIT, HISTORY))
def e03(spark, sf):
    return rates.fit_curves(rates.curves(curve(spark, sf)), 0.5).select("obs_date", *(rnd(f"b{i}", 5).alias(f"b{i}") for i in range(3)), rnd("rmse").alias("rmse"))


GRID = ("grid", f"SELECT * FROM curve, (VALUES {', '.join(f'({x!r}::DOUBLE)' for x in rates.LAMBDAS)}) AS g(lam)")


@query("E04_lambda_grid", oracle("""SELECT lam, round(rmse, 6) AS rmse FROM (SELECT lam, avg(rmse) AS rmse FROM (SELECT g.lam, g.obs_date, sqrt(avg(power(yield - b0 - b1*(1-exp(-g.lam*maturity))/(g.lam*maturity) - b2*((1-exp(-g.lam*maturity))/(g.lam*maturity) - exp(-g.lam*maturity)), 2))) AS rmse
  FROM grid g JOIN gridfit f ON g.obs_date = f.obs_date AND g.lam = f.lam GROUP BY 1, 2) GROUP BY 1) ORDER BY rmse, lam LIMIT 1""", GRID, ("gridfit", fits("lam", "grid", "lam"))))
def e04(spark, sf):
    return rates.best_lambda(rates.curves(curve(spark, sf))).select("lam", rnd("rmse").alias("rmse"))


def history(spark, sf):
    return rates.factor_history(rates.curves(curve(spark, sf)), 0.5)


@query("E05_factor_history", oracle("SELECT obs_date, round(level, 5) AS level, round(slope, 5) AS slope, round(curvature, 5) AS curvature, round(spread, 5) AS spread FROM history", FIT, HISTORY))
def e05(spark, sf):
    return history(spark, sf).select("obs_date", *(rnd(c, 5).alias(c) for c in ("level", "slope", "curvature", "spread")))


@query("E06_carry_rolldown", oracle(f"SELECT obs_date, round((1 - power(1 + y9, -9)) / y9 * (y10 - y9) * 100, 5) AS rolldown, round((1 - power(1 + y10, -10)) / y10, 5) AS duration FROM (SELECT obs_date, {ns(10.0, 0.5)} / 100 AS y10, {ns(9.0, 0.5)} / 100 AS y9 FROM fit)", FIT))
def e06(spark, sf):
    f = rates.fit_curves(rates.curves(curve(spark, sf)), 0.5)
    y = lambda m: finance.ns_yield(F.col("b0"), F.col("b1"), F.col("b2"), F.lit(m), 0.5) / 100
    return f.select("obs_date", rnd(finance.par_duration(y(9.0), F.lit(9.0)) * (y(10.0) - y(9.0)) * 100, 5).alias("rolldown"), rnd(finance.par_duration(y(10.0), F.lit(10.0)), 5).alias("duration"))


REGIME = ("regimes", f"""SELECT obs_date, CASE WHEN spread < 0 THEN 'inverted' WHEN coalesce(seen AND dspread > 0.25, false) THEN 're_steepening' WHEN abs(spread) < 0.5 THEN 'flat' WHEN coalesce(dlevel > 0, false) THEN 'steep_tightening' ELSE 'steep_easing' END AS regime FROM (SELECT *, coalesce(max(CAST(spread < 0 AS INT)) OVER (ORDER BY {DAY} RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING), 0) = 1 AS seen,
  spread - lag(spread, 252) OVER (ORDER BY obs_date) AS dspread, level - lag(level, 252) OVER (ORDER BY obs_date) AS dlevel FROM history)""")


@query("E07_curve_regime", oracle("SELECT * FROM regimes", FIT, HISTORY, REGIME))
def e07(spark, sf):
    h = history(spark, sf).withColumn("series_id", F.lit("curve"))
    seen = windows.seen_before(F.col("spread") < 0, ["series_id"], "obs_date", 365)
    return h.select("obs_date", finance.curve_regime(F.col("spread"), seen, windows.change(F.col("spread"), W(), 252), windows.change(F.col("level"), W(), 252)).alias("regime"))


@query("E08_risk_confidence", oracle(f"""SELECT obs_date, round(least(100, greatest(0, 100 * (1 - power(1 + y10, -10)) / y10 * coalesce(vol, 0.9) / 12)), 4) AS risk, round(least(1, greatest(0, (1 - rmse / 0.35) * n / 11)), 4) AS confidence FROM (SELECT h.*, {ns(10.0, 0.5)} / 100 AS y10, CASE WHEN count(d) OVER (ORDER BY obs_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) >= 20 THEN stddev_pop(d) OVER (ORDER BY obs_date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) * sqrt(252) END AS vol
  FROM (SELECT *, level - lag(level) OVER (ORDER BY obs_date) AS d FROM history) h)""", FIT, HISTORY))
def e08(spark, sf):
    f = rates.fit_curves(rates.curves(curve(spark, sf)), 0.5).withColumn("series_id", F.lit("curve"))
    d = f.withColumn("d", windows.change(F.col("b0"), W()))
    vol = F.coalesce(windows.rolling(F.stddev_pop, F.col("d"), W(), 252, 20) * 252**0.5, F.lit(0.9))
    y10 = finance.ns_yield(F.col("b0"), F.col("b1"), F.col("b2"), F.lit(10.0), 0.5) / 100
    risk = finance.clip(100 * finance.par_duration(y10, F.lit(10.0)) * vol / 12, 0, 100)
    return d.select("obs_date", rnd(risk, 4).alias("risk"), rnd(finance.clip((1 - F.col("rmse") / 0.35) * F.size("points") / len(TENORS), 0, 1), 4).alias("confidence"))


@query("E09_rates_outputs", oracle("SELECT obs_date, metric, round(value, 5) AS value FROM (SELECT obs_date, level, slope, curvature, spread FROM history) UNPIVOT (value FOR metric IN (level, slope, curvature, spread))", FIT, HISTORY))
def e09(spark, sf):
    return reshape.tall(history(spark, sf), ["obs_date"], ["level", "slope", "curvature", "spread"], 5)


@query("M01_money_market_yield", oracle("SELECT obs_date, round(value / (1 - value / 100 * 91 / 360.0::DOUBLE), 8) AS value FROM rates_short"))
def m01(spark, sf):
    return rates_short(spark, sf).select("obs_date", rnd(finance.money_market_yield(F.col("value")), 8).alias("value"))


SOFR = ("sofr", "SELECT obs_date, value + 0.1 AS value FROM rates_short WHERE obs_date >= DATE '1996-06-01'")
SPLICE = ("short", "SELECT coalesce(a.obs_date, b.obs_date) AS obs_date, coalesce(a.value, b.value / (1 - b.value / 100 * 91 / 360.0::DOUBLE)) AS value, CASE WHEN a.value IS NOT NULL THEN 'sofr' ELSE 'bill' END AS source FROM sofr a FULL JOIN rates_short b ON a.obs_date = b.obs_date")


def short(spark, sf):
    r = rates_short(spark, sf)
    sofr = r.where("obs_date >= date'1996-06-01'").select("obs_date", (F.col("value") + 0.1).alias("value"))
    bill = r.select("obs_date", finance.money_market_yield(F.col("value")).alias("value"))
    return joins.precedence({"sofr": sofr, "bill": bill}, "obs_date", "value").withColumn("series_id", F.lit("SR"))


@query("M02_short_rate", oracle("SELECT obs_date, round(value, 8) AS value, source FROM short", SOFR, SPLICE))
def m02(spark, sf):
    return short(spark, sf).select("obs_date", rnd("value", 8).alias("value"), "source")


PATH = ("path", """SELECT obs_date, exp(sum(growth) OVER (PARTITION BY segment ORDER BY obs_date)) AS wealth FROM (SELECT *, sum(CAST(restart AS INT)) OVER (ORDER BY obs_date) AS segment FROM (SELECT *, gap IS NULL OR gap > 40 AS restart, CASE WHEN gap <= 40 THEN before / 100 * gap / 360 ELSE 0 END AS growth FROM (SELECT *, date_diff('day', lag(obs_date) OVER (ORDER BY obs_date), obs_date) AS gap, lag(value) OVER (ORDER BY obs_date) AS before FROM short)))""")


@query("M03_wealth", oracle("SELECT obs_date, round(wealth, 8) AS wealth FROM path", SOFR, SPLICE, PATH))
def m03(spark, sf):
    return rates.wealth(short(spark, sf), ["series_id"]).select("obs_date", rnd("wealth", 8).alias("wealth"))


@query("M04_realized_carry", oracle("""SELECT obs_date, CASE WHEN abs(date_diff('day', start_day, obs_date) - 91) <= 10 AND low >= start_wealth THEN round(100 * ln(wealth / start_wealth) * 360 / date_diff('day', start_day, obs_date), 5) END AS carry FROM (SELECT p.obs_date, p.wealth, s.obs_date AS start_day, s.wealth AS start_wealth,
  (SELECT min(q.wealth) FROM path q WHERE q.obs_date BETWEEN s.obs_date AND p.obs_date) AS low FROM (SELECT *, obs_date - 91 AS probe FROM path) p ASOF LEFT JOIN path s ON p.probe >= s.obs_date)""", SOFR, SPLICE, PATH))
def m04(spark, sf):
    return rates.realized_carry(rates.wealth(short(spark, sf), ["series_id"]), ["series_id"], 91).select("obs_date", rnd("carry", 5).alias("carry"))


HORIZONS = [("1m", 1 / 12), ("3m", 0.25), ("6m", 0.5), ("1y", 1.0), ("2y", 2.0), ("3y", 3.0), ("5y", 5.0), ("7y", 7.0), ("10y", 10.0), ("20y", 20.0), ("30y", 30.0)]
HZ = ("horizons", "SELECT * FROM (VALUES " + ", ".join(f"('{h}', {m!r}::DOUBLE)" for h, m in HORIZONS) + ") AS t(horizon, years)")
ZERO = "b0 + b1*(1-exp(-0.5*years))/(0.5*years) + b2*((1-exp(-0.5*years))/(0.5*years) - exp(-0.5*years))"


@query("M05_discount_factors", oracle(f"SELECT obs_date, horizon, round(exp(-(CASE WHEN years <= 1 THEN 3.0 ELSE {ZERO} END) / 100 * years), 7) AS factor FROM fit, horizons", FIT, HZ))
def m05(spark, sf):
    f = rates.fit_curves(rates.curves(curve(spark, sf)), 0.5)
    h = F.explode(F.array(*(F.struct(F.lit(k).alias("horizon"), F.lit(float(y)).alias("years")) for k, y in HORIZONS))).alias("h")
    df = f.select("obs_date", "b0", "b1", "b2", h).select("*", "h.*")
    zero = F.when(F.col("years") <= 1, 3.0).otherwise(finance.ns_yield(F.col("b0"), F.col("b1"), F.col("b2"), F.col("years"), 0.5))
    return df.select("obs_date", "horizon", rnd(finance.discount_factor(zero, F.col("years")), 7).alias("factor"))


ROLES = ["rii", "tail_probability", "shock_likelihood"]


@query("M06_published_curve", oracle("SELECT * FROM (SELECT as_of, " + ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in ROLES) + " FROM outputs WHERE asset = 'equity' GROUP BY 1) WHERE " + " AND ".join(f"{m} IS NOT NULL" for m in ROLES) + " AND rii > 0"))
def m06(spark, sf):
    wide = outputs(spark, sf).where("asset = 'equity'").groupBy("as_of").pivot("metric", ROLES).agg(F.first("value"))
    return wide.na.drop(subset=ROLES).where("rii > 0")


INPUTS = ("inputs", f"""SELECT series_id, obs_date, spread, CASE WHEN count(spread) {over(3)} >= 3 THEN avg(spread) {over(3)} END AS spread_mean, bill - lag(bill, 10) OVER ({BY}) AS bill_change, night - lag(night, 10) OVER ({BY}) AS overnight_change, rrp, (CASE WHEN count(rrp) {over(5)} >= 5 THEN avg(rrp) {over(5)} END) / (CASE WHEN count(rrp) {over(63)} >= 63 THEN avg(rrp) {over(63)} END) AS rrp_ratio
  FROM (SELECT series_id, obs_date, value AS bill, value + 0.4 * cos(n / 15.0::DOUBLE) AS night, -0.4 * cos(n / 15.0::DOUBLE) AS spread, CASE WHEN n % 6 <> 0 THEN 300 + 250 * sin(n / 70.0::DOUBLE) END AS rrp FROM (SELECT *, {DAY} AS n FROM rates_short))""")


def liquidity_inputs(spark, sf):
    n = dayno("obs_date")
    base = rates_short(spark, sf).select("series_id", "obs_date", F.col("value").alias("bill"), (F.col("value") + 0.4 * F.cos(n / 15.0)).alias("night"), (-0.4 * F.cos(n / 15.0)).alias("spread"), F.when(n % 6 != 0, 300 + 250 * F.sin(n / 70.0)).alias("rrp"))
    r = F.col("rrp")
    made = {"spread_mean": windows.rolling(F.avg, F.col("spread"), W(), 3), "bill_change": windows.change(F.col("bill"), W(), 10), "overnight_change": windows.change(F.col("night"), W(), 10), "rrp_ratio": windows.rolling(F.avg, r, W(), 5, 4) / windows.rolling(F.avg, r, W(), 63, 50)}
    return base.withColumns(made)


INPUTS = (INPUTS[0], INPUTS[1].replace(f"count(rrp) {over(5)} >= 5", f"count(rrp) {over(5)} >= 4").replace(f"count(rrp) {over(63)} >= 63", f"count(rrp) {over(63)} >= 50"))
CLASSED = ("classed", """SELECT *, CASE WHEN coalesce(spread <= -1.5, false) OR (coalesce(spread_mean <= -0.55, false) AND (coalesce(bill_change <= -0.5, false) OR coalesce(overnight_change >= 0.25, false))) THEN 'stressed' WHEN coalesce(spread_mean <= -0.2, false) OR (coalesce(rrp >= 100, false) AND coalesce(rrp_ratio <= 0.75, false)) THEN 'tightening'
  WHEN coalesce(rrp >= 250, false) AND coalesce(rrp_ratio >= 0.9, false) THEN 'abundant' ELSE 'normal' END AS state FROM inputs""")


@query("M07_liquidity_inputs", oracle("SELECT obs_date, round(spread, 6) AS spread, round(spread_mean, 6) AS spread_mean, round(bill_change, 6) AS bill_change, round(overnight_change, 6) AS overnight_change, round(rrp_ratio, 6) AS rrp_ratio FROM inputs", INPUTS))
def m07(spark, sf):
    return liquidity_inputs(spark, sf).select("obs_date", *(rnd(c).alias(c) for c in ("spread", "spread_mean", "bill_change", "overnight_change", "rrp_ratio")))


def liquidity(spark, sf):
    cols = [F.col(c) for c in ("spread", "spread_mean", "bill_change", "overnight_change", "rrp", "rrp_ratio")]
    return liquidity_inputs(spark, sf).withColumn("state", finance.liquidity_state(*cols))


@query("M08_liquidity_state", oracle("SELECT obs_date, state FROM classed", INPUTS, CLASSED))
def m08(spark, sf):
    return liquidity(spark, sf).select("obs_date", "state")


@query("M09_money_risk", oracle("SELECT obs_date, round(10 * least(greatest(-spread, 0), 1), 4) AS risk, round(1 - (CASE WHEN spread_mean IS NULL THEN 0.3::DOUBLE ELSE 0 END) - (CASE WHEN rrp IS NULL THEN 0.2::DOUBLE ELSE 0 END), 4) AS confidence FROM inputs", INPUTS))
def m09(spark, sf):
    df = liquidity_inputs(spark, sf)
    risk = 10 * finance.clip(F.greatest(-F.col("spread"), F.lit(0.0)), 0, 1)
    penalty = F.when(F.col("spread_mean").isNull(), 0.3).otherwise(0.0) + F.when(F.col("rrp").isNull(), 0.2).otherwise(0.0)
    return df.select("obs_date", rnd(risk, 4).alias("risk"), rnd(finance.clip(1 - penalty, 0, 1), 4).alias("confidence"))


@query("M10_discount_history", oracle(f"SELECT s.obs_date, round(exp(-(CASE WHEN f.b0 IS NULL THEN s.value ELSE {ns(10.0, 0.5)} END) / 100 * 10), 7) AS factor_10y, f.b0 IS NULL AS fell_back FROM short s LEFT JOIN (SELECT * FROM fit WHERE n >= 9) f ON s.obs_date = f.obs_date", SOFR, SPLICE, FIT))
def m10(spark, sf):
    f = rates.fit_curves(rates.curves(curve(spark, sf)).where(F.size("points") >= 9), 0.5).select("obs_date", "b0", "b1", "b2")
    df = short(spark, sf).join(f, "obs_date", "left")
    zero = F.coalesce(finance.ns_yield(F.col("b0"), F.col("b1"), F.col("b2"), F.lit(10.0), 0.5), F.col("value"))
    return df.select("obs_date", rnd(finance.discount_factor(zero, F.lit(10.0)), 7).alias("factor_10y"), F.col("b0").isNull().alias("fell_back"))
