"""Queries of the gold, crypto and equity engines, over the price view as the asset and paths made from day numbers as its drivers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagelake.functions import finance
from vintagelake.operators import aggregates, attribution, crypto, equity, factors, gold, joins, models, reshape, windows
from vintagelake.plans.fixtures import dayno, monthly, oracle, price, price_alt, price_late, rates_short
from vintagelake.plans.registry import query
from vintagelake.plans.series import BY, EVER, RETURNS, STATE, W, over, returns, rnd, states
from vintagelake.sources.shared import scratch, stored

N = "date_diff('day', DATE '1995-01-01', obs_date)"
DRIVERS = ("drivers", f"SELECT *, n / 100.0::DOUBLE + 2 * sin(n / 33.0::DOUBLE) AS stress, 5 + sin(n / 200.0::DOUBLE) AS nominal, CASE WHEN obs_date >= DATE '1997-01-01' AND n % 3 <> 0 THEN 2 + cos(n / 170.0::DOUBLE) END AS breakeven, CASE WHEN obs_date >= DATE '1998-01-01' THEN 100 + 10 * sin(n / 90.0::DOUBLE) END AS broad, 80 + 5 * cos(n / 60.0::DOUBLE) AS legacy FROM returns")
BASE = [RETURNS, DRIVERS]


def drivers(spark, sf):
    n = F.col("n")
    return returns(spark, sf).withColumns({
        "stress": n / 100.0 + 2 * F.sin(n / 33.0), "nominal": 5 + F.sin(n / 200.0), "breakeven": F.when((F.col("obs_date") >= F.lit("1997-01-01").cast("date")) & (n % 3 != 0), 2 + F.cos(n / 170.0)),
        "broad": F.when(F.col("obs_date") >= F.lit("1998-01-01").cast("date"), 100 + 10 * F.sin(n / 90.0)), "legacy": 80 + 5 * F.cos(n / 60.0),
    })


def cpi(spark, sf):
    return monthly(spark, sf).where("series_id = 'A'").select(F.lit("PX").alias("series_id"), F.col("obs_date").alias("month"), F.col("value").alias("cpi"))


REAL = ("real", f"""SELECT d.obs_date, coalesce(d.nominal - d.held, d.nominal - y.yoy) AS real_rate, d.held IS NULL AND y.yoy IS NOT NULL AS is_ex_post FROM (SELECT *, last_value(breakeven IGNORE NULLS) {EVER} AS held FROM drivers) d ASOF LEFT JOIN (SELECT obs_date, (value / lag(value, 12) OVER (ORDER BY obs_date) - 1) * 100 AS yoy FROM monthly WHERE series_id = 'A' QUALIFY lag(value, 12) OVER (ORDER BY obs_date) IS NOT NULL) y ON d.obs_date >= y.obs_date""")


@query("G01_real_rate", oracle("SELECT obs_date, round(real_rate, 6) AS real_rate, is_ex_post FROM real", *BASE, REAL))
def g01(spark, sf):
    return gold.real_rate(drivers(spark, sf), cpi(spark, sf)).select("obs_date", rnd("real_rate").alias("real_rate"), "is_ex_post")


USD = f"coalesce(ln(broad / lag(broad, 252) OVER ({BY})), ln(legacy / lag(legacy, 252) OVER ({BY})))"


@query("G02_usd_trend", oracle(f"SELECT obs_date, round({USD}, 6) AS trend FROM drivers", *BASE))
def g02(spark, sf):
    return drivers(spark, sf).select("obs_date", rnd(gold.usd_trend(F.col("broad"), F.col("legacy"), W())).alias("trend"))


@query("G03_driver_panel", oracle(f"""SELECT month, round(100 * ln(value / lag(value) OVER (ORDER BY month)), 6) AS ret, round(z, 6) AS z_stress FROM (SELECT last_day(obs_date) AS month, max_by(value, obs_date) AS value, max_by(z, obs_date) AS z FROM (SELECT obs_date, value, CASE WHEN count(stress) {EVER} >= 300 THEN greatest(-4, least(4, (stress - avg(stress) {EVER}) / nullif(stddev_samp(stress) {EVER}, 0))) END AS z FROM drivers) GROUP BY 1)
  QUALIFY lag(value) OVER (ORDER BY month) IS NOT NULL""", *BASE))
def g03(spark, sf):
    return gold.monthly_panel(drivers(spark, sf), ["stress"], 300).select(F.col("obs_date").alias("month"), rnd("ret").alias("ret"), rnd("z_stress").alias("z_stress"))


@query("G06_gold_posterior", oracle("""SELECT obs_date, round(hedge / (crisis + carry + hedge), 6) AS hedge_bid, round(carry / (crisis + carry + hedge), 6) AS carry_headwind, round(crisis / (crisis + carry + hedge), 6) AS crisis_bid FROM (SELECT *, greatest(0, 1 - crisis - carry) AS hedge FROM (SELECT *, (1 - crisis) / (1 + exp(-2 * (0.7 * sin(n / 21.0::DOUBLE) + 0.3 * cos(n / 17.0::DOUBLE) - 0.35))) AS carry
  FROM (SELECT obs_date, n, (n % 10) / 10.0::DOUBLE / (1 + exp(-2 * (y - 0.5))) AS crisis FROM returns)))""", RETURNS))
def g06(spark, sf):
    n = F.col("n")
    return returns(spark, sf).select("obs_date", *(rnd(c).alias(k) for k, c in finance.gold_posterior(n % 10 / 10.0, F.col("y"), F.sin(n / 21.0), F.cos(n / 17.0)).items()))


C1 = (2 / np.pi) ** 0.5
LIMIT = f"(sqrt(2 * ln(k)) / {C1} - (ln(pi()) + ln(ln(k))) / (2 * {C1} * sqrt(2 * ln(k))) + {-np.log(-np.log(0.99))!r}::DOUBLE / ({C1} * sqrt(2 * ln(k))))".replace("np.float64(", "(")
JUMPS = ("jumped", f"""SELECT *, coalesce(abs(l) > limit_, false) AS is_jump FROM (SELECT *, CASE WHEN k >= 3 THEN {LIMIT} END AS limit_ FROM (SELECT *, count(l) {EVER} AS k FROM (SELECT *, r / ({C1}::DOUBLE * nullif(sqrt(bv), 0)) AS l FROM (SELECT *, CASE WHEN count(p) {over(63)} >= 61 THEN sum(p) {over(63)} / 61 END AS bv FROM (SELECT *, abs(r) * abs(lag(r) OVER ({BY})) AS p FROM returns WHERE r IS NOT NULL)))))""")


@query("G07_jumps", oracle(f"SELECT obs_date, round(l, 5) AS statistic, is_jump, CASE WHEN count(*) {over(252)} >= 63 THEN round(avg(CAST(is_jump AS INT)) {over(252)} * 252, 6) END AS intensity FROM jumped", RETURNS, JUMPS))
def g07(spark, sf):
    return gold.jumps(returns(spark, sf)).select("obs_date", rnd("statistic", 5).alias("statistic"), "is_jump", rnd("intensity").alias("intensity"))


@query("G08_crisis_premium", oracle(f"SELECT obs_date, round(least(1, greatest(0, least(1, intensity / 6.0::DOUBLE) * (1 + 0.5 * greatest(0, y)))), 6) AS premium FROM (SELECT *, CASE WHEN count(*) {over(252)} >= 63 THEN avg(CAST(is_jump AS INT)) {over(252)} * 252 END AS intensity FROM jumped) WHERE intensity IS NOT NULL", RETURNS, JUMPS))
def g08(spark, sf):
    """By the intensity of the jumps found."""
    j = gold.jumps(returns(spark, sf)).where("intensity is not null")
    return j.select("obs_date", rnd(finance.crisis_premium(F.col("intensity"), F.col("y"))).alias("premium"))


@query("G09_hedge_score", oracle(f"""SELECT obs_date, days, round(least(100, greatest(0, 100 * CASE WHEN c IS NULL THEN support ELSE 0.6 * least(1, greatest(0, (1 - c) / 2)) + 0.4 * support END)), 5) AS score FROM (SELECT *, count(ma) {over(504)} AS days, CASE WHEN count(ma) {over(504)} >= 40 THEN corr(ma, mb) {over(504)} END AS c FROM (SELECT *, CASE WHEN fallen AND e IS NOT NULL THEN r END AS ma, CASE WHEN fallen AND r IS NOT NULL THEN e END AS mb FROM (SELECT *, (n % 5) / 5.0::DOUBLE AS support, legacy / max(legacy) {over(252)} - 1 <= -0.05 AS fallen, ln(legacy / lag(legacy) OVER ({BY})) AS e FROM drivers)))""", *BASE))
def g09(spark, sf):
    d = drivers(spark, sf).withColumn("support", F.col("n") % 5 / 5.0)
    return gold.hedge(d, "r", "legacy", "support").select("obs_date", "days", rnd("score", 5).alias("score"))


@query("G10_gold_state", oracle(f"""SELECT obs_date, round(100 * least(1, greatest(0, 0.7 * CASE WHEN vol IS NULL THEN 0.5 ELSE least(1, vol / 30) END + 0.3 * least(1, coalesce(intensity, 0) / 6))), 4) AS risk, round(least(0.7, greatest(0, 0.7 - CASE WHEN vol IS NULL THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN intensity IS NULL THEN 0.05::DOUBLE ELSE 0 END)), 4) AS confidence FROM (SELECT *, CASE WHEN count(r) {over(252)} >= 252 THEN stddev_samp(r) {over(252)} * sqrt(252) * 10 END AS vol, CASE WHEN count(*) {over(252)} >= 63 THEN avg(CAST(is_jump AS INT)) {over(252)} * 252 END AS intensity FROM jumped)""", RETURNS, JUMPS))
def g10(spark, sf):
    j = gold.jumps(returns(spark, sf)).withColumn("vol", windows.rolling(F.stddev_samp, F.col("r"), W(), 252) * 252**0.5 * 10)
    return j.select("obs_date", *(rnd(c, 4).alias(k) for k, c in gold.state(F.col("vol"), F.col("intensity")).items()))


@query("G11_window_evaluation", oracle("SELECT name, state, n, share FROM (SELECT name, state, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY name)::DOUBLE, 6) AS share FROM states JOIN (VALUES ('first', DATE '1996-01-01', DATE '1996-12-31'), ('second', DATE '1999-01-01', DATE '1999-12-31')) AS e(name, a, b) ON obs_date BETWEEN a AND b GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, state) = 1", RETURNS, STATE))
def g11(spark, sf):
    spans = [("first", "1996-01-01", "1996-12-31"), ("second", "1999-01-01", "1999-12-31")]
    return gold.modal_state(aggregates.within(states(spark, sf), "obs_date", spans))


@query("C01_price_record", oracle("""SELECT obs_date, value, 'older' AS source FROM price_alt WHERE obs_date < (SELECT min(obs_date) FROM price_late) AND (SELECT count(*) >= 250 AND median(abs(a.value / b.value - 1)) <= 0.05 AND stddev_samp(ln(a.value / a.before)) / stddev_samp(ln(b.value / b.before)) BETWEEN 0.75 AND 1.35
  FROM (SELECT *, lag(value) OVER (ORDER BY obs_date) AS before FROM price_alt) a JOIN (SELECT *, lag(value) OVER (ORDER BY obs_date) AS before FROM price_late) b ON a.obs_date = b.obs_date) UNION ALL SELECT obs_date, value, 'base' FROM price_late"""))
def c01(spark, sf):
    return crypto.price_record(price_late(spark, sf), price_alt(spark, sf))


EPOCHS = ("epochs", "SELECT * FROM (VALUES " + ", ".join(f"({i}, DATE '{a}', DATE '{b}', {s!r}::DOUBLE, {t!r}::DOUBLE)" for i, a, b, s, t in crypto.epochs()) + ") AS t(epoch, first, last, subsidy, supply)")
SUPPLY = ("supply", "SELECT d AS obs_date, subsidy, last, supply + 210000 * subsidy * date_diff('day', first, d) / date_diff('day', first, last)::DOUBLE AS issued FROM (SELECT obs_date + 6000 AS d FROM price) JOIN epochs ON d >= first AND d < last")


@query("C02_supply_schedule", oracle("SELECT obs_date, round(issued, 4) AS issued_supply, round(100 * subsidy * 52596 / issued, 6) AS issuance_rate, round(issued / (subsidy * 52596), 6) AS stock_to_flow, date_diff('day', obs_date, last) AS days_to_next FROM supply", EPOCHS, SUPPLY))
def c02(spark, sf):
    days = price(spark, sf).select(F.date_add("obs_date", 6000).alias("obs_date"))
    return crypto.schedule(days).select("obs_date", rnd("issued_supply", 4).alias("issued_supply"), rnd("issuance_rate").alias("issuance_rate"), rnd("stock_to_flow").alias("stock_to_flow"), "days_to_next")


@query("C03_crypto_regime", oracle(f"""SELECT obs_date, CASE WHEN row > 400 AND yr IS NOT NULL AND vol IS NOT NULL THEN CASE WHEN dd <= -0.45 THEN 'winter' WHEN yr >= 0.69 AND vol >= 60 THEN 'frenzy' ELSE 'normal' END END AS regime FROM (SELECT obs_date, row_number() OVER ({BY}) AS row, value / max(value) {over(365)} - 1 AS dd, ln(value / lag(value, 365) OVER ({BY})) AS yr, CASE WHEN count(r) {over(365)} >= 365 THEN 100 * stddev_samp(r) {over(365)} * sqrt(365) END AS vol FROM returns)""", RETURNS))
def c03(spark, sf):
    return crypto.regime(returns(spark, sf)).select("obs_date", "regime")


LIQUID = ("liquid", "SELECT obs_date, last_value(a IGNORE NULLS) OVER (ORDER BY obs_date) + 0.001 * last_value(r IGNORE NULLS) OVER (ORDER BY obs_date) AS level FROM (SELECT obs_date, max(value) FILTER (WHERE series_id = 'A') AS a, max(value) FILTER (WHERE series_id = 'R') AS r FROM monthly GROUP BY 1)")
MONTHS = ("months", "SELECT 'PX' AS series_id, m.month AS obs_date, 100 * ln(m.value / lag(m.value) OVER (ORDER BY m.month)) AS ret, 100 * ln(l.level / lag(l.level) OVER (ORDER BY m.month)) AS dl FROM (SELECT last_day(obs_date) AS month, max_by(value, obs_date) AS value FROM price GROUP BY 1) m JOIN liquid l ON l.obs_date = m.month")
BETA = ("beta", f"""SELECT *, CASE WHEN n >= 24 THEN ret - alpha - b * dl END AS residual FROM (SELECT *, sqrt(greatest(0, syy - b * sxy) / nullif(n - 2, 0)) AS sigma FROM (SELECT obs_date, ret, dl, series_id, count(ret) {EVER} AS n, regr_slope(ret, dl) {EVER} AS b, regr_intercept(ret, dl) {EVER} AS alpha, regr_syy(ret, dl) {EVER} AS syy, regr_sxy(ret, dl) {EVER} AS sxy FROM months WHERE dl IS NOT NULL AND ret IS NOT NULL))""")


def liquid(spark, sf):
    return crypto.composite_liquidity(monthly(spark, sf), "A", "R")


def beta(spark, sf):
    m = reshape.month_end(price(spark, sf), ["series_id"], "obs_date", "value").withColumnRenamed("month", "obs_date").where("value is not null")
    joined = m.join(liquid(spark, sf).select("obs_date", "level"), "obs_date")
    return crypto.liquidity_beta(joined, 24)


@query("C04_composite_liquidity", oracle("SELECT obs_date, round(level, 6) AS level FROM liquid", LIQUID))
def c04(spark, sf):
    return liquid(spark, sf).select("obs_date", rnd("level").alias("level"))


@query("C05_liquidity_beta", oracle("SELECT obs_date, CASE WHEN n >= 24 THEN round(b, 6) END AS beta, round(residual, 5) AS residual FROM beta", LIQUID, MONTHS, BETA))
def c05(spark, sf):
    return beta(spark, sf).select("obs_date", rnd("beta").alias("beta"), rnd("residual", 5).alias("residual"))


@query("C06_band_excess", oracle(f"SELECT obs_date, round(sum(residual) {EVER}, 4) AS deviation, CASE WHEN n >= 24 THEN round(2 * sigma * sqrt(n), 4) END AS width, CASE WHEN n >= 24 THEN round(greatest(0, sum(residual) {EVER} / nullif(2 * sigma * sqrt(n), 0)), 6) END AS excess FROM beta", LIQUID, MONTHS, BETA))
def c06(spark, sf):
    return crypto.band(beta(spark, sf)).select("obs_date", rnd("deviation", 4).alias("deviation"), rnd("width", 4).alias("width"), rnd("excess").alias("excess"))


SPECULATION = ("terms", f"SELECT obs_date, CASE WHEN count(r) {over(63)} >= 63 THEN least(1, greatest(0, 100 * stddev_samp(r) {over(63)} * sqrt(365) / 2000)) END AS a, least(1, greatest(0, ((CASE WHEN count(value) {over(90)} >= 45 THEN avg(value) {over(90)} END) / (CASE WHEN count(value) {over(365)} >= 182 THEN avg(value) {over(365)} END) - 1) / 0.5)) AS b0, count(value) {over(365)} AS k, least(1, abs(y) / 5) AS c FROM returns")


@query("C07_speculation", oracle("SELECT obs_date, CASE WHEN a IS NULL OR k < 182 THEN NULL WHEN least(a, b0, c) = 0 THEN 0 ELSE round(100 * exp((ln(a) + ln(b0) + ln(c)) / 3), 5) END AS score FROM terms", RETURNS, SPECULATION))
def c07(spark, sf):
    r = returns(spark, sf)
    vol = finance.clip(100 * windows.rolling(F.stddev_samp, F.col("r"), W(), 63) * 365**0.5 / 2000, 0, 1)
    volume = finance.clip((crypto.volume_trend(F.col("value"), W()) - 1) / 0.5, 0, 1)
    return r.select("obs_date", rnd(100 * aggregates.geometric_mean([vol, volume, F.least(F.lit(1.0), F.abs("y") / 5)]), 5).alias("score"))


@query("C08_crypto_state", oracle("SELECT obs_date, NULL::DOUBLE AS expected_return, round(0.5 - CASE WHEN n < 36 THEN 0.1::DOUBLE ELSE 0 END, 4) AS confidence FROM beta", LIQUID, MONTHS, BETA))
def c08(spark, sf):
    b = beta(spark, sf)
    return b.select("obs_date", F.lit(None).cast("double").alias("expected_return"), rnd(F.lit(0.5) - F.when(F.col("n") < 36, 0.1).otherwise(0.0), 4).alias("confidence"))


@query("Y01_role_resolution", oracle("SELECT 'calibration' AS role, CASE WHEN (SELECT count(*) FROM price_late) >= 5000 THEN 'late' WHEN (SELECT count(*) FROM price_alt) >= 250 THEN 'alt' END AS series_id"))
def y01(spark, sf):
    counts = price_late(spark, sf).agg(F.lit("late").alias("series_id"), F.count("*").alias("n")).union(price_alt(spark, sf).agg(F.lit("alt").alias("series_id"), F.count("*").alias("n")))
    return equity.resolve_role(counts, "calibration", [("late", 5000), ("alt", 250)])


@query("Y02_publication_splice", oracle("SELECT obs_date, value, 'base' AS source FROM price_late"))
def y02(spark, sf):
    return joins.prefix_splice(price_late(spark, sf), price_alt(spark, sf), 250, 0.001)


@query("Y04_ffd_weights", oracle("SELECT d, k, round(w, 10) AS w FROM (WITH RECURSIVE t(d, k, w) AS (SELECT DISTINCT (n % 4 + 2) / 10.0::DOUBLE AS d, 0, 1.0::DOUBLE FROM returns UNION ALL SELECT d, k + 1, -w * (d - (k + 1) + 1) / (k + 1) FROM t WHERE k < 249) SELECT d, k, w FROM t) WHERE abs(w) >= 0.001", RETURNS))
def y04(spark, sf):
    """Weights of the orders that a table names."""
    orders = returns(spark, sf).select((((F.col("n") % 4) + 2) / 10.0).alias("d")).distinct()
    return windows.ffd_weight_rows(orders, "d", 1e-3, 250).select("d", "k", rnd("w", 10).alias("w"))


SLOPE = f"sin(n / 80.0::DOUBLE) / 100"


@query("Y06_kinematics", oracle(f"""SELECT obs_date, round(v, 6) AS velocity, round(a, 4) AS acceleration, CASE WHEN count(j) {EVER} >= 300 THEN round((j - avg(j) {EVER}) / nullif(stddev_samp(j) {EVER}, 0), 4) END AS jerk_z, CASE WHEN count(r) {over(21)} >= 21 THEN round(sum(r) {over(21)}, 6) END AS momentum_1m FROM (SELECT *, a - lag(a) OVER ({BY}) AS j FROM (SELECT *, 252 * (v - lag(v) OVER ({BY})) AS a FROM (SELECT *, CASE WHEN row_number() OVER ({BY}) > 252 THEN {SLOPE} * 252 END AS v FROM returns)))""", RETURNS))
def y06(spark, sf):
    r = returns(spark, sf).withColumn("slope", F.sin(F.col("n") / 80.0) / 100)
    k = equity.kinematics(r, "slope", "r", 252, burn_in=252, baseline=300)
    return k.select("obs_date", rnd("velocity").alias("velocity"), rnd("acceleration", 4).alias("acceleration"), rnd("jerk_z", 4).alias("jerk_z"), rnd("momentum_1m").alias("momentum_1m"))


@query("Y07_jerk_lamp", oracle("SELECT obs_date, CASE WHEN y IS NULL THEN -1 WHEN abs(y) >= 3 THEN 2 WHEN abs(y) >= 2 THEN 1 ELSE 0 END AS code FROM returns", RETURNS))
def y07(spark, sf):
    return returns(spark, sf).select("obs_date", finance.lamp(F.col("y")).alias("code"))


DESIGN = ("design", f"""SELECT series_id, obs_date, r, (ln(value / lag(value, 63) OVER ({BY})) * 252 / 63) / nullif(vol, 0) AS trend_fast, (ln(value / lag(value, 252) OVER ({BY})) * 252 / 252) / nullif(vol, 0) AS trend_slow, ln(vol / nullif(CASE WHEN count(vol) {over(252)} >= 126 THEN quantile_cont(vol, 0.5) {over(252)} END, 0)) AS vol_ratio, CASE WHEN count(value) {over(252)} >= 126 THEN (ln(value) - max(ln(value)) {over(252)}) / nullif(vol, 0) END AS drawdown_sigma
  FROM (SELECT *, CASE WHEN count(r) {over(21)} >= 21 THEN stddev_samp(r) {over(21)} * sqrt(252) END AS vol FROM returns)""")
FEATURES = ["trend_fast", "trend_slow", "vol_ratio", "drawdown_sigma"]


def design(spark, sf):
    return equity.design(returns(spark, sf), 252, baseline=252)


@query("Y09_regime_design", oracle(f"SELECT obs_date, {', '.join(f'round({f}, 5) AS {f}' for f in FEATURES)} FROM design WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}", RETURNS, DESIGN))
def y09(spark, sf):
    return design(spark, sf).select("obs_date", *(rnd(f, 5).alias(f) for f in FEATURES))


@query("Y13_transition_labels", oracle(f"SELECT obs_date, entry, CASE WHEN count(*) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) = 63 THEN max(entry) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 63 FOLLOWING) END AS label FROM (SELECT *, CAST(state = 'bear' AND coalesce(lag(state) OVER ({BY}), '') <> 'bear' AS INT) AS entry FROM states)", RETURNS, STATE))
def y13(spark, sf):
    s = states(spark, sf).withColumn("entry", windows.edge(F.col("state") == "bear", W()).cast("int"))
    return s.select("obs_date", "entry", windows.forward_max(F.col("entry"), W(), 63).alias("label"))


@query("Y14_purged_folds", oracle("""SELECT fold, count(*) FILTER (WHERE role = 'train') AS train, count(*) FILTER (WHERE role = 'test') AS test FROM (SELECT f.fold, CASE WHEN d.obs_date BETWEEN f.a AND f.b THEN 'test' WHEN NOT (d.obs_date + INTERVAL 6 MONTH >= f.a AND d.obs_date <= f.b) AND NOT (d.obs_date > f.b AND d.obs_date <= f.b + INTERVAL 6 MONTH) THEN 'train' END AS role FROM price d, (SELECT fold, min(obs_date) AS a, max(obs_date) AS b FROM (SELECT obs_date, ntile(5) OVER (ORDER BY obs_date) - 1 AS fold FROM price) GROUP BY 1) f) GROUP BY 1"""))
def y14(spark, sf):
    folds = equity.purged_folds(price(spark, sf), 5, 6, 6)
    return folds.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("train"), F.count_if(F.col("role") == "test").alias("test"))


@query("Y15_training_frame", oracle(f"SELECT d.obs_date, round(d.trend_fast, 5) AS trend_fast, s.state = 'bear' AS adverse_now, f.value AS factor FROM design d JOIN states s USING (obs_date) ASOF JOIN (SELECT * FROM monthly WHERE series_id = 'A') f ON d.obs_date >= f.obs_date WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}", RETURNS, STATE, DESIGN))
def y15(spark, sf):
    f = monthly(spark, sf).where("series_id = 'A'").select(F.lit("PX").alias("series_id"), F.col("obs_date").alias("month"), F.col("value").alias("factor"))
    d = design(spark, sf).select("series_id", "obs_date", "trend_fast").join(states(spark, sf).select("obs_date", (F.col("state") == "bear").alias("adverse_now")), "obs_date")
    return joins.as_of_join(d, f, ["series_id"], "obs_date", "month", ["factor"]).where("factor is not null").select("obs_date", rnd("trend_fast", 5).alias("trend_fast"), "adverse_now", "factor")


def training(spark, sf):
    s = states(spark, sf).withColumn("entry", windows.edge(F.col("state") == "bear", W()).cast("int"))
    labels = s.select("obs_date", windows.forward_max(F.col("entry"), W(), 63).alias("label")).where("label is not null")
    folder = scratch(spark)  # read again and again by the trees
    design(spark, sf).join(labels, "obs_date").write.parquet(folder)
    return spark.read.parquet(folder)


@query("Y16_Y17_calibrated_trees")
def y16(spark, sf):
    return equity.calibrated_forecast(training(spark, sf), FEATURES, "label", rounds=5)


#: Two trees over the first three features: (feature or -1, threshold, left, right, value, cover).
SMALL_TREES = [
    ([(0, 0.2, 1, 2, 0.0, 100.0), (2, 0.0, 3, 4, 0.0, 60.0), (0, 1.1, 5, 6, 0.0, 40.0), (-1, 0, 0, 0, 1.0, 20.0), (-1, 0, 0, 0, -2.0, 40.0), (1, 0.3, 7, 8, 0.0, 30.0), (-1, 0, 0, 0, 5.0, 10.0), (-1, 0, 0, 0, 0.5, 10.0), (-1, 0, 0, 0, 3.0, 20.0)], 1.0),
    ([(1, -0.4, 1, 2, 0.0, 100.0), (2, 0.1, 5, 6, 0.0, 30.0), (2, -0.2, 3, 4, 0.0, 70.0), (-1, 0, 0, 0, -1.0, 50.0), (-1, 0, 0, 0, 2.0, 20.0), (-1, 0, 0, 0, 4.0, 12.0), (-1, 0, 0, 0, 0.25, 18.0)], 0.5),
]


def worth_sql(known: set[int], nodes: list, at: int = 0) -> str:
    """A tree's value in SQL if only the known features are: the others are averaged over by cover."""
    f, threshold, left, right, value, cover = nodes[at]
    if f < 0:
        return f"{value!r}::DOUBLE"
    a, b = worth_sql(known, nodes, left), worth_sql(known, nodes, right)
    if f in known:
        return f"CASE WHEN {FEATURES[f]} <= {threshold!r}::DOUBLE THEN {a} ELSE {b} END"
    return f"({nodes[left][5] / cover!r}::DOUBLE * {a} + {nodes[right][5] / cover!r}::DOUBLE * {b})"


def shapley_sql(i: int) -> str:
    """Feature i's Shapley value by all subsets of the other two."""
    j, k = (x for x in range(3) if x != i)
    worth = lambda known: "(" + " + ".join(f"{w!r}::DOUBLE * {worth_sql(known, n)}" for n, w in SMALL_TREES) + ")"
    return " + ".join(f"({worth({*s, i})} - {worth(s)}) / {n}" for s, n in ((set(), 3), ({j}, 6), ({k}, 6), ({j, k}, 3)))


@query("Y18_shapley_values", oracle("SELECT obs_date, " + ", ".join(f"round({shapley_sql(i)}, 8) AS {FEATURES[i]}" for i in range(3)) + f" FROM design WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}", RETURNS, DESIGN))
def y18_shapley(spark, sf):
    """Exact Shapley values by leaves; the SQL goes through all subsets of the features."""
    leaves, _ = attribution.leaf_table(spark, SMALL_TREES)
    made = attribution.shapley_values(design(spark, sf), ["obs_date"], FEATURES[:3], leaves)
    return made.select("obs_date", *(rnd(f, 8).alias(f) for f in FEATURES[:3]))


@query("Y18_contributions")
def y18(spark, sf):
    return equity.contributions(training(spark, sf), FEATURES, "label", rounds=5)


@query("Y19_nested_horizons", oracle("SELECT obs_date, a AS p_3m, greatest(a, b) AS p_6m, greatest(a, b, c) AS p_12m FROM (SELECT obs_date, (n % 7) / 10.0::DOUBLE AS a, (n % 5) / 10.0::DOUBLE AS b, (n % 11) / 10.0::DOUBLE AS c FROM returns)", RETURNS))
def y19(spark, sf):
    p = returns(spark, sf).select("obs_date", *((F.col("n") % m / 10.0).alias(c) for c, m in (("p_3m", 7), ("p_6m", 5), ("p_12m", 11))))
    return windows.nested(p, ["p_3m", "p_6m", "p_12m"])


PARTS = {"entropy": "abs(sin(n / 30.0::DOUBLE))", "jerk": "abs(r)", "vol_of_vol": f"CASE WHEN count(r) {over(21)} >= 21 THEN stddev_samp(r) {over(21)} END"}
LONG = ("parts", " UNION ALL ".join(f"SELECT '{k}' AS series_id, obs_date, round({v}, 9) AS value FROM returns" for k, v in PARTS.items()))
ZP = ("pz", f"SELECT series_id, obs_date, CASE WHEN count(value) {EVER} < 2 THEN 0 ELSE round(coalesce(greatest(-3, least(3, (value - avg(value) {EVER}) / nullif(stddev_pop(value) {EVER}, 0))), 0), 9) END AS z FROM parts WHERE value IS NOT NULL")
SP = ("sp", "SELECT a.series_id, a.obs_date, 100 * CASE WHEN count(b.z) = 0 THEN 0.5 ELSE (count(*) FILTER (WHERE b.z < a.z) + count(*) FILTER (WHERE b.z <= a.z)) / 2.0::DOUBLE / count(b.z) END AS score FROM pz a LEFT JOIN pz b ON a.series_id = b.series_id AND b.obs_date < a.obs_date GROUP BY a.series_id, a.obs_date, a.z")


@query("Y20_instability_index", oracle("SELECT obs_date, round(avg(score), 5) AS rii, count(*) AS parts FROM sp GROUP BY 1", RETURNS, LONG, ZP, SP))
def y20(spark, sf):
    n, r = F.col("n"), F.col("r")
    wide = returns(spark, sf).select("obs_date", F.abs(F.sin(n / 30.0)).alias("entropy"), F.abs(r).alias("jerk"), windows.rolling(F.stddev_samp, r, W(), 21).alias("vol_of_vol"))
    return equity.instability(wide, ["entropy", "jerk", "vol_of_vol"]).select("obs_date", rnd("rii", 5).alias("rii"), "parts")


DEEP = ("deep", """SELECT 'PX' AS series_id, depth - 0.8 AS x FROM (SELECT max(depth) AS depth FROM (SELECT *, sum(start) OVER (ORDER BY obs_date) AS island FROM (SELECT *, CASE WHEN (depth > 0.8) IS NOT DISTINCT FROM lag(depth > 0.8) OVER (ORDER BY obs_date) THEN 0 ELSE 1 END AS start
  FROM (SELECT obs_date, 1 - value / max(value) OVER (ORDER BY obs_date) AS depth FROM price))) WHERE depth > 0.8 GROUP BY island)""")
SIZED = ("sized", "SELECT series_id, count(*) AS n, max(x) AS most FROM deep GROUP BY 1")


def profile(places: str) -> str:
    return f"SELECT series_id, s, k, -(ln(k / ratio) + k + 1) AS l FROM (SELECT series_id, s, avg(ln(1 + (exp(s) - 1) / most * x)) AS k, max((exp(s) - 1) / most) AS ratio FROM deep JOIN sized USING (series_id), {places} WHERE n >= 25 GROUP BY 1, 2) WHERE k > -0.5"


ROUGH = ("rough", profile("(SELECT round(-6 + 0.1::DOUBLE * i + 0.0313::DOUBLE, 4) AS s FROM range(121) AS r(i))"))
CLOSE = ("close", profile("(SELECT near + i * 0.005::DOUBLE AS s FROM (SELECT s AS near FROM rough ORDER BY l DESC, s DESC LIMIT 1), range(-20, 21) AS r(i))"))
TOP = ("summit", "SELECT s + coalesce(0.0025::DOUBLE * (low - high) / (low - 2 * l + high), 0) AS s FROM (SELECT *, lag(l) OVER (ORDER BY s) AS low, lead(l) OVER (ORDER BY s) AS high FROM close) ORDER BY l DESC LIMIT 1")


@query("Y21_tail_fit", oracle("SELECT z.series_id, z.n, round(shape, 5) AS shape, round(shape / ratio, 6) AS scale FROM sized z LEFT JOIN (SELECT series_id, avg(ln(1 + (exp(s) - 1) / most * x)) AS shape, max((exp(s) - 1) / most) AS ratio FROM deep JOIN sized USING (series_id), summit WHERE n >= 25 GROUP BY 1) f USING (series_id)", DEEP, SIZED, ROUGH, CLOSE, TOP))
def y21(spark, sf):
    d = price(spark, sf).withColumn("depth", -windows.drawdown(F.col("value"), W()))
    out = equity.tail(aggregates.episodes(d, ["series_id"], "obs_date", "depth", 0.8), "depth", 0.8)
    return out.select("series_id", "n", rnd("shape", 5).alias("shape"), rnd("scale").alias("scale"))


@query("Y22_horizon_probability", oracle("SELECT obs_date, round(1 - exp(-(0.02 * 12 * power(1 + 0.33 * (0.2 - 0.1) / 0.083, -1 / 0.33) * (0.5 + 1.5 * least(9, floor(rii / 10.0::DOUBLE)) / 9))), 6) AS p FROM (SELECT obs_date, round(avg(score), 5) AS rii FROM sp GROUP BY 1)", RETURNS, LONG, ZP, SP))
def y22(spark, sf):
    """By each day's instability index."""
    survival = finance.gpd_survival(F.lit(0.2), 0.1, 0.33, 0.083)
    return y20(spark, sf).select("obs_date", rnd(finance.horizon_probability(0.02, 12.0, survival, finance.hazard_multiplier(F.col("rii")))).alias("p"))


MOVE = np.array([[0.9, 0.06, 0.02, 0.01, 0.01], [0.05, 0.88, 0.05, 0.01, 0.01], [0.02, 0.05, 0.86, 0.05, 0.02], [0.01, 0.02, 0.07, 0.85, 0.05], [0.01, 0.01, 0.03, 0.1, 0.85]])


REACH = ("reach", "SELECT s, hit FROM (WITH RECURSIVE t(s, step, a, b, c, hit) AS (SELECT s, 0, CAST(s = 0 AS INT)::DOUBLE, CAST(s = 1 AS INT)::DOUBLE, CAST(s = 2 AS INT)::DOUBLE, 0.0::DOUBLE FROM (VALUES (0), (1), (2)) AS v(s) UNION ALL SELECT s, step + 1, a*0.9 + b*0.05 + c*0.02, a*0.06 + b*0.88 + c*0.05, a*0.02 + b*0.05 + c*0.86, hit + a*0.02 + b*0.02 + c*0.07 FROM t WHERE step < 63) SELECT * FROM t WHERE step = 63)")


@query("Y24_transmission", oracle("SELECT obs_date, round(greatest(0.1, (least(1, greatest(0, (n % 15 - 3) / 7.0::DOUBLE)) + coalesce(b, 0) + least(1, greatest(0, (sin(n / 9.0::DOUBLE) + 0.5) / 2))) / (2 + CAST(b IS NOT NULL AS INT))), 6) AS score FROM (SELECT *, least(1, greatest(0, r / 2)) AS b0, CASE WHEN r IS NOT NULL THEN least(1, greatest(0, r / 2)) END AS b FROM returns)", RETURNS))
def y24(spark, sf):
    n = F.col("n")
    t = finance.transmission({"credit_spread": (n % 15).cast("double"), "credit_velocity": F.col("r"), "liquidity": F.sin(n / 9.0)})
    return returns(spark, sf).select("obs_date", rnd(t).alias("score"))


@query("Y25_crash_risk", oracle("SELECT obs_date, round(100 * (n % 10) / 10.0::DOUBLE * (n % 7) / 7.0::DOUBLE * greatest(0.1, least(1, greatest(0, (n % 15 - 3) / 7.0::DOUBLE))), 6) AS crash_risk FROM returns", RETURNS))
def y25(spark, sf):
    n = F.col("n")
    risk = equity.crash_risk(n % 10 / 10.0, n % 7 / 7.0, finance.transmission({"credit_spread": (n % 15).cast("double")}))
    return returns(spark, sf).select("obs_date", rnd(risk).alias("crash_risk"))


def simulated(spark, paths=400):
    shock = {"rate": 0.3, "threshold": 0.1, "shape": 0.33, "scale": 0.083, "onset": 10, "recovery": 250}
    return models.simulate(spark, [0.18, 0.1, 0.05, -0.1, -0.3], [0.1, 0.13, 0.16, 0.22, 0.4], MOVE, [0.2] * 5, [0.5, 2.0], paths, 20260731, shock)


@query("Y26_monte_carlo")
def y26(spark, sf):
    return simulated(spark)


@query("Y27_path_summary")
def y27(spark, sf):
    return equity.path_summary(simulated(spark))


OUT = ("outp", "SELECT obs_date, r, y FROM returns")


@query("Y28_outputs", oracle("SELECT obs_date, metric, round(value, 6) AS value FROM outp UNPIVOT (value FOR metric IN (r, y))", RETURNS, OUT))
def y28(spark, sf):
    return reshape.tall(returns(spark, sf).select("obs_date", "r", "y"), ["obs_date"], ["r", "y"])


@query("Y29_expected_return", oracle("SELECT obs_date, round(0.18 * (n % 5) / 10.0::DOUBLE - 0.3 * (1 - (n % 5) / 10.0::DOUBLE), 6) AS expected_return, round(-((n % 5) / 10.0::DOUBLE * ln(greatest((n % 5) / 10.0::DOUBLE, 1e-12)) + (1 - (n % 5) / 10.0::DOUBLE) * ln(1 - (n % 5) / 10.0::DOUBLE)), 6) AS entropy FROM returns", RETURNS))
def y29(spark, sf):
    p = F.col("n") % 5 / 10.0
    return returns(spark, sf).select("obs_date", rnd(0.18 * p - 0.3 * (1 - p)).alias("expected_return"), rnd(finance.entropy([p, 1 - p])).alias("entropy"))


@query("Y30_instability_on_dates", oracle("SELECT p.obs_date, s.state FROM price_late p ASOF JOIN states s ON p.obs_date >= s.obs_date", RETURNS, STATE))
def y30(spark, sf):
    s = states(spark, sf).select("series_id", F.col("obs_date").alias("day"), "state")
    return joins.as_of_join(price_late(spark, sf), s, ["series_id"], "obs_date", "day", ["state"]).select("obs_date", "state")


@query("Y32_episode_evaluation", oracle("SELECT name, days, coverage, lead_days FROM (SELECT name, count(*) AS days, round(avg(CAST(state = 'bear' AS INT)), 6) AS coverage, date_diff('day', min(obs_date), min(obs_date) FILTER (WHERE state = 'bear')) AS lead_days FROM states JOIN (VALUES ('a', DATE '1996-01-01', DATE '1997-06-30'), ('b', DATE '1998-03-01', DATE '2000-02-28')) AS e(name, first, last) ON obs_date BETWEEN first AND last GROUP BY 1)", RETURNS, STATE))
def y32(spark, sf):
    return equity.episode_evaluation(states(spark, sf), [("a", "1996-01-01", "1997-06-30"), ("b", "1998-03-01", "2000-02-28")], ["bear"])


TAIL = ("tail", "SELECT z.series_id, z.n, shape, shape / ratio AS scale FROM sized z JOIN (SELECT series_id, avg(ln(1 + (exp(s) - 1) / most * x)) AS shape, max((exp(s) - 1) / most) AS ratio FROM deep JOIN sized USING (series_id), summit WHERE n >= 25 GROUP BY 1) f USING (series_id)")


@query("Y33_return_levels", oracle("SELECT series_id, years, round(CASE WHEN years * rate <= 1 THEN 0.8 ELSE 0.8 + scale / shape * (power(years * rate, shape) - 1) END, 5) AS fitted FROM (SELECT *, n / ((SELECT date_diff('day', min(obs_date), max(obs_date)) FROM price) / 365.25) AS rate FROM tail), (VALUES (10.0::DOUBLE), (25.0), (50.0), (100.0)) AS t(years)", DEEP, SIZED, ROUGH, CLOSE, TOP, TAIL))
def y33(spark, sf):
    """Levels passed once in so many years, by the fitted tail of each series and the rate of its episodes."""
    p = price(spark, sf)
    d = p.withColumn("depth", -windows.drawdown(F.col("value"), W()))
    fits = equity.tail(aggregates.episodes(d, ["series_id"], "obs_date", "depth", 0.8), "depth", 0.8).where("shape is not null")
    span = p.groupBy("series_id").agg((F.datediff(F.max("obs_date"), F.min("obs_date")) / 365.25).alias("years_of"))
    rows = fits.join(span, "series_id").withColumn("years", F.explode(F.array(*map(F.lit, (10.0, 25.0, 50.0, 100.0)))))
    return rows.select("series_id", "years", rnd(finance.gpd_quantile(F.col("years"), F.col("n") / F.col("years_of"), 0.8, F.col("shape"), F.col("scale")), 5).alias("fitted"))


@query("Y11_state_labels", oracle(f"SELECT state, rank FROM (SELECT state, row_number() OVER (ORDER BY round(avg(r), 12) DESC, stddev_samp(r)) AS rank FROM states GROUP BY 1)", RETURNS, STATE))
def y11(spark, sf):
    """States in order of mean return, then calm: the order in which names are given."""
    means = states(spark, sf).groupBy("state").agg(F.round(F.avg("r"), 12).alias("m"), F.stddev_samp("r").alias("s"))
    w = Window.orderBy(F.desc("m"), "s")  # as many rows as states
    return means.select("state", F.row_number().over(w).cast("bigint").alias("rank"))
