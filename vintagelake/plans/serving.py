"""Queries of the read side."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagelake.functions import finance
from vintagelake.plans import views
from vintagelake.plans.fixtures import CUTOFF, dayno, metadata, obs, oracle, outputs, price, table
from vintagelake.plans.core import thinned_with_extremes
from vintagelake.plans.registry import query

TODAY = "2001-12-31"
K = "date_diff('day', DATE '1995-01-01', as_of)"
STATES = ("states_", f"SELECT asset, as_of, 'v' || ({K} % 2) AS model_version, value AS risk FROM outputs WHERE metric = 'rii' AND asset = 'equity' OR metric = 'hedge_score'")


def states(spark, sf):
    o = outputs(spark, sf).where("metric = 'rii' and asset = 'equity' or metric = 'hedge_score'")
    return o.select("asset", "as_of", F.concat(F.lit("v"), (dayno("as_of") % 2).cast("string")).alias("model_version"), F.col("value").alias("risk"))


@query("V01_catalogue", oracle(f"SELECT m.series_id, m.title, coalesce(n, 0) AS n, first, last, value, date_diff('day', last, DATE '{TODAY}') AS age_days FROM metadata m LEFT JOIN (SELECT series_id, count(*) AS n, min(obs_date) AS first, max(obs_date) AS last, max_by(value, (obs_date, revision_date)) AS value FROM obs GROUP BY 1) USING (series_id)"))
def v01(spark, sf):
    return views.catalogue(obs(spark, sf), metadata(spark, sf), TODAY)


@query("V02_series", oracle("SELECT series_id, obs_date, value, count(*) OVER () AS available, count(*) OVER () > 100 AS truncated FROM (SELECT * FROM obs WHERE series_id = '1-URGENT' AND obs_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' QUALIFY row_number() OVER (PARTITION BY obs_date ORDER BY revision_date DESC) = 1) ORDER BY obs_date LIMIT 100"))
def v02(spark, sf):
    return views.series_history(obs(spark, sf), "1-URGENT", "1996-01-01", "1998-12-31", 100)


@query("V02_series_thinned", oracle(thinned_with_extremes("urgent", 100), ("urgent", "SELECT series_id, obs_date, value FROM obs WHERE series_id = '1-URGENT' QUALIFY row_number() OVER (PARTITION BY obs_date ORDER BY revision_date DESC, value DESC) = 1")))
def v02_thin(spark, sf):
    return views.series_history(obs(spark, sf), "1-URGENT", points=100)


@query("V03_pit", oracle(f"""SELECT *, (SELECT count(*) FROM metadata) AS total FROM (SELECT series_id, 'available' AS kind, obs_date, release_date, value, NULL::INT AS published_days_later FROM pit_latest UNION ALL SELECT series_id, 'withheld', obs_date, release_date, value, date_diff('day', DATE '{CUTOFF}', release_date) FROM (SELECT * FROM obs WHERE release_date > DATE '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY obs_date, release_date, revision_date) = 1))"""))
def v03(spark, sf):
    return views.snapshot(obs(spark, sf), metadata(spark, sf), CUTOFF)


@query("V04_assets", oracle(f"SELECT v.asset, as_of, model_version, risk, coalesce(date_diff('day', as_of, DATE '{TODAY}') > 5, true) AS stale, as_of IS NULL AS awaiting_first_run FROM (VALUES ('equity'), ('gold'), ('crypto')) AS v(asset) LEFT JOIN (SELECT * FROM states_ QUALIFY row_number() OVER (PARTITION BY asset ORDER BY as_of DESC, model_version DESC) = 1) USING (asset)", STATES))
def v04(spark, sf):
    return views.asset_states(states(spark, sf), ["equity", "gold", "crypto"], TODAY)


@query("V05_asset_state", oracle("SELECT * FROM states_ WHERE asset = 'gold' ORDER BY as_of DESC, model_version DESC LIMIT 1", STATES))
def v05(spark, sf):
    return views.asset_state(states(spark, sf), "gold")


@query("V06_metric_history", oracle("SELECT asset, metric, as_of, value, count(*) OVER () AS available, count(*) OVER () > 200 AS truncated FROM outputs WHERE asset = 'equity' AND metric = 'rii' AND as_of >= DATE '1996-01-01' ORDER BY as_of LIMIT 200"))
def v06(spark, sf):
    return views.metric_history(outputs(spark, sf), "equity", "rii", "1996-01-01", limit=200)


@query("V06_metrics", oracle("SELECT DISTINCT metric FROM outputs WHERE asset = 'gold'"))
def v06_metrics(spark, sf):
    return views.metrics(outputs(spark, sf), "gold")


FEATURES = ("features", f"SELECT asset, metric, as_of, value, 'v' || ({K} % 2) AS model_version FROM outputs")


def versioned(spark, sf):
    return outputs(spark, sf).withColumn("model_version", F.concat(F.lit("v"), (dayno("as_of") % 2).cast("string")))


@query("V07_newest_features", oracle("SELECT as_of, model_version, asset, metric, value FROM features WHERE (as_of, model_version) = (SELECT max((as_of, model_version)) FROM features)", FEATURES))
def v07(spark, sf):
    return views.newest_features(versioned(spark, sf)).select("as_of", "model_version", "asset", "metric", "value")


@query("V08_forces", oracle("SELECT * FROM (SELECT as_of, value, 'm' AS model_version, metric AS force FROM outputs WHERE asset = 'equity' AND metric = 'tail_probability' ORDER BY as_of DESC LIMIT 50)"))
def v08(spark, sf):
    forces = outputs(spark, sf).where("asset = 'equity'").select("as_of", "value", F.lit("m").alias("model_version"), F.col("metric").alias("force"))
    return views.force_history(forces, "tail_probability", 50)


LEGS = ("legs", "SELECT as_of, metric AS regime, value AS probability, model_version FROM features WHERE asset = 'equity' AND metric <> 'rii'")


@query("V09_regimes", oracle("SELECT as_of, CASE WHEN coalesce(t, -1) >= coalesce(s, -1) THEN 'tail_probability' ELSE 'shock_likelihood' END AS label, greatest(coalesce(t, -1), coalesce(s, -1)) AS confidence FROM (SELECT as_of, max(probability) FILTER (WHERE regime = 'tail_probability') AS t, max(probability) FILTER (WHERE regime = 'shock_likelihood') AS s FROM legs WHERE model_version = (SELECT max(model_version) FROM legs) GROUP BY 1)", FEATURES, LEGS))
def v09(spark, sf):
    legs = versioned(spark, sf).where("asset = 'equity' and metric <> 'rii'").select("as_of", F.col("metric").alias("regime"), F.col("value").alias("probability"), "model_version")
    return views.regime_history(legs, ["tail_probability", "shock_likelihood"]).drop("posterior")


@query("V10_instability", oracle("SELECT as_of, max(value) FILTER (WHERE metric = 'rii') AS rii, max(value) FILTER (WHERE metric = 'tail_probability') AS tail_probability, max(value) FILTER (WHERE metric = 'shock_likelihood') AS shock_likelihood, max(value) FILTER (WHERE metric = 'crash_risk') AS crash_risk FROM outputs WHERE asset = 'equity' GROUP BY 1"))
def v10(spark, sf):
    return views.metric_pivot(outputs(spark, sf), "equity", ["rii", "tail_probability", "shock_likelihood", "crash_risk"]).withColumn("crash_risk", F.col("crash_risk").cast("double"))


@query("V11_forecast", oracle("SELECT horizon, list(value ORDER BY quantile) AS levels FROM (SELECT as_of, model_version, metric AS horizon, q AS quantile, value * q AS value FROM features, (VALUES (0.1::DOUBLE), (0.5), (0.9)) AS t(q) WHERE asset = 'equity') WHERE (as_of, model_version) = (SELECT max((as_of, model_version)) FROM features) GROUP BY 1", FEATURES))
def v11(spark, sf):
    bands = versioned(spark, sf).where("asset = 'equity'").select("as_of", "model_version", F.col("metric").alias("horizon"), "value", F.explode(F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("quantile")).withColumn("value", F.col("value") * F.col("quantile"))
    return views.forecast(bands).select("horizon", F.map_values("quantiles").alias("levels"))


@query("V12_simulation_summary", oracle("SELECT asset, as_of, risk AS median FROM states_", STATES))
def v12(spark, sf):
    s = states(spark, sf).withColumn("components", F.create_map(F.lit("mc_median"), F.col("risk"), F.lit("other"), F.lit(1.0)))
    out = views.simulation_summary(s)
    return out.where(F.size("summary") == 1).select("asset", "as_of", F.col("summary")["mc_median"].alias("median"))


@query("V13_health", "SELECT bool_and(status <> 'failed') AS ok, max(run_at) AS newest, max(run_at) + INTERVAL 36 HOUR < TIMESTAMP '2024-02-05' AS stale FROM (SELECT event_type, max_by(CASE WHEN value > 1000 THEN 'failed' ELSE 'ok' END, ts) AS status, max(ts) AS run_at FROM events GROUP BY 1)")
def v13(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("source"), F.when(F.col("value") > 1000, "failed").otherwise("ok").alias("status"), F.col("ts").alias("run_at"))
    return views.health(log, "2024-02-05 00:00:00")


@query("V14_coverage_probe", oracle("SELECT asset, metric, min(as_of) AS first, max(as_of) AS last, count(value) AS n FROM outputs GROUP BY 1, 2"))
def v14(spark, sf):
    return views.coverage_probe(outputs(spark, sf))


@query("V14_tiers", oracle("SELECT as_of, CASE WHEN value >= 70 THEN 'high' WHEN value >= 40 THEN 'elevated' ELSE 'low' END AS risk FROM outputs WHERE asset = 'equity' AND metric = 'rii'"))
def v14_tiers(spark, sf):
    return outputs(spark, sf).where("asset = 'equity' and metric = 'rii'").select("as_of", views.tier(F.col("value"), ("low", "elevated", "high"), 40, 70).alias("risk"))


@query("V14_freshness", oracle(f"SELECT series_id, CASE WHEN age IS NULL THEN 'stale' WHEN age <= 4 THEN 'fresh' WHEN age <= 10 THEN 'aging' ELSE 'stale' END AS tier FROM (SELECT m.series_id, date_diff('day', max(o.obs_date), DATE '{TODAY}') AS age FROM metadata m LEFT JOIN obs o USING (series_id) GROUP BY 1)"))
def v14_freshness(spark, sf):
    c = views.catalogue(obs(spark, sf), metadata(spark, sf), TODAY)
    return c.select("series_id", views.freshness(F.col("age_days"), F.lit("daily")).alias("tier"))


@query("V14_implied_zero", oracle("SELECT obs_date, round(-ln(exp(-value / 1000 * 5)) / 5 * 100, 6) AS zero FROM price"))
def v14_zero(spark, sf):
    factor = F.exp(-F.col("value") / 1000 * 5)
    return price(spark, sf).select("obs_date", F.round(finance.implied_zero_rate(factor, F.lit(5.0)), 6).alias("zero"))


@query("L04_row_ceiling", oracle("SELECT as_of, metric, value, count(*) OVER () AS available, count(*) OVER () > 300 AS truncated FROM outputs WHERE asset = 'equity' ORDER BY as_of, metric LIMIT 300"))
def l04(spark, sf):
    """The limit counts dates: 100 dates of three metrics."""
    rows = outputs(spark, sf).where("asset = 'equity'").select("as_of", "metric", "value")
    return views.by_date(rows, ["as_of", "metric"], dates=100, rows_per_date=3)
