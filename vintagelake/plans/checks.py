"""Queries of the data-quality checks, over figures with faults put in."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagelake.operators import quality
from vintagelake.plans.fixtures import dayno, metadata, obs, obs_invalid, obs_null_rev, oracle, price, rates_short
from vintagelake.plans.registry import query

N = "date_diff('day', DATE '1995-01-01', obs_date)"
FAULTY = ("faulty", f"""SELECT 'PX' AS series_id, obs_date, CASE WHEN {N} % 90 = 7 THEN obs_date - 3 ELSE obs_date + 1 END AS release_date, obs_date + 1 AS revision_date, CASE WHEN {N} % 211 = 5 THEN -value ELSE value END AS value, CASE WHEN {N} % 300 = 9 THEN 'usd' ELSE 'index' END AS unit, 'daily' AS frequency FROM price
  UNION ALL SELECT 'PX', obs_date, obs_date + 1, obs_date + 1, value + 1, 'index', 'daily' FROM price WHERE {N} % 40 = 11
  UNION ALL SELECT 'SR', obs_date, obs_date, obs_date, value, 'index', 'daily' FROM rates_short""")
SPECS = ("specs", "SELECT * FROM (VALUES ('PX', 'index', 'daily'), ('SR', 'index', 'weekly'), ('NONE', 'index', 'daily')) AS t(series_id, unit, frequency)")
LATEST = ("latest", "SELECT * FROM faulty QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY greatest(release_date, revision_date) DESC, value DESC) = 1")
MOVES = ("moves", "SELECT *, value - before AS move, (value - before) / nullif(abs(before), 0) AS relative FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY obs_date) AS before FROM latest)")
PERIODS = ("periods", "SELECT *, date_diff('day', lag(obs_date) OVER (PARTITION BY series_id ORDER BY obs_date), obs_date) AS gap FROM (SELECT DISTINCT series_id, obs_date FROM faulty)")
JUMPS = ("jumps", """SELECT series_id, obs_date, value, before FROM moves JOIN (SELECT series_id, min(value) < 0 AND max(value) > 0 AS crosses, list_sort(list(abs(value)))[CAST(floor(0.75 * count(*)) AS INT) + 1] AS scale FROM latest GROUP BY 1) USING (series_id) WHERE CASE WHEN crosses THEN abs(move) > 3 * scale ELSE abs(relative) > 2 END""")
ALL = [FAULTY, SPECS, LATEST, MOVES, PERIODS, JUMPS]


def faulty(spark, sf):
    p = price(spark, sf).withColumn("n", dayno("obs_date"))
    day = F.date_add("obs_date", 1)
    a = p.select("series_id", "obs_date", F.when(F.col("n") % 90 == 7, F.date_sub("obs_date", 3)).otherwise(day).alias("release_date"), day.alias("revision_date"), F.when(F.col("n") % 211 == 5, -F.col("value")).otherwise(F.col("value")).alias("value"), F.when(F.col("n") % 300 == 9, "usd").otherwise("index").alias("unit"), F.lit("daily").alias("frequency"))
    b = p.where("n % 40 = 11").select("series_id", "obs_date", day.alias("release_date"), day.alias("revision_date"), (F.col("value") + 1).alias("value"), F.lit("index").alias("unit"), F.lit("daily").alias("frequency"))
    c = rates_short(spark, sf).select("series_id", "obs_date", F.col("obs_date").alias("release_date"), F.col("obs_date").alias("revision_date"), "value", F.lit("index").alias("unit"), F.lit("daily").alias("frequency"))
    return a.unionByName(b).unionByName(c)


def specs(spark):
    return spark.createDataFrame([("PX", "index", "daily"), ("SR", "index", "weekly"), ("NONE", "index", "daily")], "series_id string, unit string, frequency string")


@query("Q01_empty", oracle("SELECT series_id, 'empty' AS code, 'error' AS severity, CAST(0 AS BIGINT) AS n FROM specs WHERE series_id NOT IN (SELECT series_id FROM faulty)", *ALL))
def q01(spark, sf):
    return quality.empty(faulty(spark, sf), specs(spark))


@query("Q02_mismatch", oracle("SELECT series_id, 'unit_mismatch' AS code, 'error' AS severity, count(*) AS n FROM faulty f JOIN specs s USING (series_id) WHERE f.unit <> s.unit GROUP BY 1 UNION ALL SELECT series_id, 'frequency_mismatch', 'error', count(*) FROM faulty f JOIN specs s USING (series_id) WHERE f.frequency <> s.frequency GROUP BY 1", *ALL))
def q02(spark, sf):
    f = faulty(spark, sf)
    return quality.mismatch(f, specs(spark), "unit").union(quality.mismatch(f, specs(spark), "frequency"))


@query("Q03_duplicate_timestamp", oracle("SELECT series_id, 'duplicate_timestamp' AS code, 'error' AS severity, count(*) AS n FROM (SELECT series_id FROM faulty GROUP BY series_id, obs_date, revision_date HAVING count(*) > 1) GROUP BY 1", *ALL))
def q03(spark, sf):
    return quality.duplicates(faulty(spark, sf))


@query("Q04_revision_conflict", oracle("""SELECT series_id, 'revision_conflict' AS code, 'error' AS severity, count(*) AS n FROM (SELECT series_id FROM faulty GROUP BY series_id, obs_date, revision_date HAVING count(DISTINCT round(value, 10)) > 1) GROUP BY 1
  UNION ALL SELECT series_id, 'revision_conflict_stored', 'error', count(*) FROM faulty f JOIN (SELECT series_id, obs_date, obs_date + 1 AS revision_date, value AS was FROM price) USING (series_id, obs_date, revision_date) WHERE abs(value - was) > 1e-9 GROUP BY 1""", *ALL))
def q04(spark, sf):
    f = faulty(spark, sf)
    stored = price(spark, sf).withColumns({c: F.date_add("obs_date", 1) for c in ("release_date", "revision_date")})
    return quality.conflicts(f).union(quality.stored_conflicts(f, stored))


@query("Q05_invalid_frequency", oracle("SELECT series_id, 'invalid_frequency' AS code, 'error' AS severity, n FROM (SELECT series_id, quantile_cont(gap, 0.5) AS gap, count(*) AS n FROM periods GROUP BY 1) JOIN specs USING (series_id) WHERE n >= 3 AND (gap < 0.4 * CASE frequency WHEN 'daily' THEN 1 ELSE 7 END OR gap > 2.0 * CASE frequency WHEN 'daily' THEN 1 ELSE 7 END)", *ALL))
def q05(spark, sf):
    return quality.invalid_frequency(faulty(spark, sf), specs(spark))


@query("Q06_missing", oracle("SELECT series_id, obs_date, gap FROM periods JOIN specs USING (series_id) WHERE gap > 3 * CASE frequency WHEN 'daily' THEN 5 ELSE 10 END QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY gap DESC, obs_date) <= 5", *ALL))
def q06(spark, sf):
    return quality.gaps(faulty(spark, sf), specs(spark))


@query("Q07_coverage", oracle("SELECT series_id, present, round(CASE frequency WHEN 'daily' THEN span * 5 / 7 - span / 365 * 9 ELSE span / 7 END + 1, 6) AS expected FROM (SELECT series_id, count(DISTINCT obs_date) AS present, CAST(date_diff('day', min(obs_date), max(obs_date)) AS DOUBLE) AS span FROM faulty GROUP BY 1) JOIN specs USING (series_id)", *ALL))
def q07(spark, sf):
    return quality.coverage(faulty(spark, sf), specs(spark)).withColumn("expected", F.round("expected", 6))


@query("Q08_abnormal_jump", oracle("SELECT * FROM jumps", *ALL))
def q08(spark, sf):
    return quality.jumps(faulty(spark, sf))


@query("Q09_outlier_move", oracle("""SELECT series_id, obs_date, round(relative, 6) AS relative, round(z, 4) AS z FROM (SELECT *, (relative - med) / nullif(1.4826 * mad, 0) AS z FROM (SELECT *, quantile_cont(abs(relative - med), 0.5) OVER (PARTITION BY series_id) AS mad FROM (SELECT *, quantile_cont(relative, 0.5) OVER (PARTITION BY series_id) AS med, count(*) OVER (PARTITION BY series_id) AS n FROM moves WHERE relative IS NOT NULL)))
  WHERE n >= 30 AND abs(z) > 12 AND abs(relative) <= 2""", *ALL))
def q09(spark, sf):
    return quality.outliers(faulty(spark, sf)).select("series_id", "obs_date", F.round("relative", 6).alias("relative"), F.round("z", 4).alias("z"))


@query("Q10_non_positive", oracle("SELECT series_id, 'non_positive_value' AS code, 'warning' AS severity, count(*) AS n FROM faulty WHERE value <= 0 AND series_id IN (SELECT series_id FROM specs WHERE unit IN ('index', 'usd', 'usd_billions', 'ratio')) GROUP BY 1", *ALL))
def q10(spark, sf):
    return quality.non_positive(faulty(spark, sf), specs(spark))


@query("Q11_release_inversion", oracle("SELECT series_id, 'release_date_inversion' AS code, 'warning' AS severity, count(*) AS n FROM (SELECT *, lag(first) OVER (PARTITION BY series_id ORDER BY obs_date) AS before FROM (SELECT series_id, obs_date, min(release_date) AS first FROM faulty GROUP BY 1, 2)) WHERE first < before GROUP BY 1", *ALL))
def q11(spark, sf):
    return quality.release_inversions(faulty(spark, sf))


@query("Q12_flags", oracle("SELECT f.series_id, f.obs_date, f.value, CASE WHEN j.obs_date IS NOT NULL THEN 'abnormal_jump' END AS quality_flag FROM faulty f LEFT JOIN jumps j ON f.series_id = j.series_id AND f.obs_date = j.obs_date", *ALL))
def q12(spark, sf):
    return quality.flagged(faulty(spark, sf)).select("series_id", "obs_date", "value", "quality_flag")


@query("Q12_status", oracle("SELECT * FROM (VALUES ('PX', 'error'), ('SR', 'error'), ('NONE', 'error')) AS t(series_id, status)"))
def q12_status(spark, sf):
    return quality.status(quality.report(faulty(spark, sf), specs(spark)), specs(spark))


#: All findings of a table `t` in SQL, for series described by `d`.
REPORT = """report_{t} AS (WITH latest AS (SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY greatest(release_date, coalesce(revision_date, release_date)) DESC, value DESC) = 1),
  moved AS (SELECT *, value - before AS move, (value - before) / nullif(abs(before), 0) AS relative FROM (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY obs_date) AS before FROM latest)),
  spaced AS (SELECT *, date_diff('day', lag(obs_date) OVER (PARTITION BY series_id ORDER BY obs_date), obs_date) AS gap FROM (SELECT DISTINCT series_id, obs_date FROM {t})),
  jumped AS (SELECT series_id, obs_date FROM moved JOIN (SELECT series_id, min(value) < 0 AND max(value) > 0 AS crosses, list_sort(list(abs(value)))[CAST(floor(0.75 * count(*)) AS INT) + 1] AS scale FROM latest GROUP BY 1) USING (series_id) WHERE CASE WHEN crosses THEN abs(move) > 3 * scale ELSE abs(relative) > 2 END)
  SELECT series_id, 'empty' AS code, 'error' AS severity, CAST(0 AS BIGINT) AS n FROM {d} WHERE series_id NOT IN (SELECT series_id FROM {t})
  UNION ALL SELECT series_id, 'duplicate_timestamp', 'error', count(*) FROM (SELECT series_id FROM {t} GROUP BY series_id, obs_date, coalesce(revision_date, release_date) HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT series_id, 'revision_conflict', 'error', count(*) FROM (SELECT series_id FROM {t} GROUP BY series_id, obs_date, coalesce(revision_date, release_date) HAVING count(DISTINCT round(value, 10)) > 1) GROUP BY 1
  UNION ALL SELECT series_id, 'invalid_frequency', 'error', n FROM (SELECT series_id, quantile_cont(gap, 0.5) AS gap, count(*) AS n FROM spaced GROUP BY 1) JOIN {d} USING (series_id) WHERE n >= 3 AND (gap < 0.4 * CASE frequency WHEN 'daily' THEN 1 ELSE 7 END OR gap > 2.0 * CASE frequency WHEN 'daily' THEN 1 ELSE 7 END)
  UNION ALL SELECT series_id, 'missing_observations', 'warning', count(*) FROM spaced JOIN {d} USING (series_id) WHERE gap > 3 * CASE frequency WHEN 'daily' THEN 5 ELSE 10 END GROUP BY 1
  UNION ALL SELECT series_id, 'sparse_coverage', 'warning', present FROM (SELECT series_id, count(DISTINCT obs_date) AS present, CAST(date_diff('day', min(obs_date), max(obs_date)) AS DOUBLE) AS span FROM {t} GROUP BY 1) JOIN {d} USING (series_id) WHERE present < 0.8 * (CASE frequency WHEN 'daily' THEN span * 5 / 7 - span / 365 * 9 ELSE span / 7 END + 1)
  UNION ALL SELECT series_id, 'abnormal_jump', 'anomaly', count(*) FROM jumped GROUP BY 1
  UNION ALL SELECT series_id, 'outlier_move', 'warning', count(*) FROM (SELECT *, (relative - med) / nullif(1.4826 * mad, 0) AS z FROM (SELECT *, quantile_cont(abs(relative - med), 0.5) OVER (PARTITION BY series_id) AS mad FROM (SELECT *, quantile_cont(relative, 0.5) OVER (PARTITION BY series_id) AS med, count(*) OVER (PARTITION BY series_id) AS n FROM moved WHERE relative IS NOT NULL))) WHERE n >= 30 AND abs(z) > 12 AND abs(relative) <= 2 GROUP BY 1
  UNION ALL SELECT series_id, 'non_positive_value', 'warning', count(*) FROM {t} WHERE value <= 0 AND series_id IN (SELECT series_id FROM {d} WHERE unit IN ('index', 'usd', 'usd_billions', 'ratio')) GROUP BY 1
  UNION ALL SELECT series_id, 'release_date_inversion', 'warning', count(*) FROM (SELECT *, lag(first) OVER (PARTITION BY series_id ORDER BY obs_date) AS before FROM (SELECT series_id, obs_date, min(release_date) AS first FROM {t} GROUP BY 1, 2)) WHERE first < before GROUP BY 1)"""


def reported(table: str, specs: str) -> tuple[str, str]:
    name, _, body = REPORT.format(t=table, d=specs).partition(" AS ")
    return name, body.strip()[1:-1]


@query("Q00_report", oracle("SELECT * FROM report_faulty", FAULTY, SPECS, reported("faulty", "specs")))
def q00(spark, sf):
    return quality.report(faulty(spark, sf), specs(spark))


@query("Q00_report_obs", oracle("SELECT * FROM report_obs UNION ALL SELECT * FROM report_obs_invalid", reported("obs", "metadata"), reported("obs_invalid", "metadata")))
def q00_obs(spark, sf):
    return quality.report(obs(spark, sf), metadata(spark, sf)).unionByName(quality.report(obs_invalid(spark, sf), metadata(spark, sf)))


@query("Q03_Q04_null_revisions", oracle("""SELECT series_id, code, severity, n FROM report_obs_null_rev WHERE code IN ('duplicate_timestamp', 'revision_conflict')""", reported("obs_null_rev", "metadata")))
def q03_null(spark, sf):
    """Figures that were not revised are told apart by their release."""
    o = obs_null_rev(spark, sf)
    return quality.duplicates(o).unionByName(quality.conflicts(o))
