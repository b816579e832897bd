"""Queries of the point-in-time core, the joins and the set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vintagelake.operators import joins, pit, reshape, windows
from vintagelake.plans.fixtures import CUTOFF, events_obs, lines, metadata, monthly, obs, obs_invalid, obs_null_rev, oracle, outputs, price, price_alt, price_late, table
from vintagelake.plans.registry import query

IDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SOME = ["1-URGENT", "3-MEDIUM"]
KNOWN = "greatest(release_date, coalesce(revision_date, release_date))"


@query("T01_rejects", oracle("SELECT series_id, count(*) AS n, min(obs_date) AS first_obs FROM obs_invalid WHERE release_date < obs_date GROUP BY 1"))
def t01(spark, sf):
    return pit.rejects(obs_invalid(spark, sf)).groupBy("series_id").agg(F.count("*").alias("n"), F.min("obs_date").alias("first_obs"))


@query("T02_knowable_at", oracle(f"SELECT series_id, obs_date, release_date, value, {KNOWN} AS knowable_at FROM obs_null_rev"))
def t02(spark, sf):
    return obs_null_rev(spark, sf).select("series_id", "obs_date", "release_date", "value", pit.knowable_at().alias("knowable_at"))


@query("T03_pit_join", oracle("SELECT series_id, obs_date, release_date, revision_date, value, knowable_at, staleness_days FROM pit_latest"))
def t03(spark, sf):
    return pit.pit_join(obs(spark, sf), CUTOFF)


@query("T04_pit_history", oracle("SELECT series_id, obs_date, release_date, revision_date, value, knowable_at FROM pit_hist"))
def t04(spark, sf):
    return pit.pit_history(obs(spark, sf), CUTOFF)


@query("T05_lookahead", oracle(f"SELECT series_id, count(*) AS n, min(obs_date) AS first_obs FROM obs WHERE {KNOWN} > DATE '{CUTOFF}' GROUP BY 1"))
def t05(spark, sf):
    return pit.lookahead(obs(spark, sf), CUTOFF).groupBy("series_id").agg(F.count("*").alias("n"), F.min("obs_date").alias("first_obs"))


FREQ = "CASE series_id WHEN '1-URGENT' THEN 'monthly' WHEN '2-HIGH' THEN 'quarterly' WHEN '3-MEDIUM' THEN 'weekly' ELSE 'daily' END"


@query("T06_release_synthesis", oracle(f"""SELECT DISTINCT series_id, obs_date, (CASE {FREQ} WHEN 'monthly' THEN last_day(obs_date) WHEN 'quarterly' THEN CAST(date_trunc('quarter', obs_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) WHEN 'weekly' THEN obs_date + 6 ELSE obs_date END) + 30 AS release_date FROM obs"""))
def t06(spark, sf):
    return obs(spark, sf).select("series_id", "obs_date", pit.synthesized_release(F.col("obs_date"), F.expr(FREQ), 30).alias("release_date")).distinct()


REPAIR = ("seeded_obs", "SELECT series_id, obs_date, greatest(release_date, DATE '1997-06-30') AS release_date, greatest(revision_date, DATE '1997-06-30') AS revision_date, value FROM obs")


@query("T07_repair_releases", oracle("""SELECT series_id, obs_date, fixed AS release_date, CASE WHEN revision_date <= release_date THEN fixed ELSE revision_date END AS revision_date, value FROM (SELECT *, CASE WHEN (n > 1 AND release_date = epoch AND obs_date < epoch) OR floor_date < release_date THEN least(obs_date + 10, floor_date) ELSE release_date END AS fixed FROM (
  SELECT *, count(*) FILTER (WHERE release_date = epoch) OVER (PARTITION BY series_id) AS n FROM (SELECT *, min(release_date) OVER (PARTITION BY series_id) AS epoch, min(release_date) OVER (PARTITION BY series_id ORDER BY obs_date DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS floor_date FROM seeded_obs)))""", REPAIR))
def t07(spark, sf):
    o = obs(spark, sf)
    seeded = o.withColumns({c: F.greatest(c, F.lit("1997-06-30").cast("date")) for c in ("release_date", "revision_date")})
    return pit.repair_pre_archive_releases(seeded, F.lit("daily"), 10).select(*pit.OBS_COLUMNS)


@query("T08_wide", oracle("SELECT obs_date, " + ", ".join(f"max(value) FILTER (WHERE series_id = '{i}') AS \"{i}\"" for i in [*SOME, "MISSING"]) + f" FROM pit_hist WHERE series_id IN ('{SOME[0]}', '{SOME[1]}') GROUP BY 1"))
def t08(spark, sf):
    wide = pit.PitView(obs(spark, sf), CUTOFF).wide([*SOME, "MISSING"])
    return wide.withColumn("MISSING", F.col("MISSING").cast("double"))


@query("T09_available", oracle("SELECT series_id, obs_date, release_date, revision_date, value, title, unit FROM pit_latest JOIN metadata USING (series_id)"))
def t09(spark, sf):
    return pit.available(obs(spark, sf), metadata(spark, sf), CUTOFF).select(*pit.OBS_COLUMNS, "title", "unit")


@query("T10_withheld", oracle(f"""SELECT series_id, obs_date, release_date, value, title, date_diff('day', DATE '{CUTOFF}', release_date) AS published_days_later FROM (SELECT * FROM obs WHERE release_date > DATE '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY obs_date, release_date, revision_date) = 1) JOIN metadata USING (series_id)"""))
def t10(spark, sf):
    return pit.withheld(obs(spark, sf), metadata(spark, sf), CUTOFF).select("series_id", "obs_date", "release_date", "value", "title", "published_days_later")


@query("T11_counts", oracle("SELECT series_id, coalesce(n, 0) AS n FROM metadata LEFT JOIN (SELECT series_id, count(value) AS n FROM pit_hist GROUP BY 1) USING (series_id)"))
def t11(spark, sf):
    return pit.observation_counts(obs(spark, sf), CUTOFF, metadata(spark, sf).select("series_id"))


@query("P01_in_filter", oracle(f"SELECT series_id, count(*) AS n FROM knowable WHERE series_id IN ('{SOME[0]}', '{SOME[1]}') GROUP BY 1"))
def p01(spark, sf):
    return pit.knowable(obs(spark, sf), CUTOFF, SOME).groupBy("series_id").agg(F.count("*").alias("n"))


@query("P02_range_filter", oracle("SELECT * FROM price WHERE obs_date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"))
def p02(spark, sf):
    return reshape.between(price(spark, sf), "obs_date", "1996-01-01", "1996-12-31")


@query("P03_positive", oracle("SELECT series_id, obs_date, value - 10 AS value FROM price WHERE value - 10 > 0"))
def p03(spark, sf):
    return reshape.positive(price(spark, sf).withColumn("value", F.col("value") - 10), "value")


@query("P04_complete_cases", oracle(f"SELECT obs_date, \"{SOME[0]}\", \"{SOME[1]}\" FROM (SELECT obs_date, " + ", ".join(f"max(value) FILTER (WHERE series_id = '{i}') AS \"{i}\"" for i in SOME) + f" FROM pit_hist GROUP BY 1) WHERE \"{SOME[0]}\" IS NOT NULL AND \"{SOME[1]}\" IS NOT NULL"))
def p04(spark, sf):
    return pit.PitView(obs(spark, sf), CUTOFF).wide(SOME).na.drop(how="any", subset=SOME)


@query("P06_history_cut", oracle("SELECT * FROM price WHERE obs_date >= (SELECT max(obs_date) FROM price) - 365"))
def p06(spark, sf):
    return reshape.trailing(price(spark, sf), "obs_date", 365)


@query("P08_warm_up", oracle("SELECT series_id, obs_date, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY obs_date) > 20 THEN value END AS value FROM price"))
def p08(spark, sf):
    w = windows.ordered(["series_id"], "obs_date")
    return price(spark, sf).withColumn("value", F.when(F.row_number().over(w) > 20, F.col("value")))


@query("P10_remap", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'equity' ELSE lower(o_orderpriority) END AS asset, count(*) AS n FROM orders GROUP BY 1")
def p10(spark, sf):
    asset = F.when(F.col("o_orderpriority") == "1-URGENT", "equity").otherwise(F.lower("o_orderpriority"))
    return table(spark, sf, "orders").groupBy(asset.alias("asset")).agg(F.count("*").alias("n"))


@query("J01_inner", oracle("SELECT k.series_id, obs_date, value, unit FROM knowable k JOIN metadata m ON k.series_id = m.series_id"))
def j01(spark, sf):
    return pit.knowable(obs(spark, sf), CUTOFF).join(metadata(spark, sf), "series_id").select("series_id", "obs_date", "value", "unit")


@query("J02_left", oracle("SELECT m.series_id, title, l.obs_date, l.value, coalesce(l.staleness_days, -1) AS staleness_days FROM metadata m LEFT JOIN pit_latest l ON m.series_id = l.series_id"))
def j02(spark, sf):
    latest = pit.pit_join(obs(spark, sf), CUTOFF).select("series_id", "obs_date", "value", "staleness_days")
    return metadata(spark, sf).join(latest, "series_id", "left").select("series_id", "title", "obs_date", "value", F.coalesce("staleness_days", F.lit(-1)).cast("bigint").alias("staleness_days"))


@query("J03_as_of", oracle("SELECT p.obs_date, p.value, m.obs_date AS as_of_month, m.value AS month_value FROM price p ASOF LEFT JOIN (SELECT * FROM monthly WHERE series_id = 'A') m ON p.obs_date >= m.obs_date"))
def j03(spark, sf):
    months = monthly(spark, sf).where("series_id = 'A'").select(F.lit("PX").alias("series_id"), F.col("obs_date").alias("month"), F.col("value").alias("month_value"))
    return joins.as_of_join(price(spark, sf), months, ["series_id"], "obs_date", "month", ["month_value"]).drop("series_id")


@query("J04_composed", oracle("""SELECT a.obs_date, greatest(a.release_date, b.release_date, c.release_date) AS release_date, round(100 / a.value - (b.value - c.value), 6) AS value FROM (SELECT * FROM monthly WHERE series_id = 'A') a
  ASOF JOIN (SELECT * FROM monthly WHERE series_id = 'N') b ON a.obs_date >= b.obs_date ASOF JOIN (SELECT * FROM monthly WHERE series_id = 'R') c ON a.obs_date >= c.obs_date"""))
def j04(spark, sf):
    leg = {k: monthly(spark, sf).where(F.col("series_id") == k).withColumn("series_id", F.lit("X")) for k in "ANR"}
    out = joins.composed(leg["A"], {"b": leg["N"], "c": leg["R"]}, ["series_id"], lambda a, b, c: F.round(100 / a - (b - c), 6))
    return out.select("obs_date", "release_date", "value")


@query("J05_full_outer", oracle("SELECT coalesce(a.obs_date, b.obs_date) AS obs_date, a.value AS a, b.value AS b FROM price_alt a FULL JOIN price_late b ON a.obs_date = b.obs_date"))
def j05(spark, sf):
    a, b = (f(spark, sf).select("obs_date", F.col("value").alias(n)) for n, f in (("a", price_alt), ("b", price_late)))
    return a.join(b, "obs_date", "full_outer")


@query("J06_inner_blocks", oracle("SELECT a.obs_date, a.value AS a, b.value AS b FROM price_alt a JOIN price_late b ON a.obs_date = b.obs_date"))
def j06(spark, sf):
    a, b = (f(spark, sf).select("obs_date", F.col("value").alias(n)) for n, f in (("a", price_alt), ("b", price_late)))
    return a.join(b, "obs_date")


@query("J07_left_ffill", oracle("SELECT * FROM (SELECT p.obs_date, p.value, last_value(m.value IGNORE NULLS) OVER (ORDER BY p.obs_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS factor FROM price p LEFT JOIN (SELECT * FROM monthly WHERE series_id = 'A') m ON p.obs_date = m.obs_date) WHERE factor IS NOT NULL"))
def j07(spark, sf):
    m = monthly(spark, sf).where("series_id = 'A'").select("obs_date", F.col("value").alias("factor"))
    w = windows.ordered(["series_id"], "obs_date")
    return price(spark, sf).join(m, "obs_date", "left").withColumn("factor", windows.ffill(F.col("factor"), w)).where("factor is not null").select("obs_date", "value", "factor")


@query("J09_precedence", oracle("SELECT coalesce(a.obs_date, b.obs_date) AS obs_date, coalesce(a.value, b.value) AS value, CASE WHEN a.value IS NOT NULL THEN 'late' ELSE 'alt' END AS source FROM price_late a FULL JOIN price_alt b ON a.obs_date = b.obs_date"))
def j09(spark, sf):
    return joins.precedence({"late": price_late(spark, sf), "alt": price_alt(spark, sf)}, "obs_date", "value")


@query("J10_prefix_splice", oracle("""SELECT obs_date, value, 'older' AS source FROM price_alt WHERE obs_date < (SELECT min(obs_date) FROM price_late) AND (SELECT count(*) >= 250 AND median(abs(a.value / b.value - 1)) <= 0.01 FROM price_alt a JOIN price_late b ON a.obs_date = b.obs_date)
  UNION ALL SELECT obs_date, value, 'base' FROM price_late"""))
def j10(spark, sf):
    return joins.prefix_splice(price_late(spark, sf), price_alt(spark, sf), 250, 0.01)


@query("J11_date_intersection", oracle("SELECT obs_date FROM price_alt INTERSECT SELECT obs_date FROM price_late"))
def j11(spark, sf):
    return price_alt(spark, sf).select("obs_date").intersect(price_late(spark, sf).select("obs_date"))


@query("J12_exact_or_fallback", oracle("SELECT p.obs_date, coalesce(m.value, 0.5::DOUBLE) AS rate, m.value IS NULL AS fell_back FROM price p LEFT JOIN (SELECT * FROM monthly WHERE series_id = 'A') m ON p.obs_date = m.obs_date"))
def j12(spark, sf):
    m = monthly(spark, sf).where("series_id = 'A'").select("obs_date", F.col("value").alias("m"))
    return price(spark, sf).join(m, "obs_date", "left").select("obs_date", F.coalesce("m", F.lit(0.5)).alias("rate"), F.col("m").isNull().alias("fell_back"))


@query("J13_nearest", oracle("SELECT obs_date, value FROM monthly WHERE series_id = 'A' ORDER BY abs(date_diff('day', DATE '1997-03-20', obs_date)), obs_date LIMIT 1"))
def j13(spark, sf):
    return joins.nearest(monthly(spark, sf).where("series_id = 'A'"), "obs_date", "1997-03-20").select("obs_date", "value")


@query("J14_dedupe_newest", oracle("SELECT asset, as_of, metric, value FROM outputs QUALIFY row_number() OVER (PARTITION BY asset, as_of ORDER BY metric DESC) = 1"))
def j14(spark, sf):
    return pit.newest(outputs(spark, sf), ["asset", "as_of"], F.desc("metric"))


@query("J15_anti", oracle("SELECT series_id FROM metadata WHERE series_id NOT IN (SELECT series_id FROM obs)"))
def j15(spark, sf):
    """obs keeps a line of every series that has lines, so these name its series; each once, as a join by a few names would meet in a few tasks."""
    return metadata(spark, sf).join(lines(spark, sf).select("series_id").distinct(), "series_id", "left_anti").select("series_id")


@query("J16_differences", oracle("""SELECT coalesce(a.obs_date, b.obs_date) AS obs_date, 'value' AS field, a.value AS "left", b.value AS "right" FROM price_alt a FULL JOIN price_late b ON a.obs_date = b.obs_date WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 1e-9"""))
def j16(spark, sf):
    return joins.differences(price_alt(spark, sf), price_late(spark, sf), ["obs_date"], ["value"])


@query("R01_union_all", oracle("SELECT series_id, count(*) AS n FROM (SELECT series_id FROM monthly UNION ALL SELECT series_id FROM events_obs) GROUP BY 1"))
def r01(spark, sf):
    return monthly(spark, sf).unionByName(events_obs(spark, sf)).groupBy("series_id").agg(F.count("*").alias("n"))


@query("R02_id_sets", oracle("SELECT series_id, 'union' AS op FROM (SELECT series_id FROM monthly UNION SELECT series_id FROM obs) UNION ALL SELECT series_id, 'difference' FROM (SELECT series_id FROM metadata EXCEPT SELECT series_id FROM obs)"))
def r02(spark, sf):
    ids = lambda df: df.select("series_id")
    both = ids(monthly(spark, sf)).union(ids(obs(spark, sf))).distinct().withColumn("op", F.lit("union"))
    return both.union(ids(metadata(spark, sf)).distinct().subtract(ids(obs(spark, sf))).withColumn("op", F.lit("difference")))


@query("R03_pivot", oracle("SELECT obs_date, " + ", ".join(f"max(value) FILTER (WHERE series_id = '{i}') AS \"{i}\"" for i in "ANR") + " FROM monthly GROUP BY 1"))
def r03(spark, sf):
    return monthly(spark, sf).groupBy("obs_date").pivot("series_id", ["A", "N", "R"]).agg(F.first("value"))


@query("R06_unpivot", oracle("SELECT obs_date, metric, value FROM (SELECT obs_date, value, value * 2 AS twice, CASE WHEN value > 50 THEN value END AS high FROM price) UNPIVOT (value FOR metric IN (value, twice, high))".replace("SELECT obs_date, value, value * 2", "SELECT obs_date, value AS \"level\", value * 2").replace("IN (value, twice", "IN (\"level\", twice")))
def r06(spark, sf):
    p = price(spark, sf).select("obs_date", F.col("value").alias("level"), (F.col("value") * 2).alias("twice"), F.when(F.col("value") > 50, F.col("value")).alias("high"))
    return reshape.tall(p, ["obs_date"], ["level", "twice", "high"])


@query("R07_month_end", oracle("""SELECT s.month, m.value FROM (SELECT CAST(unnest(generate_series(date_trunc('month', min(obs_date)), date_trunc('month', max(obs_date)), INTERVAL 1 MONTH)) AS DATE) AS first_day FROM (SELECT * FROM rates_short)) q, LATERAL (SELECT last_day(first_day) AS month) s
  LEFT JOIN (SELECT last_day(obs_date) AS month, max_by(value, obs_date) AS value FROM rates_short GROUP BY 1) m ON m.month = s.month"""))
def r07(spark, sf):
    from vintagelake.plans.fixtures import rates_short

    return reshape.month_end(rates_short(spark, sf), ["series_id"], "obs_date", "value").select("month", "value")


@query("R10_spine", oracle("SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 7 DAY)) AS DATE) AS day FROM (SELECT series_id, min(obs_date) AS a, max(obs_date) AS b FROM obs GROUP BY 1)"))
def r10(spark, sf):
    """Every seventh day from each series' first to its last period."""
    return reshape.spine_of(obs(spark, sf), ["series_id"], "obs_date", "interval 7 days")


@query("L01_newest", oracle("SELECT * FROM price ORDER BY obs_date DESC LIMIT 1"))
def l01(spark, sf):
    return price(spark, sf).orderBy(F.desc("obs_date")).limit(1)


@query("L02_window_limit", oracle("SELECT series_id, obs_date, value, count(*) OVER () AS available, count(*) OVER () > 500 AS truncated FROM price ORDER BY obs_date LIMIT 500"))
def l02(spark, sf):
    return reshape.limited(price(spark, sf), "obs_date", 500)


@query("L03_newest_n", oracle("SELECT * FROM (SELECT * FROM price ORDER BY obs_date DESC LIMIT 30) ORDER BY obs_date"))
def l03(spark, sf):
    return price(spark, sf).orderBy(F.desc("obs_date")).limit(30).orderBy("obs_date")


@query("L07_top_k", oracle("SELECT series_id, obs_date, value FROM monthly QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY abs(value) DESC, obs_date) <= 4"))
def l07(spark, sf):
    w = Window.partitionBy("series_id").orderBy(F.abs("value").desc(), "obs_date")
    return monthly(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("series_id", "obs_date", "value")


def thinned(source: str, n: int) -> str:
    """Rows of source (series_id, obs_date, value) that are kept of each series: stretch after stretch, the point of the largest triangle."""
    return f"""(WITH RECURSIVE numbered AS (SELECT series_id, obs_date, value AS y, date_diff('day', DATE '1970-01-01', obs_date)::DOUBLE AS x, row_number() OVER (PARTITION BY series_id ORDER BY obs_date) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS size FROM {source} WHERE value IS NOT NULL),
  edges AS (SELECT series_id, j, CAST(floor(j * (size - 2) / {n - 2}::DOUBLE) AS BIGINT) + 1 AS first FROM (SELECT series_id, any_value(size) AS size FROM numbered GROUP BY 1), range({n - 1}) AS r(j)),
  placed AS (SELECT p.*, e.j AS stretch FROM numbered p ASOF JOIN edges e ON p.series_id = e.series_id AND p.i >= e.first),
  means AS (SELECT series_id, stretch - 1 AS stretch, avg(x) AS cx, avg(y) AS cy FROM placed GROUP BY 1, 2),
  kept(series_id, stretch, obs_date, x, y) AS (SELECT series_id, CAST(-1 AS BIGINT), obs_date, x, y FROM numbered WHERE i = 0
    UNION ALL SELECT series_id, stretch, obs_date, x, y FROM (SELECT p.series_id, p.stretch, p.obs_date, p.x, p.y, row_number() OVER (PARTITION BY p.series_id ORDER BY abs((k.x - m.cx) * (p.y - k.y) - (k.x - p.x) * (m.cy - k.y)) DESC, p.i) AS rn FROM kept k JOIN placed p ON p.series_id = k.series_id AND p.stretch = k.stretch + 1 JOIN means m ON m.series_id = p.series_id AND m.stretch = p.stretch WHERE p.i < p.size - 1) WHERE rn = 1)
  SELECT n.series_id, n.obs_date, n.y AS value FROM numbered n LEFT JOIN kept k ON k.series_id = n.series_id AND k.obs_date = n.obs_date WHERE n.size <= {n} OR k.obs_date IS NOT NULL OR n.i = n.size - 1)"""


def thinned_with_extremes(source: str, n: int) -> str:
    ends = "SELECT series_id, {0}_by(obs_date, (value, {1}date_diff('day', DATE '1970-01-01', obs_date))) AS obs_date, {0}(value) AS value FROM {2} GROUP BY 1"
    return f"SELECT * FROM {thinned(source, n)} UNION {ends.format('min', '', source)} UNION {ends.format('max', '-', source)}"


@query("L05_lttb", oracle(f"SELECT * FROM {thinned('price', 200)}"))
def l05(spark, sf):
    from vintagelake.operators.decimate import lttb

    return lttb(price(spark, sf), "series_id", "obs_date", "value", 200)


@query("L06_lttb_extremes", oracle(thinned_with_extremes("price", 200)))
def l06(spark, sf):
    from vintagelake.operators.decimate import lttb_with_extremes

    return lttb_with_extremes(price(spark, sf), "series_id", "obs_date", "value", 200)
