"""Queries of the readers, the writers and the streams: payloads are made from the views, so that SQL can state the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagelake.operators import pit
from vintagelake.plans.fixtures import dayno, events_obs, monthly, obs, oracle, outputs, price, rates_short, table
from vintagelake.plans.registry import query
from vintagelake.sources import providers as src
from vintagelake.sources import sinks
from vintagelake.sources.shared import scratch
from vintagelake.streaming import incremental

N = "date_diff('day', DATE '1995-01-01', obs_date)"


def paged(rows):
    """A provider's responses: one for each series and year, so that no text grows with the length of a series."""
    return rows.groupBy("series_id", F.year("obs_date").alias("page"))


def issues(spark, sf):
    rows = obs(spark, sf).withColumn("value", F.when(dayno("obs_date") % 13 == 0, ".").otherwise(F.format_string("%.2f", "value")))
    item = F.struct(F.date_format("obs_date", "yyyy-MM-dd").alias("date"), F.date_format("revision_date", "yyyy-MM-dd").alias("realtime_start"), "value")
    return paged(rows).agg(F.to_json(F.struct(F.collect_list(item).alias("observations"))).alias("body")).drop("page")


ISSUED = ("issued", f"SELECT series_id, obs_date, greatest(obs_date, revision_date) AS issued, value FROM obs WHERE {N} % 13 <> 0")


@query("S01_S02_vintages", oracle("SELECT series_id, obs_date, release_date, issued AS revision_date, value FROM (SELECT *, min(issued) OVER (PARTITION BY series_id, obs_date) AS release_date, lag(value) OVER (PARTITION BY series_id, obs_date ORDER BY issued) AS before FROM issued) WHERE before IS NULL OR before <> value", ISSUED))
def s01(spark, sf):
    return src.vintages(issues(spark, sf))


@query("S03_vintage_windows", oracle("SELECT series_id, CAST(floor((rn - 1) / 100) AS INT) AS chunk, min(day) AS first, max(day) AS last, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS rn FROM (SELECT DISTINCT series_id, revision_date AS day FROM obs)) GROUP BY 1, 2"))
def s03(spark, sf):
    return src.vintage_windows(obs(spark, sf).select("series_id", F.col("revision_date").alias("day")), 100)


@query("S04_truncated", oracle("SELECT series_id, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) >= 800"))
def s04(spark, sf):
    return src.truncated(obs(spark, sf), 800)


@query("S05_long_history", oracle("SELECT series_id, obs_date, last_day(obs_date) + 30 AS release_date, round(value, 6) AS value FROM (SELECT date_trunc('month', obs_date)::DATE AS obs_date, value AS NOMINAL_PRICE, 100 * 2.5 / value AS DIVIDEND_YIELD FROM monthly WHERE series_id = 'A' AND value > 0) UNPIVOT (value FOR series_id IN (NOMINAL_PRICE, DIVIDEND_YIELD))"))
def s05(spark, sf):
    m = monthly(spark, sf).where("series_id = 'A'")
    number = F.format_string("%d.%s", F.year("obs_date"), F.regexp_replace(F.format_string("%02d", F.month("obs_date")), "0$", ""))
    rows = m.select(number.alias("c0"), F.col("value").cast("string").alias("c1"), F.lit("2.5").alias("c2"))
    notes = spark.createDataFrame([("A footnote", "", ""), ("1999.13", "1", "1")], "c0 string, c1 string, c2 string")
    return src.long_history(rows.union(notes)).select("series_id", "obs_date", "release_date", F.round("value", 6).alias("value"))


def bars(spark, sf):
    """The price as CSV texts, with lines that do not parse."""
    line = F.concat_ws(",", F.date_format("obs_date", "yyyy-MM-dd"), F.lit("1"), F.lit("1"), F.lit("1"), F.when(dayno("obs_date") % 17 == 0, "n/a").otherwise(F.col("value").cast("string")))
    return paged(price(spark, sf)).agg(F.concat(F.lit(f"{src.CSV_HEADER},Volume\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("body")).drop("page")


@query("S06_daily_csv", oracle(f"SELECT series_id, obs_date, obs_date AS release_date, value FROM price WHERE {N} % 17 <> 0"))
def s06(spark, sf):
    return src.daily_csv(bars(spark, sf)).select("series_id", "obs_date", "release_date", "value")


@query("S07_challenge", r"SELECT kind, challenge, count(*) AS n FROM (SELECT kind, regexp_matches(head, '^<(!doctype|html)') OR contains(head, '<script') OR contains(head, 'javascript') AS challenge FROM (SELECT kind, lower(substr(ltrim(body, ' '), 1, 2048)) AS head FROM (SELECT 'page' AS kind, html AS body FROM pages UNION ALL SELECT 'name', p_name FROM part UNION ALL SELECT 'note', 'please enable JavaScript ' || p_name FROM part))) GROUP BY 1, 2")
def s07(spark, sf):
    part = table(spark, sf, "part")
    bodies = table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("html").alias("body")).union(part.select(F.lit("name"), "p_name")).union(part.select(F.lit("note"), F.concat(F.lit("please enable JavaScript "), "p_name")))
    return bodies.select("kind", src.is_challenge(F.col("body")).alias("challenge")).groupBy("kind", "challenge").agg(F.count("*").alias("n"))


@query("S08_chart_json", oracle(f"SELECT obs_date, value FROM price WHERE {N} % 19 <> 0"))
def s08(spark, sf):
    item = F.struct((F.unix_date("obs_date") * 86_400 + 7_200).cast("long").alias("t"), F.when(dayno("obs_date") % 19 != 0, F.col("value")).alias("c"))
    rows = paged(price(spark, sf)).agg(F.collect_list(item).alias("z"))
    body = F.to_json(F.struct(F.col("z.t").alias("timestamp"), F.col("z.c").alias("close"), F.lit(-3_600).alias("gmtoffset")), {"ignoreNullFields": "false"})
    return src.chart_json(rows.select("series_id", body.alias("body"))).select("obs_date", "value")


@query("S09_fixing_json", oracle("SELECT obs_date, obs_date + 1 AS release_date, value - 8 AS value FROM price WHERE value - 8 > 0"))
def s09(spark, sf):
    item = F.struct(F.date_format("obs_date", "yyyy-MM-dd").alias("d"), F.array(F.col("value") - 8, F.lit(1.0)).alias("v"))
    body = paged(price(spark, sf)).agg(F.to_json(F.collect_list(item)).alias("body")).drop("page")
    return src.fixing_json(body, 20).select("obs_date", "release_date", "value")


@query("S10_chain_json", oracle("SELECT obs_date, obs_date + 1 AS release_date, value FROM price"))
def s10(spark, sf):
    item = F.struct((F.unix_date("obs_date") * 86_400).cast("long").alias("x"), F.col("value").alias("y"))
    good = paged(price(spark, sf)).agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.lit("day").alias("period"), F.collect_list(item).alias("values"))).alias("body")).drop("page")
    bad = good.select(F.lit("BAD").alias("series_id"), F.replace("body", F.lit('"ok"'), F.lit('"error"')).alias("body"))
    return src.chain_json(good.union(bad)).select("obs_date", "release_date", "value")


@query("S11_period_codes", oracle("SELECT date_trunc('month', obs_date)::DATE AS obs_date, last_day(obs_date) + 15 AS release_date, value FROM monthly WHERE series_id = 'A'"))
def s11(spark, sf):
    m = monthly(spark, sf).where("series_id = 'A'").select(F.lit("CPI").alias("series_id"), F.year("obs_date").cast("string").alias("year"), F.format_string("M%02d", F.month("obs_date")).alias("period"), F.col("value").cast("string").alias("value"))
    other = spark.createDataFrame([("CPI", "1996", "M13", "1"), ("CPI", "1996", "S01", "1"), ("CPI", "1996", "M01", "-")], m.schema)
    return src.period_codes(m.union(other)).select("obs_date", "release_date", "value")


@query("S12_quarter_lines", oracle("SELECT date_trunc('quarter', obs_date)::DATE AS obs_date, CAST(date_trunc('quarter', obs_date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + 60 AS release_date, 1000 + value AS value FROM monthly WHERE series_id = 'A' AND month(obs_date) % 3 = 0"))
def s12(spark, sf):
    m = monthly(spark, sf).where("series_id = 'A' and month(obs_date) % 3 = 0")
    rows = m.select(F.lit("GDP").alias("series_id"), F.lit("1").alias("line"), F.concat(F.year("obs_date").cast("string"), F.lit("Q"), F.quarter("obs_date").cast("string")).alias("period"), F.format_number(1000 + F.col("value"), 4).alias("value"))
    other = rows.withColumn("line", F.lit("2"))
    return src.quarter_lines(rows.union(other), "1").select("obs_date", "release_date", F.round("value", 4).alias("value"))


@query("S13_published", oracle(f"SELECT 'ENGINE:' || asset || '.' || metric AS series_id, as_of AS obs_date, CASE WHEN k % 5 = 0 THEN as_of + 1 ELSE greatest(as_of, as_of + CAST(k % 4 AS INT) - 1) END AS release_date, value FROM (SELECT *, date_diff('day', DATE '1995-01-01', as_of) AS k FROM outputs)"))
def s13(spark, sf):
    k = dayno("as_of")
    o = outputs(spark, sf).withColumn("written_at", F.when(k % 5 != 0, F.expr("date_add(as_of, cast(datediff(as_of, date'1995-01-01') % 4 as int) - 1)").cast("timestamp")))
    return src.published(o).select("series_id", "obs_date", "release_date", "value")


@query("S15_mock", oracle("SELECT series_id, CAST(d AS DATE) AS obs_date, round(level + amplitude * sin(i / 12.0::DOUBLE) + 0.05::DOUBLE * i, 5) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY d) - 1 AS i FROM (SELECT series_id, level, amplitude, unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS d FROM (SELECT series_id, date_trunc('month', min(obs_date)) AS a, date_trunc('month', max(obs_date)) AS b, round(min(value), 2) AS level, round(max(value) - min(value), 2) AS amplitude FROM monthly GROUP BY 1)))"))
def s15(spark, sf):
    """A made-up stand-in for each series of a table: its span, its least value as the level, its range as the amplitude."""
    firsts = monthly(spark, sf).withColumn("obs_date", F.trunc("obs_date", "MM"))
    made = src.mock_of(firsts, "series_id", "obs_date", "monthly", F.round(F.min("value"), 2), F.round(F.max("value") - F.min("value"), 2))
    return made.select("series_id", "obs_date", F.round("value", 5).alias("value"))


@query("S16_snapshot_csv", oracle("SELECT series_id, obs_date, release_date, coalesce(revision_date, release_date) AS revision_date, value FROM obs_null_rev"))
def s16(spark, sf):
    from vintagelake.plans.fixtures import obs_null_rev

    path = scratch(spark)
    obs_null_rev(spark, sf).write.csv(path, header=True)
    return src.snapshot_csv(spark, path)


@query("S17_load_many", oracle("SELECT series_id, count(*) AS n FROM (SELECT series_id FROM events_obs UNION ALL SELECT series_id FROM monthly WHERE series_id = 'A') GROUP BY 1"))
def s17(spark, sf):
    def broken(_):
        raise OSError("no such file")

    readers = {"events": lambda _: events_obs(spark, sf), "monthly": lambda s: monthly(spark, sf).where(F.col("series_id") == s), "broken": broken}
    out, failed = src.load_many(readers, [("events", "*"), ("monthly", "A"), ("broken", "B")])
    assert failed == ["B"]
    return out.groupBy("series_id").agg(F.count("*").alias("n"))


@query("S18_source_bounds", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'")
def s18(spark, sf):
    """The bounds stand on the stored column, so they reach the scan."""
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").where((d >= F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00"))) & (d < F.to_timestamp_ntz(F.lit("1996-02-01 00:00:00")))).select("o_orderkey", F.to_date(d).alias("day"))


@query("S20_bound_sql", "SELECT event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1")
def s20(spark, sf):
    return spark.sql("SELECT event_type, count(*) AS n FROM {events} WHERE value > :least GROUP BY event_type", args={"least": 50}, events=table(spark, sf, "events"))


NEW = ("fresh", f"SELECT series_id, obs_date, value + 1 AS value, 2 AS version FROM price WHERE {N} % 3 = 0 UNION ALL SELECT 'NEW', obs_date, value, 1 FROM price WHERE {N} % 50 = 0")


@query("K01_upsert", oracle("SELECT series_id, obs_date, value, version FROM (SELECT *, 1 AS new FROM fresh UNION ALL SELECT series_id, obs_date, value, 1, 0 FROM price) QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY version DESC, new DESC) = 1", NEW))
def k01(spark, sf):
    p = price(spark, sf)
    n = dayno("obs_date")
    fresh = p.where(n % 3 == 0).select("series_id", "obs_date", (F.col("value") + 1).alias("value"), F.lit(2).alias("version")).union(p.where(n % 50 == 0).select(F.lit("NEW"), "obs_date", "value", F.lit(1)))
    folder = scratch(spark)
    sinks.upsert(spark, folder, p.withColumn("version", F.lit(1)), ["series_id", "obs_date"], "version")
    sinks.upsert(spark, folder, fresh, ["series_id", "obs_date"], "version")
    return sinks.upsert(spark, folder, fresh, ["series_id", "obs_date"], "version")


@query("K01_upsert_one_batch", oracle("SELECT series_id, obs_date, value, version FROM (SELECT series_id, obs_date, value, 1 AS version FROM price UNION ALL SELECT * FROM fresh) QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY version DESC) = 1", NEW))
def k01_one_batch(spark, sf):
    """Keys that repeat in the first batch are one row each."""
    p = price(spark, sf)
    n = dayno("obs_date")
    fresh = p.where(n % 3 == 0).select("series_id", "obs_date", (F.col("value") + 1).alias("value"), F.lit(2).alias("version")).union(p.where(n % 50 == 0).select(F.lit("NEW"), "obs_date", "value", F.lit(1)))
    return sinks.upsert(spark, scratch(spark), p.withColumn("version", F.lit(1)).union(fresh), ["series_id", "obs_date"], "version")


@query("K01_compacted", oracle("SELECT series_id, obs_date, value, version FROM (SELECT *, 1 AS new FROM fresh UNION ALL SELECT series_id, obs_date, value, 1, 0 FROM price) QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY version DESC, new DESC) = 1", NEW))
def k01_compacted(spark, sf):
    """The log's batches written as one give the same table."""
    p = price(spark, sf)
    n = dayno("obs_date")
    fresh = p.where(n % 3 == 0).select("series_id", "obs_date", (F.col("value") + 1).alias("value"), F.lit(2).alias("version")).union(p.where(n % 50 == 0).select(F.lit("NEW"), "obs_date", "value", F.lit(1)))
    folder, keys = scratch(spark), ["series_id", "obs_date"]
    sinks.upsert(spark, folder, p.withColumn("version", F.lit(1)), keys, "version")
    sinks.upsert(spark, folder, fresh, keys, "version")
    sinks.compacted(spark, folder, keys, "version")
    return sinks.current(spark, folder, keys, "version")


@query("K09_report", oracle("""SELECT 0 AS line_no, '| series_id | n | mean |' AS line UNION ALL SELECT 1, '| --- | --- | --- |'
  UNION ALL SELECT CAST(1 + row_number() OVER (ORDER BY series_id) AS INT), '| ' || series_id || ' | ' || n || ' | ' || format('{:.4f}', mean) || ' |' FROM (SELECT series_id, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / count(*), 4) AS mean FROM obs GROUP BY 1)"""))
def k09(spark, sf):
    means = obs(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("bigint")) / 100.0 / F.count("*"), 4).alias("mean"))
    return sinks.report_lines(means, ["series_id"])


@query("K02_validated", oracle("SELECT series_id, rule, count(*) AS n FROM (SELECT series_id, 'release_after_obs' AS rule FROM obs_invalid WHERE release_date < obs_date) GROUP BY 1, 2"))
def k02(spark, sf):
    from vintagelake.plans.fixtures import obs_invalid

    bad = sinks.validated(obs_invalid(spark, sf), "observations").where(F.size("broken") > 0)
    return bad.select("series_id", F.explode("broken").alias("rule")).groupBy("series_id", "rule").agg(F.count("*").alias("n"))


@query("K04_chunks", oracle("SELECT series_id, obs_date, CAST(floor((row_number() OVER (PARTITION BY series_id ORDER BY obs_date) - 1) / 250) AS INT) AS chunk FROM price"))
def k04(spark, sf):
    return sinks.chunks(price(spark, sf), ["series_id"], ["obs_date"], 250).select("series_id", "obs_date", "chunk")


@query("K05_tall_payload", oracle("SELECT obs_date, metric, value FROM (SELECT obs_date, value AS level, CASE WHEN value > 10 THEN value * 2 END AS twice FROM price) UNPIVOT (value FOR metric IN (level, twice))"))
def k05(spark, sf):
    from vintagelake.operators.reshape import tall

    p = price(spark, sf).select("obs_date", F.col("value").alias("level"), F.when(F.col("value") > 10, F.col("value") * 2).alias("twice"))
    return tall(p, ["obs_date"], ["level", "twice"])


@query("K06_latest_artifact", "SELECT p_brand AS name, max(p_type || '@' || p_size) AS latest FROM part GROUP BY 1")
def k06(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.concat_ws("@", "p_type", F.col("p_size").cast("string")).alias("version"), F.lit("2020-01-01").cast("date").alias("fit_date"), F.lit("{}").alias("body"))
    return sinks.latest_artifacts(rows).select("name", F.col("version").alias("latest"))


@query("K08_log", "SELECT 'orders' AS source, count(*) * 2 AS n FROM orders")
def k08(spark, sf):
    folder = scratch(spark)
    row = table(spark, sf, "orders").agg(F.lit("orders").alias("source"), F.count("*").alias("n"))
    sinks.append_log(row, folder)
    sinks.append_log(row, folder)
    return spark.read.parquet(folder).groupBy("source").agg(F.sum("n").alias("n"))


def event_stream(spark, sf):
    e = table(spark, sf, "events")
    return spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("at", F.col("ts").cast("timestamp"))


@query("X01_ingest", oracle("SELECT series_id, obs_date, release_date, revision_date, value FROM obs QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY revision_date DESC) = 1"))
def x01(spark, sf):
    landing, folder, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    o = obs(spark, sf)
    for late in (False, True):
        o.where((dayno("revision_date") % 2 == 0) == F.lit(late)).write.mode("append").parquet(landing)
        incremental.ingest(incremental.files(spark, landing, o.schema), folder, checkpoint, ["series_id", "obs_date"], "revision_date")
    return sinks.current(spark, folder, ["series_id", "obs_date"], "revision_date")


@query("X02_newest_figures", oracle("SELECT series_id, obs_date, knowable_at, value FROM pit_latest"))
def x02(spark, sf):
    from vintagelake.plans.fixtures import CUTOFF

    landing, folder, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    o = obs(spark, sf)
    for late in (True, False):
        o.where((dayno("obs_date") % 2 == 0) == F.lit(late)).write.mode("append").parquet(landing)
        incremental.newest_figures(incremental.files(spark, landing, o.schema), folder, checkpoint, CUTOFF)
    return sinks.current(spark, folder, ["series_id"], "place").select("series_id", "obs_date", "knowable_at", "value")


@query("X02_keyed_state", oracle("SELECT series_id, obs_date, greatest(release_date, coalesce(revision_date, release_date)) AS knowable_at, value, true AS monotone FROM obs QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY obs_date DESC, greatest(release_date, coalesce(revision_date, release_date)) DESC, value DESC) = 1"))
def x02_state(spark, sf):
    """Newest figures from keyed state: the later half of the periods first, then the earlier one and all of it again, each run from the checkpoint of the one before."""
    landing, folder, checkpoint = scratch(spark), scratch(spark), scratch(spark)
    o = obs(spark, sf)
    first = dayno("obs_date") % 2 == 0
    for rows in (o.where(first), o.where(~first), o):
        rows.write.mode("append").parquet(landing)
        with incremental.with_rocksdb(spark):
            incremental.run_available(incremental.newest_in_state(incremental.files(spark, landing, o.schema)), folder, checkpoint)
    sent = spark.read.parquet(folder)
    best = F.struct("obs_date", "knowable_at", "value")
    once = F.count("*") == F.count_distinct(best)  # no figure is sent twice, whatever is read again
    return sent.groupBy("series_id").agg(F.max(best).alias("_b"), once.alias("monotone")).select("series_id", "_b.*", "monotone")


def streamed(spark, df):
    folder = scratch(spark)
    incremental.run_available(df, folder, scratch(spark))
    return spark.read.schema(df.schema).parquet(folder)


#: A window is given out only when the watermark, the newest event less an hour, has passed its end.
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("X03_tumbling", f"SELECT s AS start, s + INTERVAL 6 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s FROM events) GROUP BY 1, 2, 3 HAVING s + INTERVAL 6 HOUR <= {CLOSED}")
def x03(spark, sf):
    out = streamed(spark, incremental.windowed(event_stream(spark, sf), "at", "event_type", "value", "6 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("X03_sliding", f"SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1, 2 HAVING s + INTERVAL 12 HOUR <= {CLOSED}")
def x03_sliding(spark, sf):
    out = streamed(spark, incremental.windowed(event_stream(spark, sf), "at", "event_type", "value", "12 hours", "6 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("X03_sessions", f"SELECT min(ts) AS start, max(ts) + INTERVAL 5 HOUR AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 5 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, k HAVING max(ts) + INTERVAL 5 HOUR <= {CLOSED}")
def x03_sessions(spark, sf):
    out = streamed(spark, incremental.sessions(event_stream(spark, sf), "at", "user_id", "5 hours"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("X04_without_replays", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def x04(spark, sf):
    twice = event_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    out = streamed(spark, incremental.without_replays(twice, "at", ["event_id"]).select("event_id", "at"))
    return out.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


@query("X05_late_revisions", oracle("SELECT count(*) AS n, count(DISTINCT (series_id, obs_date)) AS periods FROM obs"))
def x05(spark, sf):
    """Vintages that come late are all kept by a plain append."""
    landing = scratch(spark)
    o = obs(spark, sf)
    o.repartition(3, "series_id").write.parquet(landing)
    out = streamed(spark, incremental.files(spark, landing, o.schema, 1))
    return out.agg(F.count("*").alias("n"), F.count_distinct("series_id", "obs_date").alias("periods"))


@query("U08_replay", oracle("SELECT cutoff, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT c.cutoff, o.value FROM obs o JOIN (VALUES (DATE '1997-06-30'), (DATE '1998-06-30')) AS c(cutoff) ON greatest(release_date, coalesce(revision_date, release_date)) <= c.cutoff QUALIFY row_number() OVER (PARTITION BY c.cutoff, series_id, obs_date ORDER BY greatest(release_date, coalesce(revision_date, release_date)) DESC) = 1) GROUP BY 1"))
def u08(spark, sf):
    from vintagelake.plans.control import replay

    cutoffs = ["1997-06-30", "1998-06-30"]
    out = replay(obs(spark, sf), cutoffs, lambda view: view.paths())
    return out.groupBy(F.col("world").cast("date").alias("cutoff")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("U08_replay_equal", "SELECT CAST(0 AS BIGINT) AS differences")
def u08_equal(spark, sf):
    """What was seen at a cutoff is the same from a store that later figures have been added to."""
    from vintagelake.operators.joins import differences

    o = rates_short(spark, sf).select("series_id", "obs_date", F.col("obs_date").alias("release_date"), F.col("obs_date").alias("revision_date"), "value")
    then, now = (pit.pit_history(x, "1997-06-30") for x in (o.where("release_date <= date'1997-06-30'"), o))
    return differences(then, now, ["series_id", "obs_date"], ["value"]).agg(F.count("*").alias("differences"))


@query("K03_batches", "SELECT true AS small, count(*) AS n FROM orders")
def k03(spark, sf):
    folder = scratch(spark)
    sinks.batched(table(spark, sf, "orders"), folder, 900)
    files = spark.read.parquet(folder).groupBy(F.input_file_name()).agg(F.count("*").alias("k"))
    return files.agg((F.max("k") <= 900).alias("small"), F.sum("k").alias("n"))


@query("K07_simulation_archive", oracle("SELECT 'equity' AS asset, DATE '2020-01-31' AS as_of, 'v1' AS version, count(*) AS n, round(sum(value), 4) AS total FROM price"))
def k07(spark, sf):
    folder = scratch(spark)
    p = price(spark, sf).select("obs_date", "value")
    sinks.archive_paths(p, folder, "equity", "2020-01-31", "v1")
    kept = sinks.archive_paths(p.withColumn("value", F.col("value") * 2), folder, "equity", "2020-01-31", "v1")
    return sinks.archived(spark, folder).crossJoin(kept.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")))


@query("S14_derived", oracle("SELECT a.obs_date, greatest(a.release_date, b.release_date) AS release_date, round(a.value - b.value, 6) AS value FROM (SELECT * FROM monthly WHERE series_id = 'A') a ASOF JOIN (SELECT * FROM monthly WHERE series_id = 'N') b ON a.obs_date >= b.obs_date"))
def s14(spark, sf):
    from vintagelake.operators.factors import derived

    leg = {k: monthly(spark, sf).where(F.col("series_id") == k).withColumn("series_id", F.lit("X")) for k in "AN"}
    return derived("credit_quality_spread", {"high_yield": leg["A"], "investment_grade": leg["N"]}, ["series_id"]).select("obs_date", "release_date", F.round("value", 6).alias("value"))


@query("S19_stale_on_error", oracle("SELECT series_id, obs_date, value FROM price"))
def s19(spark, sf):
    """A first reading is staged; it is given again when a later reading fails."""
    folder = scratch(spark)

    def failing():
        raise OSError("source is down")

    sinks.staged(spark, folder, lambda: price(spark, sf), 0.0)
    return sinks.staged(spark, folder, failing, 0.0)
