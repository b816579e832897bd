"""Readers of providers' payloads as files in a landing folder: text in, observation rows out. Bad records are left out as the rules say, never guessed.

Each reader takes a DataFrame with the payload's text in `body` (and what names it), so that the same rules serve files, tables and streams.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagelake.operators.pit import OBS_COLUMNS, synthesized_release

OBS_SCHEMA = "series_id string, obs_date date, release_date date, revision_date date, value double"


def observations(df: DataFrame, obs_date: Column, value: Column, release: Column, revision: Column | None = None) -> DataFrame:
    """The five columns; rows without a date or a finite value are left out."""
    out = df.select("series_id", obs_date.cast("date").alias("obs_date"), release.cast("date").alias("release_date"), (release if revision is None else revision).cast("date").alias("revision_date"), value.cast("double").alias("value"))
    return out.where("obs_date is not null and value is not null and not isnan(value) and abs(value) <> double('inf')")


def vintages(body: DataFrame) -> DataFrame:
    """JSON {observations: [{date, realtime_start, value}]} with all issues of each period: the first issue is the release, each issue a revision.

    "." and "" are no value; an issue is never before its period; an issue that repeats the value before it is left out.
    """
    kind = "observations array<struct<date:string, realtime_start:string, value:string>>"
    rows = body.select("series_id", F.explode(F.from_json("body", kind)["observations"]).alias("o")).select("series_id", F.to_date("o.date").alias("obs_date"), F.to_date("o.realtime_start").alias("start"), F.expr("try_cast(nullif(trim(o.value), '.') as double)").alias("value"))
    known = rows.where("value is not null").withColumn("issued", F.greatest("start", "obs_date")).select("series_id", "obs_date", "issued", "value").distinct()
    w = Window.partitionBy("series_id", "obs_date")
    before = F.lag("value").over(w.orderBy("issued", "value"))
    kept = known.withColumns({"release_date": F.min("issued").over(w), "before": before}).where("before is null or before <> value")
    return kept.select("series_id", "obs_date", "release_date", F.col("issued").alias("revision_date"), "value")


def vintage_windows(days: DataFrame, most: int = 2_000) -> DataFrame:
    """Requests that cover a series' vintage days: chunks of at most `most`, the first open to the left, the last to the right."""
    w = Window.partitionBy("series_id")
    rows = days.select("series_id", "day").distinct().withColumn("chunk", F.floor((F.row_number().over(w.orderBy("day")) - 1) / most).cast("int"))
    return rows.groupBy("series_id", "chunk").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("n"))


def truncated(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Series whose response is as long as the provider's cap, so that vintages may be missing and only current values can be trusted."""
    return rows.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") >= most)


def year_month(x: Column) -> Column:
    """The first of the month of a number like 1871.01 or 1871.1, where .1 is October; null for no month."""
    month = F.bround((x - F.floor(x)) * 100).cast("int")
    return F.when((month >= 1) & (month <= 12), F.make_date(F.floor(x).cast("int"), month, F.lit(1)))


def long_history(rows: DataFrame) -> DataFrame:
    """Columns by place (date, price, dividend) from a sheet; gives the price and the dividend yield, known 30 days after the month."""
    d = year_month(F.expr("try_cast(c0 as double)"))
    price, dividend = F.expr("try_cast(c1 as double)"), F.expr("try_cast(c2 as double)")
    df = rows.select(d.alias("obs_date"), price.alias("price"), dividend.alias("dividend")).where("obs_date is not null")
    long = df.select("obs_date", F.explode(F.array(F.struct(F.lit("NOMINAL_PRICE").alias("series_id"), F.col("price").alias("value")), F.struct(F.lit("DIVIDEND_YIELD").alias("series_id"), F.when(F.col("price") > 0, 100 * F.col("dividend") / F.col("price")).alias("value")))).alias("s"))
    return observations(long.select("s.series_id", "obs_date", "s.value"), F.col("obs_date"), F.col("value"), F.date_add(F.last_day("obs_date"), 30))


CSV_HEADER = "Date,Open,High,Low,Close"


def is_challenge(body: Column) -> Column:
    """Whether a response is a page for people instead of data."""
    head = F.lower(F.substring(F.ltrim(body), 1, 2048))
    return head.rlike(r"^<(!doctype|html)") | head.contains("<script") | head.contains("javascript")


def daily_csv(body: DataFrame) -> DataFrame:
    """CSV of daily bars with a known header; lines that do not parse are left out; a close is known on its day."""
    good = body.where(F.ltrim(F.col("body")).startswith(CSV_HEADER) & ~is_challenge(F.col("body")))
    lines = good.select("series_id", F.explode(F.split(F.trim("body"), r"\r?\n")).alias("line")).where(~F.col("line").startswith("Date,"))
    cells = lines.select("series_id", F.split("line", ",").alias("c")).where(F.size("c") >= 5)
    day = F.expr("try_cast(c[0] as date)")
    return observations(cells, day, F.expr("try_cast(c[4] as double)"), day)


def chart_json(body: DataFrame, coarse_gap: int = 4, at_least: int = 30) -> DataFrame:
    """JSON {timestamp: [...], close: [...], gmtoffset}: the exchange's own day of each close; null closes are left out.

    A series with bars more than coarse_gap days apart, by the median over at_least bars, is refused.
    """
    kind = "timestamp array<long>, close array<double>, gmtoffset long"
    p = F.from_json("body", kind)
    rows = body.select("series_id", p["gmtoffset"].alias("offset"), F.explode(F.arrays_zip(p["timestamp"].alias("t"), p["close"].alias("c"))).alias("z"))
    days = observations(rows, F.to_date(F.timestamp_seconds(F.col("z.t") + F.coalesce("offset", F.lit(0)))), F.col("z.c"), F.to_date(F.timestamp_seconds(F.col("z.t") + F.coalesce("offset", F.lit(0)))))
    w = Window.partitionBy("series_id")
    gap = days.withColumn("gap", F.datediff("obs_date", F.lag("obs_date").over(w.orderBy("obs_date")))).where("gap is not null")
    ranked = gap.withColumns({"i": F.row_number().over(w.orderBy("gap")) - 1, "n": F.count("*").over(w)})
    coarse = ranked.where((F.col("i") == F.floor(F.col("n") / 2)) & (F.col("gap") > coarse_gap) & (F.col("n") + 1 >= at_least))
    return days.join(coarse.select("series_id"), "series_id", "left_anti")


def fixing_json(body: DataFrame, at_least: int = 1_000) -> DataFrame:
    """JSON [{d, v: [usd, ...]}]: the first price where it is above 0, known a day later; a series with fewer rows than at_least is refused."""
    rows = body.select("series_id", F.explode(F.from_json("body", "array<struct<d:string, v:array<double>>>")).alias("r")).select("series_id", F.to_date("r.d").alias("d"), F.try_element_at("r.v", F.lit(1)).alias("v")).where("v > 0")
    enough = rows.groupBy("series_id").agg(F.count("*").alias("n")).where(F.col("n") >= at_least).select("series_id")
    return observations(rows.join(enough, "series_id", "left_semi"), F.col("d"), F.col("v"), F.date_add("d", 1))


def chain_json(body: DataFrame, positive: bool = True) -> DataFrame:
    """JSON {status, period, values: [{x, y}]}: UTC days, known a day later; other than ok and day is refused."""
    p = F.from_json("body", "status string, period string, values array<struct<x:long, y:double>>")
    rows = body.withColumn("p", p).where("p.status = 'ok' and p.period = 'day'").select("series_id", F.explode("p.values").alias("v")).select("series_id", F.to_date(F.timestamp_seconds("v.x")).alias("d"), F.col("v.y").alias("y"))
    return observations(rows.where("y > 0") if positive else rows, F.col("d"), F.col("y"), F.date_add("d", 1))


def period_codes(rows: DataFrame) -> DataFrame:
    """year, period (M01..M12 or Q01..Q04) and value as text: the period's first day; other periods are left out. Known 15 days after the month or quarter."""
    kind, n = F.substring("period", 1, 1), F.expr("try_cast(substring(period, 2, 2) as int)")
    month = F.when((kind == "M") & n.between(1, 12), n).when((kind == "Q") & n.between(1, 4), 3 * n - 2)
    df = rows.withColumns({"d": F.make_date(F.expr("try_cast(year as int)"), month, F.lit(1)), "frequency": F.when(kind == "M", "monthly").otherwise("quarterly")}).where("d is not null")
    return observations(df, F.col("d"), F.expr("try_cast(value as double)"), synthesized_release(F.col("d"), F.col("frequency"), 15))


def quarter_lines(rows: DataFrame, line: str) -> DataFrame:
    """line, period like 2024Q1 and value with thousands commas: rows of one line, known 60 days after the quarter."""
    q = F.expr("try_cast(substring(period, 6, 1) as int)")
    df = rows.where((F.col("line") == line) & F.col("period").rlike(r"^\d{4}Q[1-4]$")).withColumn("d", F.make_date(F.substring("period", 1, 4).cast("int"), 3 * q - 2, F.lit(1)))
    return observations(df, F.col("d"), F.expr("try_cast(replace(value, ',', '') as double)"), synthesized_release(F.col("d"), F.lit("quarterly"), 60))


def published(outputs: DataFrame) -> DataFrame:
    """Rows (asset, metric, as_of, written_at, value) of the own metric store as series ENGINE:<asset>.<metric>, known when written, not before their day, a day later where that is not known."""
    release = F.when(F.col("written_at").isNotNull(), F.greatest(F.to_date("written_at"), F.col("as_of"))).otherwise(F.date_add("as_of", 1))
    return observations(outputs.withColumn("series_id", F.concat(F.lit("ENGINE:"), "asset", F.lit("."), "metric")), F.col("as_of"), F.col("value"), release)


def engine_series(series_id: Column) -> tuple[Column, Column]:
    """Asset and metric of such a series' name; null for another name."""
    rest = F.when(series_id.startswith("ENGINE:"), F.substr(series_id, F.lit(8)))
    return F.substring_index(rest, ".", 1), F.when(F.instr(rest, ".") > 0, F.regexp_replace(rest, r"^[^.]*\.", ""))


STEPS = {"daily": "interval 1 day", "weekly": "interval 7 days", "monthly": "interval 1 month", "quarterly": "interval 3 months"}


def mock(spark: SparkSession, series_id: str, first: date | str, last: date | str, frequency: str, level: float, amplitude: float) -> DataFrame:
    """A made-up series: a wave on a slow rise."""
    days = spark.range(1).select(F.posexplode(F.expr(f"sequence(date'{first}', date'{last}', {STEPS[frequency]})")).alias("i", "d"))
    return observations(days.withColumn("series_id", F.lit(series_id)), F.col("d"), level + amplitude * F.sin(F.col("i") / 12.0) + 0.05 * F.col("i"), F.col("d"))


def mock_of(df: DataFrame, key: str, day: str, frequency: str, level: Column, amplitude: Column) -> DataFrame:
    """`mock` for each key of a table, over the span of its days; level and amplitude are aggregates of its rows."""
    ends = df.groupBy(key).agg(F.min(day).alias("_a"), F.max(day).alias("_b"), level.alias("_level"), amplitude.alias("_amplitude"))
    days = ends.select(F.col(key).alias("series_id"), "_level", "_amplitude", F.posexplode(F.expr(f"sequence(_a, _b, {STEPS[frequency]})")).alias("i", "d"))
    return observations(days, F.col("d"), F.col("_level") + F.col("_amplitude") * F.sin(F.col("i") / 12.0) + 0.05 * F.col("i"), F.col("d"))


def snapshot_csv(spark: SparkSession, path: str) -> DataFrame:
    """Observations from CSV with a header; a missing revision date is the release date."""
    df = spark.read.csv(path, header=True, schema=OBS_SCHEMA)
    return df.withColumn("revision_date", F.coalesce("revision_date", "release_date")).select(*OBS_COLUMNS)


def load_many(readers: dict[str, object], wanted: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """One frame of all wanted (provider, series_id), and the ids whose reader failed. An unknown provider is an error; a failing series is skipped.

    Readers return lazy frames; only what fails while a plan is made is skipped.
    """
    if unknown := sorted({p for p, _ in wanted} - readers.keys()):
        raise KeyError(f"unknown providers: {unknown}")
    frames, failed = [], []
    for provider, series in dict.fromkeys(wanted):
        try:
            frames.append(readers[provider](series).select(*OBS_COLUMNS))
        except Exception:  # noqa: BLE001  one source must not stop the others
            failed.append(series)
    if not frames:
        raise ValueError("no series could be read")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out, failed
