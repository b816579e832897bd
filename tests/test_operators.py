"""Operators on small frames: nulls, ties, empty tables, causality; models on data whose answer is known."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vintagelake.functions import finance
from vintagelake.operators import decimate, equity, gold, joins, models, pit, quality, rates, regimes, reshape, windows
from vintagelake.sources import providers, sinks

OBS = "series_id string, obs_date date, release_date date, revision_date date, value double"
D = dt.date


def obs(spark, rows):
    return spark.createDataFrame(rows, OBS)


def test_pit_cutoff_is_inclusive_and_late_revisions_wait(spark):
    o = obs(spark, [("A", D(2020, 1, 1), D(2020, 2, 1), None, 1.0), ("A", D(2020, 1, 1), D(2020, 2, 1), D(2020, 5, 1), 2.0), ("B", D(2020, 1, 1), D(2020, 9, 1), D(2020, 9, 1), 9.0)])
    at = lambda day: {r.series_id: r.value for r in pit.pit_join(o, day).collect()}
    assert at("2020-01-31") == {} and at("2020-02-01") == {"A": 1.0} and at("2020-05-01") == {"A": 2.0} and at("2020-09-01") == {"A": 2.0, "B": 9.0}
    with pytest.raises(ValueError):
        pit.assert_no_lookahead(o, "2020-04-30")
    assert pit.PitView(o, "2020-12-31").value("NONE") is None


def test_require_valid(spark):
    with pytest.raises(ValueError):
        pit.require_valid(obs(spark, [("A", D(2020, 1, 2), D(2020, 1, 1), None, 1.0)]))


def test_cutoff_reaches_the_scan(spark, tmp_path):
    obs(spark, [("A", D(2020, 1, 1), D(2020, 2, 1), None, 1.0)]).write.parquet(str(tmp_path / "o"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = pit.pit_join(spark.read.parquet(str(tmp_path / "o")), "2020-06-30", ["A"])._jdf.queryExecution().toString()
    assert "LessThanOrEqual(release_date" in plan and "EqualTo(series_id" in plan


def test_as_of_join_keeps_probes_and_takes_equal_days(spark):
    probes = spark.createDataFrame([("A", D(2020, 1, 1), 1), ("A", D(2020, 1, 5), 2), ("A", D(2020, 1, 5), 3), ("B", D(2020, 1, 5), 4)], "k string, d date, i int")
    points = spark.createDataFrame([("A", D(2020, 1, 2), 10.0), ("A", D(2020, 1, 5), 20.0)], "k string, p date, v double")
    assert sorted((r.i, r.v) for r in joins.as_of_join(probes, points, ["k"], "d", "p", ["v"]).collect()) == [(1, None), (2, 20.0), (3, 20.0), (4, None)]
    assert joins.as_of_join(probes.limit(0), points, ["k"], "d", "p", ["v"]).count() == 0


@pytest.mark.parametrize("cut", [300, 500])
def test_windows_are_causal(spark, cut):
    """What a day's row says does not change when later days are added."""
    rng = np.random.default_rng(1)
    rows = [("A", D(2020, 1, 1) + dt.timedelta(days=i), float(x)) for i, x in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 600))))]

    def made(n):
        df = spark.createDataFrame(rows[:n], "series_id string, obs_date date, value double").withColumn("r", windows.log_return(F.col("value"), windows.ordered(["series_id"], "obs_date")))
        j = gold.jumps(df)
        d = equity.design(df, 252, baseline=126)
        return [{r.obs_date: r.asDict() for r in x.collect()} for x in (j, d, windows.expanding_midrank(df, "series_id", "obs_date", "value", "p"))]

    for short, long in zip(made(cut), made(600), strict=True):
        assert short and all(long[k] == v for k, v in short.items())


def test_lttb_keeps_ends_and_extremes(spark):
    rows = [("A", D(2000, 1, 1) + dt.timedelta(days=i), float(np.sin(i / 9)) - (50.0 if i == 333 else 0)) for i in range(1000)]
    df = spark.createDataFrame([*rows, ("A", D(2010, 1, 1), None)], "k string, d date, v double")
    out = decimate.lttb(df, "k", "d", "v", 40).collect()
    assert len(out) == 40 and {rows[0][1], rows[-1][1]} <= {r.d for r in out}
    both = {r.d for r in decimate.lttb_with_extremes(df, "k", "d", "v", 40).collect()}
    assert rows[333][1] in both
    assert decimate.lttb(df.limit(5), "k", "d", "v", 40).count() == 5


def test_month_end_gives_empty_months(spark):
    df = spark.createDataFrame([("A", D(2020, 1, 3), 1.0), ("A", D(2020, 1, 20), None), ("A", D(2020, 3, 5), 3.0)], "k string, d date, v double")
    assert sorted((r.month, r.v) for r in reshape.month_end(df, ["k"], "d", "v").collect()) == [(D(2020, 1, 31), 1.0), (D(2020, 2, 29), None), (D(2020, 3, 31), 3.0)]


def test_finance_expressions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(finance.ns_loadings(F.lit(0.0), 0.6)[0]) == 1.0
    assert value(finance.par_duration(F.lit(0.0), F.lit(7.0))) == 7.0 and value(finance.par_duration(F.lit(0.05), F.lit(0.0))) == 0.0
    assert value(finance.transmission({"credit_spread": F.lit(None).cast("double")})) is None
    assert value(finance.transmission({"credit_spread": F.lit(3.0)})) == 0.1
    assert value(finance.hedge_score(F.lit(None).cast("double"), F.lit(None).cast("double"))) == 50.0
    nothing = F.lit(None).cast("double")
    assert value(finance.liquidity_state(*[nothing] * 6)) == "normal"
    assert value(finance.gpd_survival(F.lit(0.05), 0.1, 0.3, 0.1)) == 1.0
    assert value(finance.lamp(nothing)) == -1


def test_curve_fit_recovers_factors(spark):
    rows = [(D(2020, 1, 1), m, 4.0 - 2.0 * (1 - np.exp(-0.5 * m)) / (0.5 * m) + 1.5 * ((1 - np.exp(-0.5 * m)) / (0.5 * m) - np.exp(-0.5 * m))) for m in (0.25, 1.0, 2.0, 5.0, 10.0, 30.0)]
    points = spark.createDataFrame([(d, float(m), float(y)) for d, m, y in rows] + [(D(2020, 1, 2), 1.0, 2.0)], "obs_date date, maturity double, yield double")
    got = rates.fit_curves(rates.curves(points), 0.5).collect()
    assert len(got) == 1 and (got[0].b0, got[0].b1, got[0].b2) == pytest.approx((4.0, -2.0, 1.5), abs=1e-8)
    assert rates.best_lambda(rates.curves(points)).first().lam == 0.5


def test_tail_fit_and_first_passage(spark):
    rng = np.random.default_rng(5)
    heavy, light = 0.08 / 0.3 * (rng.random(4000) ** -0.3 - 1), rng.exponential(0.05, 4000)
    rows = [("heavy", 0.1 + float(v)) for v in heavy] + [("light", 0.1 + float(v)) for v in light] + [("few", 0.2)]
    fits = {r.series_id: r for r in equity.tail(spark.createDataFrame(rows, "series_id string, depth double"), "depth", 0.1).collect()}
    assert fits["heavy"].shape == pytest.approx(0.3, abs=0.08) and fits["heavy"].scale == pytest.approx(0.08, rel=0.1)
    assert fits["light"].shape == pytest.approx(0, abs=0.05) and fits["light"].scale == pytest.approx(0.05, rel=0.1) and fits["few"].shape is None
    # No other shape and scale are likelier.
    like = lambda k, s: -len(heavy) * np.log(s) - (1 + 1 / k) * np.log1p(k * heavy / s).sum()
    k, scale = fits["heavy"].shape, fits["heavy"].scale
    assert all(like(k, scale) >= like(k * a, scale * b) for a in (0.98, 1, 1.02) for b in (0.98, 1, 1.02))
    p = models.first_passage(np.array([[0.9, 0.1], [0.5, 0.5]]), [1], 3)
    assert p[0] == pytest.approx(1 - 0.9**3)


def test_paths_do_not_depend_on_partitions(spark):
    args = ([0.1, -0.2], [0.1, 0.3], np.array([[0.9, 0.1], [0.2, 0.8]]), [0.5, 0.5], [0.5], 30, 7, {"rate": 0.5, "threshold": 0.1, "shape": 0.3, "scale": 0.1, "onset": 10, "recovery": 50})
    a = {r.path: r.terminal for r in models.simulate(spark, *args).collect()}
    b = {r.path: r.terminal for r in models.simulate(spark, *args).repartition(1).collect()}
    assert a == b and len(a) == 30


def test_contributions_add_up(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"obs_date": [D(2000, 1, 1) + dt.timedelta(days=i) for i in range(200)], "a": rng.normal(size=200), "b": rng.normal(size=200)})
    pdf["label"] = (pdf.a + 0.1 * pdf.b > 0.3).astype(int)
    rows = equity.contributions(spark.createDataFrame(pdf).withColumn("obs_date", F.to_date("obs_date")), ["a", "b"], "label", 4).collect()
    assert len(rows) == 200 and np.mean([abs(r.contributions["a"]) > abs(r.contributions["b"]) for r in rows]) > 0.85


def test_quality_on_an_empty_table(spark):
    specs = spark.createDataFrame([("A", "index", "daily")], "series_id string, unit string, frequency string")
    assert [tuple(r) for r in quality.report(obs(spark, []), specs).collect()] == [("A", "empty", "error", 0)]
    assert quality.status(quality.report(obs(spark, []), specs), specs).first().status == "error"


def test_artifacts_are_written_once(spark, tmp_path):
    store = sinks.ArtifactStore(spark, str(tmp_path / "a"))
    assert store.latest("m") is None
    a = store.put("m", "v1", "2020-01-31", {"x": 1})
    assert store.put("m", "v1", "2020-01-31", {"x": 1}) == a and store.rows().count() == 1
    with pytest.raises(ValueError):
        store.put("m", "v1", "2020-01-31", {"x": 2})
    store.put("m", "v1", "2020-02-29", {"x": 3})
    assert store.latest("m") == {"x": 3}


def test_markdown_and_batches(spark, tmp_path):
    assert sinks.markdown(spark.range(2).select("id", (F.col("id") / 3).alias("x"))).splitlines()[2:] == ["| 0 | 0 |", "| 1 | 0.3333 |"]
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(5), 4)
    sinks.batched(spark.range(2_000).coalesce(1), str(tmp_path / "b"), 900)
    assert len(list((tmp_path / "b").glob("*.parquet"))) == 3


def test_control_plane(spark):
    from vintagelake.plans import control

    with pytest.raises(KeyError):
        control.Settings.of({"seriez": []}, set())
    with pytest.raises(ValueError):
        control.SeriesSpec("A", "p", lag_days=-1)
    s = control.Settings.of({"series": [{"series_id": "A", "provider": "p"}], "roles": {"price": "A"}}, {"p"})
    assert s.series[0].frequency == "daily"

    class Bad(control.Engine):
        asset = "bad"

        def required_series(self):
            return []

        def outputs(self, view):
            raise RuntimeError("no state")

    settings = control.Settings.of({"series": [{"series_id": x, "provider": "p"} for x in "PQRST"], "engines": {"gold": True, "rates": True, "crypto": True, "money": False}, "inputs": {"gold": {"price": "P"}, "crypto": {"price": "P"}, "rates": dict(zip(["1Y", "2Y", "3Y", "5Y", "10Y"], "PQRST", strict=True))}, "options": {"rates": {"years": {"1Y": 1, "2Y": 2, "3Y": 3, "5Y": 5, "10Y": 10}, "parameters": {"lambda": 0.4}}}}, {"p"})
    made = control.enabled(settings)
    assert [e.asset for e in made] == ["gold", "rates", "crypto"] and made[0].required_series() == ["P"] and made[1].parameters == {"lambda": 0.4}
    assert [e.asset for e in control.enabled(settings, portfolio=True)] == ["gold", "rates"]
    for wrong in ({"engines": {"nobody": True}}, {"engines": {"gold": True}}):
        with pytest.raises(KeyError):
            control.enabled(control.Settings.of(wrong, set()))
    with pytest.raises(KeyError):
        control.Settings.of({"inputs": {"gold": {"price": "X"}}}, set())

    out, failed = control.run([Bad()], obs(spark, []), "2020-01-01")
    assert out is None and failed == {"bad": "no state"}
    assert control.artifact_faults({"model_version": "v", "fit_date": "d", "x": {"now": 1}}, "v", "e") == ["fit_date", "now"]


def test_readers_leave_bad_records_out(spark):
    body = spark.createDataFrame([("A", "not json"), ("B", None), ("C", '{"observations":[{"date":"2020-01-01","realtime_start":"2020-01-05","value":"."}]}')], "series_id string, body string")
    assert providers.vintages(body).count() == 0 and providers.chart_json(body).count() == 0 and providers.daily_csv(body).count() == 0 and providers.chain_json(body).count() == 0
    with pytest.raises(KeyError):
        providers.load_many({}, [("nobody", "X")])
    asset, metric = providers.engine_series(F.col("s"))
    rows = spark.createDataFrame([("ENGINE:gold.a.b",), ("OTHER:x",)], "s string").select(asset.alias("a"), metric.alias("m")).collect()
    assert [tuple(r) for r in rows] == [("gold", "a.b"), (None, None)]


def test_keyed_tables(spark, tmp_path):
    """First batches are merged too, ties go to the later batch, overlapping batches lose nothing, and faults of reading are no empty table."""
    folder, keys = str(tmp_path / "t"), ["k"]
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, version int")
    held = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert sinks.current(spark, folder, keys, "version") is None
    assert held(sinks.upsert(spark, folder, rows((1, "a", 1), (1, "b", 2), (2, "c", 1)), keys, "version")) == [(1, "b"), (2, "c")]
    assert held(sinks.upsert(spark, folder, rows((1, "x", 2), (2, "y", 0)), keys, "version")) == [(1, "x"), (2, "c")]
    # A writer that took the same number meanwhile.
    sinks.add_batch(spark, folder, rows((3, "z", 1)), keys, 2)
    assert held(sinks.current(spark, folder, keys, "version")) == [(1, "x"), (2, "c"), (3, "z")]
    assert sinks.compacted(spark, folder, keys, "version") == 3 and len(sinks.batches(spark, folder)) == 1
    assert held(sinks.current(spark, folder, keys, "version")) == [(1, "x"), (2, "c"), (3, "z")]
    assert held(sinks.upsert(spark, folder, rows().limit(0), keys, "version")) == [(1, "x"), (2, "c"), (3, "z")] and len(sinks.batches(spark, folder)) == 1
    found = sinks.current(spark, folder, keys, "version", only=rows((3, "", 0), (9, "", 0)).select("k"))
    assert held(found) == [(3, "z")] and "PartitionFilters: [_part" in found._jdf.queryExecution().toString()
    (tmp_path / "broken" / "_batch=b000000000001-0" / "_part=0").mkdir(parents=True)
    (tmp_path / "broken" / "_batch=b000000000001-0" / "_part=0" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="x.parquet"):
        sinks.upsert(spark, str(tmp_path / "broken"), rows((1, "a", 1)), keys, "version").collect()


def test_quality_counts_and_unrevised_figures(spark):
    """All gaps count, five are listed; figures without a revision are told apart by their release."""
    from vintagelake.operators import quality

    days = [f"2000-{m:02d}-01" for m in range(1, 13)]
    one = spark.createDataFrame([("A", d, d, None, 1.0) for d in days], "series_id string, obs_date string, release_date string, revision_date string, value double")
    o = one.select("series_id", *(F.to_date(c).alias(c) for c in ("obs_date", "release_date", "revision_date")), "value")
    specs = spark.createDataFrame([("A", "index", "daily")], "series_id string, unit string, frequency string")
    found = {r.code: r.n for r in quality.report(o, specs).collect()}
    assert found["missing_observations"] == 11 and quality.gaps(o, specs).count() == 5
    later = o.withColumn("release_date", F.date_add("release_date", 9)).withColumn("value", F.lit(2.0))
    assert quality.duplicates(o.union(later)).count() == quality.conflicts(o.union(later)).count() == 0
    assert quality.duplicates(o.union(o)).first().n == 12
    assert quality.stored_conflicts(o, o.withColumn("value", F.lit(3.0))).first().n == 12


def test_midranks_against_counting():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 64, 201):
        v = rng.integers(0, 12, n).astype(float)
        want = [0.5 if not i else ((v[:i] < x).sum() + (v[:i] <= x).sum()) / 2 / i for i, x in enumerate(v)]
        assert windows.midranks(v) == pytest.approx(np.array(want, float))
    assert windows.midranks(np.arange(200_000.0)[::-1])[-1] == 0


def test_refit_cutoffs_and_daily_failures(spark, tmp_path):
    """All days of a month have the month before's last day; a failing engine leaves the others' rows."""
    from vintagelake.plans import assets

    assert {assets.refit_cutoff(dt.date(2026, 8, d)) for d in range(1, 32)} == {dt.date(2026, 7, 31)}
    assert assets.refit_cutoff(dt.date(2024, 3, 10)) == dt.date(2024, 2, 29) and assets.refit_cutoff(dt.date(2026, 1, 1)) == dt.date(2025, 12, 31)

    class Bad(assets.GoldEngine):
        asset = "bad"

        def history(self, view):
            raise RuntimeError("no state")

    days = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(400)]
    o = obs(spark, [("PX", d, d, d, 100.0 + i % 7) for i, d in enumerate(days)])
    out, failed = assets.daily(spark, [Bad({"price": "PX"}), assets.CryptoEngine({"price": "PX"})], o, str(days[-1]), str(tmp_path / "out"))
    assert failed == {"bad": "no state"} and {r.asset for r in out.collect()} == {"crypto"}
    with pytest.raises(KeyError):
        assets.MoneyEngine({"bill": "B"})


def test_writers_that_overlap_and_compaction_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    folder, keys = str(tmp_path / "t"), ["k"]
    part = lambda i: spark.range(i * 1000, i * 1000 + 1500).select(F.col("id").alias("k"), F.lit(i).alias("v"), F.lit(i).alias("version"))
    sinks.upsert(spark, folder, part(0), keys, "version")
    with ThreadPoolExecutor(6) as pool:
        done = [pool.submit(sinks.add_batch, spark, folder, part(i), keys, 1) for i in range(1, 9)]
        done.insert(3, pool.submit(sinks.compacted, spark, folder, keys, "version"))
        for d in done:
            d.result()
    check = lambda: {r.v: r.n for r in sinks.current(spark, folder, keys, "version").groupBy("v").agg(F.count("*").alias("n")).collect()}
    want = {**dict.fromkeys(range(8), 1000), 8: 1500}
    assert check() == want
    sinks.compacted(spark, folder, keys, "version")
    assert check() == want and len(sinks.batches(spark, folder)) == 1


def test_keyed_state_sends_changes_once_and_tells_what_is_stale(spark, tmp_path):
    import time

    from vintagelake.streaming import incremental

    landing, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    schema = "series_id string, obs_date date, release_date date, revision_date date, value double"
    rows = lambda *r: spark.createDataFrame([(s, D(2020, 1, o), D(2020, 1, k), None, v) for s, o, k, v in r], schema)

    def run(df):
        df.coalesce(1).write.mode("append").parquet(landing)
        with incremental.with_rocksdb(spark):
            incremental.run_available(incremental.newest_in_state(incremental.files(spark, landing, schema), 2_000), out, checkpoint)
        return sorted((r.series_id, r.obs_date.day, r.knowable_at.day, r.value, r.stale) for r in spark.read.schema("series_id string, obs_date date, knowable_at date, value double, stale boolean").parquet(out).collect())

    assert run(rows(("A", 2, 3, 1.0), ("A", 1, 9, 5.0), ("B", 4, 5, 2.0), ("C", 1, 1, None))) == [("A", 2, 3, 1.0, False), ("B", 4, 5, 2.0, False)]
    first = run(rows(("A", 2, 3, 1.0), ("A", 2, 6, 1.5), ("A", 1, 20, 9.0)))
    assert [r for r in first if not r[4]] == [("A", 2, 3, 1.0, False), ("A", 2, 6, 1.5, False), ("B", 4, 5, 2.0, False)]
    time.sleep(2.5)
    last = run(rows(("Z", 1, 1, 0.0)))
    assert [r for r in last if r[4]] == [("A", 2, 6, 1.5, True), ("B", 4, 5, 2.0, True)]
    assert ("B", 4, 5, 2.0, False) in run(rows(("B", 4, 5, 2.0)))  # forgotten, so it is new again


def test_j15_sorts_no_window_and_joins_few_rows(spark):
    """The anti join meets each series once, and no vintage is ranked to name its series."""
    from vintagelake.plans.registry import queries

    plan = queries()["J15_anti"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.index("LeftAnti") < plan.rindex("Aggregate [series_id")


def test_a_report_reads_its_figures_once(spark):
    """All checks read the condensed table, of which each finds what it finds in the figures."""
    from vintagelake.plans.registry import queries

    files = queries()["Q00_report_obs"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any("orders" in f or "lineitem" in f for f in files)
    rows = [("A", dt.date(2020, 1, d), dt.date(2020, 1, d + lag), r, v) for d in range(1, 9) for lag, r, v in ((0, None, 1.0), (0, None, 1.0), (1, dt.date(2020, 1, d + 1), -1.0), (2, dt.date(2020, 1, d + 1), float(d % 3)))]
    o = spark.createDataFrame(rows, "series_id string, obs_date date, release_date date, revision_date date, value double")
    specs = spark.createDataFrame([("A", "index", "daily")], "series_id string, unit string, frequency string")
    once = quality.condensed(o)
    for check in (quality.duplicates, quality.conflicts, quality.release_inversions, quality.moves, lambda x: quality.non_positive(x, specs), lambda x: quality.coverage(x, specs)):
        a, b = check(o), check(once)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_observations_make_the_price_once(spark, monkeypatch):
    from vintagelake.plans import daily, fixtures

    made, price = [], fixtures.price

    def counted(*args):
        made.append(args)
        return price(*args)

    monkeypatch.setattr(fixtures, "price", counted)
    monkeypatch.setattr(daily, "price", counted)
    daily.observations(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_daily_fits_run_until_their_likelihood_stands_still(spark, monkeypatch):
    """F1 of FINDINGS_r04: gold's regression went two rounds and equity's variances were given."""
    from vintagelake.plans import assets, daily

    tables, keep = [], assets.stored

    def kept(df, name):
        out = keep(df, name)
        tables.append((name, out))
        return out

    monkeypatch.setattr(assets, "stored", kept)
    rng, n = np.random.default_rng(4), 1400
    days = [dt.date(2015, 1, 1) + dt.timedelta(i) for i in range(n)]
    prices = 100 * np.exp(np.cumsum(rng.normal(0, np.where(np.arange(n) // 200 % 2, 0.04, 0.01))))
    rows = [("PX", d, d, d, float(v)) for d, v in zip(days, prices, strict=True)] + [("STRESS", d, d, d, float(v)) for d, v in zip(days, rng.normal(0, 1, n), strict=True)]
    o = obs(spark, rows).localCheckpoint()
    gold, equity = (next(e for e in daily.engines() if e.asset == a) for a in ("gold", "equity"))
    gold = assets.GoldEngine({k: v for k, v in gold.series.items() if k in ("price", "stress")}, gold.parameters)
    posterior = lambda day: gold.violent(gold.with_drivers(pit.PitView(o, str(day)))).count()
    assert posterior(days[-1]) > 10
    logs = [df.first().loglik for name, df in tables if name.startswith("chain-") and "loglik" in df.columns]
    gains = np.diff(logs)
    assert len(logs) > 2 and all(gains[:-1] > 0.01) and gains[-1] <= 0.01

    tables.clear()
    equity.history(pit.PitView(o, str(days[-1])))
    assert [name for name, _ in tables].count("trend-best") == 2  # the coarse grid and the fine one

    assert posterior(days[500]) == 0  # too few months for a fit: rounds without end must end
    with pytest.raises(ValueError):
        regimes.fitted(o, o, ["series_id"], None, keep, rounds=None, gain=0.0)


def test_the_daily_run_leaves_out_no_day(spark, monkeypatch):
    """F1 of FINDINGS_r04: only the last 400 days were published."""
    from vintagelake.plans import assets, daily

    days = [dt.date(1996, 1, 1) + dt.timedelta(i) for i in range(912)]
    monkeypatch.setattr(daily, "observations", lambda spark, sf: obs(spark, [("PX", d, d, d, 100.0 + i % 7) for i, d in enumerate(days)]))
    monkeypatch.setattr(daily, "engines", lambda: [assets.CryptoEngine({"price": "PX"})])
    rows = daily.u02(spark, "").where("metric = 'price'")
    assert sorted(r.as_of for r in rows.collect()) == days
