"""The assets' engines over observations at a cutoff, the daily run, refits, and replays.

An engine turns what a view knows into one wide row for each world and day (`history`); outputs, newest state and replays are
made of that. A view of one cutoff is one world, a view of many cutoffs as many, and an engine plans the same for both: its
frames bear the world in series_id. All steps of a history look backwards only, and figures that come late are taken from the
day they were known, so a later cutoff leaves earlier days as they were.
"""

from __future__ import annotations

import copy
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vintagelake.functions import finance
from vintagelake.operators import crypto, equity, gold, joins, rates, regimes, reshape, trend, windows
from vintagelake.operators.pit import PitView, Worlds
from vintagelake.plans.control import Engine, artifact_faults, register
from vintagelake.sources import sinks
from vintagelake.sources.shared import stored

VERSION = "1"


def W():
    """Rows of a series in order of days. A function, as a window can only be made where a session is."""
    return windows.ordered(["series_id"], "obs_date")


class AssetEngine(Engine):
    """An engine with series by role and frozen parameters; `metrics` are the columns of its history that are published."""

    metrics: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    version = VERSION

    def __init__(self, series: dict[str, str], parameters: dict | None = None):
        if missing := set(self.roles) - series.keys():
            raise KeyError(f"{self.asset}: no series for {sorted(missing)}")
        self.series, self.parameters, self.artifacts = dict(series), dict(parameters or {}), None

    @classmethod
    def of(cls, inputs: dict[str, str], options: dict) -> AssetEngine:
        return cls(dict(inputs), **options)

    def required_series(self) -> list[str]:
        return sorted(set(self.series.values()))

    def role(self, view: PitView | Worlds, role: str) -> DataFrame:
        """(series_id, obs_date, value) of a role's series; series_id is the world."""
        return view.paths([self.series[role]]).select(F.col("world").alias("series_id"), "obs_date", "value")

    def known(self, view: PitView | Worlds, role: str, name: str) -> DataFrame:
        """(series_id, known_<name>, <name>): a role's newest figure by the day it was known, for as-of joins that look at nothing unpublished."""
        rows = view.paths([self.series[role]]).groupBy(F.col("world").alias("series_id"), F.col("known").alias(f"known_{name}"))
        best = rows.agg(F.max_by("value", "obs_date").alias(name), F.max("obs_date").alias("_period"))
        so_far = F.max("_period").over(Window.partitionBy("series_id").orderBy(f"known_{name}"))
        return best.withColumn("_so_far", so_far).where("_period = _so_far").drop("_period", "_so_far")  # late figures of earlier periods

    def history(self, view: PitView | Worlds) -> DataFrame:
        """series_id (the world), obs_date and `metrics`, one row for each day; `label` too where the engine names a regime."""
        raise NotImplementedError

    def told(self, view: PitView | Worlds, digits: int = 6) -> DataFrame:
        """(world, as_of, metric, value)."""
        return reshape.tall(self.history(view), ["series_id", "obs_date"], list(self.metrics), digits).withColumnsRenamed({"series_id": "world", "obs_date": "as_of"})

    def outputs(self, view: PitView) -> DataFrame:
        return self.told(view).drop("world")

    def regimes(self, view: PitView | Worlds) -> DataFrame | None:
        """(world, as_of, regime, probability): the label as sure, where the engine names one and has no posterior of its own."""
        rows = self.history(view)
        if "label" not in rows.columns:
            return None
        return rows.where("label is not null").select(F.col("series_id").alias("world"), F.col("obs_date").alias("as_of"), F.col("label").alias("regime"), F.lit(1.0).alias("probability"))

    def state(self, view: PitView) -> DataFrame:
        """asset, as_of, label and `metrics` of the newest day; no row where nothing is known."""
        rows = self.history(view)
        label = F.col("label") if "label" in rows.columns else F.lit(None).cast("string").alias("label")
        row = F.struct(label.alias("label"), *(F.col(m).cast("double").alias(m) for m in self.metrics))
        newest = rows.agg(F.max("obs_date").alias("as_of"), F.max_by(row, "obs_date").alias("row")).where("as_of is not null")
        return newest.select(F.lit(self.asset).alias("asset"), "as_of", "row.*")

    def fit(self, view: PitView) -> dict:
        """Parameters to be frozen, from what the view knows; none for an engine without any."""
        return {}

    def by_day(self, rows: DataFrame, defaults: dict[str, float]) -> DataFrame:
        """rows with a column for each parameter: what the artifact that stood on a row's day says, else this engine's own, else the default."""
        own = {k: float(self.parameters.get(k, v)) for k, v in defaults.items()}
        if self.artifacts is None:
            return rows.withColumns({k: F.lit(v) for k, v in own.items()})
        body = F.from_json("body", "parameters map<string,double>")
        versions = self.artifacts.where((F.col("name") == self.asset) & (F.col("version") == self.version)).select(F.col("fit_date").alias("_since"), *(body["parameters"][k].alias(f"_{k}") for k in own))
        held = joins.standing(rows, "obs_date", versions, "_since")
        return held.withColumns({k: F.coalesce(f"_{k}", F.lit(v)) for k, v in own.items()}).drop("_since", *(f"_{k}" for k in own))


#: Regimes in the order of their codes.
RATE_REGIMES = ["steep_easing", "steep_tightening", "flat", "inverted", "re_steepening"]
MONEY_REGIMES = ["abundant", "normal", "tightening", "stressed"]
GOLD_REGIMES = ["hedge_bid", "carry_headwind", "crisis_bid"]
CRYPTO_REGIMES = ["winter", "normal", "frenzy"]


def coded(label: Column, names: list[str]) -> Column:
    """The label's place in the list, from 0; null for none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), label) - 1, F.lit(-1)).cast("double")


def price_returns(df: DataFrame) -> DataFrame:
    return df.withColumn("r", windows.log_return(F.col("value"), W()))


@register
class RatesEngine(AssetEngine):
    """Curve factors and regimes. Roles are tenors; parameters: lambda, the frozen decay."""

    asset = "rates"
    metrics = ("ns_level", "ns_slope", "ns_curvature", "ns_rmse", "ns_lambda", "regime_code", "spread_10y_3m", "duration_years", "risk", "confidence")

    def __init__(self, series: dict[str, str], parameters: dict | None = None, years: dict[str, float] | None = None):
        super().__init__(series, parameters)
        self.years = {self.series[t]: float(y) for t, y in (years or {}).items() if t in self.series}
        if len(self.years) < rates.MIN_TENORS:
            raise KeyError("rates: too few tenors")

    def curves(self, view: PitView | Worlds) -> DataFrame:
        years = F.create_map(*(F.lit(x) for pair in self.years.items() for x in pair))
        points = view.paths(list(self.years)).select(F.element_at(years, F.col("series_id")).alias("maturity"), F.col("world").alias("series_id"), "obs_date", F.col("value").alias("yield"))
        return rates.curves(points, ["series_id", "obs_date"])

    def fit(self, view: PitView) -> dict:
        return {"lambda": rates.best_lambda(self.curves(view)).first().lam}

    def history(self, view: PitView) -> DataFrame:
        y = lambda m: finance.ns_yield(F.col("b0"), F.col("b1"), F.col("b2"), F.lit(float(m)), F.col("lambda"))
        curves = self.by_day(self.curves(view), {"lambda": rates.LAMBDA_DEFAULT})
        f = rates.fit_curves(curves, F.col("lambda")).withColumn("spread", y(10) - y(0.25))
        level_move = windows.change(F.col("b0"), W())
        f = f.withColumn("_vol", level_move)
        vol = F.coalesce(windows.rolling(F.stddev_pop, F.col("_vol"), W(), 252, 20) * 252**0.5, F.lit(0.9))
        duration = finance.par_duration(y(10) / 100, F.lit(10.0))
        seen = windows.seen_before(F.col("spread") < 0, ["series_id"], "obs_date", 365)
        named = finance.curve_regime(F.col("spread"), seen, windows.change(F.col("spread"), W(), 252), windows.change(F.col("b0"), W(), 252))
        return f.select(
            "series_id", "obs_date", F.col("rmse").alias("ns_rmse"), F.col("lambda").alias("ns_lambda"), coded(named, RATE_REGIMES).alias("regime_code"), named.alias("label"), F.col("b0").alias("ns_level"), (-F.col("b1")).alias("ns_slope"), F.col("b2").alias("ns_curvature"), F.col("spread").alias("spread_10y_3m"), duration.alias("duration_years"),
            finance.clip(100 * duration * vol / 12, 0, 100).alias("risk"), finance.clip((1 - F.col("rmse") / 0.35) * F.size("points") / len(self.years), 0, 1).alias("confidence"),
        )


@register
class MoneyEngine(AssetEngine):
    """The short rate, spliced from an overnight rate and a discount bill, what it has earned, what it discounts, and how tight money is.

    Optional roles: rrp, and the published curve's ns_level, ns_slope, ns_curvature and ns_lambda. A curve counts on its own day and
    if it was known by then; on other days the short rate stands for all horizons.
    """

    asset, roles = "money", ("overnight", "bill")
    metrics = ("wealth_index", "short_rate", "carry_1m", "carry_3m", "carry_12m", "discount_1y", "discount_3y", "discount_10y", "bill_sofr_spread", "liquidity_code")
    carries = {"carry_1m": 30, "carry_3m": 91, "carry_12m": 365}
    horizons = {"discount_1y": 1.0, "discount_3y": 3.0, "discount_10y": 10.0}
    curve = ("ns_level", "ns_slope", "ns_curvature", "ns_lambda")

    def published(self, view: PitView | Worlds) -> DataFrame:
        """(series_id, obs_date and the curve's four columns) of days whose whole curve was known that day."""
        by_id = {self.series[r]: r for r in self.curve}
        rows = view.paths(list(by_id)).where("known <= obs_date").select(F.col("world").alias("series_id"), "obs_date", *(F.when(F.col("series_id") == s, F.col("value")).alias(r) for s, r in by_id.items()))
        return rows.groupBy("series_id", "obs_date").agg(*(F.max(r).alias(r) for r in self.curve)).na.drop().where("ns_lambda > 0")

    def history(self, view: PitView | Worlds) -> DataFrame:
        keys = ["series_id", "obs_date"]
        overnight = self.role(view, "overnight")
        bill = self.role(view, "bill").withColumn("value", finance.money_market_yield(F.col("value")))
        path = rates.wealth(joins.precedence({"overnight": overnight, "bill": bill}, keys, "value"), ["series_id"])
        out = path.join(overnight.withColumnRenamed("value", "night"), keys, "left").join(bill.withColumnRenamed("value", "bill"), keys, "left")
        for name, span in self.carries.items():
            out = out.join(rates.realized_carry(path, ["series_id"], span).withColumnRenamed("carry", name), keys)
        if all(r in self.series for r in self.curve):
            out = out.join(self.published(view), keys, "left")
        else:
            out = out.withColumns({r: F.lit(None).cast("double") for r in self.curve})
        rrp = self.role(view, "rrp").withColumnRenamed("value", "rrp") if "rrp" in self.series else None
        out = out.withColumn("rrp", F.lit(None).cast("double")) if rrp is None else out.join(rrp, keys, "left")
        spread, r = F.col("bill") - F.col("night"), F.col("rrp")
        ratio = windows.rolling(F.avg, r, W(), 5, 4) / windows.rolling(F.avg, r, W(), 63, 50)
        out = out.withColumn("bill_sofr_spread", spread).withColumns({"_mean": windows.rolling(F.avg, F.col("bill_sofr_spread"), W(), 3), "_bill": windows.change(F.col("bill"), W(), 10), "_night": windows.change(F.col("night"), W(), 10), "_ratio": ratio})
        label = finance.liquidity_state(F.col("bill_sofr_spread"), F.col("_mean"), F.col("_bill"), F.col("_night"), r, F.col("_ratio"))
        zero = lambda h: F.col("value") if h <= 1 else F.coalesce(finance.ns_yield(F.col("ns_level"), -F.col("ns_slope"), F.col("ns_curvature"), F.lit(h), F.col("ns_lambda")), F.col("value"))
        factors = {n: finance.discount_factor(zero(h), F.lit(h)) for n, h in self.horizons.items()}
        return out.select(*keys, F.col("wealth").alias("wealth_index"), F.col("value").alias("short_rate"), *self.carries, *(c.alias(n) for n, c in factors.items()), "bill_sofr_spread", coded(label, MONEY_REGIMES).alias("liquidity_code"), label.alias("label"))


@register
class GoldEngine(AssetEngine):
    """The price, its jumps, its drivers as they were known, and the posterior of what bids for it.

    Optional roles: nominal, breakeven, cpi, dollar_broad, dollar_legacy, stress, equity; what lacks its role is null. Parameters: months,
    on which the switching regression is fitted (its posterior counts after them alone), and rounds at most (None: until its likelihood
    stands still); without months none is fitted.
    """

    asset, roles = "gold", ("price",)
    posteriors = tuple(f"regime_posterior_{r}" for r in GOLD_REGIMES)
    metrics = ("price", "hedge_score", "jump_statistic", "jump_intensity", "crisis_premium", "real_rate_10y", "real_rate_change_12m", "usd_trend", "stress_score", "regime_code", *posteriors, "risk", "confidence")

    def with_drivers(self, view: PitView | Worlds) -> DataFrame:
        df = price_returns(self.role(view, "price"))
        for name in ("nominal", "breakeven", "dollar_broad", "dollar_legacy", "stress", "equity"):
            if name in self.series:
                df = joins.as_of_join(df, self.known(view, name, name), ["series_id"], "obs_date", f"known_{name}", [name]).drop(f"as_of_known_{name}")
            else:
                df = df.withColumn(name, F.lit(None).cast("double"))
        if "cpi" not in self.series:
            return df.withColumn("yoy", F.lit(None).cast("double"))
        cpi = view.paths([self.series["cpi"]]).select(F.col("world").alias("series_id"), "obs_date", "known", "value")
        made = cpi.withColumn("yoy", (F.col("value") / F.lag("value", 12).over(W()) - 1) * 100).where("yoy is not null")
        newest = made.groupBy("series_id", F.col("known").alias("known_yoy")).agg(F.max_by("yoy", "obs_date").alias("yoy"))
        return joins.as_of_join(df, newest, ["series_id"], "obs_date", "known_yoy", ["yoy"]).drop("as_of_known_yoy")

    def violent(self, df: DataFrame) -> DataFrame | None:
        """(series_id, month, violent) of the months after those that the regression was fitted on; a month counts from its last day on."""
        months = int(self.parameters.get("months", 0))
        if not months:
            return None
        panel = gold.monthly_panel(df, ["stress"], 60)
        later = panel.withColumn("_n", F.row_number().over(W())).where(F.col("_n") > months).select("series_id", "obs_date")
        made = regimes.violent_probability(panel, ["z_stress"], stored, months, 2, self.parameters.get("rounds", 60))
        return made.join(later, ["series_id", "obs_date"]).withColumnRenamed("obs_date", "month")

    def history(self, view: PitView | Worlds) -> DataFrame:
        df = self.with_drivers(view)
        months = self.violent(df)
        df = df.withColumn("violent", F.lit(None).cast("double")) if months is None else joins.as_of_join(df, months, ["series_id"], "obs_date", "month", ["violent"]).drop("as_of_month")
        real = F.coalesce(F.col("nominal") - F.col("breakeven"), F.col("nominal") - F.col("yoy"))
        df = df.withColumns({"real_rate_10y": real, "usd_trend": gold.usd_trend(F.col("dollar_broad"), F.col("dollar_legacy"), W()), "stress_score": windows.expanding_z(F.col("stress"), W(), 60, True, 4.0)})
        z = lambda c: windows.expanding_z(F.col(c), W(), 60, True, 4.0)
        df = df.withColumns({"real_rate_change_12m": windows.change(F.col("real_rate_10y"), W(), 252), "_rate": z("real_rate_10y"), "_usd": z("usd_trend")})
        df = df.withColumns(finance.gold_posterior(F.col("violent"), F.col("stress_score"), F.col("_rate"), F.col("_usd")))
        df = gold.hedge(df.withColumn("_support", F.col("hedge_bid") + F.col("crisis_bid")), "r", "equity", "_support")
        j = gold.jumps(df).withColumn("vol", windows.rolling(F.stddev_samp, F.col("r"), W(), 252) * 252**0.5 * 100)
        state = gold.state(F.col("vol"), F.col("intensity"))
        top = F.greatest(*GOLD_REGIMES)
        label = F.when(F.col("violent").isNotNull(), reduce(lambda c, r: c.when(F.col(r) == top, r), GOLD_REGIMES[1:], F.when(F.col(GOLD_REGIMES[0]) == top, GOLD_REGIMES[0])))
        return j.select(
            "series_id", "obs_date", F.col("value").alias("price"), F.col("score").alias("hedge_score"), F.col("statistic").alias("jump_statistic"), F.col("intensity").alias("jump_intensity"), finance.crisis_premium(F.col("intensity"), F.col("stress_score")).alias("crisis_premium"),
            "real_rate_10y", "real_rate_change_12m", "usd_trend", "stress_score", coded(label, GOLD_REGIMES).alias("regime_code"), *(F.when(F.col("violent").isNotNull(), F.col(r)).alias(f"regime_posterior_{r}") for r in GOLD_REGIMES), state["risk"].alias("risk"), state["confidence"].alias("confidence"), label.alias("label"),
        )

    def regimes(self, view: PitView | Worlds) -> DataFrame:
        return posterior_rows(self.history(view), {r: f"regime_posterior_{r}" for r in GOLD_REGIMES})


@register
class CryptoEngine(AssetEngine):
    """The regime of the price path alone, the tie to liquidity, the supply; experimental.

    Optional roles: money and assets (liquidity, by months), volume. What lacks its role is null, as is the supply before the first block.
    """

    asset, roles, experimental = "crypto", ("price",), True
    metrics = ("price", "realized_vol", "drawdown", "return_12m", "jump_intensity", "liquidity_beta", "liquidity_beta_r2", "liquidity_residual", "issued_supply", "issuance_rate", "stock_to_flow", "tx_volume_usd", "tx_volume_trend", "regime_code")

    def tie(self, view: PitView | Worlds, price: DataFrame) -> DataFrame:
        """(series_id, month, beta, r2, residual), a month from its last day on; liquidity as known then."""
        month = reshape.month_end(price, ["series_id"], "obs_date", "value").withColumnRenamed("month", "obs_date").where("value is not null")
        for name in ("money", "assets"):
            month = joins.as_of_join(month, self.known(view, name, name), ["series_id"], "obs_date", f"known_{name}", [name]).drop(f"as_of_known_{name}")
        fit = crypto.liquidity_beta(month.withColumn("level", F.col("money") + 0.001 * F.col("assets")), 24)
        return fit.select("series_id", F.col("obs_date").alias("month"), "beta", "r2", "residual")

    def history(self, view: PitView | Worlds) -> DataFrame:
        keys, none = ["series_id", "obs_date"], F.lit(None).cast("double")
        r = price_returns(self.role(view, "price"))
        out = crypto.regime(r).join(gold.jumps(r, per_year=365).select(*keys, "intensity"), keys, "left")
        out = out.join(crypto.schedule(r.select(*keys)).select(*keys, "issued_supply", "issuance_rate", "stock_to_flow"), keys, "left")
        if {"money", "assets"} <= self.series.keys():
            out = joins.as_of_join(out, self.tie(view, r.select(*keys, "value")), ["series_id"], "obs_date", "month", ["beta", "r2", "residual"]).drop("as_of_month")
        else:
            out = out.withColumns(dict.fromkeys(("beta", "r2", "residual"), none))
        if "volume" in self.series:
            out = joins.as_of_join(out, self.known(view, "volume", "volume"), ["series_id"], "obs_date", "known_volume", ["volume"]).drop("as_of_known_volume")
        else:
            out = out.withColumn("volume", none)
        names = {"vol": "realized_vol", "year_return": "return_12m", "intensity": "jump_intensity", "beta": "liquidity_beta", "r2": "liquidity_beta_r2", "residual": "liquidity_residual", "volume": "tx_volume_usd"}
        out = out.withColumns({"tx_volume_trend": crypto.volume_trend(F.col("volume"), W()), "regime_code": coded(F.col("regime"), CRYPTO_REGIMES)})
        return out.withColumnsRenamed(names).withColumnsRenamed({"value": "price", "regime": "label"}).select(*keys, *self.metrics, "label")


@register
class EquityEngine(AssetEngine):
    """Kinematics of the filtered price, features of the regime model, and the instability of their path.

    Parameters: share and slope, the trend filter's frozen variances (`fit` finds them); without them a series' first 504 days are fitted.
    """

    asset, roles = "equity", ("price",)
    kinematic = ("price_close", "price_filtered", "velocity", "acceleration", "jerk_z", "jerk_lamp")
    metrics = (*kinematic, "trend_fast", "trend_slow", "vol_ratio", "drawdown_sigma", "rii")

    def fit(self, view: PitView) -> dict:
        best = trend.fitted(self.role(view, "price"), stored).first()
        return {"share": best.share, "slope": best.slope} if best else {}

    def history(self, view: PitView | Worlds) -> DataFrame:
        keys = ["series_id", "obs_date"]
        r = price_returns(self.role(view, "price"))
        parts = r.select("series_id", "obs_date", F.abs("r").alias("jerk"), windows.rolling(F.stddev_samp, F.col("r"), W(), 21).alias("vol_of_vol"))
        rii = equity.instability(parts.withColumnRenamed("series_id", "world"), ["jerk", "vol_of_vol"], keys=["world"]).select(F.col("world").alias("series_id"), "obs_date", "rii")
        frozen_ = (self.parameters["share"], self.parameters["slope"]) if "share" in self.parameters else None
        path = trend.filtered_trend(r, stored, frozen=frozen_)
        moved = equity.kinematics(r.join(path, keys), "slope", "r", 252, burn_in=504, baseline=300).select(*keys, F.exp("level").alias("price_filtered"), "velocity", "acceleration", "jerk_z", finance.lamp(F.col("jerk_z")).cast("double").alias("jerk_lamp"))
        out = r.select(*keys, F.col("value").alias("price_close")).join(moved, keys, "left").join(equity.design(r, 252, baseline=252).select(*keys, "trend_fast", "trend_slow", "vol_ratio", "drawdown_sigma"), keys, "left")
        return out.join(rii, keys, "left").select(*keys, *self.metrics)

    def features(self, view: PitView | Worlds) -> DataFrame:
        """(world, as_of, feature, value) of what the regime model is fitted on."""
        names = ["trend_fast", "trend_slow", "vol_ratio", "drawdown_sigma", "velocity", "acceleration", "jerk_z"]
        return reshape.tall(self.history(view), ["series_id", "obs_date"], names).withColumnsRenamed({"series_id": "world", "obs_date": "as_of", "metric": "feature"})


def posterior_rows(history: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(world, as_of, regime, probability) of a history's posterior columns, by the regime's name."""
    rows = history.select("series_id", "obs_date", *(F.col(c).alias(r) for r, c in columns.items()))
    return reshape.tall(rows, ["series_id", "obs_date"], list(columns)).withColumnsRenamed({"series_id": "world", "obs_date": "as_of", "metric": "regime", "value": "probability"})


def refit_cutoff(run_date: date) -> date:
    """The last day of the month before the run's: all runs of a month fit on the same figures."""
    return run_date.replace(day=1) - timedelta(days=1)


def refit(engine: AssetEngine, obs: DataFrame, run_date: date, store: sinks.ArtifactStore) -> dict:
    """Fits on what was known at the refit's cutoff and writes the parameters once; a second run of the month changes nothing."""
    fit_date = str(refit_cutoff(run_date))
    document = {"model_version": engine.version, "fit_date": fit_date, "parameters": engine.fit(PitView(obs, fit_date))}
    if faults := artifact_faults(document, engine.version, fit_date):
        raise ValueError(f"{engine.asset}: {faults}")
    store.put(engine.asset, engine.version, fit_date, document)
    return document


def frozen(engine: AssetEngine, store: sinks.ArtifactStore, as_of: str) -> AssetEngine:
    """The engine with its latest parameters that were fitted at or before as_of, for all days; the given engine stays as it is."""
    out, document = copy.copy(engine), store.latest(engine.asset, as_of)
    out.parameters = engine.parameters | (document["parameters"] if document else {})
    return out


def by_day(engine: AssetEngine, store: sinks.ArtifactStore) -> AssetEngine:
    """The engine with each day by the parameters that were fitted by then; the given engine stays as it is."""
    out = copy.copy(engine)
    out.artifacts = store.rows()
    return out


def daily(spark: SparkSession, engines: list[AssetEngine], obs: DataFrame, as_of: str, folder: str, history_days: int | None = 1825) -> tuple[DataFrame, dict[str, str]]:
    """Each engine's outputs of the last days (None: of all), checked and added to the table of outputs under folder; one engine's failure stops no other.

    Returns the table, one row for each asset, metric and day, and the engines that failed with the reason. The same day
    run again changes nothing; a later one replaces what it states anew.
    """
    frames, failed = [], {}
    for e in engines:
        try:
            rows = e.outputs(PitView(obs, as_of))
            if history_days is not None:
                rows = rows.where(F.col("as_of") > F.date_sub(F.lit(as_of).cast("date"), history_days))
            frames.append(rows.select(F.lit(e.asset).alias("asset"), "metric", "as_of", "value", F.lit(e.version).alias("model_version"), F.lit(as_of).cast("date").alias("run_as_of")))
        except Exception as error:  # noqa: BLE001  one engine must not stop the others
            failed[e.asset] = str(error)
    keys = ["asset", "metric", "as_of"]
    if not frames:
        return sinks.current(spark, folder, keys, "run_as_of"), failed
    rows = sinks.validated(reduce(DataFrame.unionByName, frames), "outputs").where(F.size("broken") == 0).drop("broken")
    return sinks.upsert(spark, folder, rows, keys, "run_as_of"), failed


def replayed(engine: AssetEngine, obs: DataFrame, cutoffs: list[str] | DataFrame, digits: int = 9) -> DataFrame:
    """(as_of, metric, low, high, n) of what the engine says of a day at different cutoffs: the smallest and the largest value. One plan for all cutoffs."""
    told = engine.told(Worlds(obs, cutoffs)).withColumn("value", F.round("value", digits))
    return told.groupBy("as_of", "metric").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n"))


def backfill(spark: SparkSession, engines: list[AssetEngine], obs: DataFrame, days: list[str] | DataFrame, folder: str) -> tuple[DataFrame, dict[str, str]]:
    """What each engine would have published on each of many days, as it was known then: the newest day's outputs of every world, in one plan an engine.

    Written as the daily run writes, so a span that is filled again changes nothing. One engine's failure stops no other.
    """
    frames, failed = [], {}
    for e in engines:
        try:
            told = e.told(Worlds(obs, days))
            newest = told.groupBy("world").agg(F.max("as_of").alias("as_of"))
            rows = told.join(newest, ["world", "as_of"])
            frames.append(rows.select(F.lit(e.asset).alias("asset"), "metric", "as_of", "value", F.lit(e.version).alias("model_version"), F.col("world").cast("date").alias("run_as_of")))
        except Exception as error:  # noqa: BLE001  one engine must not stop the others
            failed[e.asset] = str(error)
    keys = ["asset", "metric", "as_of", "run_as_of"]
    if not frames:
        return sinks.current(spark, folder, keys, "run_as_of"), failed
    rows = sinks.validated(reduce(DataFrame.unionByName, frames), "outputs").where(F.size("broken") == 0).drop("broken")
    return sinks.upsert(spark, folder, rows, keys, "run_as_of"), failed
