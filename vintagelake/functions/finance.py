"""Column expressions of the engines: yields, loadings, gates, scores. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vintagelake.operators.aggregates import row_mean


def clip(x: Column, low: float, high: float) -> Column:
    """x cut to the range; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy(ps: list[Column]) -> Column:
    """-sum p ln p with a floor under each p."""
    safe = [F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p)) for p in ps]
    return -reduce(Column.__add__, (p * F.log(p) for p in safe))


def money_market_yield(discount: Column, days: int = 91, basis: int = 360) -> Column:
    """A bill's discount rate in percent as a yield on what is paid for it."""
    return discount / (1 - discount / 100 * (days / basis))


def ns_loadings(maturity: Column, lam: Column | float) -> tuple[Column, Column]:
    """Slope and curvature loadings of a Nelson-Siegel curve; the level's is 1. At maturity 0 they are 1 and 0."""
    x = maturity * lam
    slope = F.when(F.abs(x) < 1e-12, 1.0).otherwise((1 - F.exp(-x)) / x)
    return slope, slope - F.exp(-x)


def ns_yield(b0: Column, b1: Column, b2: Column, maturity: Column, lam: Column | float) -> Column:
    slope, curvature = ns_loadings(maturity, lam)
    return b0 + b1 * slope + b2 * curvature


def discount_factor(zero_rate: Column, years: Column) -> Column:
    """From a rate in percent, compounded continuously."""
    return F.exp(-zero_rate / 100 * years)


def implied_zero_rate(factor: Column, years: Column) -> Column:
    return -F.log(factor) / years * 100


def par_duration(y: Column, years: Column) -> Column:
    """Duration of a par bond that yields y (a share); the time itself for no yield, 0 for no time."""
    return F.when(years <= 0, 0.0).when(F.abs(y) < 1e-9, years).otherwise((1 - F.pow(1 + y, -years)) / y)


def curve_regime(spread: Column, was_inverted: Column, spread_change: Column, level_change: Column) -> Column:
    """The first that holds: inverted, re_steepening, flat, steep_tightening, steep_easing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(spread < 0, "inverted")
        .when(yes(was_inverted & (spread_change > 0.25)), "re_steepening")
        .when(F.abs(spread) < 0.5, "flat")
        .when(yes(level_change > 0), "steep_tightening")
        .otherwise("steep_easing")
    )


def liquidity_state(spread: Column, mean: Column, bill_change: Column, overnight_change: Column, rrp: Column, rrp_ratio: Column) -> Column:
    """stressed, tightening, abundant or normal, the first that holds; what is missing does not hold."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    moving = yes(bill_change <= -0.50) | yes(overnight_change >= 0.25)
    return (
        F.when(yes(spread <= -1.50) | (yes(mean <= -0.55) & moving), "stressed")
        .when(yes(mean <= -0.20) | (yes(rrp >= 100) & yes(rrp_ratio <= 0.75)), "tightening")
        .when(yes(rrp >= 250) & yes(rrp_ratio >= 0.90), "abundant")
        .otherwise("normal")
    )


def gold_posterior(violent: Column, stress_z: Column, rate_z: Column, usd_z: Column) -> dict[str, Column]:
    """hedge_bid, carry_headwind and crisis_bid: the violent state's share gated by stress, the rest by carry; missing drivers are neutral."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    stress = sigmoid(2.0 * (zero(stress_z) - 0.5))
    carry_gate = sigmoid(2.0 * (0.7 * zero(rate_z) + 0.3 * zero(usd_z) - 0.35))
    crisis = clip(violent * stress, 0, 1)
    carry = clip((1 - crisis) * carry_gate, 0, 1)
    hedge = F.when(crisis.isNotNull(), F.greatest(F.lit(0.0), 1 - crisis - carry))
    total = F.nullif(crisis + carry + hedge, F.lit(0.0))
    return {k: F.coalesce(v / total, F.lit(1 / 3)) for k, v in (("hedge_bid", hedge), ("carry_headwind", carry), ("crisis_bid", crisis))}


def crisis_premium(intensity: Column, stress_z: Column, reference: float = 6.0, weight: float = 0.5) -> Column:
    return clip(clip(intensity / reference, 0, 1) * (1 + weight * F.greatest(F.lit(0.0), F.coalesce(stress_z, F.lit(0.0)))), 0, 1)


def hedge_score(correlation: Column, support: Column) -> Column:
    """0 to 100 from the correlation on days when equities fall, and the regimes that support gold; without a correlation from these alone."""
    support = clip(F.coalesce(support, F.lit(0.5)), 0, 1)
    blend = 0.6 * clip((1 - correlation) / 2, 0, 1) + 0.4 * support
    return clip(100 * F.coalesce(blend, support), 0, 100)


def crypto_regime(drawdown: Column, year_return: Column, vol: Column, row: Column) -> Column:
    """winter, frenzy or normal, the first that holds; null until 400 rows are there and all inputs known."""
    known = drawdown.isNotNull() & year_return.isNotNull() & vol.isNotNull() & (row > 400)
    return F.when(known, F.when(drawdown <= -0.45, "winter").when((year_return >= 0.69) & (vol >= 60), "frenzy").otherwise("normal"))


def gpd_survival(x: Column, threshold: float, shape: float, scale: float) -> Column:
    """Probability that an excess goes beyond x, given that it is beyond the threshold."""
    excess = (x - threshold) / scale
    tail = F.exp(-excess) if abs(shape) < 1e-12 else F.pow(F.greatest(F.lit(0.0), 1 + shape * excess), -1 / shape)
    return F.when(x <= threshold, 1.0).otherwise(tail)


def gpd_quantile(years: Column, rate_per_year: Column | float, threshold: float, shape: Column | float, scale: Column | float) -> Column:
    """The level passed once in so many years."""
    n = years * rate_per_year
    return F.when(n <= 1, threshold).otherwise(threshold + (scale / shape) * (F.pow(n, shape) - 1))


def horizon_probability(rate: Column | float, observations: Column | float, survival: Column, multiplier: Column | float = 1.0) -> Column:
    """At least one event in so many observations, from a Poisson count."""
    expected = F.lit(rate) * F.lit(observations) * survival * F.greatest(F.lit(0.0), F.lit(multiplier))
    return 1 - F.exp(-F.greatest(F.lit(0.0), expected))


def hazard_multiplier(index: Column, low: float = 0.5, high: float = 2.0) -> Column:
    """Linear in the decile of an index from 0 to 100; 1 where it is missing."""
    decile = F.greatest(F.lit(0), F.least(F.lit(9), F.floor(index / 10))) / 9.0
    return F.coalesce(low + (high - low) * decile, F.lit(1.0))


def severity_at_frequency(x: Column, from_per_year: float, to_per_year: float) -> Column:
    return x * (from_per_year / to_per_year) ** 0.5


#: Zero and width of each term of the transmission score, and its floor.
FRAGILITY = {"credit_spread": (3.0, 7.0), "credit_velocity": (0.0, 2.0), "liquidity": (-0.5, 2.0), "curve_slope": (0.0, -1.5)}
FLOOR = 0.10


def transmission(inputs: dict[str, Column]) -> Column:
    """Mean of the terms there are, not below the floor; null without any."""
    terms = {k: clip((v - FRAGILITY[k][0]) / FRAGILITY[k][1], 0, 1) for k, v in inputs.items()}
    mean = row_mean(terms, dict.fromkeys(terms, 1.0))
    return F.when(mean.isNotNull(), F.greatest(F.lit(FLOOR), mean))


def lamp(z: Column) -> Column:
    """-1 unknown, 0 calm, 1 elevated from 2 deviations on, 2 extreme from 3 on."""
    return F.when(z.isNull() | F.isnan(z), -1).when(F.abs(z) >= 3, 2).when(F.abs(z) >= 2, 1).otherwise(0)
