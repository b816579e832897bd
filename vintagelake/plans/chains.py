"""Queries of the models that run along a series: trend filter, regimes, switching regression. The SQL states them as plain recursions.

Fits go a round or two here, as each round is two recursions in SQL; Y10_Y12_Y31_walk_forward and G04_G05_switching run until
the likelihood stands still.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vintagelake.operators import differencing, equity, gold, models, regimes, scan, trend
from vintagelake.plans.fixtures import SQL as VIEWS
from vintagelake.plans.fixtures import price
from vintagelake.plans.markets import BASE, DESIGN, FEATURES, MOVE, REACH, design, drivers
from vintagelake.plans.registry import query
from vintagelake.plans.series import BY, EVER, RETURNS, over, returns, rnd
from vintagelake.sources.shared import stored


def recursive(body: str, *more: tuple[str, str]) -> str:
    """The body over all views and `more` ones, which are computed once."""
    return "WITH " + ",\n".join([*(f"{k} AS ({v})" for k, v in VIEWS.items()), *(f"{k} AS MATERIALIZED ({v})" for k, v in more)]) + "\n" + body


# --- trend


def trend_path(places: str, until: str) -> str:
    """Rows of the filter for each place: t, m1, m2 and the sums of the likelihood, as a plain recursion."""
    return f"""SELECT * FROM (WITH RECURSIVE k(share, slope, t, m1, m2, p11, p12, p22, s, l, n) AS (SELECT share, slope, 0::BIGINT, y, 0.0::DOUBLE, 1e6::DOUBLE, 0.0::DOUBLE, 1e6::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT FROM {places}, logp WHERE t = 1
  UNION ALL SELECT share, slope, t, pm1 + q11 / f * v, m2 + q12 / f * v, q11 - q11 * q11 / f, q12 - q11 * q12 / f, q22 - q12 * q12 / f, s + CASE WHEN t > 2 THEN v * v / f ELSE 0 END, l + CASE WHEN t > 2 THEN ln(f) ELSE 0 END, n + CASE WHEN t > 2 THEN 1 ELSE 0 END
  FROM (SELECT *, y - pm1 AS v, q11 + share AS f FROM (SELECT k.share, k.slope, p.t, p.y, m1 + m2 AS pm1, m2, p11 + 2 * p12 + p22 + 1 - share AS q11, p12 + p22 AS q12, p22 + power(10.0::DOUBLE, slope) AS q22, s, l, n FROM k JOIN logp p ON p.t = k.t + 1 WHERE p.t <= {until})))
  SELECT * FROM k)"""


LOGP = ("logp", "SELECT obs_date, ln(value) AS y, row_number() OVER (ORDER BY obs_date) AS t FROM price WHERE value > 0")
PLACES = ("places", "SELECT * FROM (VALUES " + ", ".join(f"({w!r}::DOUBLE)" for w in trend.SHARES) + ") a(share), (VALUES " + ", ".join(f"({s!r}::DOUBLE)" for s in trend.SLOPES) + ") b(slope)")
TOP = "SELECT share, slope FROM {} WHERE t = 504 ORDER BY round(-0.5::DOUBLE * (n * (ln(2 * pi() * s / n) + 1) + l), 6) DESC, share, slope LIMIT 1"
TREND = [
    LOGP, PLACES, ("coarse", trend_path("places", "504")), ("near", TOP.format("coarse")),
    ("around", f"SELECT DISTINCT greatest(0, least(1, round(share + i * {trend.FINE_SHARE}::DOUBLE, 4))) AS share, slope + j * {trend.FINE_SLOPE}::DOUBLE AS slope FROM near, range(-{trend.SIDE}, {trend.SIDE + 1}) a(i), range(-{trend.SIDE}, {trend.SIDE + 1}) b(j)"),
    ("fine", trend_path("around", "504")), ("chosen", TOP.format("fine")), ("whole", trend_path("chosen", "(SELECT max(t) FROM logp)")),
    ("filtered", "SELECT 'PX' AS series_id, obs_date, m1 AS level, m2 AS slope FROM whole JOIN logp USING (t) WHERE t > 0"),
]


def trended(spark, sf):
    return trend.filtered_trend(price(spark, sf), stored)


@query("Y03_kalman_trend", recursive("SELECT series_id, obs_date, round(level, 5) AS level, round(slope, 7) AS slope FROM filtered", *TREND))
def y03(spark, sf):
    """Filtered level and slope; the three variances are those of most likelihood over the first 504 days."""
    return trended(spark, sf).select("series_id", "obs_date", rnd("level", 5).alias("level"), rnd("slope", 7).alias("slope"))


@query("Y08_feature_pipeline", recursive(f"""SELECT series_id, obs_date, round(v, 5) AS velocity, round(a, 3) AS acceleration, CASE WHEN count(j) {EVER} >= 300 THEN round((j - avg(j) {EVER}) / nullif(stddev_samp(j) {EVER}, 0), 3) END AS jerk_z, CASE WHEN count(r) {over(21)} >= 21 THEN round(sum(r) {over(21)}, 6) END AS momentum_1m
  FROM (SELECT *, a - lag(a) OVER ({BY}) AS j FROM (SELECT *, 252 * (v - lag(v) OVER ({BY})) AS a FROM (SELECT series_id, obs_date, r, CASE WHEN row_number() OVER ({BY}) > 252 THEN slope * 252 END AS v FROM returns JOIN filtered USING (series_id, obs_date))))""", RETURNS, *TREND))
def y08(spark, sf):
    """Kinematics of the filtered slope."""
    both = returns(spark, sf).join(trended(spark, sf), ["series_id", "obs_date"])
    k = equity.kinematics(both, "slope", "r", 252, burn_in=252, baseline=300)
    return k.select("series_id", "obs_date", rnd("velocity", 5).alias("velocity"), rnd("acceleration", 3).alias("acceleration"), rnd("jerk_z", 3).alias("jerk_z"), rnd("momentum_1m").alias("momentum_1m"))


# --- chains in SQL: tables zc (c, t, z..., past), par (c, s, ...), mov (c, i, j, a), sta (c, s, p) of a round


def cols(name: str, k: int) -> str:
    return ", ".join(f"{name}{s}" for s in range(k))


def likelihood_sql(k: int, log: str, par: str) -> str:
    """(c, t, l0..): likelihoods over their largest. log: the log likelihood of a row of zc under a row p of par."""
    logs = f"SELECT z.c, z.t, {', '.join(f'max(CASE WHEN s = {s} THEN {log} END) AS g{s}' for s in range(k))} FROM zc z JOIN {par} p ON p.c = z.c GROUP BY z.c, z.t"
    top = f"greatest({cols('g', k)})"
    return f"SELECT c, t, {', '.join(f'exp(g{s} - {top}) AS l{s}' for s in range(k))} FROM ({logs})"


def moves_sql(k: int, mov: str) -> str:
    return f"SELECT c, {', '.join(f'max(CASE WHEN i = {i} AND j = {j} THEN a END) AS a{i}{j}' for i in range(k) for j in range(k))} FROM {mov} GROUP BY c"


def forward_sql(k: int, like: str, mov: str, sta: str) -> str:
    n = " + ".join(f"f{s}" for s in range(k))
    step = ", ".join(f"({' + '.join(f'f{i} * a{i}{j}' for i in range(k))}) * l{j} AS f{j}" for j in range(k))
    begin = ", ".join(f"max(CASE WHEN s = {s} THEN p END) * any_value(l{s}) AS f{s}" for s in range(k))
    norm = lambda inner: f"SELECT c, t, {', '.join(f'f{s} / ({n}) AS f{s}' for s in range(k))} FROM ({inner})"
    return f"""SELECT * FROM (WITH RECURSIVE w(c, t, {cols('f', k)}) AS ({norm(f'SELECT l.c, l.t, {begin} FROM {like} l JOIN {sta} s ON s.c = l.c WHERE l.t = 1 GROUP BY l.c, l.t')}
  UNION ALL {norm(f'SELECT w.c, l.t, {step} FROM w JOIN {like} l ON l.c = w.c AND l.t = w.t + 1 JOIN {mov} m ON m.c = w.c')}) SELECT * FROM w)"""


def backward_sql(k: int, like: str, mov: str) -> str:
    n = " + ".join(f"b{s}" for s in range(k))
    step = ", ".join(f"{' + '.join(f'a{i}{j} * l{j} * b{j}' for j in range(k))} AS b{i}" for i in range(k))
    return f"""SELECT * FROM (WITH RECURSIVE w(c, t, {cols('b', k)}) AS (SELECT c, max(t), {', '.join(['1.0::DOUBLE'] * k)} FROM zc WHERE past GROUP BY c
  UNION ALL SELECT c, t - 1, {', '.join(f'b{s} / ({n}) AS b{s}' for s in range(k))} FROM (SELECT w.c, w.t, {step} FROM w JOIN {like} l ON l.c = w.c AND l.t = w.t JOIN {mov} m ON m.c = w.c WHERE w.t > 1)) SELECT * FROM w)"""


def round_sql(k: int, i: int, log: str, move_prior: str, par: str) -> list[tuple[str, str]]:
    """The tables of round i + 1 from those of round i. par makes par from gamma (c, t, s, g) joined to zc, grouped by c and s."""
    fb = " + ".join(f"f{s} * b{s}" for s in range(k))
    pair = " + ".join(f"w.f{x} * a{x}{y} * l{y} * b{y}" for x in range(k) for y in range(k))
    pairs = ", ".join(f"{{'i': {x}, 'j': {y}, 'v': w.f{x} * a{x}{y} * l{y} * b{y} / ({pair})}}" for x in range(k) for y in range(k))
    gammas = ", ".join(f"{{'s': {s}, 'g': f{s} * b{s} / ({fb})}}" for s in range(k))
    return [
        (f"like{i}", likelihood_sql(k, log, f"par{i}")), (f"move{i}", moves_sql(k, f"mov{i}")), (f"fwd{i}", forward_sql(k, f"like{i}", f"move{i}", f"sta{i}")), (f"bwd{i}", backward_sql(k, f"like{i}", f"move{i}")),
        (f"gamma{i}", f"SELECT c, t, unnest([{gammas}], recursive := true) FROM fwd{i} JOIN bwd{i} USING (c, t)"),
        (f"xi{i}", f"SELECT c, i, j, sum(v) AS v FROM (SELECT w.c, unnest([{pairs}], recursive := true) FROM fwd{i} w JOIN like{i} l ON l.c = w.c AND l.t = w.t + 1 JOIN bwd{i} b ON b.c = w.c AND b.t = w.t + 1 JOIN move{i} m ON m.c = w.c) GROUP BY 1, 2, 3"),
        (f"mov{i + 1}", f"SELECT c, i, j, ({move_prior}) / sum({move_prior}) OVER (PARTITION BY c, i) AS a FROM xi{i}"), (f"sta{i + 1}", f"SELECT c, s, g AS p FROM gamma{i} WHERE t = 1"), (f"par{i + 1}", par.format(i=i)),
    ]


# --- regimes

TWO, STATES, STAY = ["trend_fast", "vol_ratio"], 3, 1000.0
HALF_YEARS = [f"{y}-{d}" for y in (1997, 1998, 1999, 2000) for d in ("06-30", "12-31")]
TWO_YEARS = ["1996-12-31", "1998-12-31", "2000-12-31"]


def cutoffs(spark, days: list[str]):
    """Days to fit at, each with the next as the last to filter to."""
    pairs = list(zip(days, [*days[1:], "2003-12-31"], strict=True))
    return spark.createDataFrame(pairs, "cutoff string, until string").select(F.to_date("cutoff").alias("cutoff"), F.to_date("until").alias("until"))


def regime_tables(days: list[str], rounds: int) -> list[tuple[str, str]]:
    k = STATES
    cuts = ", ".join(f"(DATE '{a}', DATE '{b}')" for a, b in zip(days, [*days[1:], "2003-12-31"], strict=True))
    log = "-0.5 * ((p.c22 * (z.z1 - p.m1) ** 2 - 2 * p.c12 * (z.z1 - p.m1) * (z.z2 - p.m2) + p.c11 * (z.z2 - p.m2) ** 2) / (p.c11 * p.c22 - p.c12 ** 2) + ln(p.c11 * p.c22 - p.c12 ** 2) + 2 * ln(2 * pi()))"
    sums = lambda w: f"sum({w}) AS w, sum({w} * z1) AS x1, sum({w} * z2) AS x2, sum({w} * z1 * z1) AS x11, sum({w} * z1 * z2) AS x12, sum({w} * z2 * z2) AS x22"
    moments = lambda inner: f"SELECT c, s, x1 / w AS m1, x2 / w AS m2, x11 / w - (x1 / w) ** 2 + 0.001::DOUBLE AS c11, x12 / w - x1 * x2 / w / w AS c12, x22 / w - (x2 / w) ** 2 + 0.001::DOUBLE AS c22 FROM (SELECT * REPLACE (w + 1e-9::DOUBLE AS w) FROM ({inner}))"
    shrunk = f"""SELECT e.c, e.s, {', '.join(f'coalesce(b.{x}, 0) + 10 * a.{x} / a.w AS {x}' for x in ('w', 'x1', 'x2', 'x11', 'x12', 'x22'))} FROM (SELECT DISTINCT c, s FROM zc, range({k}) r(s)) e
      JOIN (SELECT c, {sums('1')} FROM zc WHERE past GROUP BY c) a USING (c) LEFT JOIN (SELECT c, greatest(0, least({k - 1}, floor(z1 / 0.8::DOUBLE + {k / 2}::DOUBLE)))::INT AS s, {sums('1')} FROM zc WHERE past GROUP BY 1, 2) b ON b.c = e.c AND b.s = e.s"""
    out = [
        ("cuts", f"SELECT * FROM (VALUES {cuts}) AS v(c, until)"), ("days", f"SELECT obs_date, r, {TWO[0]} AS f1, {TWO[1]} AS f2 FROM design WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FEATURES)}"),
        ("units", "SELECT c, any_value(until) AS until, avg(f1) AS a1, avg(f2) AS a2, stddev_pop(f1) + 1e-9::DOUBLE AS s1, stddev_pop(f2) + 1e-9::DOUBLE AS s2 FROM cuts JOIN days ON obs_date <= c GROUP BY c HAVING count(*) >= 60"),
        ("zc", "SELECT c, obs_date, row_number() OVER (PARTITION BY c ORDER BY obs_date) AS t, (f1 - a1) / s1 AS z1, (f2 - a2) / s2 AS z2, coalesce(r, 0) AS r, obs_date <= c AS past FROM units JOIN days ON obs_date <= until"),
        ("par0", moments(shrunk)), ("mov0", f"SELECT c, i, j, CASE WHEN i = j THEN 0.98::DOUBLE ELSE {0.02 / (k - 1)!r}::DOUBLE END AS a FROM units, range({k}) x(i), range({k}) y(j)"), ("sta0", f"SELECT c, s, {1 / k!r}::DOUBLE AS p FROM units, range({k}) x(s)"),
    ]
    par = moments("SELECT c, s, " + sums("g") + " FROM gamma{i} JOIN zc USING (c, t) GROUP BY c, s")
    for i in range(rounds):
        out += round_sql(k, i, log, f"v + 1 + CASE WHEN i = j THEN {STAY} ELSE 0 END", par)
    i = rounds
    return [*out, (f"like{i}", likelihood_sql(k, log, f"par{i}")), (f"move{i}", moves_sql(k, f"mov{i}")), ("posterior", forward_sql(k, f"like{i}", f"move{i}", f"sta{i}"))]


REGIME = [RETURNS, DESIGN]


@query("Y12_forward_filter", recursive(f"SELECT c AS cutoff, obs_date, {', '.join(f'round(f{s}, 7) AS p{s}' for s in range(STATES))} FROM posterior JOIN zc USING (c, t) WHERE NOT past", *REGIME, *regime_tables(HALF_YEARS, 0)))
def y12(spark, sf):
    """Filtered posteriors under parameters frozen at each of eight cutoffs, up to the next one, all cutoffs in one plan."""
    return half_yearly(spark, sf).select("cutoff", "obs_date", *(rnd(F.col("p")[s], 7).alias(f"p{s}") for s in range(STATES)))


def half_yearly(spark, sf):
    chain, keys, days = regimes.Gaussian(STATES, 2, STAY), ["series_id", "cutoff"], cutoffs(spark, HALF_YEARS)
    d = design(spark, sf)
    first = regimes.first_gaussian(d, TWO, days, chain, 60).drop("until").join(F.broadcast(days), "cutoff")
    out = regimes.filtered(stored(scan.blocks(d, "obs_date", TWO), "blocks"), stored(first, "parameters"), keys, chain)
    return out.where("obs_date > cutoff")


@query("Y23_first_passage", recursive("SELECT c AS cutoff, obs_date, round(" + " + ".join(f"f{s} * (SELECT hit FROM reach WHERE s = {s})" for s in range(STATES)) + ", 6) AS p FROM posterior JOIN zc USING (c, t) WHERE NOT past", REACH, *REGIME, *regime_tables(HALF_YEARS, 0)))
def y23(spark, sf):
    """From each day's filtered posterior of the three benign states: the chance of an adverse one within 63 days."""
    reach = [float(x) for x in models.first_passage(MOVE, [3, 4], 63)[:STATES]]
    p = sum((F.col(f"q{s}") * r for s, r in enumerate(reach)), F.lit(0.0))
    return half_yearly(spark, sf).select("cutoff", "obs_date", *(F.col("p")[s].alias(f"q{s}") for s in range(STATES))).select("cutoff", "obs_date", rnd(p).alias("p"))


@query("Y10_em_rounds", recursive("SELECT c AS cutoff, s AS state, round(m1, 5) AS m1, round(m2, 5) AS m2, round(c11, 5) AS c11, round(c12, 5) AS c12, round(c22, 5) AS c22, round(p, 5) AS start, round(a, 6) AS stays FROM par2 JOIN sta2 USING (c, s) JOIN (SELECT c, i AS s, a FROM mov2 WHERE i = j) USING (c, s)", *REGIME, *regime_tables(TWO_YEARS, 2)))
def y10_rounds(spark, sf):
    """Parameters after two rounds of expectation and maximization at each cutoff."""
    chain, keys, k = regimes.Gaussian(STATES, 2, STAY), ["series_id", "cutoff"], STATES
    d = design(spark, sf)
    first = regimes.first_gaussian(d, TWO, cutoffs(spark, TWO_YEARS), chain, 60)
    fit = regimes.fitted(stored(scan.blocks(d, "obs_date", TWO), "blocks"), first, keys, chain, stored, rounds=2)
    at = k + k * k + 4
    value = lambda i: F.get("theta", (F.lit(i) if isinstance(i, int) else i))
    s = F.col("state")
    names = {"m1": at + 2 * s, "m2": at + 2 * s + 1, "c11": at + 2 * k + 4 * s, "c12": at + 2 * k + 4 * s + 1, "c22": at + 2 * k + 4 * s + 3}
    rows = fit.withColumn("state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return rows.select("cutoff", F.col("state").cast("bigint").alias("state"), *(rnd(value(i), 5).alias(n) for n, i in names.items()), rnd(value(s), 5).alias("start"), rnd(value(k + s * (k + 1)), 6).alias("stays"))


NAMES = ["bull", "neutral", "bear"]
ORDERED = ("ordered", f"SELECT c, s, row_number() OVER (PARTITION BY c ORDER BY -round(m, 12), c11 + c22, s) AS place FROM (SELECT c, s, sum(f * r) / greatest(sum(f), 1e-9) AS m FROM (SELECT c, t, unnest([{', '.join(f'{{s: {s}, f: f{s}}}' for s in range(STATES))}], recursive := true) FROM posterior) JOIN zc USING (c, t) WHERE past GROUP BY c, s) JOIN par1 USING (c, s)")


@query("Y31_walk_forward", recursive(f"""SELECT c AS cutoff, obs_date, CASE place {' '.join(f"WHEN {i + 1} THEN '{n}'" for i, n in enumerate(NAMES))} END AS label, round(f, 6) AS p, round(entropy, 6) AS entropy
  FROM (SELECT *, -sum(greatest(f, 1e-12) * ln(greatest(f, 1e-12))) OVER (PARTITION BY c, t) AS entropy FROM (SELECT c, t, unnest([{', '.join(f'{{s: {s}, f: f{s}}}' for s in range(STATES))}], recursive := true) FROM posterior)) JOIN ordered USING (c, s) JOIN zc USING (c, t) WHERE NOT past QUALIFY row_number() OVER (PARTITION BY c, t ORDER BY f DESC, place) = 1""", *REGIME, *regime_tables(TWO_YEARS, 1), ORDERED))
def y31(spark, sf):
    """Refits every two years over the whole record, named by return and calm, each filtering on to the next; a round each."""
    out = regimes.walk_forward(design(spark, sf), TWO, cutoffs(spark, TWO_YEARS), stored, NAMES, STAY, rounds=1, at_least=60)
    return out.select("cutoff", "obs_date", "label", rnd(F.array_max("p")).alias("p"), rnd("entropy").alias("entropy"))


@query("Y10_Y12_Y31_walk_forward")
def y10(spark, sf):
    """All five regimes and four features, each fit until its likelihood stands still."""
    return regimes.walk_forward(design(spark, sf), FEATURES, cutoffs(spark, TWO_YEARS[1:]), stored)


# --- switching regression

FIT_MONTHS, SWITCH = 30, 2
PANEL = ("panel", f"""SELECT month AS obs_date, 100 * ln(value / lag(value) OVER (ORDER BY month)) AS y, coalesce(z, 0) AS x FROM (SELECT last_day(obs_date) AS month, max_by(value, obs_date) AS value, max_by(z, obs_date) AS z FROM (SELECT obs_date, value, CASE WHEN count(stress) {EVER} >= 60 THEN greatest(-4, least(4, (stress - avg(stress) {EVER}) / nullif(stddev_samp(stress) {EVER}, 0))) END AS z FROM drivers) GROUP BY 1)
  QUALIFY lag(value) OVER (ORDER BY month) IS NOT NULL""")


def still_sql(gain: float = 0.01) -> str:
    """Parameters of each round i from par0's on, until the log likelihood l that a round began with is no more than `gain` above the one before. The months are lists, folded ahead and back."""
    k, months = range(SWITCH), "range(1, n + 1)"
    each = lambda f, sep=", ": sep.join(f(s) for s in k)
    pairs = lambda f, sep=", ": sep.join(f(i, j) for i in k for j in k)
    row = lambda f: "{" + each(f) + "}"
    total = lambda f: f"list_sum(list_transform({months}, lambda t: {f}))"
    top, ahead, behind = f"greatest({each(lambda s: f'e.o{s}')})", each(lambda s: f"w[-1].f{s}", " + "), each(lambda s: f"h[-1].b{s}", " + ")
    both, pair = each(lambda s: f"w[t].f{s} * h[t].b{s}", " + "), pairs(lambda i, j: f"w[t - 1].f{i} * m{i}{j} * q[t].l{j} * h[t].b{j}", " + ")
    steps = [
        f"list_transform({months}, lambda t: {row(lambda s: f"'o{s}': -0.5 * ((ys[t] - a{s} - b * xs[t]) ** 2 / v{s} + ln(2 * pi() * v{s}))")}) AS logs",
        f"list_transform(logs, lambda e: {{{each(lambda s: f"'l{s}': exp(e.o{s} - {top})")}, 'top': {top}}}) AS q",
        f"list_reduce(q[2:], lambda w, e: list_append(w, {row(lambda j: f"'f{j}': ({each(lambda i: f'w[-1].f{i} * m{i}{j}', ' + ')}) / ({ahead}) * e.l{j}")}), [{row(lambda s: f"'f{s}': p{s} * q[1].l{s}")}]) AS w",
        f"list_reverse(list_reduce(list_reverse(q[2:]), lambda h, e: list_append(h, {row(lambda i: f"'b{i}': ({each(lambda j: f'm{i}{j} * e.l{j} * h[-1].b{j}', ' + ')}) / ({behind})")}), [{row(lambda s: f"'b{s}': 1.0::DOUBLE")}])) AS h",
        f"list_transform({months}, lambda t: {row(lambda s: f"'g{s}': w[t].f{s} * h[t].b{s} / ({both})")}) AS g, list_transform(range(2, n + 1), lambda t: {{{pairs(lambda i, j: f"'x{i}{j}': w[t - 1].f{i} * m{i}{j} * q[t].l{j} * h[t].b{j} / ({pair})")}}}) AS x, {total(f'ln({each(lambda s: f"w[t].f{s}", " + ")}) + q[t].top')} AS told",
        f"{each(lambda s: f"{total(f'g[t].g{s}')} + 1e-9 AS n{s}")}, {pairs(lambda i, j: f"list_sum(list_transform(x, lambda e: e.x{i}{j})) + 0.1 AS c{i}{j}")}",
        each(lambda s: f"{total(f'g[t].g{s} * (ys[t] - b * xs[t])')} / n{s} AS na{s}"),
        f"({each(lambda s: f"{total(f'g[t].g{s} * (ys[t] - na{s}) * xs[t]')} / v{s}", ' + ')}) / ({each(lambda s: f"{total(f'g[t].g{s} * xs[t] ** 2')} / v{s}", ' + ')} + 1e-9) AS nb",
    ]
    made = "SELECT * FROM em, (SELECT list(y ORDER BY t) AS ys, list(x ORDER BY t) AS xs, count(*) AS n FROM zc WHERE past) WHERE i < 2 OR gain > " + repr(gain)
    for step in steps:
        made = f"SELECT *, {step} FROM ({made})"
    names = f"i, {each(lambda s: f'a{s}')}, {each(lambda s: f'v{s}')}, b, {pairs(lambda i, j: f'm{i}{j}')}, {each(lambda s: f'p{s}')}, l, gain"
    begin = f"SELECT 0, {each(lambda s: f'(SELECT alpha FROM par0 WHERE s = {s})')}, {each(lambda s: f'(SELECT v FROM par0 WHERE s = {s})')}, (SELECT any_value(b) FROM par0), {pairs(lambda i, j: f'(SELECT a FROM mov0 WHERE i = {i} AND j = {j})')}, {each(lambda s: f'(SELECT p FROM sta0 WHERE s = {s})')}, NULL::DOUBLE, NULL::DOUBLE"
    moved = pairs(lambda i, j: f"c{i}{j} / ({each(lambda y: f'c{i}{y}', ' + ')})")
    after = f"SELECT i + 1, {each(lambda s: f'na{s}')}, {each(lambda s: f"greatest({total(f'g[t].g{s} * (ys[t] - na{s} - nb * xs[t]) ** 2')} / n{s}, 1e-9)")}, nb, {moved}, {each(lambda s: f'g[1].g{s}')}, told, told - l FROM ({made})"
    return f"SELECT * FROM (WITH RECURSIVE em({names}) AS ({begin} UNION ALL {after}) SELECT * FROM em) QUALIFY row_number() OVER (ORDER BY i DESC) = 1"


def switch_tables(rounds: int | None) -> list[tuple[str, str]]:
    """The switching regression after so many rounds: par<rounds>, posterior. None: until the likelihood stands still, par_end."""
    k = SWITCH
    log = "-0.5 * ((z.y - p.alpha - p.b * z.x) ** 2 / p.v + ln(2 * pi() * p.v))"
    out = [
        ("zc", f"SELECT 0 AS c, obs_date, row_number() OVER (ORDER BY obs_date) AS t, y, x, row_number() OVER (ORDER BY obs_date) <= {FIT_MONTHS} AS past FROM panel"),
        ("line", "SELECT *, avg_y - b * avg_x AS alpha FROM (SELECT avg(y) AS avg_y, avg(x) AS avg_x, stddev_pop(y) + 1e-9 AS sd, (sum(x * y) - count(*) * avg(x) * avg(y)) / (sum(x * x) - count(*) * avg(x) ** 2 + 1e-9) AS b FROM zc WHERE past)"),
        ("far", f"SELECT (y - alpha - b * x) ** 2 AS e, least({k - 1}, floor(abs((y - avg_y) / sd) / 0.8::DOUBLE))::INT AS s FROM zc, line WHERE past"),
        ("par0", f"SELECT 0 AS c, r.s, alpha, b, greatest((coalesce(sum(e), 0) + 10 * (SELECT avg(e) FROM far)) / (count(e) + 10), 1e-9) AS v FROM range({k}) r(s) LEFT JOIN far f ON f.s = r.s, line GROUP BY r.s, alpha, b"),
        ("mov0", f"SELECT 0 AS c, i, j, CASE WHEN i = j THEN 0.9::DOUBLE ELSE {0.1 / (k - 1)!r}::DOUBLE END AS a FROM range({k}) x(i), range({k}) y(j)"), ("sta0", f"SELECT 0 AS c, s, {1 / k!r}::DOUBLE AS p FROM range({k}) x(s)"),
    ]
    par = """SELECT c, s, alpha, b, greatest(sum(g * (y - alpha - b * x) ** 2) / (sum(g) + 1e-9), 1e-9) AS v FROM (SELECT *, sum(g / v * (y - alpha) * x) OVER () / (sum(g / v * x * x) OVER () + 1e-9) AS b
      FROM (SELECT q.c, q.t, q.s, g, y, x, v, sum(g * (y - b * x)) OVER (PARTITION BY q.s) / (sum(g) OVER (PARTITION BY q.s) + 1e-9) AS alpha FROM gamma{i} q JOIN zc USING (c, t) JOIN par{i} p ON p.c = q.c AND p.s = q.s)) GROUP BY c, s, alpha, b"""
    for i in range(rounds or 0):
        out += round_sql(k, i, log, "v + 0.1", par)
    i = "_end" if rounds is None else rounds
    if rounds is None:
        rows = lambda items: f"SELECT 0 AS c, unnest([{', '.join('{' + x + '}' for x in items)}], recursive := true) FROM still"
        out += [
            ("still", still_sql()), ("par_end", rows(f"'s': {s}, 'alpha': a{s}, 'b': b, 'v': v{s}" for s in range(k))),
            ("mov_end", rows(f"'i': {x}, 'j': {y}, 'a': m{x}{y}" for x in range(k) for y in range(k))), ("sta_end", rows(f"'s': {s}, 'p': p{s}" for s in range(k))),
        ]
    return [*out, (f"like{i}", likelihood_sql(k, log, f"par{i}")), (f"move{i}", moves_sql(k, f"mov{i}")), ("posterior", forward_sql(k, f"like{i}", f"move{i}", f"sta{i}"))]


def panel(spark, sf):
    return gold.monthly_panel(drivers(spark, sf), ["stress"], 60)


@query("G05_hamilton_filter", recursive("SELECT obs_date, round(CASE WHEN (SELECT max_by(s, v) FROM par2) = 0 THEN f0 ELSE f1 END, 6) AS violent FROM posterior JOIN zc USING (c, t)", *BASE, PANEL, *switch_tables(2)))
def g05_filter(spark, sf):
    """Filtered probability of the violent state, with parameters of two rounds over the first months."""
    return regimes.violent_probability(panel(spark, sf), ["z_stress"], stored, FIT_MONTHS, SWITCH, rounds=2).select("obs_date", rnd("violent").alias("violent"))


@query("G04_G05_switching")
def g05(spark, sf):
    """Three states, fitted until the likelihood stands still."""
    return regimes.violent_probability(panel(spark, sf), ["z_stress"], stored, FIT_MONTHS)


# --- unit roots

D = differencing
ORDERS = [
    LOGP, ("wts", "SELECT * FROM (WITH RECURSIVE r(d, k, w) AS (SELECT round(0.05::DOUBLE * i, 2), 0, 1.0::DOUBLE FROM range(21) t(i) UNION ALL SELECT d, k + 1, -w * (d - (k + 1) + 1) / (k + 1) FROM r WHERE k < 251) SELECT * FROM r) QUALIFY min(abs(w)) OVER (PARTITION BY d ORDER BY k) >= 0.001"),
    ("made", "SELECT d, p.t, sum(w * q.y) AS x FROM logp p, wts JOIN logp q ON q.t = p.t - k GROUP BY d, p.t HAVING count(*) = (SELECT count(*) FROM wts v WHERE v.d = wts.d)"),
    ("steps", "SELECT d, t, x - b AS y, b AS a, b - c AS l FROM (SELECT *, lag(x) OVER (PARTITION BY d ORDER BY t) AS b, lag(x, 2) OVER (PARTITION BY d ORDER BY t) AS c FROM made) WHERE c IS NOT NULL"),
    ("centred", "SELECT d, count(*) AS n, sum(a * a) - sum(a) ** 2 / count(*) AS aa, sum(a * l) - sum(a) * sum(l) / count(*) AS ab, sum(l * l) - sum(l) ** 2 / count(*) AS bb, sum(a * y) - sum(a) * sum(y) / count(*) AS ay, sum(l * y) - sum(l) * sum(y) / count(*) AS by_, sum(y * y) - sum(y) ** 2 / count(*) AS yy FROM steps GROUP BY d HAVING count(*) > 30"),
    ("tested", "SELECT d, n, s / sqrt((yy - s * ay - l * by_) / (n - 3) * bb / det) AS t FROM (SELECT *, (ay * bb - by_ * ab) / det AS s, (by_ * aa - ay * ab) / det AS l FROM (SELECT *, aa * bb - ab * ab AS det FROM centred))"),
    ("surface", f"SELECT *, CASE WHEN t <= {D.SURFACE_BREAK} THEN {' + '.join(f'{c}::DOUBLE * t ** {k}' for k, c in enumerate(D.SURFACE_LOW))} ELSE {' + '.join(f'{c}::DOUBLE * t ** {k}' for k, c in enumerate(D.SURFACE_HIGH))} END AS q FROM tested"),
    ("upper", f"SELECT *, exp(-q * q / 2) / sqrt(2 * pi()) * ({' + '.join(f'{c}::DOUBLE / (1 + {D.TAIL_STEP}::DOUBLE * abs(q)) ** {k + 1}' for k, c in enumerate(D.TAIL))}) AS u FROM surface"),
    ("roots", f"SELECT d, n, t, CASE WHEN t > {D.SURFACE_MOST} THEN 1 WHEN t < {D.SURFACE_LEAST} THEN 0 WHEN q >= 0 THEN 1 - u ELSE u END AS p FROM upper"),
]


@query("Y05_unit_roots", recursive("SELECT 'PX' AS series_id, d, n, round(t, 5) AS t, round(p, 6) AS p FROM roots", *ORDERS))
def y05_roots(spark, sf):
    """The unit-root test of all orders of differencing, from one table of lagged products."""
    return differencing.unit_roots(price(spark, sf)).select("series_id", "d", "n", rnd("t", 5).alias("t"), rnd("p").alias("p"))


@query("Y05_least_differencing", recursive("SELECT 'PX' AS series_id, d, round(p, 6) AS p, p < 0.05 AS stationary FROM roots ORDER BY p < 0.05 DESC, CASE WHEN p < 0.05 THEN d ELSE -d END LIMIT 1", *ORDERS))
def y05(spark, sf):
    return differencing.least_differencing(price(spark, sf)).select("series_id", "d", rnd("p").alias("p"), "stationary")
