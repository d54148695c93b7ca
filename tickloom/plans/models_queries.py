"""Queries of models: attribution, overfitting, tails, surrogates and acquisition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..operators import attribution as attr
from ..operators import surrogate as sur
from ..operators.regimes import classify
from ..sources.storage import cut
from ..sources.views import results, returns, trades
from ..sql import with_views
from .common import duck_normal, rounded
from .market import STEPS, hourly
from .results_queries import r
from .stats_queries import DRAW, PBO

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str = "", sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = with_views(views, sql)


# -- attribution: daily returns of symbols on the market and on large trades against small ones --------


def daily(spark: SparkSession, d: str) -> DataFrame:
    """symbol, day, r; `market` is the day's mean over symbols, `size` its return on large trades over that on small ones."""
    t = trades(spark, d).select("symbol", F.to_date("exit_ts").alias("day"), (F.col("return_pct") / 100).alias("r"), (F.abs("size") >= 25).alias("large"))
    by_symbol = t.groupBy("symbol", "day").agg(F.avg("r").alias("r"))
    market = by_symbol.groupBy("day").agg(F.avg("r").alias("market"))
    size = t.groupBy("day").agg((F.coalesce(F.avg(F.when(F.col("large"), F.col("r"))), F.lit(0.0)) - F.coalesce(F.avg(F.when(~F.col("large"), F.col("r"))), F.lit(0.0))).alias("size"))
    return by_symbol.join(market, "day").join(size, "day")


DAILY = """, dt AS (SELECT symbol, CAST(exit_ts AS DATE) AS day, return_pct / 100 AS r, abs(size) >= 25 AS large FROM trades),
ds AS (SELECT symbol, day, avg(r) AS r FROM dt GROUP BY ALL), dz AS (SELECT day, coalesce(avg(r) FILTER (large), 0) - coalesce(avg(r) FILTER (NOT large), 0) AS size FROM dt GROUP BY day),
f AS (SELECT symbol, day, r, avg(r) OVER (PARTITION BY day) AS market, size FROM ds JOIN dz USING (day))"""
add(
    "V24_factor_model",
    lambda s, d: attr.factor_model(daily(s, d), "symbol", "r", ["market", "size"]),
    "trades",
    DAILY + f""", g AS (SELECT symbol, count(*)::DOUBLE AS n, avg(r) AS my, avg(market) AS m1, avg(size) AS m2, var_pop(market) AS s11, var_pop(size) AS s22, covar_pop(market, size) AS s12,
  covar_pop(r, market) AS s1y, covar_pop(r, size) AS s2y, var_pop(r) AS sy, sum(market) AS t1, sum(size) AS t2, sum(r) AS ty, exp(sum(ln(1 + r))) - 1 AS total FROM f GROUP BY symbol HAVING count(*) > 3),
b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM g)
SELECT symbol, n, {r('my - b1 * m1 - b2 * m2 AS alpha', 'b1 AS beta_market', 'b2 AS beta_size', 'b1 * t1 AS attributed_market', 'b2 * t2 AS attributed_size', 'ty - n * (my - b1 * m1 - b2 * m2) - b1 * t1 - b2 * t2 AS residual', '(b1 * s1y + b2 * s2y) / sy AS r2', 'total')} FROM b""",
)
add(
    "V24_skill_test",
    lambda s, d: attr.skill(daily(s, d), "symbol", "day", "r", "market"),
    "trades",
    DAILY + f""", k AS (SELECT symbol, CAST(floor(date_diff('day', DATE '1970-01-01', day) / 30) AS BIGINT) AS block, count(*)::DOUBLE AS n, sum(market) AS sb, sum(market * market) AS sbb, sum(r) AS sy, sum(r * market) AS sby FROM f GROUP BY ALL),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY block) AS place, count(*) OVER (PARTITION BY symbol) AS blocks FROM k),
w AS (SELECT a.symbol, sim, sum(b.n) AS n, sum(b.sb) AS sb, sum(b.sbb) AS sbb, sum(b.sy) AS sy, sum(b.sby) AS sby FROM (SELECT symbol, place, blocks, sim, {DRAW.format(s='sim', k='place', n='blocks')} AS p FROM q, generate_series(1, 1000) g(sim) WHERE blocks > 1) a
  JOIN q b ON a.symbol = b.symbol AND a.p = b.place GROUP BY ALL),
a AS (SELECT symbol, (sy - CASE WHEN n * sbb - sb * sb > 1e-15 THEN (n * sby - sb * sy) / (n * sbb - sb * sb) ELSE 0 END * sb) / n AS alpha FROM w),
o AS (SELECT symbol, count(*)::DOUBLE AS blocks, sum(n) AS n, sum(sb) AS sb, sum(sbb) AS sbb, sum(sy) AS sy, sum(sby) AS sby FROM q GROUP BY symbol),
p AS (SELECT symbol, count(*) FILTER (round(alpha, 12) <= 0) / count(*) AS p, quantile_cont(alpha, 0.025) AS low, quantile_cont(alpha, 0.975) AS high FROM a GROUP BY symbol)
SELECT symbol, blocks, {r('(sy - (n * sby - sb * sy) / (n * sbb - sb * sb) * sb) / n AS alpha', 'p', 'low', 'high')} FROM o JOIN p USING (symbol)""",
)
add(
    "V24_timing",
    lambda s, d: attr.timing(trades(s, d), "symbol").join(trades(s, d).groupBy("symbol").agg((F.avg("return_pct") / 100).alias("mean")), "symbol").withColumn("entry_value", F.col("trade_return") - F.col("mean")).drop("mean"),
    "trades",
    f", x AS (SELECT symbol, pnl / greatest(abs(size) * entry_price, 1e-6) AS x, days::DOUBLE AS h, return_pct / 100 AS p FROM trades) SELECT symbol, count(*) AS trades, {r('CASE WHEN count(*) >= 5 THEN avg(x) ELSE 0.0 END AS trade_return', 'CASE WHEN count(*) > 5 AND stddev_pop(x) > 1e-12 AND stddev_pop(h) > 1e-12 THEN corr(x, h) ELSE 0.0 END AS hold_value', 'CASE WHEN count(*) >= 5 THEN avg(x) ELSE 0.0 END - avg(p) AS entry_value')} FROM x GROUP BY symbol",
)


def _costs(s: SparkSession, d: str) -> DataFrame:
    share = lambda rate: rate * F.abs("size") * F.col("entry_price") / 100_000.0
    t = trades(s, d).withColumns({"c": share(F.lit(0.001)), "p": share(F.lit(0.0002)), "net": F.log1p(F.col("pnl") / 10_000_000.0)})
    return attr.costs(t, "symbol", "net", {"commission": "c", "spread": "p"})


add(
    "V24_costs",
    _costs,
    "trades",
    f", x AS (SELECT symbol, exp(sum(ln(1 + pnl / 10000000.0))) - 1 AS net, sum(0.001 * abs(size) * entry_price / 100000.0) AS commission, sum(0.0002 * abs(size) * entry_price / 100000.0) AS spread FROM trades GROUP BY symbol) SELECT symbol, {r('net', 'commission', 'spread', 'commission + spread AS total_cost', 'net + commission + spread AS gross')} FROM x",
)
add(
    "V24_regimes",
    lambda s, d: attr.by_regime(classify(hourly(s, d)), "symbol", "regime", "ret_1"),
    "bars",
    STEPS + f", g AS (SELECT symbol, regime, round(sum(ret_1), 12) AS s, count(*) AS n FROM i10 WHERE ret_1 IS NOT NULL GROUP BY ALL) SELECT symbol, max_by(regime, {{'s': s, 'regime': regime}}) AS best, min_by(regime, {{'s': s, 'regime': regime}}) AS worst, {r('max(s) AS best_return', 'min(s) AS worst_return')}, CAST(sum(n) AS BIGINT) AS bars FROM g GROUP BY symbol",
)

# -- overfitting and tails -------------------------------------------------------------------------------

RANKS = PBO + """, sp AS (SELECT combo, rank() OVER (PARTITION BY combo ORDER BY i) + (count(*) OVER (PARTITION BY combo, i) - 1) / 2 AS ri, rank() OVER (PARTITION BY combo ORDER BY o) + (count(*) OVER (PARTITION BY combo, o) - 1) / 2 AS ro FROM pb WHERE i IS NOT NULL AND o IS NOT NULL),
sc AS (SELECT combo, count(*) AS n, corr(ri, ro) AS spearman FROM sp GROUP BY combo)"""
add("V11_rank_correlation", lambda s, d: st.rank_correlation(st.combination_sharpes(returns(s, d)), ["combo"], "is_", "oos"), "returns", RANKS + f" SELECT combo, n, {r('spearman')} FROM sc")
add(
    "V11_overfitting",
    lambda s, d: st.overfitting(returns(s, d)),
    "returns",
    RANKS + f" SELECT count(*) AS combos, {r('count(*) FILTER (p < 0.5) / count(*) AS pbo', 'avg(ln(p / (1 - p))) AS logit_mean', 'stddev_pop(ln(p / (1 - p))) AS logit_std', 'avg(spearman) AS degradation', 'count(*) FILTER (oos < 0) / count(*) AS share_negative')} FROM pl JOIN sc USING (combo)",
)
add(
    "V23_tail_dependence",
    lambda s, d: st.tail_dependence(daily(s, d), "symbol", "market", "r"),
    "trades",
    DAILY + f""", l AS (SELECT symbol, quantile_cont(market, 0.05) AS xl, quantile_cont(market, 0.95) AS xh, quantile_cont(r, 0.05) AS yl, quantile_cont(r, 0.95) AS yh FROM f GROUP BY symbol),
c AS (SELECT symbol, count(*) AS n, count(*) FILTER (market <= xl + 1e-12) AS low, count(*) FILTER (market <= xl + 1e-12 AND r <= yl + 1e-12) AS both_low, count(*) FILTER (market >= xh - 1e-12) AS high, count(*) FILTER (market >= xh - 1e-12 AND r >= yh - 1e-12) AS both_high FROM f JOIN l USING (symbol) GROUP BY symbol)
SELECT symbol, n, both_low, both_high, {r('both_low / low AS lambda_low', 'both_high / high AS lambda_high')} FROM c""",
)

# -- surrogates ---------------------------------------------------------------------------------------------

INPUTS = ["total_return_pct", "max_drawdown_pct", "win_rate", "total_trades"]


def candidates(s: SparkSession, d: str) -> DataFrame:
    """A row for each strategy: the means of its results, and their Sharpe ratio where there is one. Stored: fits and predictions read it."""
    return cut(results(s, d).groupBy("strategy_id").agg(*[F.avg(c).alias(c) for c in INPUTS], F.avg("sharpe_ratio").alias("y")), "rated")


def _model(s: SparkSession, d: str) -> tuple[DataFrame, sur.Surrogate]:
    x = candidates(s, d)
    return x, sur.fit(x.filter("y is not null"), "strategy_id", INPUTS, "y")


def _predicted(s: SparkSession, d: str) -> DataFrame:
    x, model = _model(s, d)
    return sur.predict(x, model).select("strategy_id", "mu", "sigma")


def _cross_validated(s: SparkSession, d: str) -> DataFrame:
    """How the chosen surrogate does on folds that it hasn't seen."""
    _, m = _model(s, d)
    n = len(m.cv_r2)
    mean = sum(m.cv_r2) / n
    row = (m.n, *(float(x) for x in (m.length, m.ridge, m.noise**0.5, mean, (sum((x - mean) ** 2 for x in m.cv_r2) / n) ** 0.5)))
    return s.createDataFrame([row], "n long, length double, ridge double, noise double, cv_mean double, cv_std double")


def _thompson(s: SparkSession, d: str) -> DataFrame:
    x, model = _model(s, d)
    return sur.thompson_picks(x, "strategy_id", model)


add("P18_posterior", _predicted)
add("P18_cross_validation", _cross_validated)
add("P19_thompson_picks", _thompson)
MS = ", p AS (SELECT strategy_id, avg(sharpe_ratio) AS mu, stddev_samp(sharpe_ratio) AS sigma FROM results GROUP BY 1 HAVING stddev_samp(sharpe_ratio) > 0)"
BAR = " || '|' || "
U = lambda *x: f"((('0x' || substr(md5({BAR.join(x)}), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"


def _spread(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).groupBy("strategy_id").agg(F.avg("sharpe_ratio").alias("mu"), F.stddev_samp("sharpe_ratio").alias("sigma")).filter("sigma > 0")


add(
    "P19_thompson_scores",
    lambda s, d: _spread(s, d).select("strategy_id", sur.acquisition("mu", "sigma", "ts", key="strategy_id").alias("ts"), sur.acquisition("mu", "sigma", "random", key="strategy_id").alias("random")),
    "results",
    MS + ", q AS (SELECT strategy_id, mu, sigma, " + " + ".join(f"sqrt(-2 * ln({U(repr('r'), repr(f'42|{i}'), 'strategy_id')})) * cos(2 * pi() * {U(repr('a'), repr(f'42|{i}'), 'strategy_id')})" for i in range(10)) + f" AS z, {U(repr('42'), 'strategy_id')} AS random FROM p) SELECT strategy_id, {r('mu + greatest(sigma, 1e-9) * z / 10 AS ts', 'random')} FROM q",
)


def _objectives(s: SparkSession, d: str) -> DataFrame:
    """Candidates by the weighted expected improvement of Sharpe ratio (weight 2) and return over the 90th percentile of each."""
    x = results(s, d).groupBy("strategy_id").agg(*[f(c).alias(f"{n}_{k}") for k, c in (("s", "sharpe_ratio"), ("t", "total_return_pct")) for n, f in (("m", F.avg), ("d", F.stddev_samp))]).filter("d_s > 0 and d_t > 0")
    best = x.agg(F.percentile("m_s", 0.9).alias("b_s"), F.percentile("m_t", 0.9).alias("b_t"))
    y = x.join(F.broadcast(best), how="cross")  # one row
    return y.select("strategy_id", sur.several({"s": ("m_s", "d_s", F.col("b_s"), 2.0), "t": ("m_t", "d_t", F.col("b_t"), 1.0)}).alias("score"))


EI = lambda k: f"greatest((m_{k} - b_{k} - 0.01) * ({duck_normal('z_' + k)}) + greatest(d_{k}, 1e-9) * exp(-z_{k} * z_{k} / 2) / sqrt(2 * pi()), 0.0)"
add(
    "P19_multi_objective",
    _objectives,
    "results",
    f""", x AS (SELECT strategy_id, avg(sharpe_ratio) AS m_s, stddev_samp(sharpe_ratio) AS d_s, avg(total_return_pct) AS m_t, stddev_samp(total_return_pct) AS d_t FROM results GROUP BY 1 HAVING d_s > 0 AND d_t > 0),
y AS (SELECT x.*, b_s, b_t, (m_s - b_s - 0.01) / greatest(d_s, 1e-9) AS z_s, (m_t - b_t - 0.01) / greatest(d_t, 1e-9) AS z_t FROM x, (SELECT quantile_cont(m_s, 0.9) AS b_s, quantile_cont(m_t, 0.9) AS b_t FROM x)),
e AS (SELECT strategy_id, {EI('s')} AS e_s, {EI('t')} AS e_t FROM y) SELECT strategy_id, {r('(2 * e_s + e_t) / 3 AS score')} FROM e""",
)


# -- evolution ------------------------------------------------------------------------------------------------


def _population(s: SparkSession, d: str) -> DataFrame:
    """All strategies with a Sharpe ratio: win rate and drawdown, as shares, are the genes."""
    x = candidates(s, d).filter("y is not null")
    return x.select(F.col("strategy_id").alias("key"), F.col("y").alias("fitness"), (F.col("win_rate") / 100).alias("win"), (F.col("max_drawdown_pct") / 100).alias("drawdown"))


def _evolved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three generations whose fitness is what a surrogate of all strategies expects."""
    from ..operators.evolution import evolve

    people = _population(s, d)
    model = sur.fit(people, "key", ["win", "drawdown"], "fitness", width=32)
    judged = lambda rows: sur.predict(rows, model).withColumnRenamed("mu", "fitness").drop("sigma")
    return evolve(people, ["win", "drawdown"], judged, 3, 200, "rank", "sbx", "polynomial", archive=20)


add("P17_generations", lambda s, d: _evolved(s, d)[2])
add("P17_archive", lambda s, d: _evolved(s, d)[1])
