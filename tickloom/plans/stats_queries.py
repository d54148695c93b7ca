"""Queries over return series: resampling, distribution, risk, overfitting, drift, attribution."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions import statistics as st
from ..functions.normal import ppf
from ..operators import scans
from ..operators.regimes import indicators
from ..sources.views import returns, trades
from ..sql import with_views
from .common import duck_normal, rounded
from .market import STEPS, hourly
from .results_queries import r

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str = "", sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = with_views(views, sql)


DRAW = "((({s} * 1103515 + {k} * 12345 + 6789) % 1000003) * 7919 + {s} * 31 + {k} * 17) % 999983 % {n} + 1"
BOOT = f""", n AS (SELECT strategy_id, max(t) AS n FROM returns GROUP BY 1), d AS (SELECT strategy_id, sim, k, {DRAW.format(s='sim', k='k', n='n')} AS t FROM (SELECT strategy_id, n, sim, unnest(generate_series(1, n)) AS k FROM n, generate_series(1, 1000) g(sim))),
b AS (SELECT strategy_id, sim, avg(r) AS mean, CASE WHEN stddev_pop(r) > 1e-9 THEN avg(r) / stddev_pop(r) ELSE 0 END AS sharpe, count(*) FILTER (r > 0) / count(*) AS win, CASE WHEN count(*) FILTER (r < 0) = 0 THEN 10.0 ELSE coalesce(sum(r) FILTER (r > 0), 0) / sum(-r) FILTER (r < 0) END AS profit_factor FROM d JOIN returns USING (strategy_id, t) GROUP BY ALL)
"""


def interval(c: str) -> str:
    return r(f"quantile_cont({c}, 0.025) AS {c}_low", f"quantile_cont({c}, 0.975) AS {c}_high", f"count(*) FILTER (round({c}, 12) <= {1 if c == 'profit_factor' else 0}) / count(*) AS {c}_p")


add("V1_bootstrap_mean", lambda s, d: st.bootstrap(returns(s, d), ["mean"]), "returns", BOOT + f"SELECT strategy_id, {interval('mean')} FROM b GROUP BY 1")
add("V2_bootstrap_sharpe", lambda s, d: st.bootstrap(returns(s, d), ["sharpe"]), "returns", BOOT + f"SELECT strategy_id, {interval('sharpe')} FROM b GROUP BY 1")
add("V3_bootstrap_win_profit", lambda s, d: st.bootstrap(returns(s, d), ["win", "profit_factor"]), "returns", BOOT + f"SELECT strategy_id, {interval('win')}, {interval('profit_factor')} FROM b GROUP BY 1")


def mc(cost: float) -> str:
    return f""", s AS (SELECT strategy_id, t, r, sim, {DRAW.format(s='sim', k='t', n='999983')} AS key FROM returns, generate_series(1, 1000) g(sim)),
e AS (SELECT *, 1 + sum(r - {cost}) OVER w AS equity, row_number() OVER w AS place FROM s WINDOW w AS (PARTITION BY strategy_id, sim ORDER BY key, t ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, 1 - equity / greatest(1.0, max(equity) OVER (PARTITION BY strategy_id, sim ORDER BY key, t ROWS UNBOUNDED PRECEDING)) AS dd FROM e), o AS (SELECT strategy_id, sim, max(dd) AS dd, max_by(equity, place) AS final FROM q GROUP BY ALL)
SELECT strategy_id, {r('avg(dd) AS dd_mean', 'quantile_cont(dd, 0.95) AS dd_95', 'count(*) FILTER (round(final, 9) > 1) / count(*) AS p_profit', 'count(*) FILTER (round(dd, 9) >= 0.5) / count(*) AS p_ruin')} FROM o GROUP BY 1"""


add("V4_monte_carlo", lambda s, d: st.monte_carlo(returns(s, d)), "returns", mc(0.0))
add("V5_monte_carlo_costs", lambda s, d: st.monte_carlo(returns(s, d), cost=0.001), "returns", mc(0.001))
WF = """, n AS (SELECT *, max(t) OVER (PARTITION BY strategy_id) // 3 AS size FROM returns), f AS (SELECT *, (t - 1) // size AS fold, (t - 1) % size < floor(size * 0.7) AS inside FROM n WHERE size >= 3), g AS (SELECT strategy_id, fold, avg(r) FILTER (inside) AS is_mean, avg(r) FILTER (NOT inside) AS oos_mean FROM f WHERE fold < 3 GROUP BY ALL)"""
add("V6_walk_forward", lambda s, d: st.walk_forward(returns(s, d)), "returns", WF + f" SELECT strategy_id, {r('avg(is_mean) AS is_mean', 'avg(oos_mean) AS oos_mean', 'count(*) FILTER (oos_mean > 0) / count(*) AS positive', 'CASE WHEN stddev_pop(is_mean) > 1e-9 AND stddev_pop(oos_mean) > 1e-9 THEN covar_pop(is_mean, oos_mean) / (stddev_pop(is_mean) * stddev_pop(oos_mean)) END AS corr')} FROM g GROUP BY 1")
QUERIES["W23_folds"], ORACLE["W23_folds"] = QUERIES["V6_walk_forward"], ORACLE["V6_walk_forward"]
LB = ", m AS (SELECT symbol, ts, ret_1 - avg(ret_1) OVER (PARTITION BY symbol) AS m FROM i2 WHERE ret_1 IS NOT NULL), l AS (SELECT *, " + ", ".join(f"lag(m, {k}) OVER (PARTITION BY symbol ORDER BY ts) AS l{k}" for k in range(1, 11)) + " FROM m), a AS (SELECT symbol, count(m) AS n, " + ", ".join(f"sum(m * l{k}) / nullif(sum(m * m), 0) AS ac{k}" for k in range(1, 11)) + " FROM l GROUP BY 1), q AS (SELECT *, n * (n + 2) * (" + " + ".join(f"ac{k} * ac{k} / (n - {k})" for k in range(1, 11)) + ") AS q FROM a)"
bars_r = lambda s, d: indicators(hourly(s, d)).filter("ret_1 is not null").select("symbol", "ts", F.col("ret_1").alias("r"))
add("V7_serial_dependence", lambda s, d: st.serial_dependence(bars_r(s, d), "symbol", "ts", "r").select("symbol", "n", "ac1", "ac5", "ac10", "q", "p"), "bars", STEPS + LB + f" SELECT symbol, n, {r('ac1', 'ac5', 'ac10', 'q', 'exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24) AS p')} FROM q")
QUERIES["W18_autocorrelation"], ORACLE["W18_autocorrelation"] = QUERIES["V7_serial_dependence"], ORACLE["V7_serial_dependence"]
MOM = ", c AS (SELECT *, r - avg(r) OVER (PARTITION BY strategy_id) AS m FROM returns), g AS (SELECT strategy_id, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS sd, stddev_pop(r) AS std, avg(m * m * m) / nullif(pow(avg(m * m), 1.5), 0) AS skew, avg(pow(m, 4)) / nullif(pow(avg(m * m), 2), 0) - 3 AS kurt FROM c GROUP BY 1)"
add("V8_distribution", lambda s, d: st.distribution(returns(s, d)), "returns", MOM + f" SELECT strategy_id, n, {r('mean', 'std', 'skew', 'kurt', 'n / 6 * (skew * skew + kurt * kurt / 4) AS jb', 'exp(-n / 6 * (skew * skew + kurt * kurt / 4) / 2) AS jb_p')} FROM g")
Z = ppf(0.05)
CF = f"({Z!r} + ({Z!r}::DOUBLE * {Z!r} - 1) * skew / 6 + ({Z**3 - 3 * Z!r}) * kurt / 24 - ({2 * Z**3 - 5 * Z!r}) * skew * skew / 36)"
TAIL = ", v AS (SELECT strategy_id, quantile_cont(r, 0.05) AS v95, quantile_cont(r, 0.01) AS v99 FROM returns GROUP BY 1), t AS (SELECT strategy_id, avg(r) FILTER (r <= v95 + 1e-12) AS cvar95, avg(r) FILTER (r <= v99 + 1e-12) AS cvar99 FROM returns JOIN v USING (strategy_id) GROUP BY 1)"
add("V10_value_at_risk", lambda s, d: st.value_at_risk(returns(s, d)), "returns", MOM + TAIL + f" SELECT strategy_id, {r('v95 AS var_hist', f'mean + {Z!r} * sd AS var_normal', f'mean + {CF} * sd AS var_cf', 'cvar95 AS cvar')} FROM g JOIN v USING (strategy_id) JOIN t USING (strategy_id)")
E_MAX = (1 - st.GAMMA) * ppf(0.99) + st.GAMMA * ppf(1 - 1 / (100 * math.e))
SR = MOM + ", x AS (SELECT *, mean / sd AS sr, sqrt(greatest((1 - skew * mean / sd + (kurt + 2) / 4 * pow(mean / sd, 2)) / (n - 1), 1e-12)) AS se FROM g WHERE sd > 1e-9)"
add("V12_deflated_sharpe", lambda s, d: st.sharpe_tests(returns(s, d)).select("strategy_id", "sr", F.round("dsr_z", 4).alias("dsr_z"), "min_track"), "returns", SR + f" SELECT strategy_id, {r('sr')}, round(round((sr - {E_MAX!r} / sqrt(n)) / se, 4) + 3.05e-8, 6) + 0.0 AS dsr_z, CASE WHEN abs(sr) < 1e-9 THEN 999999 ELSE CAST(least(999999.0, ceil(pow({E_MAX!r} / sr, 2) - 1e-9)) AS BIGINT) END AS min_track FROM x")
add("V13_probabilistic_sharpe", lambda s, d: st.sharpe_tests(returns(s, d)).select("strategy_id", "psr", "dsr_p"), "returns", SR + f", z AS (SELECT strategy_id, sr / se AS a, (sr - {E_MAX!r} / sqrt(n)) / se AS b FROM x) SELECT strategy_id, {r(duck_normal('a') + ' AS psr', '1 - (' + duck_normal('b') + ') AS dsr_p')} FROM z")
COMBOS = ", ".join(f"({i}, {p}, {int(p in c)})" for i, c in enumerate(itertools.combinations(range(1, 9), 4)) for p in range(1, 9))
PBO = f""", combos(combo, part, inside) AS (VALUES {COMBOS}), pt AS (SELECT strategy_id, r, ntile(8) OVER (PARTITION BY strategy_id ORDER BY t) AS part FROM returns),
ps AS (SELECT strategy_id, part, count(*) AS n, sum(r) AS s, sum(r * r) AS ss FROM pt GROUP BY ALL), pg AS (SELECT combo, strategy_id, inside, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM ps JOIN combos USING (part) GROUP BY ALL),
pv AS (SELECT *, (ss - s * s / n) / nullif(n - 1, 0) AS var FROM pg), ph AS (SELECT *, round(CASE WHEN n > 1 AND var > 1e-18 THEN s / n / sqrt(var) * sqrt(252) ELSE 0.0 END, 9) AS sharpe FROM pv),
pb AS (SELECT combo, strategy_id, max(sharpe) FILTER (inside = 1) AS i, max(sharpe) FILTER (inside = 0) AS o FROM ph GROUP BY ALL),
best AS (SELECT * FROM pb QUALIFY row_number() OVER (PARTITION BY combo ORDER BY i DESC NULLS LAST, strategy_id) = 1),
pr AS (SELECT combo, count(*) AS n, count(*) FILTER (pb.o < best.o) + (count(*) FILTER (pb.o = best.o) + 1) / 2 AS rank FROM pb JOIN best USING (combo) GROUP BY combo),
pl AS (SELECT combo, strategy_id, i AS best_is, o AS oos, least(greatest(rank / n, 1e-6), 1 - 1e-6) AS p FROM best JOIN pr USING (combo))"""
add("V11_pbo_combinations", lambda s, d: st.pbo(returns(s, d)), "returns", PBO + f" SELECT combo, strategy_id, {r('best_is', 'oos', 'ln(p / (1 - p)) AS logit')} FROM pl")
add("V11_pbo", lambda s, d: st.pbo_summary(st.pbo(returns(s, d))), "returns", PBO + f" SELECT count(*) AS combos, {r('count(*) FILTER (p < 0.5) / count(*) AS pbo', 'count(*) FILTER (oos < 0) / count(*) AS share_negative')} FROM pl")
QUERIES["W22_ntile"] = lambda s, d: returns(s, d).withColumn("part", F.ntile(8).over(Window.partitionBy("strategy_id").orderBy("t"))).groupBy("strategy_id", "part").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("last"))
ORACLE["W22_ntile"] = with_views("returns", ", p AS (SELECT *, CAST(ntile(8) OVER (PARTITION BY strategy_id ORDER BY t) AS INTEGER) AS part FROM returns) SELECT strategy_id, part, count(*) AS n, max(t) AS last FROM p GROUP BY ALL")
add("V14_tearsheet", lambda s, d: returns(s, d).groupBy("strategy_id").agg((F.avg("r") * 252).alias("annual"), (F.stddev_samp("r") * math.sqrt(252)).alias("vol"), (F.count_if(F.col("r") > 0) / F.count(F.lit(1))).alias("win"), F.percentile("r", 0.05).alias("var95"), (F.exp(F.sum(F.log1p("r"))) - 1).alias("total")), "returns", f"SELECT strategy_id, {r('avg(r) * 252 AS annual', 'stddev_samp(r) * sqrt(252.0) AS vol', 'count(*) FILTER (r > 0) / count(*) AS win', 'quantile_cont(r, 0.05) AS var95', 'exp(sum(ln(1 + r))) - 1 AS total')} FROM returns GROUP BY 1")
add("V16_sign_flip", lambda s, d: st.sign_flip(returns(s, d)), "returns", f", x AS (SELECT strategy_id, sim, avg(r * CASE WHEN {DRAW.format(s='sim', k='t', n='2')} = 1 THEN 1 ELSE -1 END) AS m, avg(r) AS real FROM returns, generate_series(1, 40) g(sim) GROUP BY ALL) SELECT strategy_id, {r('count(*) FILTER (round(m, 12) >= round(real, 12)) / count(*) AS p')} FROM x GROUP BY 1")
add("V23_tail_risk", lambda s, d: st.tail_risk(returns(s, d)).select("strategy_id", "var95", "var99", "cvar95", "cvar99", "dar95", "max_dd"), "returns", TAIL + f", e AS (SELECT *, exp(sum(ln(1 + greatest(r, -0.99))) OVER (PARTITION BY strategy_id ORDER BY t)) AS e FROM returns), p AS (SELECT *, 1 - e / greatest(1.0, max(e) OVER (PARTITION BY strategy_id ORDER BY t)) AS dd FROM e), h AS (SELECT strategy_id, quantile_cont(dd, 0.95) AS dar95, max(dd) AS max_dd FROM p GROUP BY 1) SELECT strategy_id, {r('v95 AS var95', 'v99 AS var99', 'cvar95', 'cvar99', 'dar95', 'max_dd')} FROM v JOIN t USING (strategy_id) JOIN h USING (strategy_id)")
add("V23_tail_score", lambda s, d: st.tail_risk(returns(s, d)).select("strategy_id", "score"))
CUM = STEPS + ", z AS (SELECT symbol, ts, ret_1 AS r, (ret_1 - avg(ret_1) OVER (PARTITION BY symbol)) / stddev_samp(ret_1) OVER (PARTITION BY symbol) AS z FROM i2 WHERE ret_1 IS NOT NULL), u AS (SELECT *, sum(z - 0.5) OVER w AS u, sum(-z - 0.5) OVER w AS d, sum(z) OVER w AS plain, r - avg(r) OVER w - 0.005 AS x FROM z WINDOW w AS (PARTITION BY symbol ORDER BY ts)), s AS (SELECT *, sum(x) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM u)"
zbars = lambda s, d: bars_r(s, d).withColumn("z", st.zscore("r", "symbol"))
add("W16_cusum", lambda s, d: st.cusum(zbars(s, d), "symbol", "ts", "z").select("symbol", "ts", "cusum_up", "cusum_down"), "bars", CUM + f" SELECT symbol, ts, {r('u - least(0.0, min(u) OVER (PARTITION BY symbol ORDER BY ts)) AS cusum_up', 'd - least(0.0, min(d) OVER (PARTITION BY symbol ORDER BY ts)) AS cusum_down')} FROM u")
add("W15_batch_cusum", lambda s, d: zbars(s, d).withColumn("c", F.sum("z").over(Window.partitionBy("symbol").orderBy("ts"))).groupBy("symbol").agg(F.max(F.abs("c")).alias("most")), "bars", CUM + f" SELECT symbol, {r('max(abs(plain)) AS most')} FROM u GROUP BY 1")
add("W17_page_hinkley", lambda s, d: st.page_hinkley(bars_r(s, d), "symbol", "ts", "r").select("symbol", "ts", "page_hinkley"), "bars", CUM + f" SELECT symbol, ts, {r('s - min(s) OVER (PARTITION BY symbol ORDER BY ts) AS page_hinkley')} FROM s")
add("W20_losing_streak", lambda s, d: st.losing_streak(returns(s, d), "strategy_id", ["t"], "r"), "returns", ", x AS (SELECT strategy_id, r < 0 AS lost, row_number() OVER (PARTITION BY strategy_id ORDER BY t) - row_number() OVER (PARTITION BY strategy_id, r < 0 ORDER BY t) AS island FROM returns) SELECT strategy_id, max(c) AS longest FROM (SELECT strategy_id, count(*) AS c FROM x WHERE lost GROUP BY strategy_id, island) GROUP BY 1")
halves = lambda s, d: bars_r(s, d).withColumn("h", F.ntile(2).over(Window.partitionBy("symbol").orderBy("ts")))
PSI = STEPS + """, h AS (SELECT symbol, ret_1 AS r, ntile(2) OVER (PARTITION BY symbol ORDER BY ts) AS h FROM i2 WHERE ret_1 IS NOT NULL), ed AS (SELECT symbol, quantile_cont(r, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM h WHERE h = 1 GROUP BY 1),
bn AS (SELECT symbol, len(list_filter(e, lambda v: v <= r)) AS bin, count(*) FILTER (h = 1) AS a, count(*) FILTER (h = 2) AS b FROM h JOIN ed USING (symbol) GROUP BY ALL), gr AS (SELECT symbol, bin, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (SELECT symbol, unnest(generate_series(0, 9)) AS bin FROM ed) LEFT JOIN bn USING (symbol, bin)),
pr AS (SELECT symbol, greatest(a / sum(a) OVER (PARTITION BY symbol), 1e-6) AS pa, greatest(b / sum(b) OVER (PARTITION BY symbol), 1e-6) AS pb FROM gr), ps AS (SELECT symbol, sum((pb - pa) * ln(pb / pa)) AS psi FROM pr GROUP BY 1),
kk AS (SELECT symbol, r, count(*) FILTER (h = 1) AS a, count(*) FILTER (h = 2) AS b FROM h GROUP BY ALL), kd AS (SELECT symbol, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY symbol) - sum(b) OVER w / sum(b) OVER (PARTITION BY symbol)) AS d FROM kk WINDOW w AS (PARTITION BY symbol ORDER BY r))"""
add("V22_psi_ks", lambda s, d: (lambda x: st.population_stability(x.filter("h = 1"), x.filter("h = 2"), "symbol", "r"))(halves(s, d)).select("symbol", "psi", "ks"), "bars", PSI + f" SELECT symbol, {r('any_value(psi) AS psi', 'max(d) AS ks')} FROM ps JOIN kd USING (symbol) GROUP BY symbol")
add("V22_drift", lambda s, d: (lambda x: st.drift(x.filter("h = 1"), x.filter("h = 2")))(halves(s, d)))


def _factor(s, d):
    day = trades(s, d).select("symbol", F.to_date("exit_ts").alias("day"), (F.col("return_pct") / 100).alias("r")).groupBy("symbol", "day").agg(F.avg("r").alias("r"))
    return day.join(day.groupBy("day").agg(F.avg("r").alias("b")), "day")


DAY = ", dd AS (SELECT symbol, CAST(exit_ts AS DATE) AS day, avg(return_pct / 100) AS r FROM trades GROUP BY ALL), f AS (SELECT dd.*, avg(r) OVER (PARTITION BY day) AS b FROM dd)"
add("V24_attribution", lambda s, d: st.attribution(_factor(s, d), "symbol", "r", "b"), "trades", DAY + f" SELECT symbol, {r('regr_slope(r, b) AS beta', 'regr_intercept(r, b) AS alpha', 'regr_r2(r, b) AS r2', 'exp(sum(ln(1 + r))) - 1 AS total', 'corr(r, b) AS corr', 'covar_samp(r, b) AS cov')} FROM f GROUP BY 1")
add("X13_compounding", lambda s, d: returns(s, d).groupBy("strategy_id").agg((F.product(1 + F.col("r")) - 1).alias("total")), "returns", f"SELECT strategy_id, {r('product(1 + r) - 1 AS total')} FROM returns GROUP BY 1")
add("X4_percentiles", lambda s, d: trades(s, d).groupBy("symbol").agg(F.median("return_pct").alias("median"), F.percentile("return_pct", 0.9).alias("p90"), F.count_if(F.col("return_pct") > 5).alias("tail")), "trades", f"SELECT symbol, {r('median(return_pct) AS median', 'quantile_cont(return_pct, 0.9) AS p90')}, count(*) FILTER (return_pct > 5) AS tail FROM trades GROUP BY 1")
add("X5_slope", lambda s, d: returns(s, d).groupBy("strategy_id").agg(F.regr_slope("r", "t").alias("slope"), st.correlation("r", "t").alias("corr")), "returns", f"SELECT strategy_id, {r('regr_slope(r, t) AS slope', 'corr(r, t) AS corr')} FROM returns GROUP BY 1")
add("X6_dates", lambda s, d: trades(s, d).groupBy(F.date_format("exit_ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.datediff("exit_ts", "entry_ts")).alias("days")), "trades", "SELECT strftime(exit_ts, '%Y-%m') AS month, count(*) AS n, CAST(sum(date_diff('day', entry_ts, exit_ts)) AS BIGINT) AS days FROM trades GROUP BY 1")
# kernels in numpy, one series a group
add("V9_garch", lambda s, d: scans.garch(bars_r(s, d), "symbol", "ts", "r"))
add("V15_permutation_test", lambda s, d: kernels.permutation_test(bars_r(s, d), "symbol", "ts", "r"))
GRID = lambda cells: kernels.cross_grid_sql(cells)
add("V17_latency", lambda s, d: kernels.latency(hourly(s, d)), "bars", GRID(kernels.LATENCY_CELLS) + f", l AS (SELECT *, first_value(metric) OVER (PARTITION BY symbol ORDER BY delay) AS base FROM grid), q AS (SELECT symbol, delay, metric, CASE WHEN delay > 0 AND abs(base) > 1e-12 THEN (base - metric) / abs(base) / delay END AS loss_per_bar FROM l) SELECT symbol, delay, {r('metric', 'loss_per_bar')}, coalesce(loss_per_bar, 0) > 0.2 AS fragile FROM q")
add("V18_slippage_stress", lambda s, d: kernels.slippage_stress(hourly(s, d)), "bars", GRID(kernels.SLIPPAGE_CELLS) + f", l AS (SELECT *, round(cost / 0.001, 6) AS factor FROM grid), p AS (SELECT *, lag(mean) OVER w AS pm, lag(factor) OVER w AS pf FROM l WINDOW w AS (PARTITION BY symbol ORDER BY factor)) SELECT symbol, {r('factor', 'mean', 'metric', 'CASE WHEN pm > 0 AND mean <= 0 THEN pf + (factor - pf) * pm / (pm - mean) END AS break_even')} FROM p")
add("V19_combined_stress", lambda s, d: kernels.combined_stress(hourly(s, d)), "bars", GRID(kernels.STRESS_CELLS) + f", l AS (SELECT symbol, delay, {', '.join(f'max(mean) FILTER (round(cost / 0.001) = {k}) AS cost_{k}' for k in (1, 2, 3))} FROM grid GROUP BY ALL), v AS (SELECT symbol, 100.0 * count(*) FILTER (mean > 0) / count(*) AS survival_pct FROM grid GROUP BY symbol) SELECT symbol, delay, {r('cost_1', 'cost_2', 'cost_3', 'survival_pct')} FROM l JOIN v USING (symbol)")
add("V20_parameter_sweep", lambda s, d: kernels.parameter_sweep(hourly(s, d)), "bars", GRID(kernels.SWEEP_CELLS) + f", l AS (SELECT symbol, fast, round(metric, 9) AS m FROM grid), p AS (SELECT *, abs(m - lag(m) OVER (PARTITION BY symbol ORDER BY fast)) AS step FROM l) SELECT symbol, first(fast ORDER BY m DESC NULLS LAST, fast) AS best, {r('max(m) AS metric', 'avg(step) AS mean_step')} FROM p GROUP BY symbol")
add("V21_heat_map", lambda s, d: kernels.heat_map(hourly(s, d)), "bars", GRID(kernels.HEAT_CELLS) + f", l AS (SELECT symbol, fast, slow, round(metric, 9) AS m FROM grid), p AS (SELECT *, greatest(abs(m - lag(m) OVER (PARTITION BY symbol, fast ORDER BY slow)), abs(m - lag(m) OVER (PARTITION BY symbol, slow ORDER BY fast))) AS step, max(m) OVER (PARTITION BY symbol) AS top FROM l) SELECT symbol, first(fast ORDER BY m DESC NULLS LAST, fast, slow) AS fast, first(slow ORDER BY m DESC NULLS LAST, fast, slow) AS slow, {r('max(m) AS metric', '100.0 * count(*) FILTER (m >= 0.9 * top) / count(*) AS plateau_pct', 'max(step) AS cliff')} FROM p GROUP BY symbol")
add("V23_extreme_value", lambda s, d: kernels.extreme_value(returns(s, d)))
add("V25_feature_table", lambda s, d: st.distribution(returns(s, d)).join(st.value_at_risk(returns(s, d)), "strategy_id").join(st.losing_streak(returns(s, d), "strategy_id", ["t"], "r"), "strategy_id", "left"))
