"""Scalar families, hooks, batches and searches that compose the operators."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import cross_grid, cross_grid_sql
from ..functions.normal import chi2_sf_even, norm_cdf, norm_pdf, norm_ppf
from ..functions.statistics import distribution, pass_rate
from ..operators.bars import resample
from ..operators.reports import asset_class
from ..operators.simulate import RULES, simulate
from ..sources import files
from ..sources.storage import cut
from ..sources.views import SYMBOLS, results, returns, strategies, table, trades
from ..sql import with_views
from .common import duck_normal, rounded
from .market import hourly
from .results_queries import CLASS, r
from .stats_queries import MOM
from .trading_queries import _signals

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str = "", sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = with_views(views, sql)


add("X1_clip", lambda s, d: trades(s, d).groupBy("symbol").agg(F.avg(F.least(F.greatest("return_pct", F.lit(-5.0)), F.lit(5.0))).alias("clipped")), "trades", f"SELECT symbol, {r('avg(least(greatest(return_pct, -5.0), 5.0)) AS clipped')} FROM trades GROUP BY 1")
NUMERIC = "SELECT strategy_id, symbol, total_trades AS n, win_rate / 100 AS p, total_return_pct AS x FROM results"
add("X2_numeric", lambda s, d: results(s, d).select("strategy_id", "symbol", F.log(F.col("total_trades").cast("double")).alias("ln"), F.sqrt(F.col("total_trades").cast("double")).alias("root"), F.pow(F.col("total_trades").cast("double"), F.lit(0.6)).alias("power"), F.sinh(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("total_return_pct")))).alias("sinh"), F.when((F.col("win_rate") > 0) & (F.col("win_rate") < 100), F.log(F.try_divide(F.col("win_rate"), 100 - F.col("win_rate")))).alias("logit")), "results", f", v AS ({NUMERIC}) SELECT strategy_id, symbol, {r('ln(n) AS ln', 'sqrt(n) AS root', 'pow(n, 0.6) AS power', 'sinh(greatest(-3.0, least(3.0, x))) AS sinh', 'CASE WHEN p > 0 AND p < 1 THEN ln(p / (1 - p)) END AS logit')} FROM v")
JB = "g.n / 6 * (skew * skew + kurt * kurt / 4)"
add("X3_chi_squared", lambda s, d: distribution(returns(s, d)).filter("jb is not null").select("strategy_id", chi2_sf_even(F.col("jb"), 2).alias("p2"), chi2_sf_even(F.col("jb"), 4).alias("p4")), "returns", MOM + f", j AS (SELECT strategy_id, {JB} AS x FROM g) SELECT strategy_id, {r('exp(-x / 2) AS p2', 'exp(-x / 2) * (1 + x / 2) AS p4')} FROM j WHERE x IS NOT NULL")
add("X3_normal", lambda s, d: results(s, d).filter("abs(sharpe_ratio) < 100").select("strategy_id", "symbol", norm_cdf(F.col("sharpe_ratio") / 5.0).alias("cdf"), norm_pdf(F.col("sharpe_ratio") / 5.0).alias("pdf"), norm_ppf(F.col("win_rate") / 100).alias("quantile")).withColumn("back", norm_cdf("quantile")).drop("quantile"), "results", f", z AS (SELECT strategy_id, symbol, sharpe_ratio / 5 AS z, win_rate / 100 AS w FROM results WHERE abs(sharpe_ratio) < 100) SELECT strategy_id, symbol, {r(duck_normal('z') + ' AS cdf', 'exp(-z * z / 2) / sqrt(2 * pi()) AS pdf', 'CASE WHEN w > 0 AND w < 1 THEN w END AS back')} FROM z")
add("X7_time_zones", lambda s, d: trades(s, d).select(F.from_utc_timestamp(F.col("entry_ts") + F.expr("INTERVAL 90 MINUTES"), "Asia/Tokyo").alias("t")).groupBy(F.hour("t").alias("hour")).count(), "trades", "SELECT CAST(hour(entry_ts + INTERVAL 90 MINUTE + INTERVAL 9 HOUR) AS INTEGER) AS hour, count(*) AS count FROM trades GROUP BY 1")
add("X8_strings", lambda s, d: strategies(s, d).select("strategy_id", F.upper("name").alias("u"), F.replace("name", F.lit(" "), F.lit("-")).alias("dashed"), F.concat_ws("/", F.split("name", " ")).alias("joined"), F.substring("name", 1, 3).alias("head"), F.startswith("name", F.lit("red")).alias("red")), "strategies", "SELECT strategy_id, upper(name) AS u, replace(name, ' ', '-') AS dashed, array_to_string(string_split(name, ' '), '/') AS joined, substr(name, 1, 3) AS head, starts_with(name, 'red') AS red FROM strategies")
add("X9_case", lambda s, d: strategies(s, d).select("strategy_id", F.coalesce("parent_id", F.lit(-1)).alias("parent"), (F.col("status") == "active").cast("int").alias("active")), "strategies", "SELECT strategy_id, coalesce(parent_id, -1) AS parent, CAST(status = 'active' AS INTEGER) AS active FROM strategies")
add("X10_json", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k INT").alias("j")).select("event_id", F.col("j.k").alias("k"), F.to_json("j").alias("again"), F.size(F.map_keys(F.create_map(F.lit("k"), F.col("j.k")))).alias("keys")), "ticks", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS INTEGER) || '}' AS again, 1 AS keys FROM events""")
add("X12_hashes", lambda s, d: strategies(s, d).select("strategy_id", F.substring(F.sha2("name", 256), 1, 16).alias("short"), F.md5("name").alias("m")), "strategies", "SELECT strategy_id, substr(sha256(name), 1, 16) AS short, md5(name) AS m FROM strategies")
FILES = "SELECT DISTINCT '/data/' || lower(symbol) || '_' || timeframe || '.csv' AS path, symbol FROM results"


def _symbol_files(s, d):
    """The file of each symbol among those that results were made of, named by symbol and timeframe."""
    seen = results(s, d).select("symbol", "timeframe").distinct()
    paths = seen.select(F.concat(F.lit("/data/"), F.lower("symbol"), F.lit("_"), "timeframe", F.lit(".csv")).alias("path"))
    names = s.createDataFrame([(x, files.spellings(x)) for x in SYMBOLS], "symbol string, spellings array<string>")
    return files.resolve_files(paths, seen.select("symbol").distinct().join(F.broadcast(names), "symbol"))


add("S2_symbol_files", _symbol_files, "results", f", f AS ({FILES}) SELECT symbol, min(path) AS path FROM f GROUP BY symbol")
add("S13_asset_router", lambda s, d: trades(s, d).groupBy("symbol").agg(F.max(asset_class("symbol")).alias("asset_class")), "trades", f"SELECT symbol, max({CLASS}) AS asset_class FROM trades GROUP BY 1")


def _batch(s, d):
    """The cross of moving averages for every symbol and timeframe."""
    h = cut(hourly(s, d), "bars")
    out = None
    for tf in ("1hour", "4hour", "1day"):
        g = cross_grid(h if tf == "1hour" else resample(h, tf), [(10, 30, 0, 0.0)]).withColumn("timeframe", F.lit(tf))
        out = g if out is None else out.unionByName(g)
    return out.select("symbol", "timeframe", "mean", "metric")


COARSER = {"4hour": "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01')", "1day": "date_trunc('day', ts)"}
_each = "".join(f", b_{tf} AS (SELECT symbol, {t} AS ts, last(close ORDER BY bars.ts) AS close FROM bars GROUP BY symbol, {t})" for tf, t in COARSER.items())
_grids = "".join(re.sub(r"\b(g\d|grid)\b", rf"\1_{tf}", cross_grid_sql([(10, 30, 0, 0.0)], "bars" if tf == "1hour" else f"b_{tf}")) for tf in ("1hour", *COARSER))
add("B-3_batch", _batch, "bars", _each + _grids + " " + " UNION ALL ".join(f"SELECT symbol, '{tf}' AS timeframe, {r('mean', 'metric')} FROM grid_{tf}" for tf in ("1hour", *COARSER)))


def _rule_trades(s, d):
    sig = _signals(s, d).select("symbol", "ts", "open", "high", "low", "close", "signal")
    out = None
    for rule in RULES:
        t = simulate(sig, rule).withColumn("rule", F.lit(rule))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("rule", "reason").agg(F.count(F.lit(1)).alias("trades"), F.avg(F.col("exit") / F.col("entry") - 1).alias("mean_return"), F.avg("bars").alias("mean_bars"))


add("B-4_trade_union", _rule_trades)


BUDGET = 12


def _grid(s, d, tried: list[tuple[int, int]]):
    """Mean metric of every tried (fast, slow), in one pass over the bars."""
    return cross_grid(hourly(s, d), [(f, w, 0, 0.0) for f, w in tried]).groupBy("fast", "slow").agg(F.avg("metric").alias("objective"))


def _search(s, d):
    """A search with a budget of evaluations: four corners first, then halving steps around the best so far."""
    known: dict[tuple[int, int], float] = {}
    ask, step = [(5, 20), (5, 50), (20, 30), (20, 50)], 8
    while ask and len(known) < BUDGET:
        for row in _grid(s, d, ask[: BUDGET - len(known)]).collect():
            known[row["fast"], row["slow"]] = row["objective"] if row["objective"] is not None else float("-inf")
        (f, w), step = max(known, key=lambda k: (known[k], (-k[0], -k[1]))), step // 2
        ask = [p for p in ((f + step, w), (f - step, w), (f, w + step), (f, w - step)) if step and 1 < p[0] < p[1] and p not in known]
    best = max(known.values())
    rows = [(i + 1, *k, v if v > float("-inf") else None, v == best) for i, (k, v) in enumerate(known.items())]
    return s.createDataFrame(rows, "trial int, fast int, slow int, objective double, best boolean")


TRIED = [(5, 20), (5, 30), (10, 30), (10, 50), (20, 50)]
add("B-5_parameter_objective", lambda s, d: _grid(s, d, TRIED), "bars", cross_grid_sql([(f, w, 0, 0.0) for f, w in TRIED]) + f" SELECT fast, slow, {r('avg(metric) AS objective')} FROM grid GROUP BY fast, slow")
add("P21_budgeted_search", _search)
KEY = "((sim * 1103515 + t * 12345 + 6789) % 1000003 * 7919 + sim * 31 + t * 17) % 999983 % 999983 + 1"
add("K10_pass_rate", lambda s, d: pass_rate(returns(s, d)), "returns", f", x AS (SELECT *, {KEY} AS key FROM returns, generate_series(1, 1000) g(sim)), e AS (SELECT *, sum(r) OVER w AS e, row_number() OVER w AS place FROM x WINDOW w AS (PARTITION BY strategy_id, sim ORDER BY key, t ROWS UNBOUNDED PRECEDING)), g AS (SELECT strategy_id, sim, min(place) FILTER (round(e, 9) >= 0.1) AS hit, min(place) FILTER (round(e, 9) <= -0.1) AS ruin FROM e GROUP BY ALL) SELECT strategy_id, {r('count(*) FILTER (hit < coalesce(ruin, 1 << 30)) / count(*) AS pass_rate')} FROM g GROUP BY 1")


def _hook(s, d):
    """A caller's metric of a series as a grouped aggregate."""

    def metric(x: pd.Series) -> float:
        return float(x.quantile(0.75) - x.quantile(0.25))

    return returns(s, d).groupBy("strategy_id").agg(F.pandas_udf(metric, T.DoubleType())("r").alias("spread"))


add("D1_metric_hook", _hook, "returns", f"SELECT strategy_id, {r('quantile_cont(r, 0.75) - quantile_cont(r, 0.25) AS spread')} FROM returns GROUP BY 1")
add("D9_events_of_trades", lambda s, d: trades(s, d).select("strategy_id", F.explode(F.array(F.struct(F.lit("entry").alias("kind"), F.col("entry_ts").alias("ts")), F.struct(F.lit("exit").alias("kind"), F.col("exit_ts").alias("ts")))).alias("e")).groupBy("strategy_id", "e.kind").agg(F.count(F.lit(1)).alias("n"), F.max("e.ts").alias("last")), "trades", "SELECT strategy_id, kind, count(*) AS n, max(ts) AS last FROM (SELECT strategy_id, 'entry' AS kind, entry_ts AS ts FROM trades UNION ALL SELECT strategy_id, 'exit', exit_ts FROM trades) GROUP BY ALL")
