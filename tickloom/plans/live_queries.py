"""Queries of live control, streams and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import control as ctl
from ..sources import files
from ..sources.views import results, returns, strategies, ticks, trades
from ..sql import with_views
from ..streaming import live
from .common import rounded
from .results_queries import r

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str = "", sql: str = "") -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = with_views(views, sql)


METRICS = """SELECT strategy_id, round(avg(return_pct) FILTER (WHERE return_pct < 0) * -0.4 + 3.05e-8, 6) AS daily_loss, round(stddev_samp(return_pct) + 3.05e-8, 6) AS weekly_loss, round(max(return_pct) * 0.9 + 3.05e-8, 6) AS monthly_loss,
  round(sum(CASE WHEN return_pct < 0 THEN -return_pct ELSE 0 END) / 3 + 3.05e-8, 6) AS drawdown, {count} AS losses, round(avg(return_pct) + 3.05e-8, 6) AS live_sharpe, round(max(abs(return_pct)) / nullif(avg(abs(return_pct)), 0) + 3.05e-8, 6) AS vol_ratio,
  round(max(abs(size)) * 0.4 + 3.05e-8, 6) AS position_pct, count(*) AS trades, {days} AS days, round(abs(avg(return_pct)) / 4 + 3.05e-8, 6) AS degradation,
  CASE strategy_id % 5 WHEN 0 THEN 'research' WHEN 1 THEN 'paper' WHEN 2 THEN 'live' WHEN 3 THEN 'paused' ELSE 'review' END AS state FROM trades GROUP BY strategy_id"""
DUCK = METRICS.format(count="count(*) FILTER (WHERE return_pct < 0) // 2", days="count(DISTINCT CAST(entry_ts AS DATE))")


def metrics(s, d):
    """Live figures of each strategy, made from its trades."""
    text = METRICS.format(count="count(*) FILTER (WHERE return_pct < 0) div 2", days="count(DISTINCT to_date(entry_ts))")
    return s.sql(text.replace("FROM trades", "FROM {trades}"), trades=trades(s, d))


HIT = "list_max(list_filter([" + ", ".join(f"CASE WHEN {c} THEN struct_pack(rank := {k}, ord := {-i}, rule := '{n}', action := '{a}') END" for i, (n, c, k, a) in enumerate(ctl.RULES)) + "], lambda x: x IS NOT NULL))"
add("R5_kill_switch", lambda s, d: ctl.kill_switch(metrics(s, d)).select("strategy_id", "action", "rule", "severity", "multiplier"), "trades", f", m AS ({DUCK}), h AS (SELECT strategy_id, {HIT} AS h FROM m) SELECT strategy_id, coalesce(h.action, 'NONE') AS action, h.rule AS rule, coalesce(h.rank, 0) AS severity, CASE h.action WHEN 'LIQUIDATE' THEN 0.0::DOUBLE WHEN 'REDUCE' THEN 0.5 ELSE 1.0 END AS multiplier FROM h")
add("R6_kill_actions", lambda s, d: ctl.kill_switch(metrics(s, d)).groupBy("action").count(), "trades", f", m AS ({DUCK}), h AS (SELECT {HIT} AS h FROM m) SELECT coalesce(h.action, 'NONE') AS action, count(*) AS count FROM h GROUP BY 1")
HEALTH = "greatest(CASE WHEN drawdown > 20 THEN 2 WHEN drawdown > 10 THEN 1 ELSE 0 END, CASE WHEN live_sharpe < 0 AND days >= 10 THEN 2 WHEN live_sharpe < 0.3 AND days >= 10 THEN 1 ELSE 0 END, CASE WHEN losses >= 8 THEN 2 ELSE 0 END)"
add("R7_health", lambda s, d: metrics(s, d).select("strategy_id", ctl.health_name(ctl.health()).alias("health")), "trades", f", m AS ({DUCK}) SELECT strategy_id, ['healthy', 'degraded', 'critical'][{HEALTH} + 1] AS health FROM m")
BAD = "(degradation > 0.5 OR drawdown > 20 OR losses >= 10)"
NEXT = f"CASE WHEN state = 'paper' AND days >= 30 AND degradation <= 0.2 AND drawdown < 20 AND trades >= 20 THEN 'live' WHEN state = 'live' AND drawdown > 25 THEN 'paused' WHEN state = 'live' AND {BAD} THEN 'review' WHEN state = 'paused' AND NOT {BAD} THEN 'live' WHEN state = 'review' AND days > 30 THEN 'retired' ELSE state END"
add("R9_lifecycle", lambda s, d: ctl.apply_transitions(metrics(s, d), s).select("strategy_id", "state", "new_state"), "trades", f", m AS ({DUCK}) SELECT strategy_id, state, {NEXT} AS new_state FROM m")
ALLOWED = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in ctl.TRANSITIONS.items() for b in bs) + ") t(state, new_state)"
add("R9_allowed_transitions", lambda s, d: ctl.apply_transitions(metrics(s, d), s).groupBy("state", "new_state").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(ctl.transitions(s).toDF("state", "new_state").withColumn("ok", F.lit(True))), ["state", "new_state"], "left").select("state", "new_state", "n", (F.coalesce("ok", F.lit(False)) | (F.col("state") == F.col("new_state"))).alias("allowed")), "trades", f", m AS ({DUCK}), x AS (SELECT state, {NEXT} AS new_state, count(*) AS n FROM m GROUP BY ALL) SELECT x.state, x.new_state, n, t.state IS NOT NULL OR x.state = x.new_state AS allowed FROM x LEFT JOIN {ALLOWED} ON x.state = t.state AND x.new_state = t.new_state")
PAIR = ", p AS (SELECT strategy_id, round(avg(r) FILTER (WHERE t <= n // 2) + 3e-11, 9) AS a, round(avg(r) FILTER (WHERE t > n // 2) + 3e-11, 9) AS b FROM (SELECT *, max(t) OVER (PARTITION BY strategy_id) AS n FROM returns) GROUP BY 1), g AS (SELECT *, CASE WHEN abs(a) > 1e-9 THEN (b - a) / abs(a) * 100 END AS g FROM p)"


def _halves(s, d):
    return s.sql("SELECT strategy_id, round(avg(r) FILTER (WHERE t <= n div 2) + 3e-11, 9) AS a, round(avg(r) FILTER (WHERE t > n div 2) + 3e-11, 9) AS b FROM (SELECT *, max(t) OVER (PARTITION BY strategy_id) AS n FROM {returns}) GROUP BY 1", returns=returns(s, d))


add("R10_retrain_decision", lambda s, d: _halves(s, d).select("strategy_id", ctl.retrain_decision(F.col("a"), F.col("b")).alias("decision")), "returns", PAIR + " SELECT strategy_id, CASE WHEN g >= 5 THEN 'adopt' WHEN g <= -10 THEN 'abort' WHEN abs(g) < 5 THEN 'keep' ELSE 'review' END AS decision FROM g")
add("R10_windows", lambda s, d: trades(s, d).groupBy("strategy_id").agg(F.to_date(F.max("exit_ts")).alias("today"), F.to_date(F.min("entry_ts")).alias("start")).select("strategy_id", *[F.datediff(F.col("today"), ctl.retrain_window(k, F.col("today"), F.col("start"))).cast("long").alias(k) for k in ("rolling", "expanding", "anchored")]), "trades", ", g AS (SELECT strategy_id, CAST(max(exit_ts) AS DATE) AS today, CAST(min(entry_ts) AS DATE) AS start FROM trades GROUP BY 1) SELECT strategy_id, 365::BIGINT AS rolling, date_diff('day', start, today) AS expanding, date_diff('day', date_trunc('year', start), today) AS anchored FROM g")
add("R10_interval", lambda s, d: metrics(s, d).groupBy(ctl.interval_days(F.col("vol_ratio")).alias("days")).count(), "trades", f", m AS ({DUCK}) SELECT CASE WHEN vol_ratio > 1.5 THEN 3 WHEN vol_ratio < 1 / 1.5 THEN 14 ELSE 7 END AS days, count(*) AS count FROM m GROUP BY 1")
CYCLE = "CASE WHEN degradation > 0.6 THEN 'demote' WHEN degradation > 0.3 THEN 'flag' WHEN losses >= 8 THEN 'retrain' ELSE 'keep' END"
add("R11_learning_cycle", lambda s, d: metrics(s, d).groupBy(F.expr(CYCLE).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.avg("degradation").alias("mean")), "trades", f", m AS ({DUCK}) SELECT {CYCLE} AS step, count(*) AS n, {r('avg(degradation) AS mean')} FROM m GROUP BY 1")
add("R12_metric_trend", lambda s, d: returns(s, d).groupBy("strategy_id").agg(F.count(F.lit(1)).cast("int").alias("points"), F.max_by("r", "t").alias("last")), "returns", f"SELECT strategy_id, CAST(count(*) AS INTEGER) AS points, {r('max_by(r, t) AS last')} FROM returns GROUP BY 1")
BARS = "SELECT symbol, date_trunc('hour', ts) AS ts, round(first(price ORDER BY ticks.ts, tick_id), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(last(price ORDER BY ticks.ts, tick_id), 6) AS close, count(*) AS ticks FROM ticks GROUP BY symbol, date_trunc('hour', ts)"
add("R1_stream_bars", lambda s, d: live.latest(live.run_available(live.stream_bars(live.tick_stream(s, d))), ["symbol", "ts"]), "ticks", BARS)
add("R3_stream_drift", lambda s, d: live.latest(live.run_available(live.stream_drift(live.tick_stream(s, d), 50.0, 50.0)), ["symbol"]))
add("R4_stream_paper", lambda s, d: live.latest(live.run_available(live.stream_paper(live.tick_stream(s, d), 20.0, 60.0)), ["symbol"]))


def _live(s, d):
    """The loop over ticks: the account that the signals make and the drift beside it, and what the kill rules say to both."""
    account = live.latest(live.run_available(live.stream_paper(live.tick_stream(s, d), 20.0, 60.0)), ["symbol"])
    drift = live.latest(live.run_available(live.stream_drift(live.tick_stream(s, d), 50.0, 50.0)), ["symbol"]).select("symbol", "cusum_up", "cusum_down")
    drifted = F.greatest("cusum_up", "cusum_down") > 5
    return account.join(drift, "symbol").select("symbol", "fills", "cash", F.when(F.col("cash") < 900, "LIQUIDATE").when(drifted, "PAUSE").otherwise("NONE").alias("action"))


add("R2_live_loop", _live)
add("R8_daily_rollover", lambda s, d: ticks(s, d).groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("ticks"), F.sum("price").alias("turnover")).select("symbol", F.col("w.start").alias("day"), "ticks", "turnover"), "ticks", f"SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS ticks, {r('sum(price) AS turnover')} FROM ticks GROUP BY ALL")
SESSIONS = "SELECT symbol, min(ts) AS start, count(*) AS ticks, round(sum(price) + 3.05e-8, 6) + 0.0 AS turnover FROM (SELECT *, sum(CASE WHEN ts < prev + INTERVAL 30 MINUTE THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts, tick_id) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY symbol ORDER BY ts, tick_id) AS prev FROM ticks)) GROUP BY symbol, n"
add("R14_sessions", lambda s, d: live.stream_sessions(ticks(s, d)), "ticks", SESSIONS)

# stored tables
add("S15_upsert", lambda s, d: files.upsert(strategies(s, d).select("strategy_id", "status"), strategies(s, d).filter("strategy_id % 10 = 0").select("strategy_id", F.lit("updated").alias("status")), ["strategy_id"]), "strategies", "SELECT strategy_id, CASE WHEN strategy_id % 10 = 0 THEN 'updated' ELSE status END AS status FROM strategies")
add("S23_synthetic_bars", lambda s, d: files.synthetic_walks(ticks(s, d).select("symbol").distinct(), 200), "ticks", f", y AS (SELECT symbol, ('0x' || substr(md5(symbol), 1, 6))::BIGINT % 1000 AS k FROM (SELECT DISTINCT symbol FROM ticks)), g AS (SELECT symbol, i, (i * (7919 + k) + 104729 + k) % 1000 / 1000.0::DOUBLE - 0.5 AS n FROM y, generate_series(0, 199) t(i)), c AS (SELECT symbol, i, 100 + sum(n) OVER (PARTITION BY symbol ORDER BY i) AS close FROM g) SELECT symbol, TIMESTAMP '2020-01-01' + to_days(CAST(i AS INTEGER)) AS ts, {r('close', 'close + 0.6 AS high', 'close - 0.6 AS low')} FROM c")
add("S28_schema_evolution", lambda s, d: strategies(s, d).select("strategy_id").unionByName(results(s, d).select("strategy_id", "symbol"), allowMissingColumns=True), "strategies results", "SELECT strategy_id, NULL::VARCHAR AS symbol FROM strategies UNION ALL SELECT strategy_id, symbol FROM results")
add("S7_merge_years", lambda s, d: files.merge_years(trades(s, d).select("symbol", F.col("entry_ts").alias("ts"), F.col("order_key").alias("year"), F.lit(1).alias("one"))).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars")), "trades", "SELECT symbol, count(DISTINCT entry_ts) AS bars FROM trades GROUP BY 1")
