"""Queries over stored results and strategy families: filters, joins, aggregates, rankings, lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lineage as lin
from ..operators import reports as rep
from ..operators.regimes import classify
from ..operators.scans import asof
from ..sources.views import results, strategies, table, trades
from ..sql import ORDER, with_views
from .common import SHIFT, rounded
from .market import STEPS, hourly

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str, sql: str, recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    ORACLE[name] = with_views(views, sql, recursive)


def on_results(name: str, make, sql: str) -> None:
    add(name, lambda s, d: make(results(s, d)), "results", sql)


def on_both(name: str, make, sql: str) -> None:
    add(name, lambda s, d: make(strategies(s, d), results(s, d)), "strategies results", sql)


def r(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]} + {SHIFT}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


KEY = ["strategy_id", "symbol"]
CLASS = """CASE WHEN symbol IN ('BTCUSDT', 'ETHUSDT') THEN 'crypto' WHEN symbol IN ('EURUSD', 'GBPUSD', 'USDJPY') THEN 'forex' WHEN symbol = 'SPX500' THEN 'index' WHEN symbol = 'XAUUSD' THEN 'metal' ELSE 'unknown' END"""

# filters
on_results("F1_filter_strategy", lambda t: rep.filtered(t, symbol="EURUSD", variant="variant_03").select(*KEY, "variant_id", "total_return_pct"), f"SELECT strategy_id, symbol, variant_id, {r('total_return_pct')} FROM results WHERE symbol = 'EURUSD' AND variant_id = 'variant_03'")
on_results("F2_variant_results", lambda t: t.filter("variant_id = 'variant_02'").orderBy(F.desc("total_return_pct")).select(*KEY, "total_return_pct"), f"SELECT strategy_id, symbol, {r('total_return_pct')} FROM results WHERE variant_id = 'variant_02'")
on_results("F3_sharpe_above", lambda t: t.filter("sharpe_ratio > 1.0").select(*KEY, "sharpe_ratio"), f"SELECT strategy_id, symbol, {r('sharpe_ratio')} FROM results WHERE sharpe_ratio > 1.0")
on_results("F4_strong_performers", lambda t: rep.strong(t, 2.0, 6).select(*KEY, "sharpe_ratio", "total_trades"), f"SELECT strategy_id, symbol, {r('sharpe_ratio')}, total_trades FROM results WHERE sharpe_ratio > 2.0 AND total_trades >= 6")
on_results("F5_timeframe_symbol", lambda t: rep.filtered(t, timeframe="1hour", symbol="USDJPY").select(*KEY, "timeframe"), "SELECT strategy_id, symbol, timeframe FROM results WHERE timeframe = '1hour' AND symbol = 'USDJPY'")
on_results("F6_asset_class", lambda t: t.filter(rep.asset_class("symbol") == "crypto").select(*KEY), "SELECT strategy_id, symbol FROM results WHERE symbol IN ('BTCUSDT', 'ETHUSDT')")
add("F7_unprocessed_oldest", lambda s, d: table(s, d, "documents").filter("source = 'src1'").orderBy("doc_id").limit(20).select("doc_id", "source"), "ticks", "SELECT doc_id, source FROM documents WHERE source = 'src1' ORDER BY doc_id LIMIT 20")
on_both("F8_ready_for_backtest", lambda a, b: a.filter("status = 'active' AND origin <> 'manual' AND cost > 1000").select("strategy_id", "origin", "status"), "SELECT strategy_id, origin, status FROM strategies WHERE status = 'active' AND origin <> 'manual' AND cost > 1000")
on_both("F9_by_status", lambda a, b: a.filter("status = 'retired'").select("strategy_id", "name"), "SELECT strategy_id, name FROM strategies WHERE status = 'retired'")
on_both("F10_pipeline_eligible", lambda a, b: a.filter("strategy_id % 13 <> 0 AND (level > 3 OR origin = 'manual') AND coalesce(status NOT IN ('retired', 'rejected'), true)").select("strategy_id"), "SELECT strategy_id FROM strategies WHERE strategy_id % 13 <> 0 AND (level > 3 OR origin = 'manual') AND coalesce(status NOT IN ('retired', 'rejected'), true)")
on_both("F11_by_origin", lambda a, b: a.filter("origin = 'manual'").orderBy(F.desc("strategy_id")).limit(25).select("strategy_id", "origin"), "SELECT strategy_id, origin FROM strategies WHERE origin = 'manual' ORDER BY strategy_id DESC LIMIT 25")
on_both("F12_generation_range", lambda a, b: a.filter("level BETWEEN 2 AND 5 AND origin = 'scraped'").select("strategy_id", "level"), "SELECT strategy_id, level FROM strategies WHERE level BETWEEN 2 AND 5 AND origin = 'scraped'")
add("F13_existence", lambda s, d: table(s, d, "documents").join(table(s, d, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id"), "ticks", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
on_results("F14_metric_range", lambda t: t.withColumn("m", F.create_map(F.lit("sharpe"), "sharpe_ratio", F.lit("dd"), "max_drawdown_pct")).filter((F.coalesce(F.col("m")["sharpe"], F.lit(float("-inf"))) >= 1.5) & (F.coalesce(F.col("m")["dd"], F.lit(float("inf"))) <= 20)).select(*KEY), "SELECT strategy_id, symbol FROM results WHERE coalesce(sharpe_ratio, '-inf'::DOUBLE) >= 1.5 AND coalesce(max_drawdown_pct, 'inf'::DOUBLE) <= 20")
on_results("F15_latest_runs", lambda t: t.orderBy(F.desc("end_ts"), *KEY).limit(50).select(*KEY, "timeframe", "total_return_pct"), f"SELECT strategy_id, symbol, timeframe, {r('total_return_pct')} FROM (SELECT * FROM results ORDER BY end_ts DESC, strategy_id, symbol LIMIT 50)")
on_both("F16_update_rows", lambda a, b: a.withColumn("status", F.when(F.col("cost") < 950, "archived").otherwise(F.col("status"))).filter("status <> 'retired'").groupBy("status").count(), "SELECT CASE WHEN cost < 950 THEN 'archived' ELSE status END AS status, count(*) AS count FROM strategies WHERE CASE WHEN cost < 950 THEN 'archived' ELSE status END <> 'retired' GROUP BY 1")
on_both("F17_fuzzy_search", lambda a, b: a.filter(F.regexp_replace(F.lower("name"), " ", "").contains("redwid")).select("strategy_id", "name"), "SELECT strategy_id, name FROM strategies WHERE replace(lower(name), ' ', '') LIKE '%redwid%'")
on_results("F18_canonical", rep.canonical, f"SELECT strategy_id, symbol, {r('coalesce(sharpe_ratio, 0.0) AS sharpe', 'max_drawdown_pct / 100 AS drawdown', 'coalesce(win_rate, 50.0) / 100 AS win_share', 'coalesce(profit_factor, 1.0) AS profit_factor')}, total_trades AS trades, {r('total_return_pct AS return_pct')} FROM results")

# joins
on_both("J1_mutation_success", lin.mutation_success, f""", b AS (SELECT strategy_id, max_by(struct_pack(s := sharpe_ratio, t := total_return_pct), struct_pack(a := coalesce(sharpe_ratio, '-inf'::DOUBLE), b := symbol)) AS m FROM results GROUP BY strategy_id)
SELECT mutation_type, count(*) AS strategies, {r('avg(m.s) AS avg_sharpe', 'avg(m.t) AS avg_return')}, count(*) FILTER (status = 'promoted') AS promoted, {r("100.0 * count(*) FILTER (status = 'promoted') / count(*) AS success_pct")} FROM strategies LEFT JOIN b USING (strategy_id) GROUP BY 1""")
QUERIES["A7_mutation_success"], ORACLE["A7_mutation_success"] = QUERIES["J1_mutation_success"], ORACLE["J1_mutation_success"]
BEST = ", b AS (SELECT strategy_id, max_by(sharpe_ratio, struct_pack(a := coalesce(sharpe_ratio, '-inf'::DOUBLE), b := symbol)) AS sharpe_ratio FROM results GROUP BY strategy_id)"
on_both("J2_generation_stats", lin.generation_stats, BEST + f""", g AS (SELECT level AS generation, count(*) AS strategies, avg(sharpe_ratio) AS avg_sharpe, max(sharpe_ratio) AS best_sharpe FROM strategies LEFT JOIN b USING (strategy_id) GROUP BY 1)
SELECT generation, strategies, {r('avg_sharpe', 'best_sharpe', 'coalesce(avg_sharpe - lag(avg_sharpe) OVER (ORDER BY generation), 0.0) AS delta')} FROM g""")
for other in ("A8_generation_stats", "A22_generation_delta"):
    QUERIES[other], ORACLE[other] = QUERIES["J2_generation_stats"], ORACLE["J2_generation_stats"]
IMPROVED = BEST + ", i AS (SELECT s.strategy_id, s.parent_id, s.mutation_type, s.hypothesis_id, s.cost, c.sharpe_ratio - p.sharpe_ratio AS improvement FROM strategies s JOIN b c ON c.strategy_id = s.strategy_id JOIN b p ON p.strategy_id = s.parent_id WHERE c.sharpe_ratio IS NOT NULL AND p.sharpe_ratio IS NOT NULL)"
on_both("J4_parent_child", lambda a, b: lin.improvements(a, b).select("strategy_id", "parent_id", "improvement"), IMPROVED + f" SELECT strategy_id, parent_id, {r('improvement')} FROM i")


def _asof(spark, d):
    """Each event with the regime of the bar of its symbol that is nearest in time: the later one if two are as near."""
    bars = classify(hourly(spark, d)).select("symbol", F.unix_seconds("ts").alias("at"), "regime", F.unix_seconds("ts").alias("bar_at"))
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return asof(e, bars, "symbol", "at", ["bar_at", "regime"]).select("event_id", "symbol", "bar_at", "regime")


add("J3_asof_nearest", _asof, "bars", STEPS + """, e AS (SELECT event_id, event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS tsec FROM events),
x AS (SELECT symbol, CAST(epoch(ts) AS BIGINT) AS bar_at, regime FROM i10), p AS (SELECT e.*, x.bar_at AS pb, x.regime AS pr FROM e ASOF LEFT JOIN x ON e.symbol = x.symbol AND e.tsec >= x.bar_at),
q AS (SELECT p.*, x.bar_at AS nb, x.regime AS nr FROM p ASOF LEFT JOIN x ON p.symbol = x.symbol AND p.tsec <= x.bar_at)
SELECT event_id, symbol, CASE WHEN nb IS NULL OR tsec - pb < nb - tsec THEN pb ELSE nb END AS bar_at, CASE WHEN nb IS NULL OR tsec - pb < nb - tsec THEN pr ELSE nr END AS regime FROM q""")


def _trade_regimes(spark, d):
    x = _asof(spark, d).join(table(spark, d, "events").select("event_id", F.col("value").alias("pnl")), "event_id")
    return x.groupBy("regime").agg(F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("total"), F.avg("pnl").alias("mean"), (100.0 * F.count_if(F.col("pnl") > 50) / F.count(F.lit(1))).alias("win_pct"), F.max("pnl").alias("best"), F.min("pnl").alias("worst"))


add("A15_regime_trades", _trade_regimes, "bars", ORACLE["J3_asof_nearest"].split(STEPS)[1].replace("SELECT event_id, symbol, CASE", ", z AS (SELECT event_id, symbol, CASE", 1).join([STEPS, ""]) + f") SELECT regime, count(*) AS trades, {r('sum(value) AS total', 'avg(value) AS mean', '100.0 * count(*) FILTER (value > 50) / count(*) AS win_pct', 'max(value) AS best', 'min(value) AS worst')} FROM z JOIN events USING (event_id) GROUP BY regime")
on_results("A16_rollup_of_means", lambda t: t.groupBy("timeframe", "symbol").agg(F.avg("total_return_pct").alias("m")).groupBy("timeframe").agg(F.avg("m").alias("mean_of_means"), F.count(F.lit(1)).alias("groups")), f"SELECT timeframe, {r('avg(m) AS mean_of_means')}, count(*) AS groups FROM (SELECT timeframe, symbol, avg(total_return_pct) AS m FROM results GROUP BY ALL) GROUP BY timeframe")
add("J8_grid", lambda s, d: results(s, d).select("symbol").distinct().join(F.broadcast(results(s, d).select("timeframe").distinct()), how="cross"), "results", "SELECT symbol, timeframe FROM (SELECT DISTINCT symbol FROM results), (SELECT DISTINCT timeframe FROM results)")  # names of both, a few

# aggregates
on_results("A1_variant_summary", rep.variant_summary, f"SELECT variant_id, count(*) AS tests, {r('avg(total_return_pct) AS avg_return', 'max(total_return_pct) AS max_return', 'min(total_return_pct) AS min_return', 'avg(sharpe_ratio) AS avg_sharpe', 'avg(win_rate) AS avg_win_rate', 'avg(max_drawdown_pct) AS avg_drawdown')} FROM results WHERE variant_id IS NOT NULL GROUP BY variant_id")
on_results("A2_overall_summary", rep.overall_summary, f"SELECT count(*) AS tests, count(DISTINCT strategy_name) AS strategies, count(DISTINCT symbol) AS symbols, count(DISTINCT variant_id) AS variants, {r('avg(total_return_pct) AS avg_return', 'max(total_return_pct) AS best_return', 'min(total_return_pct) AS worst_return', 'avg(sharpe_ratio) AS avg_sharpe')} FROM results")
on_results("A3_compare_variants", rep.compare_variants, f"SELECT coalesce(variant_id, strategy_name) AS variant, min(strategy_name) AS strategy_name, count(*) AS tests, {r('avg(total_return_pct) AS avg_return', 'avg(sharpe_ratio) AS avg_sharpe', 'avg(max_drawdown_pct) AS avg_drawdown')}, count(*) FILTER (total_return_pct > 0) AS profitable FROM results GROUP BY 1")
on_results("A4_by_timeframe", rep.by_timeframe, f"SELECT timeframe, count(*) AS tests, {r('avg(total_return_pct) AS avg_return', 'avg(sharpe_ratio) AS avg_sharpe', 'avg(max_drawdown_pct) AS avg_drawdown')}, count(*) FILTER (total_return_pct > 0) AS positive FROM results GROUP BY 1")
on_results("A5_by_asset_class", rep.by_asset_class, f"SELECT {CLASS} AS asset_class, count(*) AS tests, {r('avg(total_return_pct) AS avg_return', 'avg(sharpe_ratio) AS avg_sharpe')}, count(*) FILTER (total_return_pct > 0) AS positive FROM results GROUP BY 1")
on_results("A6_variant_stats", rep.variant_stats, f"SELECT coalesce(variant_id, 'original') AS variant, count(*) AS tests, {r('coalesce(avg(total_return_pct), 0) AS avg_return', 'coalesce(max(total_return_pct), 0) AS best_return', 'coalesce(min(total_return_pct), 0) AS worst_return', 'coalesce(avg(sharpe_ratio), 0) AS avg_sharpe', 'coalesce(avg(max_drawdown_pct), 0) AS avg_drawdown')}, CAST(sum(total_trades) AS BIGINT) AS trades, {r('100.0 * count(*) FILTER (total_return_pct > 0) / count(total_return_pct) AS positive_rate')} FROM results GROUP BY 1")
on_both("A9_lineage_summary", lambda a, b: lin.lineage_summary(a), "SELECT count(*) AS total, count(*) FILTER (origin = 'scraped') AS scraped, count(*) FILTER (origin = 'manual') AS manual, count(*) FILTER (origin = 'mutation') AS mutated, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'promoted') AS promoted, count(*) FILTER (status = 'retired') AS retired, max(level) AS max_generation, count(DISTINCT parent_id) AS parents FROM strategies")
add("A10_pipeline_stats", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("scored"), F.avg("quality").alias("avg_quality"), F.min("quality").alias("min_quality"), F.max("quality").alias("max_quality"), F.count_if(F.col("toxic") == 1).alias("toxic")), "ticks", f"SELECT source, count(*) AS documents, count(quality) AS scored, {r('avg(quality) AS avg_quality')}, min(quality) AS min_quality, max(quality) AS max_quality, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
on_both("A11_status_counts", lambda a, b: a.groupBy("origin").agg(*[F.count_if(F.col("status") == x).alias(x) for x in ("active", "promoted", "retired")]), "SELECT origin, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'promoted') AS promoted, count(*) FILTER (status = 'retired') AS retired FROM strategies GROUP BY origin")
on_results("A13_batch_summary", rep.batch_summary, f"SELECT count(*) AS tests, {r('avg(total_return_pct) AS avg_return')}, count(*) FILTER (total_return_pct > 0) AS profitable, first(strategy_name ORDER BY total_return_pct DESC, strategy_id, symbol DESC) AS best, {r('max(total_return_pct) AS best_return')}, first(strategy_name ORDER BY total_return_pct, strategy_id, symbol) AS worst, {r('min(total_return_pct) AS worst_return')} FROM results")
add("A14_trade_analytics", lambda s, d: rep.trade_analytics(trades(s, d)), "trades", f", g AS (SELECT strategy_id, count(*) AS trades, greatest(date_diff('day', min(entry_ts), max(exit_ts)), 1) AS span, avg(days) AS mean_days, avg(return_pct) AS mean_return_pct, sum(days) AS days FROM trades GROUP BY 1) SELECT strategy_id, trades, {r('trades / span AS trades_per_day', 'mean_days', 'mean_return_pct', 'least(100.0, 100.0 * days / span) AS time_in_market_pct')} FROM g")
on_results("A18_multi_run", rep.multi_run, f"SELECT strategy_id, {r('coalesce(avg(nullif(sharpe_ratio, 0)), 0) AS mean_sharpe', 'max(max_drawdown_pct) AS max_drawdown')}, CAST(sum(total_trades) AS BIGINT) AS trades, {r('avg(total_return_pct) AS mean_return')} FROM results GROUP BY 1")
on_both("A20_mutation_report", lambda a, b: lin.mutation_report(lin.improvements(a, b)), IMPROVED + f" SELECT mutation_type, count(*) AS children, {r('count(*) FILTER (improvement > 0) / count(*) AS success_rate', 'avg(improvement) AS mean', 'median(improvement) AS median', 'max(improvement) AS best', 'min(improvement) AS worst', 'sum(cost) AS cost', 'sum(improvement) / sum(cost) AS roi')} FROM i GROUP BY 1")
on_both("A21_hypothesis_report", lin.hypothesis_report, BEST + f", n AS (SELECT hypothesis_id, sharpe_ratio, row_number() OVER (PARTITION BY hypothesis_id ORDER BY strategy_id) AS n FROM strategies JOIN b USING (strategy_id) WHERE sharpe_ratio IS NOT NULL) SELECT hypothesis_id, count(*) AS strategies, {r('avg(sharpe_ratio) AS avg_sharpe', 'max(sharpe_ratio) AS best_sharpe', 'regr_slope(sharpe_ratio, n) AS slope')} FROM n GROUP BY 1")
on_both("A23_mutation_weights", lambda a, b: lin.mutation_weights(lin.mutation_report(lin.improvements(a, b))), IMPROVED + f", m AS (SELECT mutation_type, greatest(count(*) FILTER (improvement > 0) / count(*) * greatest(avg(improvement) + 0.1, 0.01), 0.01) AS score FROM i GROUP BY 1) SELECT mutation_type, {r('score', 'score / sum(score) OVER () AS weight')} FROM m")
on_both("A24_best_mutation_by_symbol", lin.best_mutation_by_symbol, f", m AS (SELECT symbol, mutation_type, avg(sharpe_ratio) AS s FROM results JOIN strategies USING (strategy_id) GROUP BY ALL) SELECT symbol, first(mutation_type ORDER BY s DESC NULLS LAST, mutation_type DESC) AS mutation_type, {r('max(s) AS mean_sharpe')} FROM m GROUP BY symbol")
FAIL = "CASE WHEN total_trades < 3 THEN 'too_few_trades' WHEN total_return_pct < -5 THEN 'large_loss' WHEN max_drawdown_pct > 10 THEN 'drawdown' WHEN sharpe_ratio < 0 THEN 'negative_sharpe' WHEN win_rate < 40 THEN 'low_win_rate' END"
on_results("A25_failure_patterns", lambda t: t.withColumn("failure", F.expr(FAIL)).filter("failure is not null").groupBy("failure").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("variant_id").alias("variants")).filter("n > 2"), f"SELECT failure, count(*) AS n, count(DISTINCT variant_id) AS variants FROM (SELECT *, {FAIL} AS failure FROM results) WHERE failure IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
QUERIES["F19_failure_log"] = lambda s, d: results(s, d).withColumn("failure", F.expr(FAIL)).filter("failure is not null").select(*KEY, "failure")
ORACLE["F19_failure_log"] = with_views("results", f"SELECT strategy_id, symbol, {FAIL} AS failure FROM results WHERE {FAIL} IS NOT NULL")
LADDER = [("too_few_trades", "total_trades < 3"), ("large_loss", "total_return_pct < -5"), ("drawdown", "max_drawdown_pct > 10"), ("negative_sharpe", "sharpe_ratio < 0"), ("low_win_rate", "win_rate < 40")]
# the first rule that a result breaks, how many it breaks, and all of them
_ladder = lambda t: t.withColumn("broken", F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in LADDER]))).select(*KEY, F.try_element_at("broken", F.lit(1)).alias("failure"), F.size("broken").alias("rules"), F.concat_ws(";", "broken").alias("all_rules"))
on_results("P5_failure_ladder", _ladder, ", b AS (SELECT strategy_id, symbol, list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in LADDER) + "], lambda x: x IS NOT NULL) AS b FROM results) SELECT strategy_id, symbol, b[1] AS failure, CAST(len(b) AS INTEGER) AS rules, array_to_string(b, ';') AS all_rules FROM b")
on_both("A26_mutation_effectiveness", lambda a, b: lin.improvements(a, b).groupBy("mutation_type").agg(F.avg("improvement").alias("mean"), F.count(F.lit(1)).alias("n")), IMPROVED + f" SELECT mutation_type, {r('avg(improvement) AS mean')}, count(*) AS n FROM i GROUP BY 1")
on_both("A27_prune_hypotheses", lambda a, b: lin.prune_hypotheses(a, b, 3, 0.5), f", q AS (SELECT strategy_id, max(sharpe_ratio) AS bt, avg(sharpe_ratio) AS lv FROM results GROUP BY 1), g AS (SELECT hypothesis_id, count(*) AS strategies, count(*) FILTER (lv > 0.8 * bt) / count(*) AS holding FROM strategies JOIN q USING (strategy_id) GROUP BY 1) SELECT hypothesis_id, strategies, {r('holding')} FROM g WHERE strategies >= 3 AND holding < 0.5")
on_results("A28_compare_runs", lambda t: t.select("timeframe", F.explode(F.create_map(F.lit("sharpe"), "sharpe_ratio", F.lit("return"), "total_return_pct")).alias("metric", "v")).groupBy("timeframe", "metric").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.max("v").alias("best"), F.min("v").alias("worst"), F.count("v").alias("n")), f"SELECT timeframe, metric, {r('avg(v) AS mean', 'stddev_samp(v) AS std', 'max(v) AS best', 'min(v) AS worst')}, count(v) AS n FROM (SELECT timeframe, 'sharpe' AS metric, sharpe_ratio AS v FROM results UNION ALL SELECT timeframe, 'return', total_return_pct FROM results) GROUP BY ALL")
on_results("A29_portfolio_snapshot", lambda t: t.agg(F.sum(F.col("final_value") - F.col("initial_cash")).alias("pnl"), F.count_if(F.col("max_drawdown_pct") <= 5).alias("healthy"), F.count_if(F.col("max_drawdown_pct") > 5).alias("degraded"), F.try_divide(F.avg("total_return_pct"), F.stddev_samp("total_return_pct")).alias("pooled_sharpe"), F.max("max_drawdown_pct").alias("max_drawdown")), f"SELECT {r('sum(final_value - initial_cash) AS pnl')}, count(*) FILTER (max_drawdown_pct <= 5) AS healthy, count(*) FILTER (max_drawdown_pct > 5) AS degraded, {r('avg(total_return_pct) / stddev_samp(total_return_pct) AS pooled_sharpe', 'max(max_drawdown_pct) AS max_drawdown')} FROM results")
on_both("A30_state_counts", lambda a, b: a.groupBy("level").pivot("status", ["active", "promoted", "retired"]).count().na.fill(0), "SELECT level, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'promoted') AS promoted, count(*) FILTER (status = 'retired') AS retired FROM strategies GROUP BY level")
DECIDE = "CASE WHEN total_return_pct >= 5 THEN 'adopt' WHEN total_return_pct <= -10 THEN 'abort' WHEN abs(total_return_pct) < 5 THEN 'keep' ELSE 'review' END"
on_results("A31_retrain_summary", lambda t: t.groupBy(F.expr(DECIDE).alias("decision")).count(), f"SELECT {DECIDE} AS decision, count(*) AS count FROM results GROUP BY 1")
on_results("A32_pivot", lambda t: t.groupBy("symbol").pivot("timeframe", ["15min", "1hour", "4hour", "1day"]).agg(F.avg("total_return_pct")).select("symbol", *[F.col(f"`{x}`").alias(f"r_{x}") for x in ("15min", "1hour", "4hour", "1day")]), "SELECT symbol, " + ", ".join(r(f"avg(total_return_pct) FILTER (timeframe = '{x}') AS r_{x}") for x in ("15min", "1hour", "4hour", "1day")) + " FROM results GROUP BY symbol")
on_results("A33_funnel", rep.funnel, "SELECT count(*) AS stage_0, count(*) FILTER (total_trades >= 3) AS stage_1, count(*) FILTER (total_trades >= 3 AND total_return_pct > 0) AS stage_2, count(*) FILTER (total_trades >= 3 AND total_return_pct > 0 AND sharpe_ratio > 0.5) AS stage_3, count(*) FILTER (total_trades >= 3 AND total_return_pct > 0 AND sharpe_ratio > 0.5 AND max_drawdown_pct < 10) AS stage_4 FROM results")
on_results("A34_base_context", lambda t: t.filter("variant_id is null").groupBy("symbol").agg(F.count(F.lit(1)).alias("runs"), F.avg("total_return_pct").alias("mean"), F.percentile("total_return_pct", 0.5).alias("median")), f"SELECT symbol, count(*) AS runs, {r('avg(total_return_pct) AS mean', 'quantile_cont(total_return_pct, 0.5) AS median')} FROM results WHERE variant_id IS NULL GROUP BY 1")
on_results("A35_category_counts", lambda t: t.groupBy("timeframe", rep.asset_class("symbol").alias("asset_class")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * 350 / 1e6 * 3.0).alias("cost")), f"SELECT timeframe, {CLASS} AS asset_class, count(*) AS n, {r('count(*) * 350 / 1e6 * 3.0 AS cost')} FROM results GROUP BY ALL")
add("A36_performance_panel", lambda s, d: trades(s, d).groupBy("strategy_id").agg(F.avg(F.when(F.col("return_pct") > 0, F.col("return_pct"))).alias("avg_win"), F.avg(F.when(F.col("return_pct") < 0, F.col("return_pct"))).alias("avg_loss"), F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.try_divide(F.avg("return_pct"), F.stddev_pop(F.when(F.col("return_pct") < 0, F.col("return_pct")))))).alias("sortino")), "trades", f"SELECT strategy_id, {r('avg(return_pct) FILTER (return_pct > 0) AS avg_win', 'avg(return_pct) FILTER (return_pct < 0) AS avg_loss', 'greatest(-5.0, least(5.0, avg(return_pct) / nullif(stddev_pop(return_pct) FILTER (return_pct < 0), 0))) AS sortino')} FROM trades GROUP BY 1")


def _risk_panel(spark, d):
    t = trades(spark, d)
    g = t.groupBy("symbol").agg(F.percentile("return_pct", 0.05).alias("var95"), F.min("return_pct").alias("worst"), F.stddev_samp(F.when(F.col("return_pct") < 0, F.col("return_pct"))).alias("downside"), F.count(F.lit(1)).cast("double").alias("n"), F.skewness("return_pct").alias("sk"), F.kurtosis("return_pct").alias("ku"))
    tail = t.join(g.select("symbol", "var95"), "symbol").filter("return_pct <= var95").groupBy("symbol").agg(F.avg("return_pct").alias("cvar95"))
    n = F.col("n")
    g = g.withColumns({"skew": F.col("sk") * F.sqrt(n * (n - 1)) / (n - 2), "kurt": (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("ku") + 6)})
    return g.join(tail, "symbol").select("symbol", "var95", "cvar95", "worst", "downside", "skew", "kurt")


add("A37_risk_panel", _risk_panel, "trades", f", q AS (SELECT symbol, quantile_cont(return_pct, 0.05) AS var95, min(return_pct) AS worst, stddev_samp(return_pct) FILTER (return_pct < 0) AS downside, skewness(return_pct) AS skew, kurtosis(return_pct) AS kurt FROM trades GROUP BY 1), c AS (SELECT symbol, avg(return_pct) AS cvar95 FROM trades JOIN q USING (symbol) WHERE return_pct <= var95 GROUP BY 1) SELECT symbol, {r('var95', 'cvar95', 'worst', 'downside', 'skew', 'kurt')} FROM q JOIN c USING (symbol)")
on_results("A38_ui_stats", lambda t: t.groupBy("variant_id").agg(F.avg(F.coalesce("total_return_pct", F.lit(0.0))).alias("avg_return"), F.avg("sharpe_ratio").alias("avg_sharpe")), f"SELECT variant_id, {r('avg(coalesce(total_return_pct, 0)) AS avg_return', 'avg(sharpe_ratio) AS avg_sharpe')} FROM results GROUP BY 1")

# rankings
on_results("L1_top_n", lambda t: rep.top(t, "sharpe_ratio", 20).select(*KEY, "sharpe_ratio"), f"SELECT strategy_id, symbol, {r('sharpe_ratio')} FROM (SELECT * FROM results ORDER BY results.sharpe_ratio DESC NULLS LAST, strategy_id, symbol LIMIT 20)")
on_results("L2_worst_n", lambda t: rep.top(t, "sharpe_ratio", 20, True, True).select(*KEY, "sharpe_ratio"), f"SELECT strategy_id, symbol, {r('sharpe_ratio')} FROM (SELECT * FROM results ORDER BY results.sharpe_ratio NULLS FIRST, strategy_id, symbol LIMIT 20)")
on_results("L3_best_performers", lambda t: rep.top(t.filter("total_return_pct is not null"), "total_return_pct", 10).select(*KEY, "total_return_pct"), f"SELECT strategy_id, symbol, {r('total_return_pct')} FROM (SELECT * FROM results WHERE total_return_pct IS NOT NULL ORDER BY results.total_return_pct DESC, strategy_id, symbol LIMIT 10)")
on_results("L4_best_individual", lambda t: rep.top(t, "profit_factor", 10).select(*KEY, "profit_factor"), f"SELECT strategy_id, symbol, {r('profit_factor')} FROM (SELECT * FROM results ORDER BY results.profit_factor DESC NULLS LAST, strategy_id, symbol LIMIT 10)")
on_results("L5_rank_variants", lambda t: rep.ranked(rep.variant_stats(t), {"avg_return": True, "avg_drawdown": False, "worst_return": True}, "variant").select("variant", "rank_avg_return", "rank_avg_drawdown", "rank_worst_return"), ", v AS (SELECT coalesce(variant_id, 'original') AS variant, avg(total_return_pct) AS a, avg(max_drawdown_pct) AS d, min(total_return_pct) AS w FROM results GROUP BY 1) SELECT variant, CAST(row_number() OVER (ORDER BY a DESC, variant) AS INTEGER) AS rank_avg_return, CAST(row_number() OVER (ORDER BY d, variant) AS INTEGER) AS rank_avg_drawdown, CAST(row_number() OVER (ORDER BY w DESC, variant) AS INTEGER) AS rank_worst_return FROM v")
on_results("L6_best_run", lambda t: t.orderBy(F.coalesce("sharpe_ratio", F.lit(0.0)).desc(), *KEY).limit(1).select(*KEY), "SELECT strategy_id, symbol FROM results ORDER BY coalesce(sharpe_ratio, 0) DESC, strategy_id, symbol LIMIT 1")
on_both("L7_due_jobs", lambda a, b: a.filter("status = 'active'").orderBy(F.desc("cost"), "strategy_id").limit(30).select("strategy_id", "cost"), "SELECT strategy_id, cost FROM strategies WHERE status = 'active' ORDER BY cost DESC, strategy_id LIMIT 30")
on_results("L10_argmax_cell", lambda t: t.groupBy("timeframe", "symbol").agg(F.avg("sharpe_ratio").alias("m")).groupBy("timeframe").agg(F.min_by("symbol", F.struct(-F.col("m"), "symbol")).alias("best"), F.min_by("symbol", F.struct("m", "symbol")).alias("worst")), ", g AS (SELECT timeframe, symbol, avg(sharpe_ratio) AS m FROM results GROUP BY ALL) SELECT timeframe, first(symbol ORDER BY m DESC, symbol) AS best, first(symbol ORDER BY m, symbol) AS worst FROM g GROUP BY 1")
on_results("L11_report_listing", lambda t: rep.top(t, "total_return_pct", 10).select(*KEY, F.lit("top").alias("part")).unionByName(rep.top(t, "total_return_pct", 10, True).select(*KEY, F.lit("bottom").alias("part"))), "(SELECT strategy_id, symbol, 'top' AS part FROM results ORDER BY total_return_pct DESC, strategy_id, symbol LIMIT 10) UNION ALL (SELECT strategy_id, symbol, 'bottom' FROM results ORDER BY total_return_pct, strategy_id, symbol LIMIT 10)")


def _pools(t):
    """The 50 best by mean Sharpe ratio, and the rest: the short list is broadcast, the rest is not ranked."""
    g = t.groupBy("strategy_id").agg(F.avg("sharpe_ratio").alias("s")).filter("s is not null")
    best = g.orderBy(F.desc("s"), "strategy_id").limit(50).select("strategy_id", F.lit("live").alias("pool"))
    return g.join(F.broadcast(best), "strategy_id", "left").groupBy(F.coalesce("pool", F.lit("reserve")).alias("pool")).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"))


on_results("W19_rank_split", _pools, f", g AS (SELECT strategy_id, avg(sharpe_ratio) AS s FROM results GROUP BY 1 HAVING avg(sharpe_ratio) IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY s DESC, strategy_id) AS rank FROM g) SELECT CASE WHEN rank <= 50 THEN 'live' ELSE 'reserve' END AS pool, count(*) AS n, {r('avg(s) AS mean')} FROM k GROUP BY 1")

# sets
on_results("U1_union_all", lambda t: t.filter("total_trades > 5").select(*KEY).unionByName(t.filter("total_return_pct > 5").select(*KEY)), "SELECT strategy_id, symbol FROM results WHERE total_trades > 5 UNION ALL SELECT strategy_id, symbol FROM results WHERE total_return_pct > 5")
on_results("U2_distinct_pairs", lambda t: t.select("variant_id", "timeframe").distinct(), "SELECT DISTINCT variant_id, timeframe FROM results")
add("U3_keep_first", lambda s, d: trades(s, d).withColumn("n", F.row_number().over(Window.partitionBy("strategy_id", "entry_ts").orderBy("exit_ts", "order_key", "line", "variant_key", "entry_price", "size"))).filter("n = 1").groupBy("strategy_id").agg(F.count(F.lit(1)).alias("kept"), F.sum("pnl").alias("pnl")), "trades", f", k AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY strategy_id, entry_ts ORDER BY {ORDER}) = 1) SELECT strategy_id, count(*) AS kept, {r('sum(pnl) AS pnl')} FROM k GROUP BY 1")
add("U5_seen_suppression", lambda s, d: table(s, d, "pages").withColumn("host", F.parse_url("url", F.lit("HOST"))).groupBy("host").agg(F.min("page_id").alias("page_id")).select("page_id", "host"), "ticks", "SELECT page_id, host FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1")
on_both("U6_set_difference", lambda a, b: a.select("strategy_id").join(b.filter("total_return_pct > 0").select("strategy_id"), "strategy_id", "left_anti"), "SELECT strategy_id FROM strategies WHERE strategy_id NOT IN (SELECT strategy_id FROM results WHERE total_return_pct > 0)")

# lineage
on_both("G1_register", lambda a, b: a.select("strategy_id", F.substring(F.sha2(F.concat_ws("|", "name", F.col("strategy_id").cast("string")), 256), 1, 16).alias("code"), (F.col("level")).alias("generation")), "SELECT strategy_id, substr(sha256(name || '|' || strategy_id), 1, 16) AS code, level AS generation FROM strategies")
add("G2_descendants", lambda s, d: lin.descendants(strategies(s, d), strategies(s, d).filter("strategy_id = 5")).select(F.col("node").alias("strategy_id"), "depth"), "strategies", ", d AS (SELECT strategy_id, 0::BIGINT AS depth FROM strategies WHERE strategy_id = 5 UNION ALL SELECT e.strategy_id, d.depth + 1 FROM d JOIN strategies e ON e.parent_id = d.strategy_id) SELECT strategy_id, depth FROM d", True)
add("G6_descendants_of_many", lambda s, d: lin.descendants(strategies(s, d), strategies(s, d).filter("strategy_id IN (3, 9, 12)")), "strategies", ", d AS (SELECT strategy_id AS root, strategy_id AS node, 0::BIGINT AS depth FROM strategies WHERE strategy_id IN (3, 9, 12) UNION ALL SELECT d.root, e.strategy_id, d.depth + 1 FROM d JOIN strategies e ON e.parent_id = d.node) SELECT root, node, depth FROM d", True)
on_both("G3_best_metrics", lambda a, b: lin.best_metrics(b), f"SELECT strategy_id, max_by(symbol, k) AS symbol, {r('max_by(sharpe_ratio, k) AS sharpe_ratio', 'max_by(total_return_pct, k) AS total_return_pct', 'max_by(max_drawdown_pct, k) AS max_drawdown_pct')}, max_by(total_trades, k) AS total_trades, count(*) AS runs FROM (SELECT *, struct_pack(a := coalesce(sharpe_ratio, '-inf'::DOUBLE), b := symbol) AS k FROM results) GROUP BY 1")
add("G4_family_tree", lambda s, d: lin.descendants(strategies(s, d), strategies(s, d).filter("strategy_id = 7")).join(strategies(s, d), F.col("node") == F.col("strategy_id")).select("node", "depth", "parent_id", "mutation_type"), "strategies", ", d AS (SELECT strategy_id AS node, 0::BIGINT AS depth, parent_id, mutation_type FROM strategies WHERE strategy_id = 7 UNION ALL SELECT e.strategy_id, d.depth + 1, e.parent_id, e.mutation_type FROM d JOIN strategies e ON e.parent_id = d.node) SELECT * FROM d", True)
add("G5_ancestors", lambda s, d: lin.ancestors(strategies(s, d), strategies(s, d).filter("strategy_id IN (101, 150)")), "strategies", ", d AS (SELECT strategy_id AS root, strategy_id AS node, 0::BIGINT AS depth FROM strategies WHERE strategy_id IN (101, 150) UNION ALL SELECT d.root, e.parent_id, d.depth + 1 FROM d JOIN strategies e ON e.strategy_id = d.node WHERE e.parent_id IS NOT NULL) SELECT root, node, depth FROM d", True)
on_both("G7_top_lineages", lambda a, b: lin.top_lineages(a, b, 3), BEST + f", s AS (SELECT strategy_id >> (level - 3) AS family, strategy_id, sharpe_ratio FROM strategies JOIN b USING (strategy_id) WHERE level >= 3 AND sharpe_ratio IS NOT NULL), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY family ORDER BY sharpe_ratio DESC, strategy_id) = 1 ORDER BY sharpe_ratio DESC, strategy_id LIMIT 3) SELECT family, strategy_id, {r('sharpe_ratio')} FROM o")
