"""Queries of accounts, hooks, files, sinks and models: what is written is read again and held against SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import hooks
from ..operators.accounts import broker, gated_orders, paper_account, quote
from ..operators.bars import mean
from ..operators.indicators import CATALOGUE
from ..operators.simulate import POSITION_SQL
from ..sources import files
from ..sources.storage import cut, new_folder
from ..sources.views import TRADE_ORDER, results, returns, strategies, table, trades
from ..sql import ORDER, with_views
from .common import SHIFT, rounded
from .market import hourly
from .results_queries import FAIL, r

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, views: str = "", sql: str = "", recursive: bool = False) -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        ORACLE[name] = with_views(views, sql, recursive)


# accounts
add("B-6_paper_account", lambda s, d: paper_account(trades(s, d), TRADE_ORDER))
GATE = f""", g AS (SELECT *, CAST(exit_ts AS DATE) AS day FROM trades),
c AS (SELECT *, 100000.0 + coalesce(sum(pnl) OVER (PARTITION BY strategy_id ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cash,
  coalesce(sum(pnl) OVER (PARTITION BY strategy_id, day ORDER BY {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS day_pnl FROM g),
p AS (SELECT *, greatest(100000.0, max(cash) OVER (PARTITION BY strategy_id ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
o AS (SELECT *, CASE WHEN abs(size) > 100000 THEN 'size' WHEN cash - day_pnl > 0 AND -day_pnl / (cash - day_pnl) * 100 >= 5 THEN 'daily_loss' WHEN (peak - cash) / peak * 100 >= 10 THEN 'drawdown'
  WHEN size > 0 AND cash < size * entry_price * 0.1 THEN 'margin' WHEN cash < 5000 THEN 'equity_floor' END AS reason FROM p)"""
add("B-9_risk_gate", lambda s, d: gated_orders(trades(s, d), TRADE_ORDER).groupBy("strategy_id", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("orders"), F.sum("size").alias("size")),
    "trades", GATE + f" SELECT strategy_id, coalesce(reason, 'accepted') AS outcome, count(*) AS orders, {r('sum(size) AS size')} FROM o GROUP BY ALL")
BROKER = """, o AS (SELECT strategy_id, symbol, size, entry_price, row_number() OVER (PARTITION BY strategy_id, symbol ORDER BY entry_ts, order_key, line, variant_key, size, entry_price) AS n FROM trades),
f AS (SELECT *, entry_price * (1 + sign(size) * 0.0001) AS fill FROM o),
s AS (SELECT strategy_id, symbol, n, size AS position, fill AS average, 100000.0::DOUBLE - fill * abs(size) * 0.001 AS balance, 0.0::DOUBLE AS realised, entry_price AS last FROM f WHERE n = 1
  UNION ALL SELECT s.strategy_id, s.symbol, f.n, s.position + f.size,
    CASE WHEN s.position * f.size >= 0 THEN (s.average * abs(s.position) + f.fill * abs(f.size)) / (abs(s.position) + abs(f.size)) WHEN abs(f.size) > abs(s.position) THEN f.fill WHEN s.position + f.size = 0 THEN 0.0 ELSE s.average END,
    s.balance - f.fill * abs(f.size) * 0.001 + CASE WHEN s.position * f.size >= 0 THEN 0.0 ELSE least(abs(s.position), abs(f.size)) * (f.fill - s.average) * sign(s.position) END,
    s.realised + CASE WHEN s.position * f.size >= 0 THEN 0.0 ELSE least(abs(s.position), abs(f.size)) * (f.fill - s.average) * sign(s.position) - f.fill * abs(f.size) * 0.001 END, f.entry_price
  FROM s JOIN f ON f.strategy_id = s.strategy_id AND f.symbol = s.symbol AND f.n = s.n + 1)"""
add("B-12_paper_broker", lambda s, d: broker(trades(s, d), ["strategy_id", "symbol"], ["entry_ts", "order_key", "line", "variant_key"], price="entry_price"), "trades",
    BROKER + f" SELECT strategy_id, symbol, CAST(n AS INTEGER) AS fills, 0::BIGINT AS rejected, CASE WHEN position > 0 THEN 'long' WHEN position < 0 THEN 'short' ELSE 'flat' END AS side, "
    f"{r('position', 'average', 'balance', 'realised', '(last - average) * position AS unrealised', 'balance + (last - average) * position AS equity')} FROM s QUALIFY row_number() OVER (PARTITION BY strategy_id, symbol ORDER BY n DESC) = 1", True)
add("B-12_quotes", lambda s, d: hourly(s, d).select("symbol", "ts", *[c.alias(n) for n, c in quote(F.col("close")).items()]), "bars",
    f", q AS (SELECT symbol, ts, CASE WHEN close > 0 THEN close END AS p FROM bars) SELECT symbol, ts, {r('p - p / 20000 AS bid', 'p + p / 20000 AS ask', 'p AS mid', 'CASE WHEN p IS NOT NULL THEN 1.0::DOUBLE END AS spread_bps')} FROM q")

# hooks


def _moments(pdf: pd.DataFrame) -> dict[str, float]:
    return {"mean": float(pdf["r"].mean()), "worst": float(pdf["r"].min()), "growth": float((1 + pdf["r"]).prod() - 1)}


add("D2_backtest_hook", lambda s, d: hooks.backtest_each(returns(s, d), "strategy_id", _moments, ["mean", "worst", "growth"]), "returns", f"SELECT strategy_id, {r('avg(r) AS mean', 'min(r) AS worst', 'product(1 + r) - 1 AS growth')} FROM returns GROUP BY 1")
add("D3_signal_hook", lambda s, d: hooks.with_signal(hourly(s, d), lambda: F.signum(F.col("close") - mean("close", 20))).select("symbol", "ts", "signal"), "bars",
    "SELECT symbol, ts, CAST(coalesce(CASE WHEN count(close) OVER w = 20 THEN sign(close - avg(close) OVER w) END, 0) AS INTEGER) AS signal FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)")
_window_metrics = lambda df, keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.min("r").alias("worst"))
add("D4_windows_hook", lambda s, d: hooks.over_windows(returns(s, d), "strategy_id", "t", 3, _window_metrics), "returns",
    f", w AS (SELECT *, CAST(ntile(3) OVER (PARTITION BY strategy_id ORDER BY t) AS INTEGER) AS window FROM returns) SELECT strategy_id, \"window\", count(*) AS n, {r('avg(r) AS mean', 'min(r) AS worst')} FROM w GROUP BY ALL")
_decided = lambda s, d: results(s, d).withColumn("decision", F.when(F.col("sharpe_ratio") < 0, "demote").when(F.col("max_drawdown_pct") > 5, "retrain").otherwise("keep"))
_callbacks = {"demote": lambda df: df.select("strategy_id", "symbol", F.lit("retired").alias("status")), "retrain": lambda df: df.select("strategy_id", "symbol", F.lit("training").alias("status"))}
add("D5_callbacks", lambda s, d: hooks.run_callbacks(_decided(s, d), "decision", _callbacks), "results",
    "SELECT strategy_id, symbol, CASE WHEN sharpe_ratio < 0 THEN 'retired' ELSE 'training' END AS status FROM results WHERE sharpe_ratio < 0 OR ((sharpe_ratio >= 0 OR sharpe_ratio IS NULL) AND max_drawdown_pct > 5)")
_problem = {"risk": lambda a, b: a * a + 0.5 * b * b, "gain": lambda a, b: a * (2 - b)}
add("D6_problem", lambda s, d: hooks.evaluate(results(s, d).select("strategy_id", "symbol", (F.col("win_rate") / 100).alias("a"), (F.col("max_drawdown_pct") / 100).alias("b")), _problem, ["a", "b"]).select("strategy_id", "symbol", "risk", "gain"),
    "results", f", v AS (SELECT strategy_id, symbol, win_rate / 100 AS a, max_drawdown_pct / 100 AS b FROM results) SELECT strategy_id, symbol, {r('a * a + 0.5 * b * b AS risk', 'a * (2 - b) AS gain')} FROM v")
BREAK = """, g AS (SELECT *, avg(close) OVER w AS m, count(close) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS {n} PRECEDING)),
c AS (SELECT *, CAST(coalesce(CASE WHEN n = {n} + 1 AND close > m THEN 1 WHEN n = {n} + 1 AND close < m THEN -1 END, 0) AS INTEGER) AS signal FROM g)"""
_signal_of = lambda n: F.when(F.col("close") > mean("close", n), 1).when(F.col("close") < mean("close", n), -1)
add("D7_objective", lambda s, d: hooks.as_objective(hourly(s, d), lambda n: _signal_of(n))(n=10), "bars",
    BREAK.format(n=9) + POSITION_SQL + f" SELECT symbol, {r('ln(max_by(equity, ts) / 100000.0) AS log_return', 'max((peak - equity) / peak * 100) AS max_drawdown_pct')}, count(*) FILTER (entered) AS trades, count(*) AS bars, 10 AS n FROM eq2 GROUP BY symbol")
add("D8_registered_strategy", lambda s, d: hooks.run_registered(hourly(s, d), "above_mean").groupBy("symbol", "signal").count(), "bars",
    BREAK.format(n=19) + " SELECT symbol, signal, count(*) AS count FROM c GROUP BY ALL")

# indicators by name

def _catalogue(s, d):
    """Every indicator of the catalogue over the hourly bars: how many values it has, and their mean."""
    out = None
    for name, fn in CATALOGUE.items():
        made = fn(hourly(s, d)).groupBy("symbol").agg(F.lit(name).alias("indicator"), F.count("value").alias("n"), F.avg("value").alias("mean"))
        out = made if out is None else out.unionByName(made)
    return out


add("I17_catalogue", _catalogue)

# files
_sorted = lambda s, d: hourly(s, d).select("symbol", "ts", "open", "high", "low", "close", "volume")


def _discovered(s, d):
    path = new_folder(s, "bars")
    _sorted(s, d).write.partitionBy("symbol").option("header", True).csv(f"{path}/csv")
    _sorted(s, d).write.partitionBy("symbol").parquet(f"{path}/pq")
    return files.discover(s, path).select(F.regexp_extract("path", r"symbol=([^/]+)/", 1).alias("symbol"), "ending").distinct()


add("S1_discover_files", _discovered, "bars", "SELECT DISTINCT symbol, e AS ending FROM bars, unnest(['csv', 'parquet']) t(e)")


def _read_back(s, d):
    """Bars written with other headers, in one file kind and encoding, and read again."""
    path = new_folder(s, "bars")
    raw = _sorted(s, d).select(F.date_format("ts", "yyyyMMdd").alias("<DTYYYYMMDD>"), F.date_format("ts", "HHmmss").alias("<TIME>"), *[F.col(c).cast("string").alias(f" {c.upper()} ") for c in ("open", "high", "low", "close")], F.lit(None).cast("string").alias("Vol"), F.lit("é").alias("Note"))
    raw.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_bars(s, path)


add("S3_read_bars", lambda s, d: _read_back(s, d).agg(F.count(F.lit(1)).alias("rows"), F.sum("close").alias("close"), F.sum("volume").alias("volume")), "bars", f"SELECT count(*) AS rows, {r('sum(close) AS close', '0.0::DOUBLE AS volume')} FROM bars")


def _encoded(s, d):
    """A note of Latin-1 bytes beside the bars: whole only in the right encoding."""
    path = new_folder(s, "bars")
    _sorted(s, d).select("ts", "close", F.concat(F.lit("é ü "), "symbol").alias("note")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.read_text(s, path).groupBy("note").agg(F.count(F.lit(1)).alias("rows"))


add("S3_encodings", _encoded, "bars", "SELECT 'é ü ' || symbol AS note, count(*) AS rows FROM bars GROUP BY symbol")


def _workbooks(s, d):
    """Bars of each symbol as workbooks without headers, times as Excel's day numbers, read again and united."""
    from ..sources import xlsx

    path = new_folder(s, "workbooks")
    days = F.unix_micros("ts") / 86_400_000_000 + 25_569
    sheet = _sorted(s, d).repartition("symbol").sortWithinPartitions("symbol", "ts").select(days.alias("day"), "open", "high", "low", "close", "volume", "symbol")
    xlsx.write(sheet, path, header=False).write.format("noop").mode("overwrite").save()
    back = xlsx.table(xlsx.read_cells(s, path), header=False, names=["day", "open", "high", "low", "close", "volume", "symbol"])
    return back.select("symbol", xlsx.when(F.col("day")).alias("ts"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


add("S3_read_xlsx", _workbooks, "bars", f"SELECT symbol, ts, {r('open', 'high', 'low', 'close', 'volume')} FROM bars")
_odd = lambda s, d: files.normalised(table(s, d, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 9 == 0, " x").otherwise("")).alias(" DateTime"), F.col("value").alias("O"), (F.col("value") + 1).alias("H"), F.col("value").alias("l"), F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")).otherwise("bad").alias("Adj Close"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("tick_volume")))
add("S4_S5_S6_normalise", lambda s, d: _odd(s, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.sum("high").alias("high"), F.sum("volume").alias("volume")), "ticks",
    f"SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, {r('sum(value + 1) AS high', 'sum(CASE WHEN event_id % 2 = 0 THEN event_id ELSE 0 END)::DOUBLE AS volume')} FROM events WHERE event_id % 9 <> 0 AND event_id % 7 <> 0 GROUP BY 1")


def _merged(s, d):
    path = new_folder(s, "merged")
    files.write_merged(_sorted(s, d), path)
    return s.read.option("header", True).schema("symbol string, ts timestamp, open double, high double, low double, close double, volume double").csv(path)


add("S9_merged_csv", _merged, "bars", f"SELECT symbol, ts, {r('open', 'high', 'low', 'close', 'volume')} FROM bars")


def _cached(s, d):
    path = new_folder(s, "cache")
    files.cached(s, path, lambda: _sorted(s, d))

    def never():
        raise AssertionError("the cache is there")

    found = files.cached(s, path, never).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("ts").alias("last"))
    return found


add("S10_read_through_cache", _cached, "bars", "SELECT symbol, count(*) AS bars, max(ts) AS last FROM bars GROUP BY 1")
add("S16_full_read", lambda s, d: results(s, d).select("strategy_id", "symbol", "total_return_pct", "total_trades"), "results", f"SELECT strategy_id, symbol, {r('total_return_pct')}, total_trades FROM results")


def _json(s, d):
    path, df = new_folder(s, "json"), results(s, d).select("strategy_id", "symbol", "sharpe_ratio", "start_ts")
    files.write_json(df, path)
    return s.read.schema(df.schema).json(path)


add("S17_json_sink", _json, "results", f"SELECT strategy_id, symbol, {r('sharpe_ratio')}, start_ts FROM results")


def _query_file(s, d):
    path = new_folder(s, "queries")
    strategies(s, d).select(F.when(F.col("strategy_id") % 3 == 0, F.concat(F.lit("# "), "name")).when(F.col("strategy_id") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "name", F.lit(" "))).alias("value")).write.text(path)
    return files.query_lines(s, path).groupBy("query").count()


add("S19_query_file", _query_file, "strategies", "SELECT trim(name) AS query, count(*) AS count FROM strategies WHERE strategy_id % 3 = 2 GROUP BY 1")
add("S20_header_coverage", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.lit(files.coverage(["Open", " HIGH ", "low", "value"])).alias("coverage"), F.count(F.lit(1)).alias("rows")), "ticks", "SELECT event_type, 0.75::DOUBLE AS coverage, count(*) AS rows FROM events GROUP BY 1")


def _exported(s, d):
    path = new_folder(s, "export")
    files.export_strategies(strategies(s, d).filter("status = 'active'"), path)
    back = s.read.text(path)
    return back.select("origin", F.from_json("value", "strategy_id long, name string, parent_id long, mutation_type string").alias("j")).select("origin", "j.*")


add("S22_export", _exported, "strategies", "SELECT origin, strategy_id, name, parent_id, mutation_type FROM strategies WHERE status = 'active'")


def _report(s, d):
    path = new_folder(s, "report")
    failures = results(s, d).withColumn("failure", F.expr(FAIL)).filter("failure is not null").groupBy("failure").agg(F.count(F.lit(1)).alias("runs"))
    files.markdown(failures, ["failure", "runs"], ["failure"], "Failures").write.parquet(path)
    return s.read.parquet(path)


add("S25_failure_report", _report, "results", f"""SELECT n, line FROM (VALUES (1::BIGINT, '# Failures'), (2, ''), (3, '| failure | runs |'), (4, '|-|-|')) h(n, line)
UNION ALL SELECT row_number() OVER (ORDER BY failure) + 4, '| ' || failure || ' | ' || runs || ' |' FROM (SELECT {FAIL} AS failure, count(*) AS runs FROM results GROUP BY 1) WHERE failure IS NOT NULL""")


def _model(s, d):
    """A fitted classifier, saved, loaded, and held against itself: rows, and how many predictions are equal."""
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.feature import VectorAssembler

    x = cut(results(s, d).withColumn("label", (F.col("total_return_pct") > 1).cast("double")).select("label", "max_drawdown_pct", "win_rate"), "training")
    x = VectorAssembler(inputCols=["max_drawdown_pct", "win_rate"], outputCol="features").transform(x)
    model, path = LogisticRegression(maxIter=5).fit(x), new_folder(s, "model")
    model.write().save(path)
    both = LogisticRegressionModel.load(path).transform(model.transform(x).select("features", F.col("prediction").alias("before")))
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("prediction") == F.col("before")).alias("equal"))


add("S26_model_store", _model, "results", "SELECT count(*) AS rows, count(*) AS equal FROM results")
add("S27_manual_insert", lambda s, d: files.manual_strategies(strategies(s, d).select("name", F.when(F.col("strategy_id") % 2 == 0, F.concat(F.lit("x = "), F.col("strategy_id").cast("string"))).otherwise("x = =").alias("code")), "name", "code"), "strategies",
    ", c AS (SELECT name, CASE WHEN strategy_id % 2 = 0 THEN 'x = ' || strategy_id ELSE 'x = =' END AS code, strategy_id % 2 = 0 AS valid FROM strategies) SELECT substr(sha256(name || '|' || code), 1, 16) AS code_id, name, 'manual' AS origin, valid FROM c")


def _resumed(s, d):
    """Weights that move a step at a time, stored at each; the second run finds them all and goes on for two steps."""
    path = new_folder(s, "steps")
    first = lambda: strategies(s, d).select("strategy_id", F.lit(0.0).alias("w"))
    step = lambda df, i: df.select("strategy_id", (F.col("w") + (1 - F.col("w")) / (i + 1)).alias("w"))
    files.resumable(s, path, 3, first, step)
    return files.resumable(s, path, 5, first, step)


add("S29_checkpoints", _resumed, "strategies", f"SELECT strategy_id, {r('1 - 1 / 6.0::DOUBLE AS w')} FROM strategies")
