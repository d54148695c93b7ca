"""The research data model as views over the stored tables: ticks, bars, strategies, trades, results, returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SYMBOLS = ["EURUSD", "GBPUSD", "USDJPY", "BTCUSDT", "ETHUSDT", "SPX500", "XAUUSD"]
TIMEFRAMES = ["15min", "1hour", "4hour", "1day"]
MUTATIONS = ["parameter", "indicator", "exit_rule", "risk", "timeframe"]
ORIGINS = ["scraped", "manual", "mutation"]
INITIAL_CASH = 100_000.0

#: A total order of trades within any group; the source has no unique key.
TRADE_ORDER = ["exit_ts", "order_key", "line", "variant_key", "entry_price", "size"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def symbol_of(line) -> F.Column:
    """What the trade of a line is in."""
    return _pick(SYMBOLS, line)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tick_id, symbol, ts, price, volume."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"))


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary family tree: the parent of strategy k is k div 2."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(
        key.alias("strategy_id"), F.col("p_name").alias("name"),
        F.when(key > 0, F.expr("p_partkey div 2")).alias("parent_id"),
        _pick(MUTATIONS, key % 5 + 1).alias("mutation_type"), F.col("p_brand").alias("hypothesis_id"),
        F.when(key > 0, F.length(F.bin(key))).otherwise(0).cast("long").alias("level"), _pick(ORIGINS, key % 3 + 1).alias("origin"),
        F.when(key % 7 == 0, "promoted").when(key % 11 == 0, "retired").otherwise("active").alias("status"), F.col("p_retailprice").alias("cost"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed trades: a line item and its order. Shorts have a negative size."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    t = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.col("l_partkey").alias("strategy_id"), F.col("l_suppkey").alias("variant_key"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
        symbol_of(F.col("l_linenumber")).alias("symbol"), F.least("o_orderdate", "l_shipdate").cast("timestamp").alias("entry_ts"), F.greatest("o_orderdate", "l_shipdate").cast("timestamp").alias("exit_ts"),
        (F.col("l_quantity") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("size"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("entry_price"),
        (F.col("l_extendedprice") / F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("exit_price"),
    )
    return priced(t)


def priced(t: DataFrame) -> DataFrame:
    """Trades with what follows from their sizes, prices and times: pnl, return_pct, days."""
    return t.withColumn("pnl", (F.col("exit_price") - F.col("entry_price")) * F.col("size")).withColumn(
        "return_pct", 100 * F.signum("size") * (F.col("exit_price") / F.col("entry_price") - 1)
    ).withColumn("days", F.datediff("exit_ts", "entry_ts").cast("long"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy_id, t (from 1, by exit), r (decimal)."""
    return returns_of(trades(spark, sf_dir))


def returns_of(trades: DataFrame) -> DataFrame:
    """The returns of some strategies' trades."""
    order = Window.partitionBy("strategy_id").orderBy(*TRADE_ORDER)
    return trades.select("strategy_id", F.row_number().over(order).cast("long").alias("t"), (F.col("return_pct") / 100).alias("r"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backtest result for each strategy and symbol, with the metrics of its trades, rounded so that ties are ties in any engine."""
    return results_of(trades(spark, sf_dir))


def results_of(trades: DataFrame) -> DataFrame:
    """The results of some strategies' trades."""
    run = Window.partitionBy("strategy_id", "symbol").orderBy(*TRADE_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = trades.withColumn("equity", INITIAL_CASH + F.sum("pnl").over(run))
    t = t.withColumn("peak", F.greatest(F.lit(INITIAL_CASH), F.max("equity").over(run)))
    g = t.groupBy("strategy_id", "symbol").agg(
        F.count(F.lit(1)).alias("total_trades"), (F.sum("pnl") / INITIAL_CASH * 100).alias("total_return_pct"),
        F.when(F.stddev_samp("return_pct") > 1e-9, F.avg("return_pct") / F.stddev_samp("return_pct")).alias("sharpe_raw"), F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100).alias("max_drawdown_pct"),
        (100.0 * F.count_if(F.col("pnl") > 0) / F.count(F.lit(1))).alias("win_rate"), F.try_divide(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))).alias("profit_factor"),
        F.sum("days").alias("bars_tested"), F.min("entry_ts").alias("start_ts"), F.max("exit_ts").alias("end_ts"),
    )
    k = F.col("strategy_id")
    g = g.select([F.round(F.col(c) + 3e-11, 9).alias(c) if t == "double" else F.col(c) for c, t in g.dtypes])
    return g.select(
        "strategy_id", F.concat(F.lit("strategy_"), k.cast("string")).alias("strategy_name"), F.when(k % 4 != 0, F.concat(F.lit("variant_"), F.lpad((k % 15 + 1).cast("string"), 2, "0"))).alias("variant_id"),
        "symbol", _pick(TIMEFRAMES, k % 4 + 1).alias("timeframe"), "start_ts", "end_ts", "bars_tested", F.lit(INITIAL_CASH).alias("initial_cash"), (INITIAL_CASH * (1 + F.col("total_return_pct") / 100)).alias("final_value"),
        "total_return_pct", F.round(F.col("sharpe_raw") * F.sqrt(F.lit(252.0)) + 3e-8, 6).alias("sharpe_ratio"), "max_drawdown_pct", "total_trades", "win_rate", "profit_factor",
    )
