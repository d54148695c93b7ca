"""Reports over stored results: filters, rankings and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import numbered

CRYPTO, FOREX, INDEX, METAL = ["BTCUSDT", "ETHUSDT"], ["EURUSD", "GBPUSD", "USDJPY"], ["SPX500"], ["XAUUSD"]
#: Suffixes of crypto pairs and prefixes of indices, for symbols that are in no list.
QUOTES, INDEX_HINTS = ["USDT", "BTC", "ETH"], ["SPX", "NAS", "US30", "GER", "UK1", "DAX"]


def asset_class(symbol: str | Column) -> Column:
    """Asset class by list, then by the form of the name; `unknown` for the rest, null for null."""
    s = F.upper(F.col(symbol) if isinstance(symbol, str) else symbol)
    six = s.rlike("^[A-Z]{6}$")
    return (
        F.when(s.isNull(), F.lit(None)).when(s.isin(CRYPTO), "crypto").when(s.isin(FOREX), "forex").when(s.isin(INDEX), "index").when(s.isin(METAL), "metal")
        .when(F.greatest(*[s.endswith(q) for q in QUOTES]), "crypto").when(F.greatest(*[s.startswith(q) for q in INDEX_HINTS]), "index").when(s.startswith("XAU") | s.startswith("XAG"), "metal").when(six, "forex").otherwise("unknown")
    )


def filtered(results: DataFrame, strategy: str | None = None, symbol: str | None = None, variant: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Conjunction of the conditions that are given, newest first."""
    for name, value in (("strategy_name", strategy), ("symbol", symbol), ("variant_id", variant), ("timeframe", timeframe)):
        if value is not None:
            results = results.filter(F.col(name) == value)
    return results.orderBy(F.desc("end_ts"), "strategy_id", "symbol")


def strong(results: DataFrame, sharpe: float = 1.0, trades: int = 5) -> DataFrame:
    return results.filter((F.col("sharpe_ratio") > sharpe) & (F.col("total_trades") >= trades)).orderBy(F.desc("sharpe_ratio"), "strategy_id", "symbol")


def top(results: DataFrame, metric: str, n: int, ascending: bool = False, nulls_first: bool = False) -> DataFrame:
    """The n first by a metric; a total order, so that ties are decided."""
    c = F.col(metric)
    key = (c.asc_nulls_first() if nulls_first else c.asc_nulls_last()) if ascending else c.desc_nulls_last()
    return results.orderBy(key, "strategy_id", "symbol").limit(n)


def variant_summary(results: DataFrame) -> DataFrame:
    return results.filter("variant_id is not null").groupBy("variant_id").agg(
        F.count(F.lit(1)).alias("tests"), F.avg("total_return_pct").alias("avg_return"), F.max("total_return_pct").alias("max_return"), F.min("total_return_pct").alias("min_return"),
        F.avg("sharpe_ratio").alias("avg_sharpe"), F.avg("win_rate").alias("avg_win_rate"), F.avg("max_drawdown_pct").alias("avg_drawdown"),
    )


def overall_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("tests"), F.countDistinct("strategy_name").alias("strategies"), F.countDistinct("symbol").alias("symbols"), F.countDistinct("variant_id").alias("variants"),
        F.avg("total_return_pct").alias("avg_return"), F.max("total_return_pct").alias("best_return"), F.min("total_return_pct").alias("worst_return"), F.avg("sharpe_ratio").alias("avg_sharpe"),
    )


def compare_variants(results: DataFrame) -> DataFrame:
    return results.groupBy(F.coalesce("variant_id", "strategy_name").alias("variant")).agg(
        F.min("strategy_name").alias("strategy_name"), F.count(F.lit(1)).alias("tests"), F.avg("total_return_pct").alias("avg_return"), F.avg("sharpe_ratio").alias("avg_sharpe"),
        F.avg("max_drawdown_pct").alias("avg_drawdown"), F.count_if(F.col("total_return_pct") > 0).alias("profitable"),
    )


def by_timeframe(results: DataFrame) -> DataFrame:
    return results.groupBy("timeframe").agg(F.count(F.lit(1)).alias("tests"), F.avg("total_return_pct").alias("avg_return"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.avg("max_drawdown_pct").alias("avg_drawdown"), F.count_if(F.col("total_return_pct") > 0).alias("positive"))


def by_asset_class(results: DataFrame) -> DataFrame:
    return results.groupBy(asset_class("symbol").alias("asset_class")).agg(F.count(F.lit(1)).alias("tests"), F.avg("total_return_pct").alias("avg_return"), F.avg("sharpe_ratio").alias("avg_sharpe"), F.count_if(F.col("total_return_pct") > 0).alias("positive"))


def variant_stats(results: DataFrame) -> DataFrame:
    """Statistics whose every metric skips its own nulls; no value at all counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return results.groupBy(F.coalesce("variant_id", F.lit("original")).alias("variant")).agg(
        F.count(F.lit(1)).alias("tests"), zero(F.avg("total_return_pct")).alias("avg_return"), zero(F.max("total_return_pct")).alias("best_return"), zero(F.min("total_return_pct")).alias("worst_return"),
        zero(F.avg("sharpe_ratio")).alias("avg_sharpe"), zero(F.avg("max_drawdown_pct")).alias("avg_drawdown"), F.sum("total_trades").alias("trades"), zero(100.0 * F.count_if(F.col("total_return_pct") > 0) / F.count("total_return_pct")).alias("positive_rate"),
    )


def ranked(df: DataFrame, directions: dict[str, bool], key: str) -> DataFrame:
    """A rank for each metric; True: the higher the better. Nulls come last, ties go by `key`."""
    for m, high in directions.items():
        df = numbered(df, [F.col(m).desc_nulls_last() if high else F.col(m).asc_nulls_last(), F.col(key)], f"rank_{m}")
    return df.withColumns({f"rank_{m}": F.col(f"rank_{m}").cast("int") for m in directions})


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals with the best and the worst run."""
    at = F.struct(F.col("total_return_pct"), -F.col("strategy_id"), "symbol")
    low = F.struct(F.col("total_return_pct"), F.col("strategy_id"), "symbol")
    return results.agg(
        F.count(F.lit(1)).alias("tests"), F.avg("total_return_pct").alias("avg_return"), F.count_if(F.col("total_return_pct") > 0).alias("profitable"),
        F.max_by("strategy_name", at).alias("best"), F.max("total_return_pct").alias("best_return"), F.min_by("strategy_name", low).alias("worst"), F.min("total_return_pct").alias("worst_return"),
    )


def trade_analytics(trades: DataFrame) -> DataFrame:
    """Per strategy: trades a day, mean duration, mean return, share of the time in the market (percent)."""
    span = F.greatest(F.datediff(F.max("exit_ts"), F.min("entry_ts")), F.lit(1))
    return trades.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("trades"), (F.count(F.lit(1)) / span).alias("trades_per_day"), F.avg("days").alias("mean_days"), F.avg("return_pct").alias("mean_return_pct"),
        F.least(F.lit(100.0), 100.0 * F.sum("days") / span).alias("time_in_market_pct"),
    )


def multi_run(results: DataFrame) -> DataFrame:
    """Per strategy over its runs: mean Sharpe that skips 0 and null, worst drawdown, all trades, mean return."""
    return results.groupBy("strategy_id").agg(F.coalesce(F.avg(F.when(F.col("sharpe_ratio") != 0, F.col("sharpe_ratio"))), F.lit(0.0)).alias("mean_sharpe"), F.max("max_drawdown_pct").alias("max_drawdown"), F.sum("total_trades").alias("trades"), F.avg("total_return_pct").alias("mean_return"))


def funnel(results: DataFrame) -> DataFrame:
    """How many results are left after each further condition."""
    conditions = [F.lit(True), F.col("total_trades") >= 3, F.col("total_return_pct") > 0, F.col("sharpe_ratio") > 0.5, F.col("max_drawdown_pct") < 10]
    out, so_far = [], F.lit(True)
    for i, c in enumerate(conditions):
        so_far = so_far & F.coalesce(c, F.lit(False))
        out.append(F.count_if(so_far).alias(f"stage_{i}"))
    return results.agg(*out)


def canonical(results: DataFrame) -> DataFrame:
    """Projections for later stages: shares for percents, defaults for missing metrics."""
    return results.select(
        "strategy_id", "symbol", F.coalesce("sharpe_ratio", F.lit(0.0)).alias("sharpe"), (F.col("max_drawdown_pct") / 100).alias("drawdown"), (F.coalesce("win_rate", F.lit(50.0)) / 100).alias("win_share"),
        F.coalesce("profit_factor", F.lit(1.0)).alias("profit_factor"), F.coalesce("total_trades", F.lit(0)).alias("trades"), F.coalesce("total_return_pct", F.lit(0.0)).alias("return_pct"),
    )
