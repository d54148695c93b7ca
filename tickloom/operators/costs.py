"""Trading costs, market impact and capacity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed values of the cost profiles: commission, spread, slippage and daily financing, in shares of notional.
PROFILES = [("crypto", 0.001, 0.0005, 0.0005, 0.0003), ("forex", 0.00003, 0.0001, 0.00005, 0.00005), ("index", 0.0001, 0.0002, 0.0001, 0.0001), ("metal", 0.0001, 0.0003, 0.0001, 0.0001), ("unknown", 0.0005, 0.0005, 0.0005, 0.0002)]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "asset_class string, commission double, spread double, slippage double, financing double")


def adjusted(results: DataFrame, spark: SparkSession, asset_class: Column) -> DataFrame:
    """Net return and Sharpe after round-trip costs, and financing if positions are held for more than 24 bars; reasons why a result is not viable."""
    hold = F.try_divide(F.col("bars_tested"), F.col("total_trades")) / 2
    df = results.withColumn("asset_class", asset_class).join(F.broadcast(profiles(spark)), "asset_class")  # five rows
    df = df.withColumn("hold", hold).withColumn("trade_cost_pct", 2 * (F.col("commission") + F.col("spread") + F.col("slippage")) * F.col("total_trades") * 100)
    df = df.withColumn("financing_pct", F.when(F.col("hold") > 24, F.col("total_trades") * F.col("hold") / 24 * F.col("financing") * 100).otherwise(0.0))
    df = df.withColumn("cost_pct", F.col("trade_cost_pct") + F.col("financing_pct")).withColumn("net_return_pct", F.col("total_return_pct") - F.col("cost_pct"))
    df = df.withColumn("net_sharpe", F.when(F.col("total_return_pct") > 0, F.col("sharpe_ratio") * F.greatest(F.lit(0.0), F.col("net_return_pct") / F.col("total_return_pct"))).otherwise(F.when(F.col("sharpe_ratio").isNotNull(), 0.0)))
    df = df.withColumn("cost_ratio_pct", F.when(F.col("total_return_pct") > 0, 100 * F.col("cost_pct") / F.col("total_return_pct")))
    reasons = F.array_compact(F.array(
        F.when(F.col("net_return_pct") < 0, "negative net return"), F.when(F.col("net_sharpe") < 0.5, "net sharpe below 0.5"), F.when(F.col("cost_ratio_pct") > 50, "costs above half of the return"), F.when(F.col("total_trades") < 3, "too few trades"),
    ))
    return df.withColumn("viable", F.size(reasons) == 0).withColumn("reasons", F.concat_ws("; ", reasons))


def trade_fees(trades: DataFrame, asset_class: Column, per_lot: float = 5.0, pct: float = 0.00035) -> DataFrame:
    """Forex pays per lot of 100,000 units, all else a share of notional, on both sides."""
    notional = F.abs(F.col("size")) * (F.col("entry_price") + F.col("exit_price"))
    return trades.withColumn("fee", F.when(asset_class == "forex", F.abs(F.col("size")) / 100_000 * per_lot * 2).otherwise(notional * pct))


def slippage(trades: DataFrame, pct: float = 0.05, lot: float = 0.5) -> DataFrame:
    """Fill price moved against the trader: a share of the price and a part for size, jittered by a seeded hash of the trade."""
    jitter = 0.5 + F.pmod(F.col("order_key") * 7919 + F.col("line") * 104729 + F.col("variant_key") * 31, F.lit(1000)) / 1000.0
    move = (F.col("entry_price") * pct / 100 + F.abs(F.col("size")) * lot * 1e-4 * F.col("entry_price")) * jitter
    return trades.withColumn("fill_price", F.col("entry_price") + F.signum("size") * move)


COEF = 0.1


def impact_bps(model: str, size: Column, volume: Column, volatility: Column) -> Column:
    """Impact in basis points of a participation size / volume: sqrt, almgren, linear or kyle (the root law by another name)."""
    q = F.abs(size) / F.greatest(volume, F.lit(1.0))
    base = COEF * volatility * 1e4
    if model in ("sqrt", "kyle"):
        return base * F.sqrt(q)
    if model == "almgren":
        return base * F.pow(q, F.lit(0.6)) + base * q
    if model == "linear":
        return base * q
    raise ValueError(f"unknown model {model}")


def round_trip_bps(impact: Column, spread_bps: float = 2.0) -> Column:
    """Twice the temporary part (70 %), once the permanent one (30 %), twice half the spread."""
    return 2 * 0.7 * impact + 0.3 * impact + spread_bps


def execution_schedule(orders: DataFrame, slices: int = 10, kappa: float = 0.5) -> DataFrame:
    """Slices that decay as a hyperbolic sine; they sum to the order's size."""
    i = F.col("slice")
    left = lambda t: F.sinh(kappa * (slices - t)) / F.sinh(F.lit(kappa * slices))
    df = orders.withColumn("slice", F.explode(F.sequence(F.lit(1), F.lit(slices)))).withColumn("share", left(i - 1) - left(i))
    total = F.sum("share").over(Window.partitionBy("order_id"))
    return df.withColumn("quantity", F.col("size") * F.col("share") / total)


def capacity_by_volume(df: DataFrame, participation: float = 0.01) -> DataFrame:
    """Capital at which trades take `participation` of the daily volume."""
    return df.withColumn("capacity", F.col("volume") * F.col("price") * participation / F.greatest(F.col("trades_per_day"), F.lit(1e-9)))


AUM_STEPS = 50


def capacity_by_impact(strategies: DataFrame, low: float = 1e3, high: float = 1e8, least_sharpe: float = 0.5) -> DataFrame:
    """The largest capital of a geometric grid at which the Sharpe ratio, less root-law impact, is still enough."""
    ratio = (high / low) ** (1 / (AUM_STEPS - 1))
    g = strategies.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(AUM_STEPS - 1)))).withColumn("aum", low * F.pow(F.lit(ratio), F.col("i")))
    sharpe = F.col("sharpe_ratio") - COEF * F.sqrt(F.col("aum") / F.greatest(F.col("volume"), F.lit(1.0))) * F.col("trades_per_day")
    return g.withColumn("s", sharpe).groupBy("strategy_id").agg(F.max(F.when(F.col("s") >= least_sharpe, F.col("aum"))).alias("capacity"))


#: Volume and volatility factors of the regimes.
REGIMES = [("low_vol", 1.2, 0.7), ("normal", 1.0, 1.0), ("high_vol", 0.7, 1.8), ("crisis", 0.3, 3.0)]
#: Fixed values of the stress scenarios: liquidity factor, spread factor, one-day gap in percent, volatility factor.
STRESS = [("normal", 1.0, 1.0, 0.0, 1.0), ("thin", 0.5, 2.0, 0.0, 1.2), ("flash_crash", 0.1, 10.0, -8.0, 3.0), ("gap_down", 0.6, 3.0, -5.0, 1.5), ("spread_shock", 0.8, 8.0, 0.0, 1.3), ("crisis", 0.2, 6.0, -12.0, 4.0)]


def capacity_by_regime(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Capacity scaled by regime; conservative is the least of normal, high volatility and crisis."""
    r = spark.createDataFrame(REGIMES, "regime string, volume_factor double, vol_factor double")
    g = df.join(F.broadcast(r), how="cross").withColumn("scaled", F.col("capacity") * F.col("volume_factor") / F.col("vol_factor"))  # four rows
    return g.groupBy("strategy_id").agg(*[F.max(F.when(F.col("regime") == x, F.col("scaled"))).alias(x) for x, _, _ in REGIMES], F.min(F.when(F.col("regime") != "low_vol", F.col("scaled"))).alias("conservative"))


def stress_test(returns: DataFrame, spark: SparkSession, limit: float = 0.25) -> DataFrame:
    """Per strategy and scenario: returns scaled by volatility, a cost for spread, a gap in the middle; drawdown of the compounded curve; survival."""
    s = spark.createDataFrame(STRESS, "scenario string, liquidity double, spread double, gap double, vol double")
    n = F.count(F.lit(1)).over(Window.partitionBy("strategy_id"))
    g = returns.withColumn("n", n).join(F.broadcast(s), how="cross")  # six rows
    stressed = F.col("r") * F.col("vol") - 0.0002 * F.col("spread") + F.when(F.col("t") == F.floor(F.col("n") / 2) + 1, F.col("gap") / 100).otherwise(0.0)
    run = Window.partitionBy("strategy_id", "scenario").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("x", F.greatest(stressed, F.lit(-0.99))).withColumn("equity", F.exp(F.sum(F.log1p("x")).over(run))).withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(run)))
    out = g.groupBy("strategy_id", "scenario").agg(F.max(1 - F.col("equity") / F.col("peak")).alias("drawdown"), F.max_by("equity", "t").alias("final"))
    return out.withColumn("survives", F.col("drawdown") < limit)
