"""Account rules of funded-trader programmes: daily loss, total loss, trading days, profit target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ZONE = "Europe/Prague"
ORDER = ["exit_ts", "order_key", "line", "variant_key", "entry_price", "size"]


def civil_day(ts: str) -> F.Column:
    """The trading day in Prague, summer time included."""
    return F.to_date(F.from_utc_timestamp(ts, ZONE))


def rule_day(ts: str) -> F.Column:
    """The day of an account's clock: UTC and one hour, two from the last Sunday of March to that of October, 1 o'clock, in every year.

    This is today's rule for Prague; the zone itself left summer time in September until 1995.
    """
    at = F.col(ts)
    sunday = lambda m: F.date_sub(F.make_date(F.year(at), F.lit(m), F.lit(31)), F.dayofweek(F.make_date(F.year(at), F.lit(m), F.lit(31))) - 1).cast("timestamp") + F.expr("INTERVAL 1 HOUR")
    return F.to_date(at + F.when((at >= sunday(3)) & (at < sunday(10)), F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR")))


def equity_events(trades: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """Entries and exits as events with the running balance: fees at entry, net profit at exit; and how many trades are open."""
    entry = trades.select("strategy_id", F.col("entry_ts").alias("ts"), F.lit(0).alias("kind"), (-F.col("fee")).alias("amount"), F.lit(1).alias("opened"), *[c for c in ORDER if c != "exit_ts"])
    leave = trades.select("strategy_id", F.col("exit_ts").alias("ts"), F.lit(1).alias("kind"), F.col("pnl").alias("amount"), F.lit(-1).alias("opened"), *[c for c in ORDER if c != "exit_ts"])
    run = Window.partitionBy("strategy_id").orderBy("ts", "kind", *[c for c in ORDER if c != "exit_ts"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return entry.unionByName(leave).withColumn("equity", cash + F.sum("amount").over(run)).withColumn("open_trades", F.sum("opened").over(run)).withColumn("seq", F.row_number().over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def daily_stats(events: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """First, last, least and greatest equity of each Prague day, and the loss since its start in percent of the initial balance."""
    g = events.groupBy("strategy_id", civil_day("ts").alias("day")).agg(F.min_by("equity", "seq").alias("first"), F.max_by("equity", "seq").alias("last"), F.min("equity").alias("low"), F.max("equity").alias("high"))
    before = F.lag("last", 1, cash).over(Window.partitionBy("strategy_id").orderBy("day"))
    return g.withColumn("start", before).withColumn("loss_pct", F.greatest(F.lit(0.0), (F.col("start") - F.col("low")) / cash * 100))


def verdict(trades: DataFrame, cash: float = 100_000.0, daily_limit: float = 5.0, total_limit: float = 10.0, days: int = 4, target: float = 10.0) -> DataFrame:
    """One row for each account with every rule's figure and whether it passes."""
    events = equity_events(trades, cash)
    day = daily_stats(events, cash).groupBy("strategy_id").agg(F.max("loss_pct").alias("worst_day_pct"))
    total = events.groupBy("strategy_id").agg(F.greatest(F.lit(0.0), (cash - F.min("equity")) / cash * 100).alias("max_loss_pct"), ((F.max_by("equity", "seq") - cash) / cash * 100).alias("profit_pct"))
    active = trades.groupBy("strategy_id").agg(F.countDistinct(civil_day("entry_ts")).alias("trading_days"))
    v = day.join(total, "strategy_id").join(active, "strategy_id")
    v = v.withColumns({"daily_ok": F.round(F.col("worst_day_pct"), 6) <= daily_limit, "total_ok": F.round(F.col("max_loss_pct"), 6) <= total_limit, "days_ok": F.col("trading_days") >= days, "target_ok": F.round(F.col("profit_pct"), 6) >= target})
    return v.withColumn("passes", F.col("daily_ok") & F.col("total_ok") & F.col("days_ok") & F.col("target_ok"))
