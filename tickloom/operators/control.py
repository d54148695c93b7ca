"""Control of live strategies: kill switch, health, lifecycle, retraining, learning. Severities are ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the rules, in the order that decides ties: rule, condition, rank, action.
RULES = [
    ("daily_loss", "daily_loss >= 3", 3, "HALT_DAY"), ("daily_loss_warning", "daily_loss >= 2.4", 2, "WARN"), ("weekly_loss", "weekly_loss >= 5", 3, "HALT_WEEK"), ("monthly_loss", "monthly_loss >= 8", 3, "HALT"),
    ("drawdown_liquidate", "drawdown >= 25", 4, "LIQUIDATE"), ("drawdown_halt", "drawdown >= 20", 4, "HALT"), ("drawdown_reduce", "drawdown >= 15", 3, "REDUCE"),
    ("streak_halt", "losses >= 8", 3, "HALT"), ("streak_review", "losses >= 5", 2, "REVIEW"), ("sharpe", "live_sharpe < 0", 3, "HALT"), ("vol_spike", "vol_ratio >= 3", 3, "REDUCE"), ("position", "position_pct >= 20", 2, "WARN"),
]
TRANSITIONS = {"research": ["paper", "rejected"], "paper": ["live", "review", "rejected"], "live": ["paused", "review", "retired"], "paused": ["live", "review", "retired"], "review": ["paper", "retired", "live"]}


def kill_switch(df: DataFrame) -> DataFrame:
    """The hit with the greatest severity, the first rule among equals; multiplier of position sizes."""
    hits = F.array_compact(F.array(*[F.when(F.expr(cond), F.struct(F.lit(rank).alias("rank"), F.lit(-i).alias("order"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))) for i, (rule, cond, rank, action) in enumerate(RULES)]))
    df = df.withColumn("hit", F.array_max(hits)).withColumn("hits", F.size(hits))
    action = F.coalesce("hit.action", F.lit("NONE"))
    return df.withColumns({"action": action, "rule": F.col("hit.rule"), "severity": F.coalesce("hit.rank", F.lit(0)), "multiplier": F.when(action == "LIQUIDATE", 0.0).when(action == "REDUCE", 0.5).otherwise(1.0)}).drop("hit")


def health() -> Column:
    """Rank of health: 0 healthy, 1 degraded, 2 critical."""
    return F.greatest(F.when(F.col("drawdown") > 20, 2).when(F.col("drawdown") > 10, 1).otherwise(0), F.when((F.col("live_sharpe") < 0) & (F.col("days") >= 10), 2).when((F.col("live_sharpe") < 0.3) & (F.col("days") >= 10), 1).otherwise(0), F.when(F.col("losses") >= 8, 2).otherwise(0))


def health_name(rank: Column) -> Column:
    return F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("critical")), rank + 1)


def transitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, bs in TRANSITIONS.items() for b in bs], "from_state string, to_state string")


def next_state() -> Column:
    """What the automatic rules make of a strategy's state."""
    s, deg = F.col("state"), F.col("degradation")
    bad = (deg > 0.5) | (F.col("drawdown") > 20) | (F.col("losses") >= 10)
    return (
        F.when((s == "paper") & (F.col("days") >= 30) & (deg <= 0.2) & (F.col("drawdown") < 20) & (F.col("trades") >= 20), "live")
        .when((s == "live") & (F.col("drawdown") > 25), "paused").when((s == "live") & bad, "review").when((s == "paused") & ~bad, "live").when((s == "review") & (F.col("days") > 30), "retired").otherwise(s)
    )


def apply_transitions(df: DataFrame, spark: SparkSession) -> DataFrame:
    """States after the automatic rules; a change that the table of transitions does not allow is refused."""
    t = df.withColumn("wanted", next_state()).join(F.broadcast(transitions(spark)), (F.col("state") == F.col("from_state")) & (F.col("wanted") == F.col("to_state")), "left")
    return t.withColumn("new_state", F.when(F.col("to_state").isNotNull(), F.col("wanted")).otherwise(F.col("state"))).drop("from_state", "to_state")


def retrain_decision(old: Column, new: Column) -> Column:
    gain = F.when(F.abs(old) > 1e-9, (new - old) / F.abs(old) * 100)
    return F.when(gain >= 5, "adopt").when(gain <= -10, "abort").when(F.abs(gain) < 5, "keep").otherwise("review")


def retrain_window(kind: str, today: Column, start: Column, days: int = 365) -> Column:
    """First day of the data to train on: rolling back `days`, expanding from the start, or anchored at the start of its year."""
    return {"rolling": F.date_sub(today, days), "expanding": start, "anchored": F.trunc(start, "year")}[kind]


def interval_days(vol_ratio: Column) -> Column:
    return F.when(vol_ratio > 1.5, 3).when(vol_ratio < 1 / 1.5, 14).otherwise(7)
