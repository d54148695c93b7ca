"""Backtests: vectorised where positions follow from signals, grouped pandas functions where a path decides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bars import lagged, series

CASH, FEE = 100_000.0, 0.001


def simulate_signals(df: DataFrame, cash: float = CASH, fee: float = FEE) -> DataFrame:
    """Long from the open after a +1 signal to the open after a -1 signal, all in; fees on each change.

    The position is the last signal that is not 0, a bar late: one window, no loop. Equity compounds open-to-open returns while in position.
    """
    w = series()
    held = F.coalesce(F.last(F.when(F.col("signal") != 0, F.col("signal")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("position", F.when(held == 1, 1).otherwise(0)).withColumn("before", F.coalesce(lagged("position"), F.lit(0)))
    ahead = F.lead("open").over(w)
    growth = F.when(F.col("position") == 1, F.try_divide(F.coalesce(ahead, F.col("close")), F.col("open"))).otherwise(1.0)
    df = df.withColumn("factor", growth * F.when(F.col("position") != F.col("before"), 1 - fee).otherwise(1.0)).withColumn("entered", (F.col("position") == 1) & (F.col("before") == 0))
    return df.withColumn("equity", cash * F.exp(F.sum(F.log("factor")).over(w)))


POSITION_SQL = """, s1 AS (SELECT *, CASE WHEN last_value(nullif(signal, 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 1 ELSE 0 END AS position FROM c),
s2 AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY symbol ORDER BY ts), 0) AS before, lead(open) OVER (PARTITION BY symbol ORDER BY ts) AS ahead FROM s1),
s3 AS (SELECT *, CASE WHEN position = 1 THEN coalesce(ahead, close) / nullif(open, 0) ELSE 1.0 END * CASE WHEN position <> before THEN 0.999 ELSE 1.0 END AS factor, position = 1 AND before = 0 AS entered FROM s2),
eq AS (SELECT *, 100000.0 * exp(sum(ln(factor)) OVER (PARTITION BY symbol ORDER BY ts)) AS equity FROM s3), eq2 AS (SELECT *, greatest(100000.0, max(equity) OVER (PARTITION BY symbol ORDER BY ts)) AS peak FROM eq)"""


def summarise(sim: DataFrame, cash: float = CASH) -> DataFrame:
    peak = F.greatest(F.lit(cash), F.max("equity").over(series()))
    return sim.withColumn("peak", peak).groupBy("symbol").agg(
        F.log(F.max_by("equity", "ts") / cash).alias("log_return"), F.max((F.col("peak") - F.col("equity")) / F.col("peak") * 100).alias("max_drawdown_pct"), F.count_if("entered").alias("trades"), F.count(F.lit(1)).alias("bars"),
    )


RULES = {
    "bracket": {"stop": 0.02, "target": 0.04}, "trailing": {"trail": 0.03}, "partial": {"stop": 0.015, "parts": ((0.02, 0.5), (0.04, 0.5))},
    "hold": {"stop": 0.02, "most_bars": 10}, "pyramid": {"trail": 0.02, "levels": 3, "step": 0.01},
}
TRADES = "symbol string, entry_ts timestamp, exit_ts timestamp, entry double, exit double, units double, bars long, reason string"


def walk(rows: list[tuple], rule: dict) -> list[tuple]:
    """(entry_ts, exit_ts, entry, exit, units, bars, reason) of one series of (ts, open, high, low, close, signal) under an exit rule.

    Entries are at the open after a +1 signal, also exits after a -1 signal. Within a bar, the stop is looked at before
    targets, as the order of prices inside it is not known. A position left at the end is closed at the last close.
    """
    out, entry, units, peak, since, level, done, begun = [], None, 0.0, 0.0, 0, 0, 0, None
    signal_before = 0

    def leave(ts, price, share, reason):
        nonlocal units, entry
        out.append((begun, ts, entry, price, share, since, reason))
        units -= share
        if units <= 1e-9:
            units, entry = 0.0, None

    for ts, open_, high, low, close, signal in rows:
        if entry is not None and signal_before == -1:
            leave(ts, open_, units, "signal")
        if entry is None and signal_before == 1:
            entry, units, peak, since, level, done, begun = open_, 1.0, open_, 0, 1, 0, ts
        if entry is not None:
            since += 1
            stop = max(x for x in (entry * (1 - rule["stop"]) if "stop" in rule else 0.0, peak * (1 - rule["trail"]) if "trail" in rule else 0.0))
            if low <= stop:
                leave(ts, min(open_, stop), units, "stop")
            elif "target" in rule and high >= entry * (1 + rule["target"]):
                leave(ts, max(open_, entry * (1 + rule["target"])), units, "target")
            else:
                for gain, share in rule.get("parts", ())[done:]:
                    if entry is not None and high >= entry * (1 + gain):
                        done += 1
                        leave(ts, max(open_, entry * (1 + gain)), min(share, units), "part")
                if entry is not None and "levels" in rule and level < rule["levels"] and close >= entry * (1 + rule["step"]):
                    entry, units, level = (entry * units + close) / (units + 1), units + 1, level + 1
                if entry is not None and since >= rule.get("most_bars", 1 << 60):
                    leave(ts, close, units, "time")
            peak = max(peak, high)
        signal_before, last = signal, (ts, close)
    if entry is not None:
        leave(*last, units, "end")
    return out


def simulate(df: DataFrame, rule: str) -> DataFrame:
    """Trades of every symbol under an exit rule of RULES; one sorted pass for each symbol, in its own task."""
    spec = RULES[rule]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        found = walk(list(pdf[["ts", "open", "high", "low", "close", "signal"]].itertuples(index=False, name=None)), spec)
        return pd.DataFrame([(key[0], *x) for x in found], columns=[c.split()[0] for c in TRADES.split(", ")])

    return df.groupBy("symbol").applyInPandas(run, TRADES)
