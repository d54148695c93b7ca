"""Bars from ticks, and rolling windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Width of intraday timeframes in seconds; bins are aligned to midnight UTC.
SECONDS = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1hour": 3600, "4hour": 14400}


def bin_start(ts: str, timeframe: str) -> Column:
    """Start of the bin; weeks run Monday to Sunday and are labelled by their Sunday."""
    if timeframe in SECONDS:
        width = SECONDS[timeframe]
        return F.timestamp_seconds(F.floor(F.unix_micros(ts) / (width * 1_000_000)) * width)
    if timeframe == "1day":
        return F.date_trunc("day", ts)
    if timeframe == "1week":
        return F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")
    raise ValueError(f"unknown timeframe {timeframe}")


def bars_from_ticks(ticks: DataFrame, timeframe: str = "1hour") -> DataFrame:
    """symbol, ts, open, high, low, close, volume; bins without ticks have no row. Ties of ts go by tick_id."""
    at = F.struct("ts", "tick_id")
    return ticks.groupBy("symbol", bin_start("ts", timeframe).alias("bin")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bin", "ts")


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Coarser bars from finer ones: first, max, min, last, sum."""
    return bars.groupBy("symbol", bin_start("ts", timeframe).alias("bin")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bin", "ts")


def tail_bars(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each symbol."""
    w = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def series() -> WindowSpec:
    """Bars of a symbol by time: all rolling columns share this one sort."""
    return Window.partitionBy("symbol").orderBy("ts")


def rolling(n: int, end: int = 0) -> WindowSpec:
    return series().rowsBetween(end - n + 1, end)


def full(agg: Column, value: Column, n: int, end: int = 0) -> Column:
    """`agg` over the last n rows, null until there are n values."""
    w = rolling(n, end)
    return F.when(F.count(value).over(w) == n, agg.over(w))


def mean(value: str | Column, n: int, end: int = 0) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return full(F.avg(c), c, n, end)


def std(value: str | Column, n: int) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    return full(F.stddev_samp(c), c, n)


def greatest_of(value: str, n: int, end: int = 0) -> Column:
    return full(F.max(value), F.col(value), n, end)


def least_of(value: str, n: int, end: int = 0) -> Column:
    return full(F.min(value), F.col(value), n, end)


def lagged(value: str, k: int = 1) -> Column:
    return F.lag(value, k).over(series())
