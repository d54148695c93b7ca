"""Market regimes from rolling indicators (defaults of the research configuration)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import lagged, least_of, mean, series, std


def indicators(bars: DataFrame) -> DataFrame:
    """Moving averages 20/50, ATR 14 (average 42), Bollinger 20 x 2 (average 40), ADX 14, returns, RSI 14, oversold and rising flags. `ma_distance` is signed.

    Windows give null until they are full. Directional movement and RSI are smoothed by simple means.
    """
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    df = bars.withColumns({"pc": lagged("close"), "ph": lagged("high"), "pl": lagged("low"), "sma_fast": mean("close", 20), "sma_slow": mean("close", 50)})
    true_range = F.when(F.col("pc").isNotNull(), F.greatest(h - low, F.abs(h - F.col("pc")), F.abs(low - F.col("pc"))))
    up, down, delta = h - F.col("ph"), F.col("pl") - low, c - F.col("pc")
    df = df.withColumns({
        "above_fast": F.coalesce(c > F.col("sma_fast"), F.lit(False)), "above_slow": F.coalesce(c > F.col("sma_slow"), F.lit(False)), "ma_distance": F.try_divide(c - F.col("sma_slow"), F.col("sma_slow")),
        "tr": true_range, "plus_dm": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus_dm": F.when((down > up) & (down > 0), down).otherwise(0.0),
        "gain": F.when(delta > 0, delta).otherwise(0.0), "loss": F.when(delta < 0, -delta).otherwise(0.0),
        "ret_1": F.try_divide(c, F.col("pc")) - 1, "ret_5": F.try_divide(c, lagged("close", 5)) - 1,
        "bb_mid": mean("close", 20), "bb_std": std("close", 20),
    })
    df = df.withColumns({
        "atr": mean("tr", 14), "plus_s": mean("plus_dm", 14), "minus_s": mean("minus_dm", 14), "avg_gain": mean("gain", 14), "avg_loss": mean("loss", 14),
        "bb_upper": F.col("bb_mid") + 2 * F.col("bb_std"), "bb_lower": F.col("bb_mid") - 2 * F.col("bb_std"), "bb_width": F.try_divide(4 * F.col("bb_std"), F.col("bb_mid")), "min_ret_5": least_of("ret_1", 5),
    })
    plus, minus = 100 * F.try_divide("plus_s", "atr"), 100 * F.try_divide("minus_s", "atr")
    df = df.withColumns({
        "atr_pct": F.try_divide("atr", "close"), "atr_avg": mean("atr", 42), "bb_width_avg": mean("bb_width", 40), "plus_di": plus, "minus_di": minus,
        "rsi": F.when((F.col("avg_loss") == 0) & (F.col("avg_gain") > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("avg_gain", "avg_loss"))),
    })
    df = df.withColumns({
        "atr_ratio": F.try_divide("atr", "atr_avg"), "bb_ratio": F.try_divide("bb_width", "bb_width_avg"), "dx": 100 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")),
        "was_oversold": F.coalesce(least_of("rsi", 5) < 30, F.lit(False)), "rsi_rising": F.coalesce(F.col("rsi") > lagged("rsi"), F.lit(False)),
    })
    return df.withColumn("adx", mean("dx", 14))


def regime() -> Column:
    """The ladder: unknown, crash, recovery, high volatility, ranging, bull or bear; comparisons with null are false."""
    c = lambda x: F.coalesce(x, F.lit(False))
    r, adx, dist = F.col("ret_1"), F.col("adx"), F.col("ma_distance")
    return (
        F.when(F.col("adx").isNull() | F.col("atr_ratio").isNull(), "UNKNOWN")
        .when(c(r < -0.03), "CRASH").when(c((F.col("min_ret_5") < -0.045) & (r < 0)), "CRASH")
        .when(c(F.col("was_oversold") & F.col("rsi_rising") & (r > 0) & (F.col("rsi") < 50)), "RECOVERY")
        .when(c(F.col("atr_ratio") > 1.5) | c(F.col("bb_ratio") > 1.5), "HIGH_VOL").when(c(adx < 20), "RANGING")
        .when(c((adx > 25) & F.col("above_slow") & (dist > 0.02)), "BULL").when(c((adx > 25) & ~F.col("above_slow") & (dist < -0.02)), "BEAR")
        .otherwise("RANGING")
    )


def smoothed(df: DataFrame, column: str = "raw_regime", confirm: int = 3) -> DataFrame:
    """`regime`: the last value that lasted `confirm` bars, UNKNOWN before the first: runs by gaps and islands, no loop."""
    w = series()
    df = df.withColumn("__new", F.coalesce((F.col(column) != F.lag(column).over(w)).cast("int"), F.lit(1)))
    df = df.withColumn("__rn", F.row_number().over(w)).withColumn("__run", F.col("__rn") - F.max(F.when(F.col("__new") == 1, F.col("__rn"))).over(w) + 1)
    done = F.last(F.when(F.col("__run") >= confirm, F.col(column)), ignorenulls=True).over(w)
    return df.withColumn("regime", F.coalesce(done, F.lit("UNKNOWN"))).drop("__new", "__rn", "__run")


def classify(bars: DataFrame) -> DataFrame:
    """Bars with indicators, `raw_regime` and the smoothed `regime`."""
    return smoothed(indicators(bars).withColumn("raw_regime", regime()))


def regime_summary(classified: DataFrame) -> DataFrame:
    """Per symbol and regime: bars, share of the symbol's bars, mean and deviation of returns, mean relative ATR (all in percent)."""
    g = classified.groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("bars"), (100 * F.avg("ret_1")).alias("mean_ret_pct"), (100 * F.stddev_samp("ret_1")).alias("std_ret_pct"), (100 * F.avg("atr_pct")).alias("mean_atr_pct"))
    return g.withColumn("share_pct", 100.0 * F.col("bars") / F.sum("bars").over(Window.partitionBy("symbol")))
