"""Technical indicators of the strategies: recursive averages, oscillators, channels and volume measures.

Everything that a window can express is a window over the symbol's bars. Exponential and Wilder averages are
recursions; they run as scans over ranges of a symbol's bars (`scans.py`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bars import full, greatest_of, lagged, least_of, mean, rolling, series, std
from .scans import recursive_means


def recursive_mean(df: DataFrame, spec: dict[str, tuple[str, float]], by: str = "symbol", order: str = "ts") -> DataFrame:
    """Add columns `name`: y = y' + alpha (x - y'), started at the first value; {name: (column, alpha)}.

    Nulls before the first value stay null, later ones carry the average on. A Wilder average of n has alpha 1/n, an EMA 2/(n+1).
    """
    return recursive_means(df, spec, by, order)


def ema(df: DataFrame, **spans: tuple[str, int]) -> DataFrame:
    """EMAs: name=(column, n)."""
    return recursive_mean(df, {k: (c, 2 / (n + 1)) for k, (c, n) in spans.items()})


def cross(diff: Column) -> Column:
    """+1 or -1 where the sign of `diff` differs from its last sign that was not 0; else 0."""
    w = series()
    sign = F.signum(diff)
    before = F.last(F.when(sign != 0, sign), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return F.when((sign != 0) & before.isNotNull() & (sign != before), sign).otherwise(F.lit(0.0)).cast("int")


def wilder_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    d = F.col("close") - lagged("close")
    df = df.withColumns({"up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))})
    df = recursive_mean(df, {"avg_up": ("up", 1 / n), "avg_down": ("down", 1 / n)})
    return df.withColumn("rsi", F.when((F.col("avg_down") == 0) & (F.col("avg_up") > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("avg_up", "avg_down"))))


def true_range(df: DataFrame) -> DataFrame:
    return df.withColumn("pc", lagged("close")).withColumn("tr", F.when(F.col("pc").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("pc")), F.abs(F.col("low") - F.col("pc")))).otherwise(F.col("high") - F.col("low")))


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(df, ema_fast=("close", fast), ema_slow=("close", slow)).withColumn("macd", F.col("ema_fast") - F.col("ema_slow"))
    return ema(df, macd_signal=("macd", signal)).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def stochastic(df: DataFrame, n: int = 14, smooth: int = 3) -> DataFrame:
    df = df.withColumn("k_raw", 100 * F.try_divide(F.col("close") - least_of("low", n), greatest_of("high", n) - least_of("low", n)))
    return df.withColumn("stoch_k", mean("k_raw", smooth))


def williams_r(df: DataFrame, n: int = 14) -> DataFrame:
    return df.withColumn("williams_r", -100 * F.try_divide(greatest_of("high", n) - F.col("close"), greatest_of("high", n) - least_of("low", n)))


def cci(df: DataFrame, n: int = 20) -> DataFrame:
    """Commodity channel index; the mean absolute deviation looks at the window's own mean."""
    df = df.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    values = F.collect_list("tp").over(rolling(n))
    df = df.withColumn("tp_mean", mean("tp", n)).withColumn("__tp", values)
    mad = F.aggregate("__tp", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("tp_mean"))) / n
    return df.withColumn("cci", F.when(F.col("tp_mean").isNotNull(), F.try_divide(F.col("tp") - F.col("tp_mean"), 0.015 * mad))).drop("__tp")


def rolling_vwap(df: DataFrame, n: int = 20) -> DataFrame:
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap", F.try_divide(full(F.sum(tp * F.col("volume")), tp, n), full(F.sum("volume"), F.col("volume"), n)))


def keltner(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    df = recursive_mean(true_range(df), {"kc_mid": ("close", 2 / (n + 1)), "kc_atr": ("tr", 1 / n)})
    return df.withColumn("kc_upper", F.col("kc_mid") + width * F.col("kc_atr")).withColumn("kc_lower", F.col("kc_mid") - width * F.col("kc_atr"))


def obv(df: DataFrame, n: int = 14) -> DataFrame:
    step = F.coalesce(F.signum(F.col("close") - lagged("close")), F.lit(0.0)) * F.col("volume")
    df = df.withColumn("obv_step", step).withColumn("obv", F.sum("obv_step").over(series()))
    return df.withColumn("obv_sma", mean("obv", n))


def donchian(df: DataFrame, n: int = 20) -> DataFrame:
    """Highest high and lowest low of the n bars before this one."""
    return df.withColumn("dc_high", greatest_of("high", n, -1)).withColumn("dc_low", least_of("low", n, -1))


def ichimoku(df: DataFrame, a: int = 9, b: int = 26, c: int = 52) -> DataFrame:
    mid = lambda n: (greatest_of("high", n) + least_of("low", n)) / 2
    df = df.withColumns({"tenkan": mid(a), "kijun": mid(b), "senkou_b": mid(c)})
    return df.withColumn("senkou_a", (F.col("tenkan") + F.col("kijun")) / 2)


def bollinger(df: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    return df.withColumns({"bb_mid": mean("close", n), "bb_dev": std("close", n)}).withColumns({"bb_upper": F.col("bb_mid") + width * F.col("bb_dev"), "bb_lower": F.col("bb_mid") - width * F.col("bb_dev")})


def all_columns(df: DataFrame) -> DataFrame:
    """Bars with every indicator under its advertised name: windows share one sort, recursions one scan (and one more for the signal line)."""
    up_down = F.col("close") - lagged("close")
    df = true_range(df).withColumns({f"sma_{n}": mean("close", n) for n in (20, 50, 200)} | {"bb_dev": std("close", 20), "up": F.when(up_down.isNotNull(), F.greatest(up_down, F.lit(0.0))), "down": F.when(up_down.isNotNull(), F.greatest(-up_down, F.lit(0.0)))})
    step = F.coalesce(F.signum(up_down), F.lit(0.0)) * F.col("volume")
    df = df.withColumns({"obv": F.sum(step).over(series()), "bb_upper": F.col("sma_20") + 2 * F.col("bb_dev"), "bb_middle": F.col("sma_20"), "bb_lower": F.col("sma_20") - 2 * F.col("bb_dev")})
    df = recursive_mean(df, {"ema_12": ("close", 2 / 13), "ema_26": ("close", 2 / 27), "avg_up": ("up", 1 / 14), "avg_down": ("down", 1 / 14), "atr_14": ("tr", 1 / 14)})
    rsi = F.when((F.col("avg_down") == 0) & (F.col("avg_up") > 0), 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide("avg_up", "avg_down")))
    df = recursive_mean(df.withColumns({"macd": F.col("ema_12") - F.col("ema_26"), "rsi_14": rsi}), {"macd_signal": ("macd", 2 / 10)})
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


#: Indicators by name: each adds `value` to bars of symbols.
CATALOGUE = {
    "sma": lambda df: df.withColumn("value", mean("close", 20)),
    "ema": lambda df: ema(df, value=("close", 20)),
    "rsi": lambda df: wilder_rsi(df).withColumn("value", F.col("rsi")),
    "macd": lambda df: ema(df, fast=("close", 12), slow=("close", 26)).withColumn("value", F.col("fast") - F.col("slow")),
    "bollinger": lambda df: df.withColumn("value", (F.col("close") - mean("close", 20)) / F.nullif(std("close", 20), F.lit(0.0))),
    "atr": lambda df: recursive_mean(df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lagged("close")), F.abs(F.col("low") - lagged("close")))), {"value": ("tr", 1 / 14)}),
    "obv": lambda df: df.withColumn("value", F.sum(F.signum(F.col("close") - lagged("close")) * F.col("volume")).over(series().rowsBetween(Window.unboundedPreceding, Window.currentRow))),
}
