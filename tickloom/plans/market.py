"""Queries over bars: resampling, rolling windows, indicators, regimes."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators.bars import bars_from_ticks, mean, resample, tail_bars
from ..operators.regimes import classify, indicators, regime, regime_summary
from ..sources.views import ticks
from ..sql import with_views
from .common import duck_rounded, rounded


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, sf_dir), "1hour")


def _select(make, columns: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(make(hourly(spark, sf_dir)).select("symbol", "ts", *columns.split()))

    return query


def w(agg: str, value: str, n: int, end: int = 0) -> str:
    """A window of n rows, null until it is full, in DuckDB."""
    frame = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1 - end} PRECEDING AND {f'{-end} PRECEDING' if end else 'CURRENT ROW'})"
    return f"CASE WHEN count({value}) {frame} = {n} THEN {agg} {frame} END"


O = "OVER (PARTITION BY symbol ORDER BY ts)"  # noqa: E741
LAG = lambda c, k=1: f"lag({c}, {k}) {O}"

#: The indicator columns in DuckDB, in steps.
STEPS = f""",
i1 AS (SELECT *, {LAG('close')} AS pc, {LAG('high')} AS ph, {LAG('low')} AS pl, {LAG('close', 5)} AS pc5, {w('avg(close)', 'close', 20)} AS sma_fast, {w('avg(close)', 'close', 50)} AS sma_slow,
  {w('avg(close)', 'close', 20)} AS bb_mid, {w('stddev_samp(close)', 'close', 20)} AS bb_std FROM bars),
i2 AS (SELECT *, coalesce(close > sma_fast, false) AS above_fast, coalesce(close > sma_slow, false) AS above_slow, (close - sma_slow) / nullif(sma_slow, 0) AS ma_distance,
  CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS plus_dm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS minus_dm,
  CASE WHEN close > pc THEN close - pc ELSE 0 END AS gain, CASE WHEN close < pc THEN pc - close ELSE 0 END AS loss, close / nullif(pc, 0) - 1 AS ret_1, close / nullif(pc5, 0) - 1 AS ret_5,
  bb_mid + 2 * bb_std AS bb_upper, bb_mid - 2 * bb_std AS bb_lower, 4 * bb_std / nullif(bb_mid, 0) AS bb_width FROM i1),
i3 AS (SELECT *, {w('avg(tr)', 'tr', 14)} AS atr, {w('avg(plus_dm)', 'plus_dm', 14)} AS plus_s, {w('avg(minus_dm)', 'minus_dm', 14)} AS minus_s, {w('avg(gain)', 'gain', 14)} AS avg_gain, {w('avg(loss)', 'loss', 14)} AS avg_loss,
  {w('min(ret_1)', 'ret_1', 5)} AS min_ret_5, {w('avg(bb_width)', 'bb_width', 40)} AS bb_width_avg FROM i2),
i4 AS (SELECT *, atr / nullif(close, 0) AS atr_pct, {w('avg(atr)', 'atr', 42)} AS atr_avg, 100 * plus_s / nullif(atr, 0) AS plus_di, 100 * minus_s / nullif(atr, 0) AS minus_di,
  CASE WHEN avg_loss = 0 AND avg_gain > 0 THEN 100.0 ELSE 100 - 100.0 / nullif(1 + avg_gain / nullif(avg_loss, 0), 0) END AS rsi FROM i3),
i5 AS (SELECT *, atr / nullif(atr_avg, 0) AS atr_ratio, bb_width / nullif(bb_width_avg, 0) AS bb_ratio, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx,
  coalesce({w('min(rsi)', 'rsi', 5)} < 30, false) AS was_oversold, coalesce(rsi > {LAG('rsi')}, false) AS rsi_rising FROM i4),
i6 AS (SELECT *, {w('avg(dx)', 'dx', 14)} AS adx FROM i5),
i7 AS (SELECT *, CASE WHEN adx IS NULL OR atr_ratio IS NULL THEN 'UNKNOWN' WHEN ret_1 < -0.03 THEN 'CRASH' WHEN min_ret_5 < -0.045 AND ret_1 < 0 THEN 'CRASH'
  WHEN was_oversold AND rsi_rising AND ret_1 > 0 AND rsi < 50 THEN 'RECOVERY' WHEN atr_ratio > 1.5 OR bb_ratio > 1.5 THEN 'HIGH_VOL' WHEN adx < 20 THEN 'RANGING'
  WHEN adx > 25 AND above_slow AND ma_distance > 0.02 THEN 'BULL' WHEN adx > 25 AND NOT above_slow AND ma_distance < -0.02 THEN 'BEAR' ELSE 'RANGING' END AS raw_regime FROM i6),
i8 AS (SELECT *, row_number() {O} AS rn, coalesce(raw_regime <> {LAG('raw_regime')}, true) AS fresh FROM i7),
i9 AS (SELECT *, rn - max(CASE WHEN fresh THEN rn END) {O} + 1 AS run FROM i8),
i10 AS (SELECT *, coalesce(last_value(CASE WHEN run >= 3 THEN raw_regime END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS regime FROM i9)
"""

QUERIES: dict = {}
ORACLE: dict = {}


def add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def add_steps(name: str, make, columns: str, step: str) -> None:
    """A query of indicator columns and its SQL; columns that are doubles have a `~`."""
    add(name, _select(make, columns.replace("~", "")), with_views("bars", STEPS + duck_rounded(step, "symbol ts " + columns)))


# A12: resampling, S14/L9: tails
for tf, trunc in (("5min", "time_bucket(INTERVAL 5 MINUTE, ts)"), ("15min", "time_bucket(INTERVAL 15 MINUTE, ts)"), ("30min", "time_bucket(INTERVAL 30 MINUTE, ts)"), ("1hour", "date_trunc('hour', ts)"), ("4hour", "time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01')"), ("1day", "date_trunc('day', ts)"), ("1week", "date_trunc('week', ts) + INTERVAL 6 DAY")):
    add(
        f"A12_bars_{tf}",
        partial(lambda spark, d, tf: rounded(bars_from_ticks(ticks(spark, d), tf).select("symbol", "ts", "open", "high", "low", "close", "volume")), tf=tf),
        with_views("ticks", f"""SELECT symbol, CAST({trunc} AS TIMESTAMP) AS ts, round(first(price ORDER BY ticks.ts, tick_id), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low,
          round(last(price ORDER BY ticks.ts, tick_id), 6) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, {trunc}"""),
    )
add("A12_resample_hour_to_day", lambda s, d: rounded(resample(hourly(s, d), "1day")), with_views("bars", "SELECT symbol, date_trunc('day', ts) AS ts, round(first(open ORDER BY ts), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY ts), 6) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, date_trunc('day', ts)"))
add("S14_tail_bars", lambda s, d: rounded(tail_bars(hourly(s, d), 100).select("symbol", "ts", "close")), with_views("bars", "SELECT symbol, ts, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100"))
QUERIES["L9_tail_bars"], ORACLE["L9_tail_bars"] = QUERIES["S14_tail_bars"], ORACLE["S14_tail_bars"]

add_steps("W1_sma", indicators, "~sma_fast ~sma_slow", "i2")
add_steps("W2_ma_flags", indicators, "above_fast above_slow ~ma_distance", "i2")
add_steps("W3_true_range", indicators, "~tr", "i2")
add_steps("W4_atr", indicators, "~atr ~atr_pct ~atr_avg ~atr_ratio", "i5")
add_steps("W5_bollinger", indicators, "~bb_mid ~bb_std ~bb_upper ~bb_lower ~bb_width ~bb_width_avg ~bb_ratio", "i5")
add_steps("W6_adx", indicators, "~plus_dm ~minus_dm ~plus_di ~minus_di ~dx ~adx", "i6")
add_steps("W7_returns", indicators, "~ret_1 ~ret_5", "i6")
add_steps("W8_rsi", indicators, "~rsi", "i6")
add_steps("W9_oversold", indicators, "~min_ret_5 was_oversold rsi_rising", "i6")
add_steps("W10_raw_regime", lambda b: indicators(b).withColumn("raw_regime", regime()), "raw_regime", "i7")
add_steps("W11_smoothed_regime", classify, "raw_regime regime", "i10")
add("A17_regime_summary", lambda s, d: rounded(regime_summary(classify(hourly(s, d)))), with_views("bars", STEPS + """SELECT symbol, regime, count(*) AS bars, round(100 * avg(ret_1) + 3.05e-8, 6) AS mean_ret_pct, round(100 * stddev_samp(ret_1) + 3.05e-8, 6) AS std_ret_pct,
  round(100 * avg(atr_pct) + 3.05e-8, 6) AS mean_atr_pct, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY symbol) + 3.05e-8, 6) AS share_pct FROM i10 GROUP BY symbol, regime"""))

# I: indicators of the strategies


def ema_sql(source: str, name: str, specs: dict[str, tuple[str, float]]) -> str:
    """Recursive averages in DuckDB, row by row; a null value leaves the average as it was."""
    start = ", ".join(f"{c} AS {k}" for k, (c, _) in specs.items())
    step = ", ".join(f"CASE WHEN n_{name}.{c} IS NULL THEN e.{k} WHEN e.{k} IS NULL THEN n_{name}.{c} ELSE e.{k} + {a!r}::DOUBLE * (n_{name}.{c} - e.{k}) END" for k, (c, a) in specs.items())
    return f""", n_{name} AS (SELECT *, row_number() {O} AS t FROM {source}),
{name} AS (SELECT *, {start} FROM n_{name} WHERE t = 1 UNION ALL SELECT n_{name}.*, {step} FROM {name} e JOIN n_{name} ON n_{name}.symbol = e.symbol AND n_{name}.t = e.t + 1)"""


def add_recursive(name: str, make, columns: str, ctes: str, source: str) -> None:
    add(name, _select(make, columns.replace("~", "")), with_views("bars", ctes + " " + duck_rounded(source, "symbol ts " + columns), recursive=True))


CROSS = "CASE WHEN sign(d) <> 0 AND last_value(nullif(sign(d), 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <> sign(d) THEN CAST(sign(d) AS INTEGER) ELSE 0 END"
add("I1_sma_cross", _select(lambda b: b.withColumn("d", mean("close", 20) - mean("close", 50)).withColumn("cross", ind.cross(F.col("d"))), "cross"), with_views("bars", f", x AS (SELECT *, {w('avg(close)', 'close', 20)} - {w('avg(close)', 'close', 50)} AS d FROM bars) SELECT symbol, ts, {CROSS} AS \"cross\" FROM x"))
UPDOWN = f", x AS (SELECT *, greatest(close - {LAG('close')}, 0.0) AS up, greatest({LAG('close')} - close, 0.0) AS down, {LAG('close')} AS pc FROM bars), y AS (SELECT symbol, ts, CASE WHEN pc IS NOT NULL THEN up END AS up, CASE WHEN pc IS NOT NULL THEN down END AS down FROM x)"
add("I2_wilder_rsi", _select(ind.wilder_rsi, "rsi"), with_views("bars", UPDOWN + ema_sql("y", "e", {"avg_up": ("up", 1 / 14), "avg_down": ("down", 1 / 14)}).replace("FROM e e JOIN", "FROM e JOIN") + " SELECT symbol, ts, round(CASE WHEN avg_down = 0 AND avg_up > 0 THEN 100.0 ELSE 100 - 100.0 / nullif(1 + avg_up / nullif(avg_down, 0), 0) END + 3.05e-8, 6) AS rsi FROM e", recursive=True))
TR = f", x AS (SELECT *, coalesce(greatest(high - low, abs(high - {LAG('close')}), abs(low - {LAG('close')})), high - low) AS tr FROM bars)"
add_recursive("I3_wilder_atr", lambda b: ind.recursive_mean(ind.true_range(b), {"atr": ("tr", 1 / 14)}), "~tr ~atr", TR + ema_sql("x", "q", {"atr": ("tr", 1 / 14)}), "q")
MACD = ema_sql("bars", "q", {"ema_fast": ("close", 2 / 13), "ema_slow": ("close", 2 / 27)}) + ", m AS (SELECT symbol, ts, ema_fast - ema_slow AS macd FROM q)" + ema_sql("m", "s", {"macd_signal": ("macd", 2 / 10)}) + ", h AS (SELECT *, macd - macd_signal AS macd_hist FROM s)"
add_recursive("I4_macd", ind.macd, "~macd ~macd_signal ~macd_hist", MACD, "h")
add("I4_volume_confirmation", _select(lambda b: b.withColumn("volume_ok", F.coalesce(F.col("volume") > 1.5 * mean("volume", 20), F.lit(False))), "volume_ok"), with_views("bars", f"SELECT symbol, ts, coalesce(volume > 1.5 * ({w('avg(volume)', 'volume', 20)}), false) AS volume_ok FROM bars"))
add_recursive("I5_ema_cross_adx", lambda b: ind.ema(indicators(b).select("symbol", "ts", "close", "adx"), fast=("close", 12), slow=("close", 26)).withColumn("d", F.col("fast") - F.col("slow")).withColumn("signal", F.when(F.coalesce(F.col("adx") > 25, F.lit(False)), ind.cross(F.col("d"))).otherwise(0)), "signal",
              STEPS + ", z AS (SELECT symbol, ts, close, adx FROM i6)" + ema_sql("z", "q", {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)}) + f", y AS (SELECT *, fast - slow AS d FROM q), v AS (SELECT *, {CROSS} AS c FROM y), u AS (SELECT symbol, ts, CASE WHEN adx > 25 THEN c ELSE 0 END AS signal FROM v)", "u")
add("I6_bollinger", _select(ind.bollinger, "bb_upper bb_lower"), with_views("bars", STEPS + duck_rounded("i2", "symbol ts ~bb_upper ~bb_lower")))
STOCH = f", x AS (SELECT *, 100 * (close - ({w('min(low)', 'low', 14)})) / nullif(({w('max(high)', 'high', 14)}) - ({w('min(low)', 'low', 14)}), 0) AS k_raw FROM bars), y AS (SELECT *, {w('avg(k_raw)', 'k_raw', 3)} AS stoch_k FROM x) "
add("I7_stochastic", _select(ind.stochastic, "stoch_k"), with_views("bars", STOCH + duck_rounded("y", "symbol ts ~stoch_k")))
add_recursive("I7_ema200", lambda b: ind.ema(b, ema_trend=("close", 200)).withColumn("up_trend", F.col("close") > F.col("ema_trend")), "~ema_trend up_trend", ema_sql("bars", "q", {"ema_trend": ("close", 2 / 201)}) + ", u AS (SELECT *, close > ema_trend AS up_trend FROM q)", "u")
add("I9_williams_r", _select(ind.williams_r, "williams_r"), with_views("bars", f", x AS (SELECT *, -100 * (({w('max(high)', 'high', 14)}) - close) / nullif(({w('max(high)', 'high', 14)}) - ({w('min(low)', 'low', 14)}), 0) AS williams_r FROM bars) " + duck_rounded("x", "symbol ts ~williams_r")))
add("I9_cci", _select(ind.cci, "cci"), with_views("bars", f", x AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), y AS (SELECT *, {w('avg(tp)', 'tp', 20)} AS m, list(tp) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS l FROM x), z AS (SELECT *, CASE WHEN m IS NOT NULL THEN (tp - m) / nullif(0.015 * list_sum(list_transform(l, lambda v: abs(v - m))) / 20, 0) END AS cci FROM y) " + duck_rounded("z", "symbol ts ~cci")))
add("I10_rolling_vwap", _select(ind.rolling_vwap, "vwap"), with_views("bars", f", x AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), y AS (SELECT *, ({w('sum(tp * volume)', 'tp', 20)}) / nullif({w('sum(volume)', 'volume', 20)}, 0) AS vwap FROM x) " + duck_rounded("y", "symbol ts ~vwap")))
add_recursive("I11_keltner", ind.keltner, "~kc_mid ~kc_upper ~kc_lower", TR + ema_sql("x", "q", {"kc_mid": ("close", 2 / 21), "kc_atr": ("tr", 1 / 20)}) + ", u AS (SELECT *, kc_mid + 2.0 * kc_atr AS kc_upper, kc_mid - 2.0 * kc_atr AS kc_lower FROM q)", "u")
add("I12_obv", _select(ind.obv, "obv obv_sma"), with_views("bars", f", x AS (SELECT *, coalesce(sign(close - {LAG('close')}), 0) * volume AS s FROM bars), y AS (SELECT *, sum(s) {O} AS obv FROM x), z AS (SELECT *, {w('avg(obv)', 'obv', 14)} AS obv_sma FROM y) " + duck_rounded("z", "symbol ts ~obv ~obv_sma")))
add("I12_donchian", _select(ind.donchian, "dc_high dc_low"), with_views("bars", f", x AS (SELECT *, {w('max(high)', 'high', 20, -1)} AS dc_high, {w('min(low)', 'low', 20, -1)} AS dc_low FROM bars) " + duck_rounded("x", "symbol ts ~dc_high ~dc_low")))
add("I13_session_filter", _select(lambda b: b.filter((F.hour("ts") >= 9) & (F.hour("ts") < 15)), "close"), with_views("bars", "SELECT symbol, ts, round(close, 6) AS close FROM bars WHERE hour(ts) >= 9 AND hour(ts) < 15"))
MID = lambda n: f"(({w('max(high)', 'high', n)}) + ({w('min(low)', 'low', n)})) / 2"
add("I14_ichimoku", _select(ind.ichimoku, "tenkan kijun senkou_a senkou_b"), with_views("bars", f", x AS (SELECT *, {MID(9)} AS tenkan, {MID(26)} AS kijun, {MID(52)} AS senkou_b FROM bars), y AS (SELECT *, (tenkan + kijun) / 2 AS senkou_a FROM x) " + duck_rounded("y", "symbol ts ~tenkan ~kijun ~senkou_a ~senkou_b")))
BULLISH = ["above_fast", "above_slow", "plus_di > minus_di", "rsi > 50", "close > bb_mid", "ret_5 > 0"]


def _confluence(bars: DataFrame) -> DataFrame:
    score = sum((F.coalesce(F.expr(x), F.lit(False)).cast("int") for x in BULLISH), F.lit(0))
    return indicators(bars).withColumn("score", score).withColumn("signal", F.when(score >= 4, "buy").when(score <= 2, "sell").otherwise("hold"))


add("I15_confluence", _select(_confluence, "score signal"), with_views("bars", STEPS + f", z AS (SELECT *, {' + '.join(f'CAST(coalesce({x}, false) AS INTEGER)' for x in BULLISH)} AS score FROM i6) SELECT symbol, ts, score, CASE WHEN score >= 4 THEN 'buy' WHEN score <= 2 THEN 'sell' ELSE 'hold' END AS signal FROM z"))
add_recursive("I16_ema_recursion", lambda b: ind.recursive_mean(b, {"wilder": ("close", 1 / 14), "fast": ("close", 0.5)}), "~wilder ~fast", ema_sql("bars", "q", {"wilder": ("close", 1 / 14), "fast": ("close", 0.5)}), "q")
