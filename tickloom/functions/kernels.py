"""Kernels that need a whole series at once: volatility fits, permutation tests, robustness grids, extreme values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Simulations of one task of a permutation test.
SIMS_A_TASK = 10


def permuted(x: np.ndarray, kind: str, sim: int, block: int = 20) -> np.ndarray:
    """A series shuffled, shuffled in blocks, or rotated, by an order that follows from `sim` alone."""
    rng = np.random.default_rng([{"shuffle": 0, "block": 1, "rotate": 2}[kind], sim])
    if kind == "shuffle":
        return rng.permutation(x)
    if kind == "block":
        parts = np.array_split(x, max(1, len(x) // block))
        return np.concatenate([parts[i] for i in rng.permutation(len(parts))])
    return np.roll(x, rng.integers(1, max(2, len(x))))


def momentum(x: np.ndarray) -> float:
    """Mean return of a rule that holds the sign of the last five returns' sum."""
    s = np.convolve(x, np.ones(5), "full")[: len(x)]
    return float((np.sign(s[:-1]) * x[1:]).mean()) if len(x) > 1 else 0.0


def permutation_test(df: DataFrame, by: str, order: str, value: str, sims: int = 100, block: int = 20) -> DataFrame:
    """A momentum rule's mean return against permuted, block-permuted and rotated series: p = share at least as good.

    Every SIMS_A_TASK simulations are a task of their own, so that a series is copied sims * 3 / SIMS_A_TASK times and its
    simulations run side by side; what they count is summed. A permutation needs a whole series, which has to fit a task.
    """
    kinds = ("shuffle", "block", "rotate")
    jobs = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(a).alias("first")) for k in kinds for a in range(0, sims, SIMS_A_TASK)]))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy()
        real, (_, kind, first) = momentum(x), key
        hits = sum(momentum(permuted(x, kind, k, block)) >= real - 1e-15 for k in range(first, min(first + SIMS_A_TASK, sims)))
        return pd.DataFrame([(key[0], kind, real, int(hits))], columns=[by, "kind", "real", "hits"])

    dealt = df.select(by, order, value).filter(F.col(value).isNotNull()).withColumn("__job", jobs)
    counted = dealt.groupBy(by, F.col("__job.kind").alias("kind"), F.col("__job.first").alias("first")).applyInPandas(run, f"{by} {df.schema[by].dataType.simpleString()}, kind string, real double, hits long")
    return counted.groupBy(by, "kind").agg(F.first("real").alias("real"), (F.sum("hits") / sims).alias("p"))


Cell = tuple[int, int, int, float]


def cross_grid(bars: DataFrame, cells: list[Cell]) -> DataFrame:
    """Mean return a bar of a moving-average cross, its deviation and their ratio (`metric`), by symbol and cell.

    A cell is (fast, slow, delay, cost): the signal acts `delay` bars late and costs `cost` on changes. All averages, signals and
    lags of the grid are columns of one sorted pass over the bars, and all cells are one aggregate; what grows with the grid is
    a row of numbers a symbol. A metric needs a deviation above 1e-9.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    avg = lambda n: F.when(F.count("close").over(w.rowsBetween(-(n - 1), 0)) == n, F.avg("close").over(w.rowsBetween(-(n - 1), 0)))
    held = lambda f, s, k: F.coalesce(F.lag(f"on_{f}_{s}", k).over(w), F.lit(0)).alias(f"h_{f}_{s}_{k}")
    rules, lags = sorted({c[:2] for c in cells}), sorted({(f, s, d + k) for f, s, d, _ in cells for k in (1, 2)})
    df = bars.select("symbol", "ts", "close", F.coalesce(F.log(F.col("close") / F.lag("close").over(w)), F.lit(0.0)).alias("ret"), *[avg(n).alias(f"a{n}") for n in sorted({n for r in rules for n in r})])
    df = df.select("symbol", "ts", "ret", *[F.coalesce((F.col(f"a{f}") > F.col(f"a{s}")).cast("int"), F.lit(0)).alias(f"on_{f}_{s}") for f, s in rules])
    df = df.select("symbol", "ret", *[held(*x) for x in lags])
    one = []
    for f, s, d, cost in cells:
        now, before = F.col(f"h_{f}_{s}_{d + 1}"), F.col(f"h_{f}_{s}_{d + 2}")
        x = now * F.col("ret") - cost * F.abs(now - before)
        one.append(F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.lit(d).alias("delay"), F.lit(float(cost)).alias("cost"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd")))
    g = df.groupBy("symbol").agg(F.array(*one).alias("cells")).select("symbol", F.explode("cells").alias("c")).select("symbol", "c.*")
    return g.withColumn("metric", F.when(F.col("sd") > 1e-9, F.col("mean") / F.col("sd")))


def cross_grid_sql(cells: list[Cell], source: str = "bars") -> str:
    """The same table in DuckDB, as a chain of common table expressions that ends in `grid`."""
    over = "OVER (PARTITION BY symbol ORDER BY ts)"
    mean = lambda n: f"CASE WHEN count(close) OVER w{n} = {n} THEN avg(close) OVER w{n} END AS a{n}"
    sizes, rules = sorted({n for c in cells for n in c[:2]}), sorted({c[:2] for c in cells})
    windows = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)" for n in sizes)
    steps = [f"g0 AS (SELECT symbol, ts, coalesce(ln(close / lag(close) {over}), 0) AS ret, {', '.join(map(mean, sizes))} FROM {source} WINDOW {windows})"]
    steps.append(f"g1 AS (SELECT *, {', '.join(f'CASE WHEN a{f} > a{s} THEN 1 ELSE 0 END AS on_{f}_{s}' for f, s in rules)} FROM g0)")
    lag = lambda f, s, k: f"coalesce(lag(on_{f}_{s}, {k}) {over}, 0)"
    rows = " UNION ALL ".join(f"SELECT symbol, {f} AS fast, {s} AS slow, {d} AS delay, {float(c)!r}::DOUBLE AS cost, {lag(f, s, d + 1)} * ret - {float(c)!r}::DOUBLE * abs({lag(f, s, d + 1)} - {lag(f, s, d + 2)}) AS x FROM g1" for f, s, d, c in cells)
    steps += [f"g2 AS ({rows})", "g3 AS (SELECT symbol, fast, slow, delay, cost, avg(x) AS mean, stddev_samp(x) AS sd FROM g2 GROUP BY ALL)", "grid AS (SELECT *, CASE WHEN sd > 1e-9 THEN mean / sd END AS metric FROM g3)"]
    return ", " + ", ".join(steps)


DELAYS, FACTORS, SWEEP, FASTS, SLOWS, COST = (0, 1, 2, 3), (1, 1.5, 2, 3, 5), (5, 8, 10, 12, 15, 20), (5, 10, 15), (30, 40, 50), 0.001
LATENCY_CELLS = [(10, 30, d, 0.0) for d in DELAYS]
SLIPPAGE_CELLS = [(10, 30, 0, COST * f) for f in FACTORS]
STRESS_CELLS = [(10, 30, d, COST * c) for d in (0, 1, 2) for c in (1, 2, 3)]
SWEEP_CELLS = [(v, 50, 0, 0.0) for v in SWEEP]
HEAT_CELLS = [(f, s, 0, 0.0) for f in FASTS for s in SLOWS]


def latency(bars: DataFrame) -> DataFrame:
    """Metric by delay, its loss a bar against no delay, and whether that exceeds 20 %."""
    g = cross_grid(bars, LATENCY_CELLS)
    base = F.first("metric").over(Window.partitionBy("symbol").orderBy("delay"))
    loss = F.when((F.col("delay") > 0) & (F.abs(base) > 1e-12), (base - F.col("metric")) / F.abs(base) / F.col("delay"))
    return g.withColumn("loss_per_bar", loss).select("symbol", "delay", "metric", "loss_per_bar", (F.coalesce(F.col("loss_per_bar"), F.lit(0.0)) > 0.2).alias("fragile"))


def slippage_stress(bars: DataFrame) -> DataFrame:
    """Metric by multiple of the cost and the multiple at which the mean crosses 0, interpolated."""
    g = cross_grid(bars, SLIPPAGE_CELLS).withColumn("factor", F.round(F.col("cost") / COST, 6))
    w = Window.partitionBy("symbol").orderBy("factor")
    pm, pf = F.lag("mean").over(w), F.lag("factor").over(w)
    at = F.when((pm > 0) & (F.col("mean") <= 0), pf + (F.col("factor") - pf) * pm / (pm - F.col("mean")))
    return g.withColumn("break_even", at).select("symbol", "factor", "mean", "metric", "break_even")


def combined_stress(bars: DataFrame) -> DataFrame:
    """Delay by cost grid as a pivot, with the share of cells that keep a positive mean."""
    g = cross_grid(bars, STRESS_CELLS).withColumn("c", F.round(F.col("cost") / COST).cast("int"))
    p = g.groupBy("symbol", "delay").pivot("c", [1, 2, 3]).agg(F.first("mean"))
    survive = g.groupBy("symbol").agg((100.0 * F.count_if(F.col("mean") > 0) / F.count(F.lit(1))).alias("survival_pct"))
    return p.join(survive, "symbol").select("symbol", "delay", F.col("1").alias("cost_1"), F.col("2").alias("cost_2"), F.col("3").alias("cost_3"), "survival_pct")


def parameter_sweep(bars: DataFrame) -> DataFrame:
    """One parameter: the best value and the mean step between neighbours."""
    g = cross_grid(bars, SWEEP_CELLS).withColumn("metric", F.round("metric", 9))
    step = F.abs(F.col("metric") - F.lag("metric").over(Window.partitionBy("symbol").orderBy("fast")))
    return g.withColumn("step", step).groupBy("symbol").agg(F.min_by("fast", F.struct(-F.col("metric"), F.col("fast"))).alias("best"), F.max("metric").alias("metric"), F.avg("step").alias("mean_step"))


def heat_map(bars: DataFrame) -> DataFrame:
    """Two parameters: the best cell, the share of cells within 90 % of it, the steepest step between neighbours."""
    g = cross_grid(bars, HEAT_CELLS).withColumn("metric", F.round("metric", 9))
    across = F.abs(F.col("metric") - F.lag("metric").over(Window.partitionBy("symbol", "fast").orderBy("slow")))
    down = F.abs(F.col("metric") - F.lag("metric").over(Window.partitionBy("symbol", "slow").orderBy("fast")))
    g = g.withColumn("step", F.greatest(across, down)).withColumn("best", F.max("metric").over(Window.partitionBy("symbol")))
    cell = F.struct(-F.col("metric"), F.col("fast"), F.col("slow"))
    return g.groupBy("symbol").agg(F.min_by("fast", cell).alias("fast"), F.min_by("slow", cell).alias("slow"), F.max("metric").alias("metric"), (100.0 * F.count_if(F.col("metric") >= 0.9 * F.col("best")) / F.count(F.lit(1))).alias("plateau_pct"), F.max("step").alias("cliff"))


def _gpd(excess: np.ndarray) -> tuple[float, float]:
    """Generalised Pareto shape and scale by probability-weighted moments, the shape within half of either side."""
    x = np.sort(excess)
    n = len(x)
    b0, b1 = x.mean(), ((n - np.arange(1, n + 1)) / (n - 1) * x).mean()
    xi = float(np.clip(2 - b0 / (b0 - 2 * b1), -0.5, 0.5)) if abs(b0 - 2 * b1) > 1e-12 else 0.0
    return xi, float(max(b0 * (1 - xi), 1e-12))


def extreme_value(returns: DataFrame, level: float = 0.99) -> DataFrame:
    """Peaks over the 90th percentile of losses: shape, scale, VaR and CVaR, both as negative returns."""

    from .statistics import per_series

    def tail(r: np.ndarray) -> list[float] | None:
        loss = -r
        u = np.quantile(loss, 0.9)
        over = loss[loss > u] - u
        if len(over) < 3:
            return None
        xi, sigma = _gpd(over)
        ratio = (1 - level) / (len(over) / len(loss))
        var = u + (sigma / xi * (ratio**-xi - 1) if abs(xi) > 1e-9 else -sigma * np.log(ratio))
        cvar = (var + sigma - xi * u) / (1 - xi)
        return [xi, sigma, -var, -cvar]

    return per_series(returns, tail, ["xi", "sigma", "evt_var", "evt_cvar"])
