"""Where returns come from: factors, regimes, timing, costs, and whether what is left is skill.

A regression needs only the sums of products of its columns, its Gram matrix. Those are one aggregate over the rows, with
partial sums before the shuffle; what is solved afterwards is a matrix of a few numbers a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, by: list[str], y: str, factors: list[str]) -> DataFrame:
    """`xx` (the products of 1 and the factors, row by row), `xy`, `yy` and `log` (of 1 + y), summed for each group.

    Rows with a null or NaN in `y` or a factor are left out.
    """
    x = [F.lit(1.0), *[F.col(c) for c in factors]]
    whole = F.lit(True)
    for c in (y, *factors):
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    sums = {f"__{i}_{j}": F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))}
    g = df.filter(whole).groupBy(*by).agg(
        *[v.alias(k) for k, v in sums.items()], *[F.sum(v * F.col(y)).alias(f"__{i}_y") for i, v in enumerate(x)],
        F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(F.log1p(F.greatest(F.col(y), F.lit(-0.999999)))).alias("log"),
    )
    xx = F.array(*[F.col(f"__{min(i, j)}_{max(i, j)}") for i in range(len(x)) for j in range(len(x))])
    return g.select(*by, xx.alias("xx"), F.array(*[F.col(f"__{i}_y") for i in range(len(x))]).alias("xy"), "yy", "log")


def solve(xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Coefficients from a Gram matrix: by Cholesky factors; the least ones that fit where factors depend on each other."""
    size = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    scaled = xx / np.outer(size, size)
    try:
        low = np.linalg.cholesky(scaled)
        if np.diag(low).min() < 1e-7:
            raise np.linalg.LinAlgError
        return np.linalg.solve(low.T, np.linalg.solve(low, xy / size)) / size
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(xx, xy, rcond=1e-12)[0]


def factor_model(df: DataFrame, by: str, y: str, factors: list[str]) -> DataFrame:
    """Multi-factor regression of `y` by group: n, alpha, a `beta_` and an `attributed_` (beta times the factor's sum) for each
    factor, `residual` (the sum that nothing explains), `r2` and `total` (compounded).

    A group with no more rows than coefficients has none, as any line would fit.
    """
    names = ["n", "alpha", *[f"beta_{f}" for f in factors], *[f"attributed_{f}" for f in factors], "residual", "r2", "total"]
    k = len(factors) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for key, xx, xy, yy, log in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                xx, xy = np.array(xx).reshape(k, k), np.array(xy)
                if xx[0, 0] <= k:
                    continue
                b = solve(xx, xy)
                spread = yy - xy[0] ** 2 / xx[0, 0]
                r2 = 1 - (yy - 2 * b @ xy + b @ xx @ b) / spread if spread > 1e-15 else 0.0
                parts = b[1:] * xx[0, 1:]
                keys.append(key)
                rows.append([xx[0, 0], *b, *parts, xy[0] - b @ xx[0], r2, np.expm1(log)])
            cols = np.array(rows, float).reshape(len(rows), len(names)).T
            yield pa.record_batch([pa.array(keys, batch.schema.types[0]), *(pa.array(c) for c in cols)], names=[by, *names])

    kind = df.schema[by].dataType.simpleString()
    return gram(df, [by], y, factors).mapInArrow(run, f"`{by}` {kind}, " + ", ".join(f"`{n}` double" for n in names))


def skill(df: DataFrame, by: str, order: str, y: str, benchmark: str, days: int = 30, sims: int = 1000) -> DataFrame:
    """Is the alpha over a benchmark luck? `blocks`, `alpha`, the share of resampled alphas not above 0 (`p`) and their 95 % interval.

    Rows are resampled by blocks of `days` calendar days, which keeps what neighbouring days share. A block is its Gram
    matrix, so that a resample adds a few numbers a block and no row is read again. Blocks are drawn by arithmetic that repeats.
    Groups with fewer than two blocks have no row.
    """
    from ..functions.statistics import _drawn

    block = F.floor(F.datediff(F.to_date(order), F.lit("1970-01-01").cast("date")) / days)
    parts = gram(df.withColumn("__block", block), [by, "__block"], y, [benchmark])
    one = F.array(*[F.get("xx", F.lit(i)) for i in (0, 1, 3)], *[F.get("xy", F.lit(i)) for i in (0, 1)])
    whole = parts.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__block", one.alias("g")))), lambda b: b["g"]).alias("g"))

    def alpha(s: np.ndarray) -> np.ndarray:
        n, sb, sbb, sy, sby = np.moveaxis(s, -1, 0)
        spread = n * sbb - sb * sb
        slope = np.where(spread > 1e-15, (n * sby - sb * sy) / np.where(spread > 1e-15, spread, 1.0), 0.0)
        return (sy - slope * sb) / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for key, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = np.array(g, float)
                k = len(g)
                if k < 2:
                    continue
                draws = []
                for lo in range(1, sims + 1, step := max(1, (1 << 18) // k)):
                    sim = np.arange(lo, min(sims + 1, lo + step), dtype=np.int64)
                    draws.append(alpha(g[_drawn(sim[:, None], np.arange(1, k + 1, dtype=np.int64)[None, :], k) - 1].sum(axis=1)))
                a = np.concatenate(draws)
                keys.append(key)
                rows.append([k, float(alpha(g.sum(axis=0))), (np.round(a, 12) <= 0).mean(), *np.percentile(a, [2.5, 97.5])])
            cols = np.array(rows, float).reshape(len(rows), 5).T
            yield pa.record_batch([pa.array(keys, batch.schema.types[0]), *(pa.array(c) for c in cols)], names=[by, "blocks", "alpha", "p", "low", "high"])

    kind = df.schema[by].dataType.simpleString()
    return whole.mapInArrow(run, f"`{by}` {kind}, blocks double, alpha double, p double, low double, high double")


def timing(trades: DataFrame, by: str, pnl: str = "pnl", size: str = "size", price: str = "entry_price", held: str = "days", least: int = 5) -> DataFrame:
    """`trade_return`: the mean return on a trade's notional; `hold_value`: its correlation with how long trades are held.

    Groups of fewer than `least` trades get 0 for both; a correlation needs one more, and deviations on both sides.
    """
    t = trades.select(by, (F.col(pnl) / F.greatest(F.abs(F.col(size)) * F.col(price), F.lit(1e-6))).alias("x"), F.col(held).cast("double").alias("h"))
    g = t.groupBy(by).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.covar_pop("x", "h").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("h").alias("sh"))
    enough = F.col("n") >= least
    moves = enough & (F.col("n") > least) & (F.col("sx") > 1e-12) & (F.col("sh") > 1e-12)
    return g.select(by, F.col("n").alias("trades"), F.when(enough, F.col("m")).otherwise(0.0).alias("trade_return"), F.when(moves, F.col("c") / F.greatest(F.col("sx") * F.col("sh"), F.lit(1e-300))).otherwise(0.0).alias("hold_value"))


def costs(df: DataFrame, by: str, net: str, shares: dict[str, str]) -> DataFrame:
    """Gross and net return of each group with its costs: `net` is a log return, `shares` names columns of costs as shares of the cash."""
    g = df.groupBy(by).agg(F.expm1(F.sum(net)).alias("net"), *[F.sum(c).alias(n) for n, c in shares.items()])
    total = sum((F.col(n) for n in shares), F.lit(0.0))
    return g.withColumn("total_cost", total).withColumn("gross", F.col("net") + F.col("total_cost"))


def by_regime(df: DataFrame, by: str, regime: str, value: str) -> DataFrame:
    """For each group the summed return and number of rows of every regime, as maps, and its best and worst regime (ties: by name)."""
    g = df.filter(F.col(value).isNotNull()).groupBy(by, regime).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("s", F.round("s", 12))
    return g.groupBy(by).agg(F.max_by(regime, F.struct("s", regime)).alias("best"), F.min_by(regime, F.struct("s", regime)).alias("worst"), F.max("s").alias("best_return"), F.min("s").alias("worst_return"), F.sum("n").alias("bars"))
