"""Statistics of return series: resampling, distribution, risk, overfitting, drift, attribution."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import running
from ..sources.storage import ROWS_A_TASK, cut
from .normal import chi2_sf_even, norm_cdf, ppf

BY = "strategy_id"


def run() -> object:
    return Window.partitionBy(BY).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def draw(sim: Column, k: Column, n: Column) -> Column:
    """A pseudo-random place from 1 to n by arithmetic that any engine repeats: two rounds of a congruence."""
    a = F.pmod(sim * 1103515 + k * 12345 + 6789, F.lit(1_000_003))
    return F.pmod(a * 7919 + sim * 31 + k * 17, F.lit(999_983)) % n + 1


def _series(returns: DataFrame) -> DataFrame:
    """One row for each series: its returns in order, as an array."""
    return returns.groupBy(BY).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "r"))), lambda x: x["r"]).alias("r"))


def _drawn(sim: np.ndarray, k: np.ndarray, n: int) -> np.ndarray:
    """`draw` over arrays."""
    a = (sim * 1103515 + k * 12345 + 6789) % 1_000_003
    return (a * 7919 + sim * 31 + k * 17) % 999_983 % n + 1


def _each_series(make, columns: list[str]):
    """A task's function: `make` gives a row of numbers, or None, for each series; series without returns give none."""

    def run(batches):
        for batch in batches:
            ids, rows = [], []
            for key, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.array(r, np.float64)
                made = make(x) if len(x) else None
                if made is not None:
                    ids.append(key)
                    rows.append(made)
            cols = np.array(rows, np.float64).reshape(len(rows), len(columns))
            yield pa.record_batch([pa.array(ids, batch.schema.types[0]), *(pa.array(c) for c in cols.T)], names=[BY, *columns])

    return run


def per_series(returns: DataFrame, make, columns: list[str]) -> DataFrame:
    return each_series(_series(returns), make, columns)


def each_series(series: DataFrame, make, columns: list[str]) -> DataFrame:
    """`make`'s numbers for each row of a strategy and its returns as an array."""
    return series.mapInArrow(_each_series(make, columns), f"{BY} {series.schema[BY].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in columns))


BOOTSTRAPPED = ["mean", "sharpe", "win", "profit_factor"]


def bootstrap(returns: DataFrame, columns: list[str], sims: int = 1000, level: float = 0.95) -> DataFrame:
    """Percentile intervals of resampled statistics of every series, and the share of simulations not above 0 (profit factor: 1).

    Statistics: mean, Sharpe ratio (population deviation; 0 without deviation), win rate, profit factor (10 without losses).
    A series is one row, and its simulations are made where it lies: nothing is shuffled but the returns, once.
    """
    low, high = 100 * (1 - level) / 2, 100 * (1 + level) / 2

    def make(x: np.ndarray) -> list[float]:
        n, out = len(x), []
        parts = []
        for lo in range(1, sims + 1, max(1, (1 << 20) // n)):  # bounded memory for long series
            sim = np.arange(lo, min(sims + 1, lo + max(1, (1 << 20) // n)), dtype=np.int64)
            y = x[_drawn(sim[:, None], np.arange(1, n + 1, dtype=np.int64)[None, :], n) - 1]
            sd, mean = y.std(1), y.mean(1)
            gain, loss = np.where(y > 0, y, 0).sum(1), np.where(y < 0, -y, 0).sum(1)
            with np.errstate(all="ignore"):
                parts.append(np.stack([mean, np.where(sd > 1e-9, mean / sd, 0.0), (y > 0).mean(1), np.where((y < 0).any(1), gain / loss, 10.0)]))
        values = dict(zip(BOOTSTRAPPED, np.concatenate(parts, axis=1), strict=True))
        for c in columns:
            v = values[c]
            out += [*np.percentile(v, [low, high]), float((np.round(v, 12) <= (1 if c == "profit_factor" else 0)).mean())]
        return out

    return per_series(returns, make, [f"{c}_{x}" for c in columns for x in ("low", "high", "p")])


def _permuted(x: np.ndarray, sims: np.ndarray, cost: float) -> np.ndarray:
    """The running sums of a series, less costs, in the order of a seeded key, for each simulation."""
    return np.cumsum(x[_orders(len(x), int(sims[0]), len(sims))] - cost, axis=1)


def _orders(n: int, first: int, sims: int) -> np.ndarray:
    """The orders of `n` places in `sims` simulations from `first` on; those of a length are kept while they are short."""
    return (_kept_orders if n * sims <= 1 << 18 else _kept_orders.__wrapped__)(n, first, sims)


@lru_cache(maxsize=64)
def _kept_orders(n: int, first: int, sims: int) -> np.ndarray:
    key = _drawn(np.arange(first, first + sims, dtype=np.int64)[:, None], np.arange(1, n + 1, dtype=np.int64)[None, :], 999_983)
    return np.argsort(key, axis=1, kind="stable")


def _signs(n: int, first: int, sims: int) -> np.ndarray:
    """The signs of `n` places in `sims` simulations from `first` on, kept likewise."""
    return (_kept_signs if n * sims <= 1 << 18 else _kept_signs.__wrapped__)(n, first, sims)


@lru_cache(maxsize=64)
def _kept_signs(n: int, first: int, sims: int) -> np.ndarray:
    drawn = _drawn(np.arange(first, first + sims, dtype=np.int64)[:, None], np.arange(1, n + 1, dtype=np.int64)[None, :], 2)
    return np.where(drawn == 1, 1.0, -1.0)


def monte_carlo(returns: DataFrame, sims: int = 1000, cost: float = 0.0, ruin: float = 0.5) -> DataFrame:
    """Orders permuted by a seeded key: drawdown mean and 95th percentile, shares of profit and of ruin; returns are added, less costs."""

    def make(x: np.ndarray) -> list[float]:
        dd, final, step = [], [], max(1, (1 << 20) // len(x))
        for lo in range(1, sims + 1, step):
            e = 1 + _permuted(x, np.arange(lo, min(sims + 1, lo + step), dtype=np.int64), cost)
            dd.append((1 - e / np.maximum(1.0, np.maximum.accumulate(e, axis=1))).max(1))
            final.append(e[:, -1])
        d, f = np.concatenate(dd), np.concatenate(final)
        return [d.mean(), np.percentile(d, 95), (np.round(f, 9) > 1).mean(), (np.round(d, 9) >= ruin).mean()]

    return per_series(returns, make, ["dd_mean", "dd_95", "p_profit", "p_ruin"])


def pass_rate(returns: DataFrame, sims: int = 1000, target: float = 0.1, limit: float = 0.1) -> DataFrame:
    """Share of permuted accounts that reach `target` before they lose `limit`."""
    return per_series(returns, _pass_rate(sims, target, limit), ["pass_rate"])


def _pass_rate(sims: int = 1000, target: float = 0.1, limit: float = 0.1):
    def make(x: np.ndarray) -> list[float]:
        passed, step = 0, max(1, (1 << 20) // len(x))
        for lo in range(1, sims + 1, step):
            e = np.round(_permuted(x, np.arange(lo, min(sims + 1, lo + step), dtype=np.int64), 0.0), 9)
            first = lambda hit: np.where(hit.any(1), hit.argmax(1), 1 << 30)
            passed += int((first(e >= target) < first(e <= -limit)).sum())
        return [passed / sims]

    return make


def sign_flip(returns: DataFrame, sims: int = 40) -> DataFrame:
    """`p`: the share of simulations whose mean, with signs flipped by a seeded draw, is at least the real one."""
    return per_series(returns, _sign_flip(sims), ["p"])


def _sign_flip(sims: int = 40):
    def make(x: np.ndarray) -> list[float]:
        n, hits, step = len(x), 0, max(1, (1 << 20) // len(x))
        real = round(float(x.mean()), 12)
        for lo in range(1, sims + 1, step):
            sign = _signs(n, lo, min(sims + 1, lo + step) - lo)
            hits += int((np.round((sign * x).mean(1), 12) >= real).sum())
        return [hits / sims]

    return make


def resampled(x: np.ndarray) -> list[float]:
    """What `sign_flip` and `pass_rate` say about a series."""
    return [*_sign_flip()(x), *_pass_rate()(x)]


def walk_forward(returns: DataFrame, folds: int = 3, share: float = 0.7) -> DataFrame:
    """Per fold: in-sample and out-of-sample mean; then degradation, share of positive folds, correlation."""
    n = F.max("t").over(Window.partitionBy(BY))
    f = returns.withColumn("n", n).withColumn("size", F.floor(F.col("n") / folds)).filter("size >= 3").withColumn("fold", F.floor((F.col("t") - 1) / F.col("size"))).filter(F.col("fold") < folds)
    f = f.withColumn("inside", (F.col("t") - 1) % F.col("size") < F.floor(F.col("size") * share))
    g = f.groupBy(BY, "fold").agg(F.avg(F.when(F.col("inside"), F.col("r"))).alias("is_mean"), F.avg(F.when(~F.col("inside"), F.col("r"))).alias("oos_mean"))
    return g.groupBy(BY).agg(F.avg("is_mean").alias("is_mean"), F.avg("oos_mean").alias("oos_mean"), (F.count_if(F.col("oos_mean") > 0) / F.count(F.lit(1))).alias("positive"), F.when((F.stddev_pop("is_mean") > 1e-9) & (F.stddev_pop("oos_mean") > 1e-9), F.try_divide(F.covar_pop("is_mean", "oos_mean"), F.stddev_pop("is_mean") * F.stddev_pop("oos_mean"))).alias("corr"))


def serial_dependence(series: DataFrame, by: str, order: str, value: str, lags: int = 10) -> DataFrame:
    """Autocorrelations up to `lags`, Ljung-Box statistic and its p-value."""
    g = lagged(series, by, [order], value, lags).groupBy(by).agg(*lag_sums(lags)).withColumnRenamed("lagged", "n")
    q, p = ljung_box("n", lags)
    return g.withColumn("q", q).withColumn("p", p)


def lagged(series: DataFrame, by: str, order: list[str], value: str, lags: int = 10) -> DataFrame:
    """Add `m`, the value less its mean, and `l1` and so on, what that was before."""
    w = Window.partitionBy(by).orderBy(*order)
    m = series.withColumn("m", F.col(value) - F.avg(value).over(Window.partitionBy(by)))
    return m.withColumns({f"l{k}": F.lag("m", k).over(w) for k in range(1, lags + 1)})


def lag_sums(lags: int = 10) -> list[Column]:
    """The count of values and the autocorrelations."""
    return [F.count("m").alias("lagged"), *[F.try_divide(F.sum(F.col("m") * F.col(f"l{k}")), F.sum(F.col("m") * F.col("m"))).alias(f"ac{k}") for k in range(1, lags + 1)]]


def ljung_box(n: str, lags: int = 10) -> tuple[Column, Column]:
    """The statistic from a count and autocorrelations, and its p-value."""
    q = sum((F.col(f"ac{k}") * F.col(f"ac{k}") / (F.col(n) - k) for k in range(1, lags + 1)), F.lit(0.0)) * F.col(n) * (F.col(n) + 2)
    return q, chi2_sf_even(q, lags)


def distribution(returns: DataFrame) -> DataFrame:
    """Moments and the Jarque-Bera test (two degrees: p = exp(-x / 2))."""
    g = returns.groupBy(BY).agg(*moments())
    return g.withColumn("jb", jarque_bera()).withColumn("jb_p", F.exp(-F.col("jb") / 2))


def moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.skewness("r").alias("skew"), F.kurtosis("r").alias("kurt")]


def jarque_bera() -> Column:
    return F.col("n") / 6 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)


def cornish_fisher_var(level: float, mean: str, sd: str, skew: str, kurt: str) -> Column:
    return F.col(mean) + cornish_fisher(ppf(1 - level), F.col(skew), F.col(kurt)) * F.col(sd)


def cornish_fisher(z: float, s: Column, k: Column) -> Column:
    return z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36


def value_at_risk(returns: DataFrame, level: float = 0.95) -> DataFrame:
    """Historical, parametric and Cornish-Fisher VaR, and CVaR in a second pass."""
    z = ppf(1 - level)
    g = returns.groupBy(BY).agg(F.percentile("r", 1 - level).alias("var_hist"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku"))
    tail = returns.join(g.select(BY, "var_hist"), BY).filter(F.col("r") <= F.col("var_hist") + 1e-12).groupBy(BY).agg(F.avg("r").alias("cvar"))
    return g.join(tail, BY).select(BY, "var_hist", (F.col("mu") + z * F.col("sd")).alias("var_normal"), cornish_fisher_var(level, "mu", "sd", "sk", "ku").alias("var_cf"), "cvar")


GAMMA = 0.5772156649


def sharpe_tests(returns: DataFrame, trials: int = 100, benchmark: float = 0.0) -> DataFrame:
    """Probabilistic and deflated Sharpe ratios and the least track record."""
    e_max = (1 - GAMMA) * ppf(1 - 1 / trials) + GAMMA * ppf(1 - 1 / (trials * math.e)) if trials > 1 else 0.0
    g = returns.groupBy(BY).agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("sk"), (F.kurtosis("r") + 3).alias("ku")).filter("sd > 1e-9")
    sr = F.col("mu") / F.col("sd")
    g = g.withColumn("sr", sr).withColumn("se", F.sqrt(F.greatest((1 - F.col("sk") * sr + (F.col("ku") - 1) / 4 * sr * sr) / (F.col("n") - 1), F.lit(1e-12))))
    g = g.withColumn("psr_z", (F.col("sr") - benchmark / math.sqrt(252)) / F.col("se")).withColumn("dsr_z", (F.col("sr") - e_max / F.sqrt("n")) / F.col("se"))
    return g.withColumns({"psr": norm_cdf("psr_z"), "dsr_p": 1 - norm_cdf("dsr_z"), "min_track": F.when(F.abs("sr") < 1e-9, F.lit(999_999)).otherwise(F.least(F.lit(999_999.0), F.ceil(F.pow(e_max / F.col("sr"), F.lit(2.0)) - 1e-9)).cast("long"))})


def combination_sharpes(returns: DataFrame, parts: int = 8) -> DataFrame:
    """The Sharpe ratio of every strategy in (`is_`) and out of (`oos`) each half of its parts.

    A strategy is one stored row of n, sum and sum of squares of its parts; every combination of half the parts adds those
    where they lie. No combination reads or groups a series again. Combinations: C(parts, parts / 2) rows a strategy.
    """
    places = range(1, parts + 1)
    parted = returns.withColumn("part", F.ntile(parts).over(Window.partitionBy(BY).orderBy("t")))
    of = lambda p, x: F.sum(F.when(F.col("part") == p, x))
    sums = parted.groupBy(BY).agg(*[F.coalesce(of(p, x), F.lit(0)).alias(f"{n}{p}") for p in places for n, x in (("n", F.lit(1)), ("s", F.col("r")), ("ss", F.col("r") * F.col("r")))])
    # numpy: as an expression, the sums of all parts are too much code for the JVM to compile
    return cut(sums, "parts").mapInArrow(_combined(parts), f"combo int, {BY} {returns.schema[BY].dataType.simpleString()}, is_ double, oos double")


def _combined(parts: int, step: int = 1000):
    """A task's function: for rows of a strategy, and n, s and ss of each part, a row for each combination."""
    chosen = np.array([[p in c for p in range(parts)] for c in itertools.combinations(range(parts), parts // 2)])

    def sharpe(x: np.ndarray, take: np.ndarray) -> np.ndarray:
        n, s, ss = (reduce(add, [np.where(take[:, p], x[:, 3 * p + k, None], 0.0) for p in range(parts)]) for k in range(3))
        with np.errstate(all="ignore"):
            var = (ss - s * s / n) / (n - 1)
            return np.round(np.where((n > 1) & (var > 1e-18), s / n / np.sqrt(var) * math.sqrt(252), 0.0), 9) + np.where(n > 0, 0.0, np.nan)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = batch.slice(at, step)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in rows.columns[1:]], axis=1).astype(np.float64)
                inside = sharpe(x, chosen)
                outside = inside[:, ::-1] if parts % 2 == 0 else sharpe(x, ~chosen)  # the rest of a half is the half as far from the end
                ids = rows.column(0).take(pa.array(np.repeat(np.arange(rows.num_rows), len(chosen))))
                values = [pa.array(v.ravel(), from_pandas=True) for v in (inside, outside)]
                yield pa.record_batch([pa.array(np.tile(np.arange(len(chosen), dtype=np.int32), rows.num_rows)), ids, *values], names=["combo", BY, "is_", "oos"])

    return run


def pbo(returns: DataFrame, parts: int = 8) -> DataFrame:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    The pick of each combination, then its rank among all strategies by counting: no combination is one group of all strategies.
    """
    return picked(combination_sharpes(returns, parts))


def picked(both: DataFrame) -> DataFrame:
    """The strategy that each combination picks in sample, and the logit of its rank out of sample."""
    best = both.groupBy("combo").agg(F.max_by(BY, F.struct("is_", -F.col(BY))).alias(BY), F.max("is_").alias("is_"), F.max_by("oos", F.struct("is_", -F.col(BY))).alias("oos"))
    all_ = both.select("combo", F.col("oos").alias("other")).join(F.broadcast(best.select("combo", "oos")), "combo")  # a row for each combination
    ranks = all_.groupBy("combo").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("other") < F.col("oos")) + (F.count_if(F.col("other") == F.col("oos")) + 1) / 2).alias("rank"))
    best = best.join(ranks, "combo")
    p = F.least(F.greatest(F.col("rank") / F.col("n"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return best.select("combo", BY, F.col("is_").alias("best_is"), "oos", F.log(p / (1 - p)).alias("logit"))


def pbo_summary(combos: DataFrame) -> DataFrame:
    """Textbook PBO (logit below 0) and the share of combinations whose pick loses out of sample."""
    return combos.agg(F.count(F.lit(1)).alias("combos"), (F.count_if(F.col("logit") < 0) / F.count(F.lit(1))).alias("pbo"), (F.count_if(F.col("oos") < 0) / F.count(F.lit(1))).alias("share_negative"))


def average_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Add `name`, the rank of `value` in its group, from 1, the mean of the ranks of equal values; rows without a value go.

    Ranks are running counts over ranges of (group, value), one row for each distinct value, so that no group is one task's.
    """
    known = df.filter(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = running(counts, [value], sums={"__c": F.col("__n")}, by=by)
    return known.join(upto.select(*by, value, (F.col("__c") - (F.col("__n") - 1) / 2).alias(name)), [*by, value])


def _runs(table: pa.Table, by: list[str], value: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows by group and value; where each group begins; each row's group; and its rank among the group's rows here, ties at their mean."""
    code = np.zeros(table.num_rows, np.int64)
    for c in by:
        one = pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode")
        code = code * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False)
    v = table[value].to_numpy()
    order = np.lexsort((v, code))
    code, v = code[order], v[order]
    group = np.flatnonzero(np.diff(code, prepend=-1))
    of = np.repeat(np.arange(len(group)), np.diff(group, append=len(code)))
    tie = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (v != np.concatenate([v[:1], v[:-1]])))
    many = np.diff(tie, append=len(code))
    return order, group, of, np.repeat(tie + (many + 1) / 2, many) - group[of]


def _local_ranks(by: list[str], x: str, y: str):
    """A task's function: its range's rows with the rank of `x` among the rows of their group there."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows)
            order, _, _, rank = _runs(table, by, x)
            out = table.select([*by, y]).take(pa.array(order))
            part = pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32))
            yield from out.append_column("__rank", pa.array(rank)).append_column("__part", part).to_batches(max_chunksize=10_000)

    return run


def _local_products(by: list[str], y: str):
    """A task's function: of each group in its range, sums over the centred ranks `__x` and, about their mean there, over the ranks of `y`."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows)
            order, group, of, rank = _runs(table, by, y)
            cx, n = table["__x"].to_numpy()[order], np.bincount(of)
            mean = np.bincount(of, rank) / n
            cy = rank - mean[of]
            first = table.select([*by, "__n"]).take(pa.array(order[group])).combine_chunks()
            sums = {"n": n, "sx": np.bincount(of, cx), "sxx": np.bincount(of, cx * cx), "my": mean, "syy": np.bincount(of, cy * cy), "sxy": np.bincount(of, cx * cy), "__part": np.full(len(n), TaskContext.get().partitionId(), np.int32)}
            for k, v in sums.items():
                first = first.append_column(k, pa.array(v))
            yield from first.to_batches()

    return run


def rank_correlation(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Spearman's correlation of two columns in each group; rows that lack either are left out.

    Rows are dealt to ranges of `x`, whose tasks rank them, and then to ranges of `y`, whose tasks rank those and add up products;
    what the ranges before hold of a group is added. A range has the rows of all groups; equal values share one.
    """
    types = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    value = lambda c: (F.col(c).cast("double") + 0.0).alias(c)
    both = cut(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, value(x), value(y)), "pairs")  # stored: ranges are found before rows are dealt
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // ROWS_A_TASK))
    ranked = cut(both.repartitionByRange(tasks, x).mapInArrow(_local_ranks(by, x, y), f"{types}, {y} double, __rank double, __part int"), "ranks")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = ranked.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__h"))
    held = cut(held.select("__part", *by, F.coalesce(F.sum("__h").over(before), F.lit(0)).alias("__before"), F.sum("__h").over(Window.partitionBy(*by)).alias("__n")), "held")
    same = reduce(lambda a, c: a & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")), by, F.col("l.__part") == F.col("r.__part"))
    centred = ranked.alias("l").join(held.alias("r"), same).select(*[F.col(f"l.`{c}`") for c in by], y, "__n", (F.col("__rank") + F.col("__before") - (F.col("__n") + 1) / 2).alias("__x"))
    sums = centred.repartitionByRange(tasks, y).mapInArrow(_local_products(by, y), f"{types}, __n long, n long, sx double, sxx double, my double, syy double, sxy double, __part int")
    far = F.col("my") + F.coalesce(F.sum("n").over(before), F.lit(0)) - (F.col("__n") + 1) / 2
    g = sums.withColumn("far", far).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("sxx").alias("xx"), F.sum(F.col("syy") + F.col("n") * F.col("far") * F.col("far")).alias("yy"), F.sum(F.col("sxy") + F.col("far") * F.col("sx")).alias("xy"))
    return g.select(*by, "n", F.try_divide("xy", F.nullif(F.sqrt("xx") * F.sqrt("yy"), F.lit(0.0))).alias("spearman"))


def overfitting(returns: DataFrame, parts: int = 8) -> DataFrame:
    """What picking by the in-sample Sharpe ratio does: PBO, the mean and deviation of logits, the mean rank correlation between
    in-sample and out-of-sample Sharpe ratios, and the share of combinations whose pick loses out of sample."""
    both = combination_sharpes(returns, parts)
    picks = picked(both)
    ranks = rank_correlation(both, ["combo"], "is_", "oos")
    return picks.join(ranks, "combo").agg(
        F.count(F.lit(1)).alias("combos"), (F.count_if(F.col("logit") < 0) / F.count(F.lit(1))).alias("pbo"), F.avg("logit").alias("logit_mean"), F.stddev_pop("logit").alias("logit_std"),
        F.avg("spearman").alias("degradation"), (F.count_if(F.col("oos") < 0) / F.count(F.lit(1))).alias("share_negative"),
    )


def tail_dependence(df: DataFrame, by: str, x: str, y: str, q: float = 0.05) -> DataFrame:
    """Empirical tail dependence by group: of the rows with `x` in its lowest (highest) share `q`, how many have `y` there, too.

    Limits are interpolated percentiles; both are counted in one pass over the rows. Rows that lack either value are left out.
    """
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    limit = known.groupBy(by).agg(F.percentile(x, [q, 1 - q]).alias("__x"), F.percentile(y, [q, 1 - q]).alias("__y"))
    low = lambda c, e: F.col(c) <= F.get(e, F.lit(0)) + 1e-12
    high = lambda c, e: F.col(c) >= F.get(e, F.lit(1)) - 1e-12
    g = known.join(limit, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(low(x, "__x")).alias("low"), F.count_if(low(x, "__x") & low(y, "__y")).alias("both_low"),
        F.count_if(high(x, "__x")).alias("high"), F.count_if(high(x, "__x") & high(y, "__y")).alias("both_high"),
    )
    return g.select(by, "n", "both_low", "both_high", F.try_divide("both_low", "low").alias("lambda_low"), F.try_divide("both_high", "high").alias("lambda_high"))


def tail_risk(returns: DataFrame) -> DataFrame:
    """VaR and CVaR at 95 and 99 %, drawdown at risk, and a tail score from skew, kurtosis, CVaR / VaR and drawdown."""
    w = run()
    curve = returns.withColumn("e", F.exp(F.sum(F.log1p(F.greatest("r", F.lit(-0.99)))).over(w))).withColumn("dd", 1 - F.col("e") / F.greatest(F.lit(1.0), F.max("e").over(w)))
    g = curve.groupBy(BY).agg(F.percentile("r", 0.05).alias("var95"), F.percentile("r", 0.01).alias("var99"), F.percentile("dd", 0.95).alias("dar95"), F.max("dd").alias("max_dd"), F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku"), F.count(F.lit(1)).alias("n"))
    tails = returns.join(g.select(BY, "var95", "var99"), BY).groupBy(BY).agg(F.avg(F.when(F.col("r") <= F.col("var95") + 1e-12, F.col("r"))).alias("cvar95"), F.avg(F.when(F.col("r") <= F.col("var99") + 1e-12, F.col("r"))).alias("cvar99"))
    g = g.join(tails, BY)
    ratio, jb = F.when(F.col("var95") < -1e-9, F.col("cvar95") / F.col("var95")), F.col("n") / 6 * (F.col("sk") * F.col("sk") + F.col("ku") * F.col("ku") / 4)
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    score = part(F.col("sk") < -0.5, F.least(F.abs("sk") / 3, F.lit(0.25))) + part(F.col("ku") > 1, F.least(F.col("ku") / 10, F.lit(0.25))) + part(F.exp(-jb / 2) < 0.05, F.lit(0.1)) + part(ratio > 1.5, F.least((ratio - 1) / 3, F.lit(0.15))) + part(F.col("max_dd") > 0.2, F.least((F.col("max_dd") - 0.2) / 0.3, F.lit(0.1)))
    return g.withColumn("score", F.least(F.lit(1.0), score)).drop("sk", "ku", "n")


def cusum(series: DataFrame, by: str, order: str, z: str, k: float = 0.5) -> DataFrame:
    """Two-sided CUSUM with reset at 0, in closed form: C - min(0, least C so far)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = series.withColumns({"__u": F.sum(F.col(z) - k).over(w), "__d": F.sum(-F.col(z) - k).over(w)})
    return df.withColumns({"cusum_up": F.col("__u") - F.least(F.lit(0.0), F.min("__u").over(w)), "cusum_down": F.col("__d") - F.least(F.lit(0.0), F.min("__d").over(w))}).drop("__u", "__d")


def page_hinkley(series: DataFrame, by: str, order: str, value: str, delta: float = 0.005) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = series.withColumn("__x", F.col(value) - F.avg(value).over(w) - delta).withColumn("__s", F.sum("__x").over(w))
    return df.withColumn("page_hinkley", F.col("__s") - F.min("__s").over(w)).drop("__x", "__s")


def population_stability(reference: DataFrame, live: DataFrame, by: str, value: str, bins: int = 10) -> DataFrame:
    """PSI over the reference's quantile bins, and the Kolmogorov-Smirnov distance, in one pass each."""
    edges = reference.groupBy(by).agg(F.percentile(value, [i / bins for i in range(1, bins)]).alias("edges"))
    both = reference.select(by, value, F.lit(1).alias("ref")).unionByName(live.select(by, value, F.lit(0).alias("ref"))).join(edges, by)
    b = both.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(value)))).groupBy(by, "bin").agg(F.sum("ref").alias("a"), F.sum(1 - F.col("ref")).alias("b"))
    grid = edges.select(by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(b, [by, "bin"], "left").na.fill(0, ["a", "b"])
    w = Window.partitionBy(by)
    grid = grid.withColumn("pa", F.greatest(F.col("a") / F.sum("a").over(w), F.lit(1e-6))).withColumn("pb", F.greatest(F.col("b") / F.sum("b").over(w), F.lit(1e-6)))
    psi = grid.groupBy(by).agg(F.sum((F.col("pb") - F.col("pa")) * F.log(F.col("pb") / F.col("pa"))).alias("psi"))
    n = both.groupBy(by, value).agg(F.sum("ref").alias("a"), F.sum(1 - F.col("ref")).alias("b"))
    summed = running(n, [value], sums={"ca": F.col("a"), "cb": F.col("b")}, by=[by])
    whole = n.groupBy(by).agg(F.sum("a").alias("n_ref"), F.sum("b").alias("n_live"))
    far = F.max(F.abs(F.col("ca") / F.col("n_ref") - F.col("cb") / F.col("n_live"))).alias("ks")
    ks = summed.join(whole, by).groupBy(by).agg(far, F.first("n_ref").alias("n_ref"), F.first("n_live").alias("n_live"))
    return psi.join(ks, by)


def ks_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value."""
    e = F.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * sum((F.lit((-1.0) ** (k - 1)) * F.exp(-2 * k * k * x * x) for k in range(1, 6)), F.lit(0.0))))


SEVERITY = ["none", "warning", "critical"]


def drift(reference: DataFrame, live: DataFrame, by: str = "symbol", value: str = "r") -> DataFrame:
    """Drift checks with the greatest severity: KS, PSI, Sharpe loss, mean shift, variance ratio. Severities are ranks, not strings."""
    st = lambda df, p: df.groupBy(by).agg(F.avg(value).alias(f"{p}_mean"), F.stddev_samp(value).alias(f"{p}_sd"), F.count(value).alias(f"{p}_n"))
    x = population_stability(reference, live, by, value).join(st(reference, "ref"), by).join(st(live, "live"), by)
    x = x.withColumn("ks_p", ks_p(F.col("ks"), F.col("n_ref"), F.col("n_live"))).withColumn("mean_z", F.abs(F.col("live_mean") - F.col("ref_mean")) / (F.col("ref_sd") / F.sqrt("live_n"))).withColumn("var_ratio", F.pow(F.col("live_sd") / F.col("ref_sd"), F.lit(2.0)))
    loss = F.when(F.col("ref_mean") > 0, (F.col("live_mean") / F.col("live_sd")) / (F.col("ref_mean") / F.col("ref_sd")) - 1)
    rank = lambda warn, crit: F.when(crit, 2).when(warn, 1).otherwise(0)
    x = x.withColumn("sharpe_change", loss).withColumn("severity", F.greatest(
        rank(F.col("ks_p") < 0.05, F.col("ks_p") < 0.01), rank(F.col("psi") > 0.1, F.col("psi") > 0.25), rank(F.col("sharpe_change") < -0.3, F.col("sharpe_change") < -0.5),
        rank(F.col("mean_z") > 2, F.lit(False)), rank((F.col("var_ratio") > 2) | (F.col("var_ratio") < 0.5), F.lit(False)),
    ))
    return x.select(by, "psi", "ks", "ks_p", "mean_z", "var_ratio", "sharpe_change", F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity") + 1).alias("severity"))


def attribution(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Ordinary least squares of returns on a benchmark, with compounded returns."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("beta"), F.regr_intercept(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), (F.exp(F.sum(F.log1p(y))) - 1).alias("total"), correlation(y, x).alias("corr"), F.covar_samp(y, x).alias("cov"))


def losing_streak(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """The longest run of losses: gaps and islands."""
    w = Window.partitionBy(by).orderBy(*order)
    df = df.withColumn("lost", F.col(value) < 0).withColumn("island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(by, "lost").orderBy(*order)))
    return df.filter("lost").groupBy(by, "island").count().groupBy(by).agg(F.max("count").alias("longest"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null without deviation on both sides, where Spark's own divides by zero."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def zscore(value: str, by: str) -> Column:
    w = Window.partitionBy(by)
    return (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)


def example_frame(spark: SparkSession, rows: list[tuple[int, int, float]]) -> DataFrame:
    """A small long table of returns."""
    return spark.createDataFrame(rows, "strategy_id long, t long, r double")



def classified(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """What a classifier said and what came, by bin of its probability: `bin`, `n`, mean `said`, share `came`; and over all bins the
    `precision` and `recall` of p >= 0.5, the Brier score and the expected calibration error."""
    b = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int"))
    hit = F.col(p) >= 0.5
    g = b.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("said"), F.avg(label).alias("came"), F.count_if(hit & (F.col(label) == 1)).alias("tp"), F.count_if(hit & (F.col(label) == 0)).alias("fp"),
        F.count_if(~hit & (F.col(label) == 1)).alias("fn"), F.sum(F.pow(F.col(p) - F.col(label), F.lit(2.0))).alias("sq"),
    )
    total = g.agg(
        F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fp"))).alias("precision"), F.try_divide(F.sum("tp"), F.sum(F.col("tp") + F.col("fn"))).alias("recall"),
        (F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.col("n") * F.abs(F.col("said") - F.col("came"))) / F.sum("n")).alias("calibration_error"),
    )
    return g.select("bin", "n", "said", "came").join(F.broadcast(total), how="cross")  # one row
