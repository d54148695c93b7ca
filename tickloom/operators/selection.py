"""Selection of strategies: filters, scores, diversification, portfolios, Pareto fronts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from .ordering import neighbours, running
from .pairs import similarity_matrix

#: Metric, weight, least and greatest, whether high is good.
SCORE = [("sharpe_ratio", 1.0, 0.0, 3.0, True), ("max_drawdown_pct", 0.8, 0.0, 50.0, False), ("profit_factor", 0.6, 0.0, 3.0, True), ("win_rate", 0.3, 0.0, 100.0, True), ("total_trades", 0.2, 0.0, 500.0, True)]


def hard_filters(df: DataFrame, sharpe: float = 0.3, drawdown: float = 30.0, trades: int = 3, least_return: float = -100.0) -> DataFrame:
    """`reasons`: an array of what is against a result; a null metric passes."""
    fails = F.array(
        F.when(F.col("sharpe_ratio") < sharpe, "sharpe_too_low"), F.when(F.col("max_drawdown_pct") > drawdown, "drawdown_too_high"), F.when(F.col("total_trades") < trades, "too_few_trades"), F.when(F.col("total_return_pct") < least_return, "return_too_low"),
    )
    return df.withColumn("reasons", F.array_compact(fails))


def composite_score(df: DataFrame) -> DataFrame:
    """Weighted mean of metrics scaled to 0 to 1, over the metrics that are there."""
    total, weights = F.lit(0.0), F.lit(0.0)
    for name, w, low, high, good in SCORE:
        x = F.least(F.greatest((F.col(name) - low) / (high - low), F.lit(0.0)), F.lit(1.0))
        x = F.when(F.col(name).isNotNull(), x if good else 1 - x)
        total, weights = total + F.coalesce(w * x, F.lit(0.0)), weights + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    return df.withColumn("score", F.round(F.try_divide(total, weights) + 3e-11, 9))


def rank_top(df: DataFrame, n: int) -> DataFrame:
    """The n best of those without reasons have a `rank` and are `selected`; the rest of them get `below_top_n_cutoff`.

    Only the n best are ordered; their keys are broadcast. `strategy_id` and `symbol` make a row's key.
    """
    ok = composite_score(hard_filters(df))
    best = best_of(df, n).select(F.col("strategy_id").alias("__s"), F.col("symbol").alias("__y"), "rank")
    both = ok.join(F.broadcast(best), ok["strategy_id"].eqNullSafe(F.col("__s")) & ok["symbol"].eqNullSafe(F.col("__y")), "left").drop("__s", "__y")
    below = (F.size("reasons") == 0) & F.col("rank").isNull()
    return both.withColumn("selected", F.col("rank").isNotNull()).withColumn("reasons", F.when(below, F.array(F.lit("below_top_n_cutoff"))).otherwise(F.col("reasons")))


def best_of(df: DataFrame, n: int) -> DataFrame:
    """The n best of those without reasons, with their `rank`: one pass over `df`."""
    order = (F.desc("score"), "strategy_id", "symbol")
    best = composite_score(hard_filters(df)).filter(F.size("reasons") == 0).orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def pair_correlations(returns: DataFrame, ids: DataFrame) -> DataFrame:
    """Absolute correlation of every pair of a short list over their common places (equal t): a join on t, not a cross of series."""
    r = returns.join(ids, "strategy_id")
    a, b = r.select(F.col("strategy_id").alias("a"), "t", F.col("r").alias("x")), r.select(F.col("strategy_id").alias("b"), "t", F.col("r").alias("y"))
    g = a.join(b, "t").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.filter("n >= 3 and sx > 1e-9 and sy > 1e-9").select("a", "b", F.abs(F.col("c") / (F.col("sx") * F.col("sy"))).alias("corr"))


def pair_jaccard(trades: DataFrame, ids: DataFrame) -> DataFrame:
    """Jaccard similarity of the sets of entry dates of every pair that shares one."""
    d = trades.join(ids, "strategy_id").select("strategy_id", F.to_date("entry_ts").alias("day")).distinct()
    size = d.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("n"))
    both = d.select(F.col("strategy_id").alias("a"), "day").join(d.select(F.col("strategy_id").alias("b"), "day"), "day").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    return both.join(size.select(F.col("strategy_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("strategy_id").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def similarities(returns: DataFrame, trades: DataFrame, ids: DataFrame, weight: float = 0.3) -> DataFrame:
    c = pair_correlations(returns, ids).join(pair_jaccard(trades, ids), ["a", "b"], "full")
    return c.select("a", "b", F.round((1 - weight) * F.coalesce("corr", F.lit(0.0)) + weight * F.coalesce("jaccard", F.lit(0.0)) + 3e-11, 9).alias("similarity"))


def greedy(scored: DataFrame, profiles: DataFrame, threshold: float = 0.5, most: int = 50, least: int = 5, block: int = 256) -> DataFrame:
    """The best first, then each that is similar to none chosen, up to `most`; relaxed to `least`.

    `scored` has strategy_id and score; all of them are candidates. The driver decides the best `block` candidates left;
    the executors compare all others with what it chose and drop the similar ones. Every round chooses one at least, so
    there are at most `most` rounds, and the driver holds a block and the chosen profiles only.
    """
    rest = cut(scored.join(profiles, "strategy_id").select("strategy_id", "score", "r", "days"), "candidates")
    kind = rest.select("strategy_id", "score", "r", "days").schema
    chosen: list[tuple] = []
    while len(chosen) < most:
        rows = rest.orderBy(F.desc("score"), "strategy_id").limit(block).toArrow()
        if not rows.num_rows:
            break
        new: list[tuple] = []
        items = list(zip(*(rows[c].to_pylist() for c in ("strategy_id", "r", "days")), strict=True))
        sims = similarity_matrix([x[1] for x in items], [x[2] for x in items], [x[1] for x in items], [x[2] for x in items])
        for i, x in enumerate(items):
            if len(chosen) + len(new) < most and all(sims[i, j] < threshold for j, _ in new):
                new.append((i, x))
        fresh = [x for _, x in new]
        chosen += fresh
        last = rows["strategy_id"].to_pylist()
        rest = cut(rest.filter(~F.col("strategy_id").isin(last)).mapInArrow(_unlike(fresh, threshold), kind), "candidates")
    ids = [x[0] for x in chosen]
    if len(ids) < least:
        ids += [r[0] for r in scored.filter(~F.col("strategy_id").isin(ids)).orderBy(F.desc("score"), "strategy_id").limit(least - len(ids)).collect()]
    return scored.sparkSession.createDataFrame([(s, i + 1) for i, s in enumerate(ids)], "strategy_id long, pick int")


def _unlike(chosen: list[tuple], threshold: float):
    def run(batches):
        for batch in batches:
            sims = similarity_matrix(batch.column(2).to_pylist(), batch.column(3).to_pylist(), [x[1] for x in chosen], [x[2] for x in chosen])
            yield batch.filter(pa.array((sims < threshold).all(1)))

    return run


def average_linkage(distance: np.ndarray, cut: float) -> list[int]:
    """Cluster of each row: nearest clusters merge, by mean distance, until it exceeds `cut`."""
    groups = [[i] for i in range(len(distance))]
    while len(groups) > 1:
        best = min(((float(distance[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        if best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    out = [0] * len(distance)
    for k, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = k
    return out


def clusters(similar: DataFrame, ids: list[int], cut: float = 0.7) -> DataFrame:
    """Clusters of a short list by average linkage over 1 - similarity."""
    at = {s: i for i, s in enumerate(ids)}
    d = np.ones((len(ids), len(ids))) - np.eye(len(ids))
    for a, b, s in similar.collect():
        d[at[a], at[b]] = d[at[b], at[a]] = 1 - s
    return similar.sparkSession.createDataFrame(list(zip(ids, average_linkage(d, cut), strict=True)), "strategy_id long, cluster int")


def pareto_front(df: DataFrame, high: list[str], low: list[str], key: str, block: int = 4096) -> DataFrame:
    """Rows that no other row dominates (at least as good everywhere, better somewhere); rows with a null objective are left out.

    Two objectives: of each value of the first the best of the second, kept if it beats the running best of all better values of
    the first. More: every task cuts its rows to their own front; what is left is compared with itself a block at a time.
    """
    slim = df.select(key, *high, *low).na.drop()
    signed = slim.withColumns({f"__o{i}": F.col(c) if c in high else -F.col(c) for i, c in enumerate([*high, *low])})
    count = len(high) + len(low)
    if count == 2:
        signed = cut(signed, "objectives")  # stored: read again when the front is known
        best = running(signed.groupBy("__o0").agg(F.max("__o1").alias("__o1")), [F.desc("__o0")], most={"__top": F.col("__o1")})
        # the running best is its own only where it is higher than all before it, or ties with one: then the earlier dominates
        first = best.groupBy("__top").agg(F.max("__o0").alias("__o0"))
        front = first.select("__o0", F.col("__top").alias("__o1"))
        return signed.join(front, ["__o0", "__o1"], "left_semi").select(slim.columns)
    names = [f"__o{i}" for i in range(count)]
    rest = cut(signed.mapInArrow(_local_front(names), signed.schema), "fronts")
    blocks = max(1, -(-rest.count() // block))
    rest = cut(rest.withColumn("__block", F.pmod(F.xxhash64(key, *names), F.lit(blocks))), "fronts")
    whole = rest
    for b in range(blocks):  # a block of the fronts is held at a time; every row meets all blocks
        others = whole.filter(F.col("__block") == b).select(*names).toArrow()
        rest = rest.mapInArrow(_not_dominated(np.stack([others[n].to_numpy() for n in names], axis=1) if others.num_rows else np.zeros((0, count)), names), rest.schema)
    return rest.select(slim.columns)


def _dominated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of x some row of y dominates."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x), 256):
        a = x[i : i + 256, None, :]
        out[i : i + 256] = ((y[None] >= a).all(2) & (y[None] > a).any(2)).any(1)
    return out


def _not_dominated(others: np.ndarray, names: list[str]):
    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
            yield batch.filter(pa.array(~_dominated(x, others))) if len(x) else batch

    return run


def _local_front(names: list[str]):
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1)
                yield batch.filter(pa.array(~_dominated(x, x)))

    return run


def crowding(front: DataFrame, objectives: list[str], key: str) -> DataFrame:
    """Crowding distance: neighbours' gap over each objective's range; ends are infinite (null)."""
    front = cut(front, "front")  # stored: each objective orders it once
    spans = front.agg(*[(F.max(c) - F.min(c)).alias(c) for c in objectives]).first()
    out, total = front, F.lit(0.0)
    for c in objectives:
        out = out.join(neighbours(front, c, key).select(key, ((F.col("after") - F.col("before")) / F.nullif(F.lit(spans[c]), F.lit(0.0))).alias(f"__{c}")), key)
        total = total + F.col(f"__{c}")
    return out.withColumn("crowding", total).drop(*[f"__{c}" for c in objectives])


METHODS = ["equal", "inverse_vol", "risk_parity", "min_variance", "max_sharpe", "hrp"]


def _simplex(v: np.ndarray) -> np.ndarray:
    u = np.sort(v)[::-1]
    k = np.nonzero(u * np.arange(1, len(v) + 1) > np.cumsum(u) - 1)[0][-1]
    return np.maximum(v - (np.cumsum(u)[k] - 1) / (k + 1), 0)


def weights(cov: np.ndarray, mean: np.ndarray, method: str) -> np.ndarray:
    """Portfolio weights that sum to 1, none below 0."""
    n, vol = len(mean), np.sqrt(np.diag(cov))
    w = np.full(n, 1 / n)
    if method == "inverse_vol":
        w = 1 / np.maximum(vol, 1e-12)
    elif method == "risk_parity":
        # the minimum of w'Cw / 2 - sum(log w) has equal shares of risk; each weight in turn solves its own quadratic equation
        w, own = 1 / np.maximum(vol, 1e-12), np.maximum(np.diag(cov), 1e-18)
        for _ in range(500):
            before = w.copy()
            for i in range(n):
                b = cov[i] @ w - cov[i, i] * w[i]
                w[i] = (-b + np.sqrt(b * b + 4 * own[i])) / (2 * own[i])
            if np.abs(w - before).max() <= 1e-12 * w.max():
                break
        w = w / w.sum()
    elif method in ("min_variance", "max_sharpe"):
        step = 0.5 / max(np.linalg.eigvalsh(cov)[-1], 1e-12)
        for _ in range(2000):
            if method == "min_variance":
                w = _simplex(w - step * (cov @ w))
            else:
                s = np.sqrt(max(w @ cov @ w, 1e-18))
                w = _simplex(w + 0.05 * vol.mean() * (mean / s - (w @ mean) * (cov @ w) / s**3))
    elif method == "hrp":
        d = 1 / np.maximum(np.outer(vol, vol), 1e-18)
        order = np.argsort(average_linkage(np.sqrt(np.clip((1 - cov * d) / 2, 0, 1)), 0.5), kind="stable")
        w, parts = np.ones(n), [list(order)]
        while parts:
            p = parts.pop()
            if len(p) < 2:
                continue
            a, b = p[: len(p) // 2], p[len(p) // 2 :]
            var = []
            for q in (a, b):
                iv = 1 / np.maximum(np.diag(cov)[q], 1e-18)
                iv /= iv.sum()
                var.append(iv @ cov[np.ix_(q, q)] @ iv)
            share = 1 - var[0] / max(var[0] + var[1], 1e-18)
            w[a] *= share
            w[b] *= 1 - share
            parts += [a, b]
    return w / w.sum()


def covariance(returns: DataFrame, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of a short list over common places: sums in Spark, an N x N matrix on the driver."""
    n = returns.filter(F.col("strategy_id").isin(ids)).groupBy("strategy_id").agg(F.max("t").alias("n")).agg(F.min("n")).first()[0]
    wide = returns.filter(F.col("strategy_id").isin(ids) & (F.col("t") <= n)).groupBy("t").pivot("strategy_id", ids).agg(F.first("r"))
    cols = [str(i) for i in ids]
    row = wide.agg(*[F.avg(F.col(f"`{a}`")).alias(f"m_{a}") for a in cols], *[F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c_{a}_{b}") for i, a in enumerate(cols) for b in cols[i:]]).first()
    mean, cov = np.array([row[f"m_{a}"] for a in cols]), np.zeros((len(cols), len(cols)))
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            cov[i, j] = cov[j, i] = row[f"c_{a}_{cols[j]}"]
    return mean, cov


def portfolios(returns: DataFrame, ids: list[int], most: float = 0.4) -> DataFrame:
    """Weights of all methods, capped and made to sum to 1, with risk contributions, diversification ratio and effective number."""
    mean, cov = covariance(returns, ids)
    rows = []
    for m in METHODS:
        w = np.minimum(weights(cov, mean, m), most)
        w /= w.sum()
        total = float(np.sqrt(w @ cov @ w))
        for s, x, rc in zip(ids, w, w * (cov @ w) / max(total**2, 1e-18), strict=True):
            rows.append((m, s, float(x), float(rc), float(w @ np.sqrt(np.diag(cov)) / max(total, 1e-12)), float(1 / (w * w).sum())))
    return returns.sparkSession.createDataFrame(pd.DataFrame(rows, columns=["method", "strategy_id", "weight", "risk_share", "diversification", "effective_n"]))


def _units(embeddings) -> np.ndarray:
    """Rows of length 1; a vector that is zero or has a null or no finite length becomes zeros, which are similar to nothing."""
    x = np.array(embeddings.to_pylist(), dtype=np.float64)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return np.where(good[:, None], x / np.where(good, norm, 1.0)[:, None], 0.0)


def _similar(x: np.ndarray, ids: np.ndarray, refs: np.ndarray, ref_ids: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines to 9 digits where the reference comes earlier and reaches the threshold, else -1."""
    sim = np.round(x @ refs.T + 3e-11, 9)
    return np.where((sim >= threshold) & (ref_ids[None, :] < ids[:, None]), sim, -1.0)


def semantic_duplicates(vectors: DataFrame, threshold: float = 0.85, block: int = 8192) -> DataFrame:
    """`vec_id`, `duplicate_of` of every row (vec_id, embedding): in the order of ids, an item goes if an accepted one is similar.

    `duplicate_of` is the most similar accepted item before it, the first of equals, or null for what stays. Exact: the driver
    decides a block of items that no earlier block has removed, the executors compare all later rows with what it accepted;
    pairs are never rows. Only vectors of one length are compared; rows without id or vector stay.
    """
    usable = vectors.filter("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("long"), "embedding", F.lit(-1.0).alias("sim"), F.lit(None).cast("long").alias("duplicate_of"))
    done = vectors.filter("vec_id is null or embedding is null or size(embedding) <= 0").select(F.col("vec_id").cast("long"), F.lit(None).cast("long").alias("duplicate_of"))
    kind = usable.schema["embedding"].dataType.simpleString()
    for n in sorted(x[0] for x in usable.select(F.size("embedding")).distinct().collect()):
        rest = usable.filter(F.size("embedding") == n)
        while True:
            open_ = rest.filter("duplicate_of is null")
            last = open_.select("vec_id").orderBy("vec_id").limit(block).agg(F.max("vec_id")).first()[0]
            if last is None:
                break
            items = open_.filter(F.col("vec_id") <= last).select("vec_id", "embedding").orderBy("vec_id").toArrow()
            ids, x = items.column(0).to_numpy(), _units(items.column(1))
            kept = np.zeros(0, int)
            for i in range(0, len(ids), 512):
                part = np.arange(i, min(i + 512, len(ids)))
                free = (_similar(x[part], ids[part], x[kept], ids[kept], threshold) < 0).all(1)
                within = _similar(x[part], ids[part], x[part], ids[part], threshold) >= 0
                for j in range(len(part)):
                    free[j] = free[j] and not (within[j] & free).any()
                kept = np.concatenate([kept, part[free]])
            rest = cut(rest.mapInArrow(_nearest_of(x[kept], ids[kept], threshold), f"vec_id long, embedding {kind}, sim double, duplicate_of long"))
            done = done.union(rest.filter(F.col("vec_id") <= last).select("vec_id", "duplicate_of"))
            rest = rest.filter(F.col("vec_id") > last)
        done = done.union(rest.select("vec_id", "duplicate_of"))
    return done


def _nearest_of(refs: np.ndarray, ref_ids: np.ndarray, threshold: float):
    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                sim = _similar(_units(batch.column(1)), batch.column(0).to_numpy(), refs, ref_ids, threshold)
                best, old = sim.argmax(1), batch.column(2).to_numpy()
                top = sim[np.arange(len(sim)), best]
                better = top > old  # of equals the one found first, which comes earlier
                of = [int(ref_ids[b]) if new else was for b, new, was in zip(best.tolist(), better.tolist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.where(better, top, old)), pa.array(of, pa.int64())], names=["vec_id", "embedding", "sim", "duplicate_of"])

    return run


def knee_point(front: DataFrame, x: str, y: str, key: str) -> DataFrame:
    """The row of a two-dimensional front that is farthest from the line between its ends (by `x`, then `y`, then key), and how far
    (`bend`); ties go to the smaller key. Two ends at one place have no line, and the first row is taken."""
    place = F.struct(x, y, key)
    ends = front.agg(F.min_by(F.struct(x, y), place).alias("a"), F.max_by(F.struct(x, y), place).alias("b"))
    f = front.join(F.broadcast(ends), how="cross")  # one row
    dx, dy = F.col(f"b.{x}") - F.col(f"a.{x}"), F.col(f"b.{y}") - F.col(f"a.{y}")
    away = F.abs(dx * (F.col(f"a.{y}") - F.col(y)) - dy * (F.col(f"a.{x}") - F.col(x)))
    bend = F.round(F.try_divide(away, F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))), 9)
    return f.select(key, bend.alias("bend")).orderBy(F.col("bend").desc_nulls_last(), key).limit(1)


def volatility_target(df: DataFrame, order: str, value: str, target: float, window: int, most: float) -> DataFrame:
    """A return series scaled to a yearly deviation: `scale` is the target over the deviation of the `window` values before, at most
    `most`, and 1 until there are so many. The window reads neighbours by their number, so that no task holds the series."""
    from .ordering import numbered

    rows = cut(numbered(df.select(order, value), [order], "n"), "series")
    before = rows.select(F.col(value).alias("v"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + window)).alias("n"))
    sd = before.groupBy("n").agg(F.count("v").alias("c"), F.stddev_samp("v").alias("sd"))
    x = rows.join(sd, "n", "left")
    scale = F.when((F.col("c") == window) & (F.col("sd") > 1e-9), F.least(F.lit(most), target / (F.col("sd") * 252.0**0.5))).otherwise(1.0)
    return x.select(order, value, scale.alias("scale"), (F.col(value) * scale).alias("scaled"))


def compare_methods(returns: DataFrame, ids: list[int]) -> DataFrame:
    """A row for each way of weighting a short list: what its portfolio is expected to do, and how spread it is.

    Moments come from sums in Spark; the worst drawdown walks the weighted returns of the list, place by place, as running sums."""
    from .ordering import running

    mean, cov = covariance(returns, ids)
    w = portfolios(returns, ids)
    rows, vol = [], np.sqrt(np.diag(cov))
    for method, g in w.toPandas().groupby("method", sort=True):  # six rows for each of the short list
        x = g.set_index("strategy_id")["weight"].reindex(ids).to_numpy()
        total, gain = float(np.sqrt(x @ cov @ x)), float(x @ mean)
        corr = cov / np.maximum(np.outer(vol, vol), 1e-18)
        pairs = corr[np.triu_indices(len(ids), 1)]
        rows.append((method, gain * 252 * 100, total * 252**0.5 * 100, gain / total * 252**0.5 if total > 1e-12 else None, float(x @ vol / max(total, 1e-12)), float(1 / (x * x).sum()), float(x.max() * 100), float(pairs.mean()) if len(pairs) else None))
    out = returns.sparkSession.createDataFrame(rows, "method string, expected_return double, volatility double, sharpe double, diversification double, effective_n double, max_weight double, avg_correlation double")
    common = returns.filter(F.col("strategy_id").isin(ids)).join(w.select("method", "strategy_id", "weight"), "strategy_id")
    whole = common.groupBy("method", "t").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("r") * F.col("weight")).alias("r")).filter(F.col("k") == len(ids))
    e = cut(running(whole, ["t"], sums={"s": F.log1p("r")}, by=["method"]), "curves")
    top = running(e, ["t"], most={"top": F.col("s")}, by=["method"])
    dd = top.groupBy("method").agg(F.max(1 - F.exp(F.col("s") - F.greatest(F.lit(0.0), F.col("top")))).alias("max_drawdown"))
    return out.join(dd, "method")
