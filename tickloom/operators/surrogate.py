"""A surrogate of expensive evaluations with an honest sigma: Bayesian regression on random Fourier features.

Random features turn a Gaussian kernel into a linear model of fixed width, so that a fit over any number of rows is one sum of
`width`**2 products, kept apart for every fold. All else comes from these sums: the weights of each fold's complement, the
squared error on the fold itself (yy - 2 wb + wGw), and the mean predicted variance there (a trace). Kernel width and ridge are the ones with
the least cross-validated error; the noise is set so that held-out errors have the variance that the model says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import norm_cdf, norm_pdf

LENGTHS, RIDGES = (0.5, 1.0, 2.0, 4.0), (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)


@dataclass
class Surrogate:
    columns: list[str]
    centre: np.ndarray
    scale: np.ndarray
    y_mean: float
    length: float
    ridge: float
    seed: int
    width: int
    weights: np.ndarray
    root: np.ndarray  # of the weights' covariance: root @ root.T
    noise: float
    cv_r2: list[float]
    n: int

    def features(self, x: np.ndarray) -> np.ndarray:
        return fourier((x - self.centre) / self.scale, self.length, self.width, self.seed)


def fourier(x: np.ndarray, length: float, width: int, seed: int) -> np.ndarray:
    """1 and `width` cosines of random projections: their products approach exp(-|x - x'|**2 / (2 length**2))."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(x.shape[1], width)) / length, rng.uniform(0, 2 * np.pi, width)
    return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / width) * np.cos(x @ w + b)])


def fold_of(key: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)).cast("int")


def fit(df: DataFrame, key: str, columns: list[str], y: str, width: int = 64, folds: int = 5, seed: int = 7) -> Surrogate:
    """A surrogate of `y` by `columns`; a row's fold follows from `key`. Rows with nulls are left out.

    What reaches the driver is the sums: len(LENGTHS) * folds * (width + 2)**2 numbers, whatever the rows.
    """
    rows = df.select(F.col(key), *[F.col(c).cast("double").alias(c) for c in columns], F.col(y).cast("double").alias("__y")).na.drop()
    s = rows.agg(*[f(c).alias(f"{n}_{c}") for c in [*columns, "__y"] for n, f in (("m", F.avg), ("s", F.stddev_pop))], F.count(F.lit(1)).alias("n")).first()
    if s["n"] < 2 * folds:
        raise ValueError(f"{s['n']} rows are too few for {folds} folds")
    centre, scale = np.array([s[f"m_{c}"] for c in columns]), np.array([s[f"s_{c}"] if s[f"s_{c}"] > 1e-12 else 1.0 for c in columns])
    y_mean, d = s["m___y"], width + 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(LENGTHS), folds, d, d))
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy() for c in columns])
            fold, t = batch.column("fold").to_numpy(), batch.column("__y").to_numpy() - y_mean
            for i, length in enumerate(LENGTHS):
                z = np.hstack([fourier((x - centre) / scale, length, width, seed), t[:, None]])
                for f in range(folds):
                    part = z[fold == f]
                    total[i, f] += part.T @ part
        place = [pa.array(a.ravel().astype(np.int32)) for a in np.indices((len(LENGTHS), folds))]
        yield pa.record_batch([*place, pa.array(total.reshape(-1, d * d).tolist(), pa.list_(pa.float64()))], names=["length", "fold", "g"])

    parts = rows.withColumn("fold", fold_of(key, folds)).mapInArrow(sums, "length int, fold int, g array<double>")
    flat = parts.select("length", "fold", F.posexplode("g")).groupBy("length", "fold", "pos").agg(F.sum("col").alias("v"))
    g = np.zeros((len(LENGTHS), folds, d * d))
    for r in flat.collect():
        g[r["length"], r["fold"], r["pos"]] = r["v"]
    return from_sums(g.reshape(len(LENGTHS), folds, d, d), columns, centre, scale, y_mean, width, seed, s["n"])


def from_sums(g: np.ndarray, columns, centre, scale, y_mean, width, seed, n) -> Surrogate:
    """Choose by cross-validation, then fit on all sums."""
    best = None
    counts = g[0, :, 0, 0]
    for i, length in enumerate(LENGTHS):
        whole = g[i].sum(axis=0)
        for ridge in RIDGES:
            error, spread, r2 = 0.0, 0.0, []
            for f in range(g.shape[1]):
                rest, own = whole - g[i, f], g[i, f]
                inverse = np.linalg.inv(rest[:-1, :-1] + ridge * np.eye(width + 1))
                w = inverse @ rest[:-1, -1]
                e = own[-1, -1] - 2 * w @ own[:-1, -1] + w @ own[:-1, :-1] @ w
                varied = own[-1, -1] - own[0, -1] ** 2 / max(counts[f], 1)
                r2.append(1 - e / varied if varied > 1e-12 else 0.0)
                error, spread = error + e, spread + np.trace(inverse @ own[:-1, :-1])
            if best is None or error < best[0] - 1e-9:
                best = (error, spread, i, ridge, r2)
    error, spread, i, ridge, r2 = best
    whole = g[i].sum(axis=0)
    inverse = np.linalg.inv(whole[:-1, :-1] + ridge * np.eye(width + 1))
    noise = max(error / (n + spread), 1e-18)  # held-out errors have this much times (1 + what the weights' variance adds)
    root = np.linalg.cholesky(inverse + 1e-12 * np.eye(width + 1)) * np.sqrt(noise)
    return Surrogate(columns, centre, scale, y_mean, LENGTHS[i], ridge, seed, width, inverse @ whole[:-1, -1], root, noise, r2, int(n))


def predict(df: DataFrame, model: Surrogate) -> DataFrame:
    """Add `mu` and `sigma` (of a new evaluation); null where a column is null."""

    @F.pandas_udf("mu double, sigma double")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            z = model.features(x.to_numpy(float))
            yield pd.DataFrame({"mu": z @ model.weights + model.y_mean, "sigma": np.sqrt(model.noise + ((z @ model.root) ** 2).sum(axis=1))})

    known = F.lit(True)
    for c in model.columns:
        known = known & F.col(c).isNotNull()
    p = run(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in model.columns]))
    out = df.withColumn("__p", p)
    return out.withColumns({"mu": F.when(known, F.col("__p.mu")), "sigma": F.when(known, F.col("__p.sigma"))}).drop("__p")


def thompson_picks(df: DataFrame, key: str, model: Surrogate, draws: int = 100, seed: int = 42) -> DataFrame:
    """For each draw of the weights from their posterior, the candidate that is best under it: `draw`, `key`, `score`.

    A task keeps its own best of every draw, so that `draws` rows a task are shuffled. Ties go to the smallest key.
    """
    sampled = model.weights[:, None] + model.root @ np.random.default_rng(seed).normal(size=(model.width + 1, draws))
    columns, kind = model.columns, df.schema[key].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            score = np.round(model.features(np.column_stack([batch.column(c).to_numpy() for c in columns])) @ sampled + model.y_mean, 9)
            at = score.argmax(axis=0)  # rows come in the order of the key
            yield pa.record_batch([pa.array(np.arange(draws)), batch.column(key).take(pa.array(at)), pa.array(score[at, np.arange(draws)])], names=["draw", key, "score"])

    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).na.drop().sortWithinPartitions(key)
    found = rows.mapInArrow(best, f"draw long, `{key}` {kind}, score double")
    top = found.groupBy("draw").agg(F.max("score").alias("score"))
    return found.join(top, ["draw", "score"]).groupBy("draw", "score").agg(F.min(key).alias(key))


# -- acquisition ---------------------------------------------------------------------------------------


def unit(*parts: Column) -> Column:
    """A number in (0, 1) that any engine gets alike: the first eight hex digits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal_draw(*parts: Column) -> Column:
    """A standard normal number from two units (Box and Muller)."""
    return F.sqrt(-2 * F.log(unit(F.lit("r"), *parts))) * F.cos(2 * np.pi * unit(F.lit("a"), *parts))


def acquisition(mu: str, sigma: str, rule: str, best: Column | None = None, key: str | None = None, xi: float = 0.01, kappa: float = 2.0, draws: int = 10, seed: int = 42) -> Column:
    """The score by which candidates are chosen: ei, pi, ucb, ts (the mean of `draws` normal draws) or random."""
    m, s = F.col(mu), F.greatest(F.col(sigma), F.lit(1e-9))
    if rule == "ucb":
        return m + kappa * F.col(sigma)
    if rule == "random":
        return unit(F.lit(str(seed)), F.col(key).cast("string"))
    if rule == "ts":
        z = sum((normal_draw(F.lit(f"{seed}|{i}"), F.col(key).cast("string")) for i in range(draws)), F.lit(0.0))
        return m + s * z / draws
    z = (m - best - xi) / s
    if rule == "pi":
        return norm_cdf(z)
    if rule == "ei":
        return F.greatest((m - best - xi) * norm_cdf(z) + s * norm_pdf(z), F.lit(0.0))
    raise ValueError(f"unknown rule {rule}")


def several(objectives: dict[str, tuple[str, str, Column, float]], xi: float = 0.01) -> Column:
    """The weighted mean of expected improvements over several objectives: name -> (mu, sigma, best, weight)."""
    total = sum(w for *_, w in objectives.values())
    return sum((w * acquisition(m, s, "ei", b, xi=xi) for m, s, b, w in objectives.values()), F.lit(0.0)) / max(total, 1e-10)
