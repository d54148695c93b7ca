"""Models against plain numpy: factor regressions, rank correlations, tails, surrogates and Thompson sampling."""

import math
import random
import zlib

import numpy as np
import pytest


def test_factor_model_equals_least_squares(spark):
    from tickloom.operators.attribution import factor_model

    rng = np.random.default_rng(1)
    rows, data = [], {}
    for name, n in (("a", 200), ("b", 40), ("dependent", 60), ("flat", 30), ("few", 3)):
        x = rng.normal(size=(n, 3)) * [0.01, 1.0, 100.0]
        if name == "dependent":
            x[:, 2] = 2 * x[:, 1] - x[:, 0]
        y = 0.001 + x @ [0.5, -0.002, 0.00003] + rng.normal(size=n) * 0.003 if name != "flat" else np.full(n, 0.01)
        data[name] = (x, y)
        rows += [(name, float(v), *map(float, z)) for v, z in zip(y, x, strict=True)]
    rows += [("a", None, 1.0, 1.0, 1.0), ("a", 0.5, None, 1.0, 1.0), ("a", float("nan"), 1.0, 1.0, 1.0), ("none", None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, y double, f double, g double, h double")
    got = {r["s"]: r for r in factor_model(df, "s", "y", ["f", "g", "h"]).collect()}
    assert set(got) == {"a", "b", "dependent", "flat"}
    for name, r in got.items():
        x, y = data[name]
        whole = np.column_stack([np.ones(len(y)), x])
        b = np.linalg.lstsq(whole, y, rcond=None)[0]
        fit = whole @ b
        if name != "dependent":
            assert np.allclose([r["alpha"], r["beta_f"], r["beta_g"], r["beta_h"]], b, rtol=1e-6, atol=1e-9)
            assert np.allclose([r[f"attributed_{f}"] for f in "fgh"], b[1:] * x.sum(axis=0), rtol=1e-6, atol=1e-9)
        assert math.isclose(r["r2"], 1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum() if name != "flat" else 0.0, rel_tol=1e-6, abs_tol=1e-6)
        assert abs(r["residual"]) < 1e-6 and math.isclose(r["total"], np.prod(1 + y) - 1, rel_tol=1e-9)
    assert factor_model(df.filter("false"), "s", "y", ["f"]).count() == 0


def test_skill_and_luck(spark):
    from tickloom.operators.attribution import skill

    rng = np.random.default_rng(2)
    rows = []
    for name, alpha in (("skilled", 0.002), ("lucky", 0.0), ("poor", -0.002)):
        b = rng.normal(size=900) * 0.01
        rows += [(name, i * 86400, float(x), float(alpha + 0.7 * x + e)) for i, (x, e) in enumerate(zip(b, rng.normal(size=900) * 0.01, strict=True))]
    rows += [("short", i, 0.1, 0.2) for i in range(20)]
    df = spark.createDataFrame(rows, "s string, at long, b double, y double").selectExpr("s", "timestamp_seconds(at) as at", "b", "y")
    got = {r["s"]: r for r in skill(df, "s", "at", "y", "b").collect()}
    assert set(got) == {"skilled", "lucky", "poor"} and all(r["blocks"] == 30 for r in got.values())
    assert got["skilled"]["p"] < 0.01 and 0.02 < got["lucky"]["p"] < 0.98 and got["poor"]["p"] > 0.99
    for name, r in got.items():
        x, y = np.array([(b, v) for s, _, b, v in rows if s == name]).T
        slope = np.cov(x, y, ddof=0)[0, 1] / x.var()
        assert math.isclose(r["alpha"], y.mean() - slope * x.mean(), rel_tol=1e-9, abs_tol=1e-12)
        error = (y - slope * x).std() / 30  # of a mean of 900 values
        assert r["low"] < r["alpha"] < r["high"] and 0.6 < (r["high"] - r["low"]) / (2 * 1.96 * error) < 1.5


def test_ranks_with_ties(spark):
    from tickloom.functions.statistics import average_ranks, rank_correlation

    rng = random.Random(3)
    rows = [(g, rng.choice([None, *range(6)]), rng.gauss(0, 1)) for g in ("a", "b") for _ in range(200)] + [("tied", 1, 2.0)] * 5
    df = spark.createDataFrame([(g, None if x is None else float(x), y) for g, x, y in rows], "g string, x double, y double")
    ranks = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    got = sorted((r["g"], r["x"], r["k"]) for r in average_ranks(df, ["g"], "x", "k").collect())
    want = []
    for g in ("a", "b", "tied"):
        v = [float(x) for h, x, _ in rows if h == g and x is not None]
        want += [(g, x, k) for x, k in zip(v, ranks(v), strict=True)]
    assert got == sorted(want)
    found = {r["g"]: (r["n"], r["spearman"]) for r in rank_correlation(df, ["g"], "x", "y").collect()}
    for g in ("a", "b"):
        x, y = zip(*[(x, y) for h, x, y in rows if h == g and x is not None], strict=True)
        assert found[g][0] == len(x) and math.isclose(found[g][1], np.corrcoef(ranks(x), ranks(y))[0, 1], rel_tol=1e-9)
    assert found["tied"][0] == 5 and (found["tied"][1] is None or math.isnan(found["tied"][1]))


@pytest.fixture(scope="module")
def curve(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, size=(1500, 2))
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + rng.normal(size=1500) * 0.2 + 10
    rows = [(i, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))] + [(5000, None, 1.0, 2.0), (5001, 1.0, 1.0, None)]
    return x, y, spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(5)


def test_surrogate_equals_ridge_regression_on_its_features(spark, curve):
    from tickloom.operators import surrogate as sur

    x, y, df = curve
    model = sur.fit(df, "id", ["a", "b"], "y")
    assert model.n == 1500 and np.mean(model.cv_r2) > 0.85
    z, t = model.features(x), y - y.mean()
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + model.ridge * np.eye(z.shape[1]), z.T @ t), atol=1e-6)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(1500)])
    error = spread = 0.0
    for f in range(5):
        rest, own = z[fold != f], z[fold == f]
        inverse = np.linalg.inv(rest.T @ rest + model.ridge * np.eye(z.shape[1]))
        e = t[fold == f] - own @ inverse @ rest.T @ t[fold != f]
        assert math.isclose(model.cv_r2[f], 1 - (e**2).sum() / ((t[fold == f] - t[fold == f].mean()) ** 2).sum(), rel_tol=1e-6)
        error, spread = error + (e**2).sum(), spread + np.einsum("ij,jk,ik->", own, inverse, own)
    assert math.isclose(model.noise, error / (1500 + spread), rel_tol=1e-6)
    got = {r["id"]: (r["mu"], r["sigma"]) for r in sur.predict(df, model).collect()}
    assert got[5000] == (None, None) and got[5001][0] is not None
    assert np.allclose([got[i][0] for i in range(1500)], z @ model.weights + y.mean())
    assert np.allclose([got[i][1] ** 2 for i in range(1500)], model.noise + ((z @ model.root) ** 2).sum(axis=1))
    # sigma is calibrated on rows that the model hasn't seen, and grows away from those that it has
    rng = np.random.default_rng(5)
    new = rng.uniform(-2, 2, size=(2000, 2))
    truth = np.sin(2 * new[:, 0]) + 0.5 * new[:, 1] ** 2 + rng.normal(size=2000) * 0.2 + 10
    seen = sur.predict(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(new)] + [(9999, 30.0, -30.0)], "id long, a double, b double"), model).toPandas().set_index("id").sort_index()
    scores = (truth - seen["mu"].to_numpy()[:2000]) / seen["sigma"].to_numpy()[:2000]
    assert 0.8 < (scores**2).mean() < 1.25 and 0.9 < (abs(scores) < 1.96).mean() < 0.99
    assert seen["sigma"].loc[9999] > seen["sigma"].iloc[:2000].median()
    with pytest.raises(ValueError):
        sur.fit(df.limit(9), "id", ["a", "b"], "y")


def test_thompson_picks_equal_brute_force(spark, curve):
    from tickloom.operators import surrogate as sur

    x, y, df = curve
    model = sur.fit(df, "id", ["a", "b"], "y", width=32)
    got = {r["draw"]: (r["id"], r["score"]) for r in sur.thompson_picks(df, "id", model, draws=50).collect()}
    sampled = model.weights[:, None] + model.root @ np.random.default_rng(42).normal(size=(33, 50))
    score = np.round(model.features(np.vstack([x, [[1.0, 1.0]]])) @ sampled + y.mean(), 9)
    ids = [*range(1500), 5001]
    assert got == {k: (ids[int(score[:, k].argmax())], float(score[:, k].max())) for k in range(50)}
    assert len({i for i, _ in got.values()}) > 1


def test_normal_draws_look_normal(spark):
    from pyspark.sql import functions as F

    from tickloom.operators.surrogate import normal_draw, unit

    s = spark.range(20_000).select(normal_draw(F.lit("x"), F.col("id").cast("string")).alias("z"), unit(F.col("id").cast("string")).alias("u"))
    r = s.agg(F.avg("z"), F.stddev("z"), F.avg(F.pow("z", F.lit(4))), F.min("u"), F.max("u"), F.avg("u")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03 and abs(r[2] - 3) < 0.2 and 0 < r[3] and r[4] < 1 and abs(r[5] - 0.5) < 0.01


def test_tail_dependence_of_equal_and_opposed_series(spark):
    from tickloom.functions.statistics import tail_dependence

    rng = np.random.default_rng(6)
    x = rng.normal(size=1000)
    rows = [(n, float(a), float(b)) for n, y in (("same", x), ("opposed", -x), ("apart", rng.normal(size=1000))) for a, b in zip(x, y, strict=True)] + [("same", None, 1.0), ("same", 99.0, None)]
    got = {r["s"]: r for r in tail_dependence(spark.createDataFrame(rows, "s string, x double, y double"), "s", "x", "y").collect()}
    assert got["same"]["lambda_low"] == got["same"]["lambda_high"] == 1 and got["same"]["n"] == 1000
    assert got["opposed"]["both_low"] == got["opposed"]["both_high"] == 0 and got["apart"]["lambda_low"] < 0.3
