"""Permutation tests, classifiers on unseen rows, portfolios: against plain loops."""

import math
import random

import numpy as np
import pytest


def test_permutation_test_equals_the_loop(spark, monkeypatch):
    from tickloom.functions import kernels

    rng = np.random.default_rng(1)
    rows = [(s, t, float(v)) for s, n in (("a", 90), ("b", 25), ("one", 1)) for t, v in enumerate(np.cumsum(rng.normal(size=n)) * 0.01)] + [("a", 999, None)]
    df = spark.createDataFrame(rows, "s string, t long, r double")
    monkeypatch.setattr(kernels, "SIMS_A_TASK", 7)
    got = {(r["s"], r["kind"]): (r["real"], r["p"]) for r in kernels.permutation_test(df, "s", "t", "r", sims=20).collect()}
    assert len(got) == 9
    for (s, kind), (real, p) in got.items():
        x = np.array([v for n, _, v in rows if n == s and v is not None])
        assert real == pytest.approx(kernels.momentum(x))
        assert p == sum(kernels.momentum(kernels.permuted(x, kind, k)) >= real - 1e-15 for k in range(20)) / 20
        for k in range(3):
            assert sorted(kernels.permuted(x, kind, k)) == sorted(x)
    x = np.array([0.1, -0.2, 0.3, 0.1])
    assert kernels.momentum(x) == pytest.approx((np.sign(0.1) * -0.2 + np.sign(0.1 - 0.2) * 0.3 + np.sign(0.1 - 0.2 + 0.3) * 0.1) / 3)


def test_cross_grid_equals_the_loop(spark):
    from tickloom.functions.kernels import cross_grid

    rng = random.Random(2)
    prices = [100.0]
    for _ in range(120):
        prices.append(prices[-1] * math.exp(rng.gauss(0, 0.02)))
    rows = [("a", i, p) for i, p in enumerate(prices)] + [("flat", i, 5.0) for i in range(40)]
    cells = [(3, 8, 0, 0.0), (3, 8, 2, 0.001), (5, 20, 1, 0.01)]
    got = {(r["symbol"], r["fast"], r["slow"], r["delay"], r["cost"]): r for r in cross_grid(spark.createDataFrame(rows, "symbol string, ts long, close double"), cells).collect()}
    assert len(got) == 6
    for (s, fast, slow, delay, cost), r in got.items():
        c = [p for n, _, p in rows if n == s]
        mean = lambda i, n: sum(c[i - n + 1 : i + 1]) / n if i >= n - 1 else None  # noqa: B023, E731
        on = [int(i >= slow - 1 and mean(i, fast) > mean(i, slow) + (1e-12 if s == "flat" else 0)) for i in range(len(c))]
        at = lambda i: on[i] if i >= 0 else 0  # noqa: B023, E731
        x = [at(i - 1 - delay) * (math.log(c[i] / c[i - 1]) if i else 0) - cost * abs(at(i - 1 - delay) - at(i - 2 - delay)) for i in range(len(c))]
        assert r["mean"] == pytest.approx(np.mean(x), abs=1e-12) and r["sd"] == pytest.approx(np.std(x, ddof=1), abs=1e-12)
        assert r["metric"] is None if s == "flat" else r["metric"] == pytest.approx(np.mean(x) / np.std(x, ddof=1))


def test_a_classifier_is_judged_by_bins(spark):
    from tickloom.functions.statistics import classified

    rng = random.Random(3)
    rows = [(p := rng.choice([0.0, 1.0, 0.5, rng.random()]), float(rng.random() < p)) for _ in range(300)]
    got = classified(spark.createDataFrame(rows, "p double, y double"), "p", "y").collect()
    bins = {}
    for p, y in rows:
        bins.setdefault(min(int(p * 10), 9), []).append((p, y))
    assert {r["bin"]: r["n"] for r in got} == {b: len(v) for b, v in bins.items()}
    tp, fp, fn = (sum((p >= 0.5) == a and y == b for p, y in rows) for a, b in ((True, 1), (True, 0), (False, 1)))
    for r in got:
        v = bins[r["bin"]]
        assert r["said"] == pytest.approx(sum(p for p, _ in v) / len(v)) and r["came"] == pytest.approx(sum(y for _, y in v) / len(v))
        assert r["precision"] == pytest.approx(tp / (tp + fp)) and r["recall"] == pytest.approx(tp / (tp + fn)) and r["brier"] == pytest.approx(sum((p - y) ** 2 for p, y in rows) / 300)
        assert r["calibration_error"] == pytest.approx(sum(abs(sum(p - y for p, y in v)) for v in bins.values()) / 300)


def test_portfolios_are_compared(spark):
    from tickloom.operators.selection import compare_methods, covariance, weights

    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 1)) * 0.01
    x = np.hstack([base + rng.normal(size=(60, 3)) * [[0.005, 0.01, 0.03]], rng.normal(size=(60, 1)) * 0.02]) + 0.001
    rows = [(k, t + 1, float(x[t, k])) for k in range(4) for t in range(60)] + [(9, 1, 0.5)]
    df = spark.createDataFrame(rows, "strategy_id long, t long, r double")
    ids = [0, 1, 2, 3]
    mean, cov = covariance(df, ids)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T))
    for r in compare_methods(df, ids).collect():
        w = np.minimum(weights(cov, mean, r["method"]), 0.4)
        w /= w.sum()
        total = np.sqrt(w @ cov @ w)
        e = np.cumprod(1 + x @ w)
        dd = (1 - e / np.maximum(1.0, np.maximum.accumulate(e))).max()
        want = (w @ mean * 25200, total * np.sqrt(252) * 100, w @ mean / total * np.sqrt(252), w @ np.sqrt(np.diag(cov)) / total, 1 / (w * w).sum(), w.max() * 100, np.corrcoef(x.T)[np.triu_indices(4, 1)].mean(), dd)
        assert np.allclose([r[c] for c in ("expected_return", "volatility", "sharpe", "diversification", "effective_n", "max_weight", "avg_correlation", "max_drawdown")], want, rtol=1e-6)
        assert w.min() >= -1e-12


def test_the_budgeted_search_keeps_to_its_budget(spark, data):
    from tickloom.plans.more_queries import BUDGET, _grid, _search

    rows = sorted(_search(spark, data).collect(), key=lambda r: r["trial"])
    tried = [(r["fast"], r["slow"]) for r in rows]
    assert 4 < len(tried) == len(set(tried)) <= BUDGET and tried[:4] == [(5, 20), (5, 50), (20, 30), (20, 50)] and all(f < s for f, s in tried)
    again = {(r["fast"], r["slow"]): r["objective"] for r in _grid(spark, data, tried).collect()}
    assert all(r["objective"] == pytest.approx(again[r["fast"], r["slow"]]) for r in rows if r["objective"] is not None)
    best = max(v for v in again.values() if v is not None)
    assert [r["objective"] for r in rows if r["best"]] == [pytest.approx(best)]


def brute_clusters(d, cut):
    """Average linkage, pair by pair: the nearest two groups merge while they are nearer than `cut`."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        far = lambda a, b: np.mean([d[i][j] for i in a for j in b])
        x, y = min(((i, j) for j in range(len(groups)) for i in range(j)), key=lambda p: far(groups[p[0]], groups[p[1]]))
        if far(groups[x], groups[y]) >= cut:
            break
        groups[x] += groups.pop(y)
    return {frozenset(g) for g in groups}


def test_clusters_by_average_linkage(spark):
    from tickloom.operators.selection import clusters

    rng = random.Random(5)
    ids = [10 * i for i in range(14)]
    near = {(a, b): round(rng.random(), 6) for i, a in enumerate(ids) for b in ids[:i]}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in near.items()], "a long, b long, similarity double")
    d = [[0.0 if a == b else 1 - near[max(a, b), min(a, b)] for b in ids] for a in ids]
    for cut in (0.2, 0.45, 0.7):
        got = {}
        for r in clusters(df, ids, cut).collect():
            got.setdefault(r["cluster"], set()).add(ids.index(r["strategy_id"]))
        assert {frozenset(g) for g in got.values()} == brute_clusters(d, cut)


def test_weights_do_what_their_names_say():
    from tickloom.operators.selection import METHODS, weights

    rng = np.random.default_rng(6)
    a = rng.normal(size=(5, 5))
    cov, mean = a @ a.T + 0.1 * np.eye(5), rng.normal(size=5) * 0.1
    w = {m: weights(cov, mean, m) for m in METHODS}
    assert all(x.min() >= -1e-9 and x.sum() == pytest.approx(1) for x in w.values())
    assert np.allclose(w["equal"], 0.2) and np.allclose(w["inverse_vol"] * np.sqrt(np.diag(cov)), (w["inverse_vol"] * np.sqrt(np.diag(cov)))[0])
    risk = w["risk_parity"] * (cov @ w["risk_parity"])
    assert np.allclose(risk, risk.mean(), rtol=1e-3)
    variance = lambda x: x @ cov @ x
    tries = rng.dirichlet(np.ones(5), 3000)
    assert variance(w["min_variance"]) <= min(map(variance, tries)) * 1.02
    sharpe = lambda x: x @ mean / np.sqrt(variance(x))
    assert sharpe(w["max_sharpe"]) >= max(map(sharpe, tries)) - 0.02
