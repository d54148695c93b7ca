"""Scans over long series against loops, with a series over many tasks."""

import math
import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def ranges(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def series(rng, n=400):
    """One long series, short ones, one of nulls and a null name; values start late and have gaps."""
    rows = [("long", t, None if t < 90 or rng.random() < 0.2 else rng.gauss(0, 1)) for t in range(n)]
    rows += [("short", t, float(t)) for t in range(3)] + [("one", 5, 2.5)] + [("none", t, None) for t in range(4)] + [(None, t, float(t)) for t in range(7)]
    rng.shuffle(rows)
    return rows


def by_name(rows):
    out = {}
    for s, t, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(s, []).append((t, x))
    return out


def test_values_are_carried_across_ranges(spark, ranges):
    from tickloom.operators.scans import carried

    rows = series(random.Random(1))
    df = spark.createDataFrame(rows, "s string, t long, x double")
    dealt = carried(df, ["s"], ["t"], {"p": "x"}, {"n": "x"})
    got = {(r["s"], r["t"]): (r["p"], r["n"]) for r in dealt.collect()}
    for s, v in by_name(rows).items():
        for i, (t, _) in enumerate(v):
            p = next((x for _, x in reversed(v[: i + 1]) if x is not None), None)
            n = next((x for _, x in v[i:] if x is not None), None)
            assert got[(s, t)] == (p, n)
    assert len(got) == len(rows) and carried(df.filter("false"), ["s"], ["t"], {"p": "x"}).count() == 0


@pytest.mark.parametrize("direction", ["nearest", "backward", "forward"])
def test_asof(spark, ranges, direction):
    from tickloom.operators.scans import asof

    rng = random.Random(2)
    right = [("a", rng.randrange(500), f"r{i}") for i in range(40)] + [("b", 7, "x"), ("b", 7, "y"), ("c", None, "z"), (None, 3, "null")]
    left = [(i, rng.choice(["a", "a", "a", "b", "c", "d", None]), rng.choice([None, 7, *range(0, 500, 3)])) for i in range(300)]
    got = asof(spark.createDataFrame(left, "id long, s string, at long"), spark.createDataFrame(right, "s string, at long, name string").withColumn("when", F.col("at")), "s", "at", ["when", "name"], direction)
    got = {r["id"]: (r["when"], r["name"]) for r in got.collect()}
    assert len(got) == len(left)
    for i, s, at in left:
        rows = [(t, n) for x, t, n in right if x == s and t is not None]
        back = max((r for r in rows if at is not None and r[0] <= at), default=None)
        ahead = min((r for r in rows if at is not None and r[0] >= at), default=None)
        if direction == "nearest":
            want = back if ahead is None or back and at - back[0] < ahead[0] - at else ahead
            want = back if back and ahead and back[0] == at else want
        else:
            want = back if direction == "backward" else ahead
        assert got[i] == (want or (None, None)), (s, at)


def test_recursive_means_equal_the_loop(spark, ranges):
    from tickloom.operators.scans import recursive_means

    rows = [r for r in series(random.Random(3)) if r[0]]
    df = spark.createDataFrame([(*r, r[2] and r[2] * 2) for r in rows], "s string, t long, x double, z double")
    spec = {"fast": ("x", 0.5), "slow": ("x", 1 / 200), "other": ("z", 0.1)}
    out = recursive_means(df, spec, "s", "t").withColumn("task", F.spark_partition_id())
    got = {(r["s"], r["t"]): r for r in out.collect()}
    assert len({r["task"] for r in got.values() if r["s"] == "long"}) > 3 and len(got) == len(rows)
    for s, v in by_name(rows).items():
        for name, (c, alpha) in spec.items():
            y = None
            for t, x in v:
                x = x and x * (2 if c == "z" else 1)
                if x is not None:
                    y = x if y is None else y + alpha * (x - y)
                here = got[(s, t)][name]
                assert (here is None or math.isnan(here)) if y is None else math.isclose(here, y, rel_tol=1e-9, abs_tol=1e-12)


def test_recursions_with_steps_of_their_own(spark, ranges):
    from tickloom.operators.scans import recursions

    rng = random.Random(4)
    rows = [("a", t, rng.choice([None, 0.0, 0.9, -1.1]), rng.gauss(0, 1), 3.0 if t in (40, 200) else None) for t in range(300)]
    df = spark.createDataFrame(rows, "s string, t long, a double, b double, start double")
    got = {r["t"]: r["y"] for r in recursions(df, {"y": (F.col("a"), F.col("b"), F.col("start"))}, "s", "t").collect()}
    y = None
    for _, t, a, b, start in rows:
        y = start if y is None else y if a is None else a * y + b
        assert (got[t] is None or math.isnan(got[t])) if y is None else math.isclose(got[t], y, rel_tol=1e-9, abs_tol=1e-9)


def test_garch_equals_the_loop(spark, ranges):
    import numpy as np

    from tickloom.operators.scans import CENTRE, FINER, ROUNDS, WIDTH, garch, grid_points

    rng = np.random.default_rng(5)
    h, x = 1.0, []
    for _ in range(600):
        x.append(float(rng.normal() * h**0.5))
        h = 0.1 + 0.25 * x[-1] ** 2 + 0.6 * h
    rows = [("a", t, v) for t, v in enumerate(x)] + [("b", t, v * 3 + 1) for t, v in enumerate(x[:80])] + [("few", t, float(t)) for t in range(29)] + [("flat", t, 1.0) for t in range(50)] + [("a", -1, None)]
    got = {r["s"]: tuple(r)[1:] for r in garch(spark.createDataFrame(rows, "s string, t long, x double"), "s", "t", "x").collect()}
    assert set(got) == {"a", "b"}
    for s in got:
        y = np.array([v for n, _, v in rows if n == s and v is not None])
        y = y - y.mean()
        var = y.var()

        def score(a, b):
            h, total = var, 0.0  # noqa: B023
            for v in y**2:  # noqa: B023
                total += math.log(h) + v / h
                h = var * (1 - a - b) + a * v + b * h  # noqa: B023
            return total, h

        centre, width = CENTRE, WIDTH
        for _ in range(ROUNDS):
            centre = min(grid_points(*centre, width), key=lambda p: (round(score(*p)[0], 9), p))
            width /= FINER
        assert np.allclose(got[s], [var * (1 - sum(centre)), *centre, score(*centre)[1] ** 0.5], rtol=1e-8)
