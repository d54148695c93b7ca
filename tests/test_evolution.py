"""A generation, step by step, against plain Python that hashes alike."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F


def unit(*parts):
    return (int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16) + 0.5) / 2**32


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.choice([0, 1, 2, rng.gauss(0, 3)])), rng.random(), rng.gauss(5, 2)) for k in rng.sample(range(-50, 400), 120)]
    return rows, spark.createDataFrame(rows, "key long, fitness double, a double, b double").repartition(6)


def ranked(rows):
    """From the worst: by fitness, of equal ones the greater key first."""
    return sorted(rows, key=lambda r: (r[1], -r[0]))


@pytest.mark.parametrize("rule", ["rank", "tournament", "roulette"])
def test_parents(spark, people, rule):
    from tickloom.operators.evolution import select_parents

    rows, df = people
    order, n = ranked(rows), len(rows)
    got = {r["slot"]: r["key"] for r in select_parents(df, 80, rule, generation=2).collect()}
    want, total = {}, 0.0
    sums = [total := total + r[1] - order[0][1] + 1e-6 for r in order]
    for slot in range(1, 81):
        if rule == "rank":
            place = min(max(math.ceil((math.sqrt(1 + 8 * unit("rank|2", slot) * (n * (n + 1) / 2)) - 1) / 2), 1), n)
        elif rule == "tournament":
            place = max(math.floor(unit("tournament|2", slot, i) * n) + 1 for i in range(1, 4))
        else:
            place = next(i for i, s in enumerate(sums) if s >= unit("roulette|2", slot) * total) + 1
        want[slot] = order[place - 1][0]
    assert got == want and select_parents(df.filter("false"), 5, rule).count() == 0
    mean = lambda keys: sum(dict((r[0], r[1]) for r in rows)[k] for k in keys) / len(keys)
    assert mean(list(got.values())) > mean([r[0] for r in rows])


@pytest.mark.parametrize("rule", ["blend", "uniform", "sbx"])
def test_children(spark, people, rule):
    from tickloom.operators.evolution import crossed

    rows, _ = people
    parents = {i + 1: r[2:] for i, r in enumerate(rows[:31])}
    df = spark.createDataFrame([(i, *g) for i, g in parents.items()], "slot long, a double, b double")
    got = {r["slot"]: (r["a"], r["b"]) for r in crossed(df, ["a", "b"], rule, 4).collect()}
    assert set(got) == set(parents) and got[31] == parents[31]
    for slot in range(1, 31, 2):
        pair = (slot - 1) // 2
        draw = lambda *x: unit(f"{rule}|4", *x, pair)  # noqa: B023, E731
        x, y = [], []
        for g, a, b in zip("ab", parents[slot], parents[slot + 1], strict=True):
            low, high = min(a, b), max(a, b)
            if rule == "blend":
                p, q = (low - 0.5 * (high - low) + draw(w, g) * 2 * (high - low) for w in ("first", "second"))
            elif rule == "uniform":
                p, q = (a, b) if draw("side", g) < 0.5 else (b, a)
            else:
                u = draw("spread", g)
                beta = (2 * u) ** (1 / 16) if u <= 0.5 else (1 / (2 * (1 - u))) ** (1 / 16)
                p, q = (0.5 * ((1 + beta) * low + (1 - beta) * high), 0.5 * ((1 - beta) * low + (1 + beta) * high)) if draw("gene", g) < 0.5 else (a, b)
            x.append(p)
            y.append(q)
        want = (x, y) if draw("mate") < 0.9 else (parents[slot], parents[slot + 1])
        assert got[slot] == pytest.approx(tuple(want[0])) and got[slot + 1] == pytest.approx(tuple(want[1]))


@pytest.mark.parametrize("rule", ["gaussian", "polynomial"])
def test_mutation(spark, rule):
    from tickloom.operators.evolution import mutated

    df = spark.range(1, 2001).select(F.col("id").alias("slot"), F.lit(1.0).alias("a"), F.lit(-1.0).alias("b"))
    got = {r["slot"]: (r["a"], r["b"]) for r in mutated(df, ["a", "b"], rule, 100).collect()}
    moved = [v[0] - 1 for v in got.values() if v[0] != 1]
    assert 300 < len(moved) < 500 and abs(sum(moved) / len(moved)) < 0.02
    for slot in range(1, 60):
        if rule == "gaussian":
            z = math.sqrt(-2 * math.log(unit("r", "gaussian|100|a", slot))) * math.cos(2 * math.pi * unit("a", "gaussian|100|a", slot))
            move = 0.1 * 0.5 * z
        else:
            u = unit("polynomial|100", "move", "a", slot)
            move = 0.1 * ((2 * u) ** (1 / 21) - 1 if u < 0.5 else 1 - (2 * (1 - u)) ** (1 / 21))
        assert got[slot][0] == pytest.approx(1 + (move if unit(f"{rule}|100", "gene", "a", slot) < 0.2 else 0))


def test_survivors(spark, people):
    from tickloom.operators.evolution import spread, survivors

    rows, df = people
    got = {r["key"] for r in survivors(df, 40, generation=3).collect()}
    order = ranked(rows)
    rest = order[:-4]
    won = {rest[max(math.floor(unit("tournament|3", slot, i) * len(rest)) + 1 for i in range(1, 4)) - 1][0] for slot in range(1, 37)}
    assert got == {r[0] for r in order[-4:]} | won and survivors(df, 500).count() == len(rows)
    row = spread(df, ["a", "b"]).first()
    pairs = [(x, y) for i, x in enumerate(rows) for y in rows[:i]]
    assert row["diversity"] == pytest.approx(math.sqrt(sum((x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 for x, y in pairs) / len(pairs)))
    assert spread(df.limit(1), ["a"]).first()["diversity"] == 0 == spread(df.filter("false"), ["a"]).first()["diversity"]


def brute_cover(rows, n, shards=64):
    def choose(part):
        part = sorted(part, key=lambda r: (-r[1], r[0]))
        out = [part[0]]
        while len(out) < min(n, len(part)):
            far = [-1 if r in out else min(round((r[2] - c[2]) ** 2 + (r[3] - c[3]) ** 2, 12) for c in out) for r in part]
            out.append(part[far.index(max(far))])
        return out

    while True:
        parts = {}
        for r in rows:
            parts.setdefault(zlib.crc32(str(r[0]).encode()) % shards, []).append(r)
        rows = [r for p in parts.values() for r in choose(p)]
        if shards == 1:
            return rows
        shards = max(1, shards // 8)


def test_farthest_points(spark, people):
    from tickloom.operators.evolution import farthest_points

    rows, df = people
    got = sorted(tuple(r) for r in farthest_points(df, ["a", "b"], 12).collect())
    assert got == sorted(brute_cover(rows, 12)) and sorted(tuple(r) for r in farthest_points(df.repartition(2), ["a", "b"], 12).collect()) == got
    assert max(rows, key=lambda r: (r[1], -r[0])) in got and farthest_points(df.filter("false"), ["a", "b"], 3).count() == 0
    far = lambda r, c: math.dist(r[2:], c[2:])
    cover = lambda chosen: max(min(far(r, c) for c in chosen) for r in rows)
    assert cover(got) < cover(sorted(rows)[:12])


def test_evolution_climbs_and_repeats_itself(spark, people):
    from tickloom.operators.evolution import evolve

    _, df = people
    judged = lambda rows: rows.withColumn("fitness", -(F.col("a") - 0.3) ** 2 - 0.1 * (F.col("b") - 4) ** 2)
    start = judged(df)
    runs = [evolve(start.repartition(n), ["a", "b"], judged, 3, 40, archive=8) for n in (2, 5)]
    first, second = ([sorted(map(str, x.collect())) for x in run] for run in runs)
    assert first == second
    now, kept, history = runs[0]
    best = [r["best"] for r in history.orderBy("generation").collect()]
    assert best == sorted(best) and history.count() == 3 and kept.count() == 8 and now.count() <= 40
    assert now.agg(F.avg("fitness")).first()[0] > start.agg(F.avg("fitness")).first()[0]
