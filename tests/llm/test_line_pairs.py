"""Pairs of lines across components: sizes and parities exclude most, but never a link."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("tile", [7, 1024])
def test_parities_exclude_pairs_but_no_link(spark, monkeypatch, tile):
    from tickloom.llm import line_dedup

    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = random.Random(5)
    draw = lambda n: rng.sample(range(-(1 << 31), 1 << 31), n)
    sets = {}
    for n in (5, 40, 300):
        base = draw(n)
        for i in range(10):
            new = n * i // 15
            sets[len(sets) - 15] = base[new:] + draw(new)
    share = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in combinations(sets.items(), 2)}
    known = spark.createDataFrame([(1, k, len(sets), k) for k in sets], "band long, k long, size long, c long")
    table = spark.createDataFrame(list(sets.items()), "k long, s array<int>")
    got = [tuple(r) for r in line_dedup._across(line_dedup._marked(known, table)).select("a", "b").collect()]
    links = {p for p, j in share.items() if j >= 0.8}
    assert links and links <= set(got) and len(got) == len(set(got))
    assert all(share[p] >= 0.6 for p in got)


def test_a_row_holds_eight_shingles(spark):
    from tickloom.llm import line_dedup

    texts = spark.createDataFrame([(1, "x" * 807), (2, "short"), (3, "0123456789abcdef")], "k long, line string")
    rows = line_dedup._shingles(texts.select("k", F.encode("line", "UTF-16BE").alias("u"))).groupBy("k").count()
    assert {r["k"]: r["count"] for r in rows.collect()} == {1: 100, 2: 1, 3: 2}
