"""Evolutionary search over stored populations: every step is a job over a table, and every draw is a hash.

A population has a `key`, genes and a `fitness`. Parents are drawn by rank, by fitness or in tournaments; children cross their
parents' genes and mutate; the fittest and the winners among the rest survive. A number in (0, 1) is the hash of what it is for
(generation, key, gene), so that a run repeats itself on any machine, whatever was lost and made again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import cut
from .ordering import numbered, running
from .scans import asof
from .selection import crowding, pareto_front
from .surrogate import normal_draw
from .surrogate import unit as open_unit

def select_fronts(pool: DataFrame, high: list[str], low: list[str], key: str, n: int) -> DataFrame:
    """NSGA-II's choice of `n` rows of a stored pool: front after front, and of the last one those with most room around them.

    Returns key, `front` (from 1) and `crowding` (null at the ends of a front, which come first). Every front is found over the
    whole pool that is left; the chosen rows are as few as asked for.
    """
    rest, out, count, front = cut(pool.select(key, *high, *low).na.drop(), "pool"), None, 0, 0
    while count < n and not rest.isEmpty():
        front += 1
        found = cut(crowding(pareto_front(rest, high, low, key), [*high, *low], key).withColumn("front", F.lit(front)), "front")
        if found.isEmpty():
            break
        taken = found if count + found.count() <= n else found.orderBy(F.col("crowding").isNotNull(), F.desc("crowding"), key).limit(n - count)
        taken = cut(taken.select(key, "front", "crowding"), "chosen")
        out, count = taken if out is None else out.unionByName(taken), count + taken.count()
        rest = cut(rest.join(found.select(key), key, "left_anti"), "pool")
    return out if out is not None else rest.select(key, F.lit(0).alias("front"), F.lit(None).cast("double").alias("crowding"))


def unit(*parts) -> Column:
    """A number in [0, 1) from the hash of the parts: the same on every run and machine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def next_generation(parents: DataFrame, key: str, genes: list[str], generation: int, scale: float = 0.1) -> DataFrame:
    """A child of each parent and the one before it in rank (`place`, from 1; before the first comes the last): a blend, then mutation.

    A gene lies between the parents' at a place of its own, and moves by up to `scale` of their distance either way.
    """
    n = parents.count()
    other = parents.select((F.col("place") % n + 1).alias("place"), *[F.col(g).alias(f"o_{g}") for g in genes])
    both = parents.join(other, "place")
    child = lambda g: F.col(g) + unit(F.lit(g), F.lit(str(generation)), F.col(key).cast("string")) * (F.col(f"o_{g}") - F.col(g)) + scale * (2 * unit(F.lit(f"m{g}"), F.lit(str(generation)), F.col(key).cast("string")) - 1) * F.abs(F.col(f"o_{g}") - F.col(g))
    return both.select(F.col(key).alias("parent"), "place", *[child(g).alias(g) for g in genes])


# -- a generation ----------------------------------------------------------------------------------------


def select_parents(population: DataFrame, n: int, rule: str = "tournament", generation: int = 0, size: int = 3) -> DataFrame:
    """`n` parents as rows (`slot`, from 1, and the chosen row's columns); a row may be chosen often.

    tournament  the fittest of `size` drawn rows (ties: the smaller key)
    rank        a row of rank r from the worst (1) is drawn with a chance in proportion to r
    roulette    in proportion to its fitness above the least, plus 1e-6

    Rows are found by their place or by their share of a running sum, over ranges: no task sees the whole population.
    """
    spark, total = population.sparkSession, population.count()
    if not total or n < 1:
        return population.limit(0).withColumn("slot", F.lit(1).cast("long"))
    draw = lambda *parts: open_unit(F.lit(f"{rule}|{generation}"), *[F.col(p).cast("string") for p in parts])
    slots = spark.range(1, n + 1).withColumnRenamed("id", "slot")
    order = [F.col("fitness"), F.col("key").desc()]
    if rule == "roulette":
        least = population.agg(F.min("fitness")).first()[0]
        sums = cut(running(population, order, sums={"__to": F.col("fitness") - least + 1e-6}), "roulette")
        whole = sums.agg(F.max("__to")).first()[0]
        marks = slots.select("slot", F.lit(0).alias("one"), (draw("slot") * whole).alias("at"))
        rows = sums.select(F.lit(0).alias("one"), F.col("__to").alias("at"), "key")
        found = asof(marks, rows, "one", "at", ["key"], "forward").select("slot", "key")
        return found.join(population, "key")
    placed = cut(numbered(population, order, "__place"), "places")
    if rule == "rank":
        x = draw("slot") * (total * (total + 1) / 2)
        place = F.least(F.greatest(F.ceil((F.sqrt(1 + 8 * x) - 1) / 2), F.lit(1)), F.lit(total)).cast("long")
        return slots.select("slot", place.alias("__place")).join(placed, "__place").drop("__place")
    if rule != "tournament":
        raise ValueError(f"unknown rule {rule}")
    # places are ranks, so the fittest of the drawn has the greatest
    drawn = slots.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(size)))).withColumn("__place", (F.floor(draw("slot", "i") * total) + 1).cast("long"))
    return drawn.groupBy("slot").agg(F.max("__place").alias("__place")).join(placed, "__place").drop("__place")


def crossed(parents: DataFrame, genes: list[str], rule: str = "blend", generation: int = 0, chance: float = 0.9, alpha: float = 0.5, eta: float = 15.0) -> DataFrame:
    """Two children of every two neighbouring slots (`slot`, genes); a last slot without a neighbour is copied.

    blend    anywhere between the parents' genes, or up to `alpha` of their distance beyond
    uniform  each gene from one parent, its twin's from the other
    sbx      simulated binary crossover with index `eta`, of each gene with a chance of a half
    """
    draw = lambda *what: open_unit(F.lit(f"{rule}|{generation}"), *[F.lit(w) for w in what], F.col("pair").cast("string"))
    side = lambda even: parents.filter(F.col("slot") % 2 == even).select(F.floor((F.col("slot") - 1) / 2).alias("pair"), F.col("slot").alias(f"slot{even}"), *[F.col(g).cast("double").alias(f"{g}{even}") for g in genes])
    both = side(1).join(side(0), "pair", "left")
    one, two = {}, {}
    mates = F.col("slot0").isNotNull() & (draw("mate") < chance)
    for g in genes:
        a, b = F.col(f"{g}1"), F.col(f"{g}0")
        low, high, apart = F.least(a, b), F.greatest(a, b), F.abs(a - b)
        if rule == "blend":
            place = lambda w, g=g, low=low, apart=apart: low - alpha * apart + draw(w, g) * (1 + 2 * alpha) * apart
            x, y = place("first"), place("second")
        elif rule == "uniform":
            first = draw("side", g) < 0.5
            x, y = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
        elif rule == "sbx":
            u = draw("spread", g)
            beta = F.when(u <= 0.5, F.pow(2 * u, F.lit(1 / (eta + 1)))).otherwise(F.pow(1 / (2 * (1 - u)), F.lit(1 / (eta + 1))))
            on = draw("gene", g) < 0.5
            x = F.when(on, 0.5 * ((1 + beta) * low + (1 - beta) * high)).otherwise(a)
            y = F.when(on, 0.5 * ((1 - beta) * low + (1 + beta) * high)).otherwise(b)
        else:
            raise ValueError(f"unknown rule {rule}")
        one[g], two[g] = F.when(mates, x).otherwise(a).alias(g), F.when(mates, y).otherwise(b).alias(g)
    twins = F.array(F.struct(F.col("slot1").alias("slot"), *one.values()), F.struct(F.col("slot0").alias("slot"), *two.values()))
    return both.select(F.explode(twins).alias("c")).select("c.*").filter("slot is not null")


def mutated(rows: DataFrame, genes: list[str], rule: str = "gaussian", generation: int = 0, chance: float = 0.2, scale: float = 0.1, eta: float = 20.0, step: float = 0.1, by: str = "slot") -> DataFrame:
    """Genes moved with a chance each: by a normal number of deviation `scale`, which shrinks over 200 generations to a tenth, or
    by a polynomial step of index `eta` within `step`."""
    draw = lambda *what: open_unit(F.lit(f"{rule}|{generation}"), *[F.lit(w) for w in what], F.col(by).cast("string"))
    out = {}
    for g in genes:
        if rule == "gaussian":
            move = scale * max(0.1, 1 - generation / 200) * normal_draw(F.lit(f"{rule}|{generation}|{g}"), F.col(by).cast("string"))
        elif rule == "polynomial":
            u = draw("move", g)
            move = step * F.when(u < 0.5, F.pow(2 * u, F.lit(1 / (eta + 1))) - 1).otherwise(1 - F.pow(2 * (1 - u), F.lit(1 / (eta + 1))))
        else:
            raise ValueError(f"unknown rule {rule}")
        out[g] = F.col(g) + F.when(draw("gene", g) < chance, move).otherwise(0.0)
    return rows.withColumns(out)


def survivors(population: DataFrame, size: int, elite: float = 0.1, generation: int = 0, rounds: int = 3) -> DataFrame:
    """At most `size` rows: the fittest share `elite` (one at least), and the winners of tournaments of `rounds` among the others.

    A row may win several tournaments, but survives once; ties go to the smaller key.
    """
    total = population.count()
    if total <= size:
        return population
    best = max(1, int(size * elite))
    ranked = cut(numbered(population, [F.desc("fitness"), F.col("key")], "__rank"), "ranked")
    elites, rest = ranked.filter(F.col("__rank") <= best).drop("__rank"), ranked.filter(F.col("__rank") > best).drop("__rank")
    winners = select_parents(rest, size - best, "tournament", generation, rounds).select("key").distinct()
    return elites.unionByName(rest.join(winners, "key", "left_semi"))


def spread(population: DataFrame, genes: list[str]) -> DataFrame:
    """Diversity: the root of the mean squared distance of two rows, from sums alone; 0 for fewer than two rows."""
    total = sum((F.coalesce(F.var_samp(g), F.lit(0.0)) for g in genes), F.lit(0.0))
    return population.agg(F.count(F.lit(1)).alias("n"), F.max("fitness").alias("best"), F.avg("fitness").alias("mean"), F.sqrt(2 * total).alias("diversity"))


def farthest_points(rows: DataFrame, genes: list[str], n: int, shards: int = 64) -> DataFrame:
    """`n` rows that cover all: first the fittest (ties: the smaller key), then again and again the row farthest from those chosen.

    Rows are dealt to `shards` by a hash of their key; each chooses `n` of its own, and the chosen are dealt again to an eighth
    as many, until one is left: what a task holds is its shard, or at most 8 n rows. What is chosen of chosen rows covers
    all rows within a constant of the best cover (a composable core-set), and never depends on how rows were partitioned.
    """
    cols, schema = ["key", "fitness", *genes], rows.select("key", "fitness", *[F.col(g).cast("double").alias(g) for g in genes]).schema

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[cols].sort_values(["fitness", "key"], ascending=[False, True]).reset_index(drop=True)
        x = pdf[genes].to_numpy(float)
        far, chosen = np.full(len(x), np.inf), [0]
        while len(chosen) < min(n, len(x)):
            far = np.minimum(far, np.round(((x - x[chosen[-1]]) ** 2).sum(axis=1), 12))
            far[chosen] = -1.0
            chosen.append(int(far.argmax()))
        return pdf.iloc[chosen]

    out = rows.select(*[F.col(c).cast(schema[c].dataType) for c in cols]).na.drop()
    while True:
        out = out.groupBy(F.pmod(F.crc32(F.col("key").cast("string").cast("binary")), F.lit(shards)).alias("__shard")).applyInPandas(lambda pdf: choose(pdf), schema)
        if shards == 1:
            return out
        shards = max(1, shards // 8)


def evolve(population: DataFrame, genes: list[str], evaluate: Callable[[DataFrame], DataFrame], generations: int, size: int, select: str = "tournament", cross: str = "blend", mutate: str = "gaussian", archive: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survivors, archive, history) after some generations; `evaluate` adds `fitness` to rows of genes.

    Every generation is a stored table. The archive keeps up to `archive` rows that cover the fittest half of all that lived.
    """
    now, kept, history = cut(population.select("key", "fitness", *[F.col(g).cast("double").alias(g) for g in genes]), "population"), None, None
    key = now.schema["key"].dataType
    for k in range(generations):
        parents = select_parents(now, size, select, k)
        children = mutated(crossed(parents, genes, cross, k), genes, mutate, k)
        named = children.withColumn("key", (-(F.lit(k).cast("long") * 1_000_000_000 + F.col("slot")) - 1).cast(key))
        born = cut(evaluate(named.drop("slot")).select(*now.columns).filter("fitness is not null"), "children")
        pool = now.unionByName(born)
        now = cut(survivors(pool, size, generation=k), "population")
        middle = pool.agg(F.percentile("fitness", 0.5)).first()[0]
        fit = pool.filter(F.col("fitness") >= (middle if middle is not None else 0.0))
        kept = cut(farthest_points(fit if kept is None else kept.unionByName(fit).dropDuplicates(["key"]), genes, archive), "archive")
        row = spread(now, genes).withColumn("generation", F.lit(k))
        history = row if history is None else history.unionByName(row)
    return now, kept, history
