"""Connected components by DataFrame operations: alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). A step replaces edges
by edges to the smallest neighbour, so the number of edges does not grow, and a hot vertex is an
aggregate and a join key, never a collected group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, saved


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """`v` and `component` (the smallest vertex that it is linked to) of every vertex of an edge.

    Loops and repeated edges have no effect, an edge with a null is left out; vertices without edges
    are not listed (a loop lists its vertex only if another edge does). Vertices may have any type that orders.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = saved(e.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour of x links to the smallest of x and its neighbours
        both = e.select("x", "y").union(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter(F.col("y") > F.col("x")).join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        # small star: x and its smaller neighbours link to the smallest of them
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").filter("x <> y").distinct()
        last, e = e, saved(small, "edges")
        forget(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("x").alias("v"), F.col("y").alias("component")).union(e.select("y", "y").distinct()).distinct()
