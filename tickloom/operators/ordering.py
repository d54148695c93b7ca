"""Ranks, running sums and neighbours over a whole table: range partitions and offsets instead of a window in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut


def dealt(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Stored in ranges of (`by`, `order`), with the number of each row's range."""
    return cut(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()), "ordered")


def running(df: DataFrame, order: list, sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """Running sums and maxima, each row included, in `order` (total), for each value of the columns `by`.

    Every range is summed in its own task; what the ranges before it hold, a row for each range and group, is added.
    Nulls add nothing.
    """
    by, sums, most = by or [], sums or {}, most or {}
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = dealt(df.withColumns({f"__v_{n}": c for n, c in {**sums, **most}.items()}), by, order)
    totals = rows.groupBy("__part", *by).agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums], *[F.max(f"__v_{n}").alias(f"__t_{n}") for n in most])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = totals.select("__part", *by, *[F.sum(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in sums], *[F.max(f"__t_{n}").over(earlier).alias(f"__b_{n}") for n in most])
    here = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({**{f"__s_{n}": F.sum(f"__v_{n}").over(here) for n in sums}, **{f"__s_{n}": F.max(f"__v_{n}").over(here) for n in most}})
    both = local.alias("l").join(before.alias("r"), (F.col("l.__part") == F.col("r.__part")) & _same(by), "left")
    out = [F.col(f"l.`{c}`") for c in df.columns]
    out += [(F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.coalesce(F.col(f"__b_{n}"), F.lit(0))).alias(n) for n in sums]
    out += [F.greatest(F.col(f"__s_{n}"), F.col(f"__b_{n}")).alias(n) for n in most]
    return both.select(*out)


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    return out


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The place of every row, from 1, in `order`, which must be total."""
    return running(df, order, sums={name: F.lit(1).cast("long")})


def neighbours(df: DataFrame, value: str, key: str) -> DataFrame:
    """`key` with the values before and after its own in the order of (`value`, `key`): `before`, `after`, null at the ends."""
    at = numbered(df.select(key, F.col(value).alias("__value")), ["__value", key], "__n")
    shown = F.explode(F.array(F.struct(F.col("__n").alias("n"), F.lit(0).alias("d")), F.struct((F.col("__n") + 1).alias("n"), F.lit(-1).alias("d")), F.struct((F.col("__n") - 1).alias("n"), F.lit(1).alias("d"))))
    seen = at.select(key, "__value", shown.alias("p")).groupBy("p.n").agg(
        F.max(F.when(F.col("p.d") == 0, F.col(key))).alias(key), F.max(F.when(F.col("p.d") == -1, F.col("__value"))).alias("before"), F.max(F.when(F.col("p.d") == 1, F.col("__value"))).alias("after"),
    )
    return seen.filter(F.col(key).isNotNull()).select(key, "before", "after")
