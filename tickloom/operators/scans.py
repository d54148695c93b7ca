"""Scans along long series, several tasks a series: values carried over time ranges, nearest rows, first-order recursions.

A series is cut into ranges of time by a range partition of (series, time), so that one that holds most rows is split like
any other. Each range does its own part; what it needs from the ranges before (or after) it is a row a range and series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import cut
from .ordering import dealt


def carried(df: DataFrame, by: list[str], order: list[str], behind: dict[str, str] | None = None, ahead: dict[str, str] | None = None) -> DataFrame:
    """Add columns {name: column}: the last value of `column` that is not null up to each row, and the first from it on.

    `order` orders the rows of each value of `by`, nulls first; rows that it doesn't tell apart may see each other's values.
    """
    behind, ahead = behind or {}, ahead or {}
    rows = dealt(df, by, [F.col(c) for c in order])
    place = F.struct(*order)
    known = lambda c: F.when(F.col(c).isNotNull(), place)
    ends = rows.groupBy("__part", *by).agg(
        *[F.max_by(c, known(c)).alias(f"__b_{n}") for n, c in behind.items()], *[F.min_by(c, known(c)).alias(f"__a_{n}") for n, c in ahead.items()]
    )
    # a row for each range and series
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(F.col("__part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        "__part", *by, *[F.last(f"__b_{n}", ignorenulls=True).over(before).alias(f"__b_{n}") for n in behind], *[F.last(f"__a_{n}", ignorenulls=True).over(after).alias(f"__a_{n}") for n in ahead]
    )
    upto = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    onward = Window.partitionBy("__part", *by).orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"__lb_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in behind.items()})
    local = local.withColumns({f"__la_{n}": F.last(c, ignorenulls=True).over(onward) for n, c in ahead.items()})
    same = F.col("l.__part") == F.col("r.__part")
    for c in by:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`"))
    both = local.alias("l").join(ends.alias("r"), same)
    return both.select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        *[F.coalesce(f"__lb_{n}", f"__b_{n}").alias(n) for n in behind], *[F.coalesce(f"__la_{n}", f"__a_{n}").alias(n) for n in ahead],
    )


def asof(left: DataFrame, right: DataFrame, by: str, at: str, take: list[str], direction: str = "nearest") -> DataFrame:
    """Rows of `left` with the columns `take` of the row of `right` that is nearest in `at`: of two as near, the later one.

    `direction` is backward (at or before), forward (at or after) or nearest. Both sides are one table in the order of
    (`by`, `at`), in which the rows of `right` are carried to those of `left`: no pair of rows is made, and no value of `by`, however
    frequent, is one task's. Rows of `left` without a match, or with a null `at`, get nulls; of equal rows of `right` the
    greatest in `take` counts going back, the smallest going ahead.
    """
    kept = [c for c in left.columns if c not in (by, at)]
    found = F.struct(F.col(at).alias("at"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(take)])
    r = right.filter(F.col(at).isNotNull()).select(F.col(by).alias("by"), F.col(at).alias("at"), F.lit(2 if direction == "forward" else 0).alias("side"), found.alias("r"))
    own = F.struct(F.lit(1).alias("_"), *kept)
    l = left.select(F.col(by).alias("by"), F.col(at).alias("at"), F.lit(1).alias("side"), own.alias("own"))  # noqa: E741
    both = r.unionByName(l, allowMissingColumns=True)
    x = carried(both, ["by"], ["at", "side", "r"], {"p": "r"} if direction != "forward" else None, {"n": "r"} if direction != "backward" else None).filter("side = 1")
    if direction == "nearest":
        near = F.when(F.col("n").isNull() | (F.col("at") - F.col("p.at") < F.col("n.at") - F.col("at")), F.col("p")).otherwise(F.col("n"))
    else:
        near = F.col("p" if direction == "backward" else "n")
    near = F.when(F.col("at").isNotNull(), near)
    x = x.withColumn("b", near)
    names = {"by": by, "at": at}
    return x.select(*[F.col(k).alias(v) for k, v in names.items()], *[F.col(f"own.`{c}`").alias(c) for c in kept], *[F.col(f"b._{i}").alias(c if c not in left.columns else f"right_{c}") for i, c in enumerate(take)])


# -- recursions: y = a y' + b ------------------------------------------------------------------------


def compose(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the map y -> A y + B that steps 0 .. i make together, by doubling; further axes are recursions side by side."""
    a, b = np.array(a, float), np.array(b, float)
    k = 1
    while k < len(a):
        b[k:] = a[k:] * b[:-k] + b[k:]
        a[k:] = a[k:] * a[:-k]
        k *= 2
    return a, b


def recursions(df: DataFrame, spec: dict[str, tuple[Column, Column, Column]], by: str, order: str) -> DataFrame:
    """Add columns {name: (a, b, start)}: y = a y' + b along `order`; y is null up to the first row with a `start`, where it is that.

    A step is an affine map of y', and maps compose, so that a range of rows is a map too: each range finds its own (and the
    value it ends with if the recursion starts in it), a fold over a series' ranges gives what every range begins with, and
    the ranges run on from there, all at once. Rows of one series are ordered by `order` (total); a null `a` or `b` leaves y
    as it was.
    """
    names = list(spec)
    cols = {f"__{k}_{n}": v.cast("double") for n in names for k, v in zip("abs", spec[n], strict=True)}
    rows = dealt(df.withColumns(cols), [by], [F.col(order)])
    kind, out_columns = df.schema[by].dataType.simpleString(), [*df.columns, *names]

    def steps(pdf: pd.DataFrame, n: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, s = (pdf[f"__{k}_{n}"].to_numpy(float) for k in "abs")
        none = np.isnan(a) | np.isnan(b)
        return np.where(none, 1.0, a), np.where(none, 0.0, b), s

    def started(a, b, s):
        """Values where the recursion starts in this range; NaN up to then."""
        y, first = np.full(len(a), np.nan), np.flatnonzero(~np.isnan(s))
        if len(first):
            i = first[0]
            ca, cb = compose(a[i + 1 :], b[i + 1 :])
            y[i], y[i + 1 :] = s[i], ca * s[i] + cb
        return y

    def maps(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = {"__part": [key[0]], by: [key[1]]}
        for n in names:
            a, b, s = steps(pdf, n)
            ca, cb = compose(a, b)
            out |= {f"__A_{n}": [ca[-1]], f"__B_{n}": [cb[-1]], f"__S_{n}": [started(a, b, s)[-1]]}
        return pd.DataFrame(out)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """What each range of a series begins with; NaN before the start."""
        pdf = pdf.sort_values("__part")
        out = {"__part": pdf["__part"], by: pdf[by]}
        for n in names:
            y, begin = np.nan, []
            for a, b, s in zip(pdf[f"__A_{n}"], pdf[f"__B_{n}"], pdf[f"__S_{n}"], strict=True):
                begin.append(y)
                y = s if np.isnan(y) else a * y + b
            out[f"__y_{n}"] = begin
        return pd.DataFrame(out)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(order)
        for n in names:
            y, (a, b, s) = right[f"__y_{n}"].iloc[0], steps(left, n)
            ca, cb = compose(a, b)
            left[n] = started(a, b, s) if np.isnan(y) else ca * y + cb
        return left[out_columns]

    used = ["__part", by, order, *cols]
    local = rows.select(*dict.fromkeys(used)).groupBy("__part", by).applyInPandas(maps, f"__part int, `{by}` {kind}, " + ", ".join(f"__{k}_{n} double" for n in names for k in "ABS"))
    begin = local.groupBy(by).applyInPandas(fold, f"__part int, `{by}` {kind}, " + ", ".join(f"__y_{n} double" for n in names))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` double" for n in names])
    return rows.groupBy("__part", by).cogroup(begin.groupBy("__part", by)).applyInPandas(run, schema)


def recursive_means(df: DataFrame, spec: dict[str, tuple[str, float]], by: str, order: str) -> DataFrame:
    """Add columns {name: (column, alpha)}: y = y' + alpha (x - y'), from the first value on; a null value leaves y as it was."""
    steps = {}
    for name, (column, alpha) in spec.items():
        x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
        steps[name] = (F.when(x.isNotNull(), F.lit(1 - alpha)), F.lit(alpha) * x, x)
    return recursions(df, steps, by, order)


# -- GARCH(1,1) -----------------------------------------------------------------------------------------

#: First centre and half width of the grid of (alpha, beta), points a side, rounds, and by how much each round is finer.
CENTRE, WIDTH, SIDE, ROUNDS, FINER = (0.1, 0.8), 0.2, 5, 4, 2.5


def grid_points(alpha: float, beta: float, width: float) -> list[tuple[float, float]]:
    side = lambda c: np.linspace(c - width, c + width, SIDE)
    return [(float(a), float(b)) for a in side(alpha) for b in side(beta) if a > 0.001 and b >= 0 and a + b < 0.999]


def garch(df: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """omega, alpha, beta of the variance h = omega + alpha x'**2 + beta h' and the forecast of the next deviation, by series.

    The Gaussian likelihood is compared on a grid of (alpha, beta) with the variance targeted, refined ROUNDS times around
    the best point. For one point h is a first-order recursion, so all points of a round go along together: a range of the
    series is an affine map of h for each point, a fold gives every range its first h, and the ranges sum their
    likelihoods. Series under 30 values or without variance have no row; nulls are left out.
    """
    x = df.filter(F.col(value).isNotNull()).select(by, order, F.col(value).cast("double").alias("__x"))
    whole = x.groupBy(by).agg(F.avg("__x").alias("__mean"), F.var_pop("__x").alias("__var"), F.count(F.lit(1)).alias("__n")).filter("__n >= 30 and __var > 0")
    whole = cut(whole, "garch")
    rows = dealt(x.join(whole.select(by), by, "left_semi"), [by], [F.col(order)])
    kind = df.schema[by].dataType.simpleString()
    now = whole.select(by, "__mean", "__var", F.lit(CENTRE[0]).alias("alpha"), F.lit(CENTRE[1]).alias("beta"))
    width = WIDTH

    def terms(pdf: pd.DataFrame, one: pd.Series, width: float):
        sq = (pdf.sort_values(order)["__x"].to_numpy() - one["__mean"]) ** 2
        points = np.array(grid_points(one["alpha"], one["beta"], width) if width else [(one["alpha"], one["beta"])])
        a, b = points[:, 0], points[:, 1]
        # h after each value, from the one it had at that value
        ca, cb = compose(np.broadcast_to(b, (len(sq), len(b))), one["__var"] * (1 - a - b) + sq[:, None] * a)
        return sq, points, ca, cb

    def joined(begin: DataFrame | None, fn, schema: str) -> DataFrame:
        right = now if begin is None else begin.join(now, by)
        right = rows.select("__part", by).distinct().join(right, [by] if begin is None else ["__part", by])
        right = right.withColumnsRenamed({"__part": "__p", by: "__k"}).select("*", F.lit(0))
        right = right.select([F.col(c).alias(c) for c in right.columns])
        return rows.groupBy("__part", by).cogroup(right.groupBy("__p", "__k")).applyInPandas(fn, schema)

    def maps(width):
        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            _, _, ca, cb = terms(left, right.iloc[0], width)
            return pd.DataFrame({"__part": [key[0]], by: [key[1]], "__A": [ca[-1]], "__B": [cb[-1]]})

        return joined(None, run, f"__part int, `{by}` {kind}, __A array<double>, __B array<double>").join(whole.select(by, "__var"), by)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        h, begin = np.full(len(pdf["__A"].iloc[0]), pdf["__var"].iloc[0]), []
        for a, b in zip(pdf["__A"], pdf["__B"], strict=True):
            begin.append(h)
            h = np.array(a) * h + np.array(b)
        return pd.DataFrame({"__part": pdf["__part"], by: pdf[by], "__h": begin, "__end": [h] * len(pdf)})

    folded = lambda width: maps(width).groupBy(by).applyInPandas(fold, f"__part int, `{by}` {kind}, __h array<double>, __end array<double>")

    def scores(width):
        def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            sq, points, ca, cb = terms(left, right.iloc[0], width)
            first = np.array(right["__h"].iloc[0])
            h = np.vstack([first[None, :], ca[:-1] * first + cb[:-1]])
            return pd.DataFrame({by: key[1], "alpha": points[:, 0], "beta": points[:, 1], "__s": (np.log(h) + sq[:, None] / h).sum(axis=0)})

        return joined(folded(width), run, f"`{by}` {kind}, alpha double, beta double, __s double")

    for _ in range(ROUNDS):
        sums = scores(width).groupBy(by, "alpha", "beta").agg(F.round(F.sum("__s"), 9).alias("__s"))
        best = sums.groupBy(by).agg(F.min_by(F.struct("alpha", "beta"), F.struct("__s", "alpha", "beta")).alias("p"))
        now = cut(best.join(whole, by).select(by, "__mean", "__var", "p.alpha", "p.beta"), "garch")
        width /= FINER
    last = folded(0.0).groupBy(by).agg(F.first(F.get("__end", F.lit(0))).alias("h"))
    return now.join(last, by).select(by, (F.col("__var") * (1 - F.col("alpha") - F.col("beta"))).alias("omega"), "alpha", "beta", F.sqrt("h").alias("forecast"))
