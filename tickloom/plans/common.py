"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT = 3.05e-8


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that engines that sum in another order agree; -0.0 becomes 0.0.

    Prices have few decimals, so that exact halves at the last digit are common; a small shift decides them alike.
    """
    return df.select([(F.round(F.col(c) + SHIFT, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def duck_rounded(body: str, columns: str, digits: int = 6) -> str:
    """SELECT of `columns` from `body` (a FROM clause); names after `~` are rounded like `rounded` does."""
    out = [f"round({c[1:]} + {SHIFT}, {digits}) + 0.0 AS {c[1:]}" if c.startswith("~") else c for c in columns.split()]
    return f"SELECT {', '.join(out)} FROM {body}"


def duck_normal(z: str) -> str:
    """The normal distribution function in DuckDB: its series of positive terms, z^(2n+1) / (1 * 3 * ... * (2n+1))."""
    terms = f"list_sum(list_transform(generate_series(0, 150), lambda n: exp((2 * n + 1) * ln(abs({z})) - lgamma(2 * n + 2) + n * ln(2) + lgamma(n + 1))))"
    return f"CASE WHEN {z} = 0 THEN 0.5 WHEN {z} > 8 THEN 1.0 WHEN {z} < -8 THEN 0.0 ELSE 0.5 + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {terms} END"
